"""Reading labelled sequences from files, as DataFrames with ``sequence`` and ``labels``.

Formats go by extension: csv, tsv, json (lines), parquet, arrow, orc, txt, fasta (fa, fna, fas), and bed and gff for
intervals. Nothing is inferred from data beyond the first line of a text file, which decides whether it has a header.
Pickles are not read: they can run code.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA = (".fa", ".fna", ".fas", ".fasta")
# Names that stand for the two columns, the first that a file has counts.
SEQUENCE_NAMES = ("s", "seq", "sequence", "sequences")
LABEL_NAMES = ("l", "label", "labels", "target", "targets")


def standard_columns(df: DataFrame) -> DataFrame:
    """Rename the first column named like a sequence or a label, in any case, unless the standard name is taken."""
    for names, standard in ((SEQUENCE_NAMES, "sequence"), (LABEL_NAMES, "labels")):
        by_lower = {c.lower(): c for c in reversed(df.columns)}
        found = next((by_lower[n] for n in names if n in by_lower), None)
        if found and found != standard and standard not in df.columns:
            df = df.withColumnRenamed(found, standard)
    return df


def rename(df: DataFrame, seq_col: str, label_col: str) -> DataFrame:
    for have, want in ((seq_col, "sequence"), (label_col, "labels")):
        if have != want and have in df.columns and want not in df.columns:
            df = df.withColumnRenamed(have, want)
    return df


def label_values(label: Column, sep: str) -> Column:
    """The numbers of a separated label; what is no number is null."""
    return F.transform(F.split(label, f"\\Q{sep}\\E"), lambda x: F.trim(x).try_cast("double"))


def label_number(label: Column) -> Column:
    return F.trim(label).try_cast("double")


def _extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row["value"] if row else ""


def header_names(first_line: Column, seq_col: str = "sequence", label_col: str = "labels") -> tuple[Column, Column]:
    """Whether a file's first line names the sequence and the label: a text file with both is a table, and a table with
    neither is a text file."""
    return F.contains(first_line, F.lit(seq_col)).alias("named_sequence"), F.contains(first_line, F.lit(label_col)).alias("named_label")


def typed_labels(df: DataFrame, kind: str, label: str = "labels", sep: str = ";") -> DataFrame:
    """Labels as their kind asks: whole numbers where all are (classification, else as they are), numbers (regression), or
    arrays of numbers from separated text (multi_label, multi_regression). What is no number is null. Labels that aren't
    text are only cast."""
    if label not in df.columns or kind == "unknown":
        return df
    text = df.schema[label].dataType.simpleString() == "string"
    if kind in ("multi_label", "multi_regression"):
        values = label_values(F.col(label), sep) if text else F.col(label).cast("array<double>")
        return df.withColumn(label, F.transform(values, lambda x: x.cast("int")) if kind == "multi_label" else values)
    number = label_number(F.col(label)) if text else F.col(label).cast("double")
    if kind == "regression":
        return df.withColumn(label, number)
    if kind != "classification":
        raise ValueError(f"unknown kind {kind}")
    if not text:
        return df
    other = df.where(F.col(label).isNotNull() & (number.isNull() | (number != F.floor(number)))).limit(1).count()
    return df if other else df.withColumn(label, number.cast("int"))


def read_one(spark: SparkSession, path: str | list[str], seq_col: str = "sequence", label_col: str = "labels", sep: str | None = None, fasta_sep: str = "|") -> DataFrame:
    """One file, or several of the first one's format."""
    paths = [os.path.expanduser(p) for p in ([path] if isinstance(path, str) else path)]
    if not paths:
        raise ValueError("no file given")
    kind = _extension(paths[0])
    sep = "," if kind == ".csv" else "\t" if kind == ".tsv" else sep
    if kind in (".csv", ".tsv", ".txt") and len(paths) == 1:
        first = _first_line(spark, paths[0])
        named = spark.range(1).select(*header_names(F.lit(first), seq_col, label_col)).first()
        if kind == ".txt":
            kind = ".csv" if all(named) else ".txt"
        elif not any(named):
            kind = ".txt"
    if kind in (".csv", ".tsv"):
        df = spark.read.csv(paths, header=True, sep=sep or ",", inferSchema=False)
    elif kind in (".json", ".jsonl"):
        df = spark.read.json(paths)
    elif kind == ".parquet":
        df = spark.read.parquet(*paths)
    elif kind == ".orc":
        df = spark.read.orc(paths)
    elif kind in (".arrow", ".feather"):
        df = read_arrow(spark, paths)
    elif kind in FASTA:
        return read_fasta(spark, paths, fasta_sep)
    elif kind == ".txt":
        return read_txt(spark, paths, sep)
    else:
        raise ValueError(f"no reader for files of type {kind or 'none'}")
    return rename(df, seq_col, label_col)


def read(spark: SparkSession, paths: str | list[str] | Mapping[str, str | list[str]], **options: str) -> DataFrame:
    """Files as one table; a mapping gives each its name in a column ``split``."""
    if not isinstance(paths, Mapping):
        return read_one(spark, paths, **options)
    out = None
    for name, p in paths.items():
        part = read_one(spark, p, **options).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file given")
    return out


def read_fasta(spark: SparkSession, paths: list[str], sep: str = "|") -> DataFrame:
    """(sequence, labels): wrapped lines are joined; the label is the last field of the header, or all of it. Records
    without letters are dropped. A file is cut at its headers, so it is read in parts; it has to begin with one."""
    raw = spark.read.option("lineSep", "\n>").text(paths)
    record = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", ""), "\n", 2)
    rows = raw.select(F.trim(record[0]).alias("h"), F.regexp_replace(F.coalesce(F.get(record, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))
    label = F.element_at(F.split("h", f"\\Q{sep}\\E"), -1)
    return rows.where("sequence <> ''").select("sequence", label.alias("labels"))


def read_txt(spark: SparkSession, paths: list[str], sep: str | None = None) -> DataFrame:
    """(sequence, labels): the first two fields of each line, by ``sep`` or white space; lines with fewer are dropped."""
    f = F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), f"\\Q{sep}\\E" if sep else r"\s+")
    return spark.read.text(paths).select(f.alias("f")).where(F.size("f") >= 2).select(F.col("f")[0].alias("sequence"), F.col("f")[1].alias("labels"))


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files, each read by one task."""
    import pyarrow as pa

    def open_ipc(p: str) -> pa.Table:
        with pa.memory_map(p) as source:
            try:
                return pa.ipc.open_file(source).read_all()
            except pa.ArrowInvalid:
                return pa.ipc.open_stream(source).read_all()

    empty = spark.createDataFrame(open_ipc(paths[0]).slice(0, 0))

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                yield from open_ipc(p).to_batches()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, empty.schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sequence): the lines of a file that aren't blank."""
    return spark.read.text(os.path.expanduser(path)).select(F.trim("value").alias("sequence")).where("sequence <> ''")


BED_SCHEMA = "chrom string, start_pos bigint, end_pos bigint"


def read_bed(spark: SparkSession, path: str, more: str = "", renamed: Mapping[str, str] | None = None) -> DataFrame:
    """(chrom, start_pos, end_pos, ...): a headerless tab-separated file; ``more`` names further columns. ``renamed``
    maps chromosome names to those of another file."""
    df = spark.read.csv(path, sep="\t", schema=BED_SCHEMA + (f", {more}" if more else ""), comment="#")
    if renamed:
        table = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
        df = df.withColumn("chrom", F.coalesce(F.element_at(table, F.col("chrom")), F.col("chrom")))
    return df


def gff_line(line: Column) -> Column:
    """Struct (chrom, feature, start_pos, end_pos, strand, name, parent) of a GFF3 line; places count from 0."""
    f = F.split(line, "\t")
    attribute = lambda n: F.nullif(F.regexp_extract(F.get(f, F.lit(8)), f"(?:^|;){n}=([^;,]*)", 1), F.lit(""))
    return F.struct(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(2)).alias("feature"), (F.get(f, F.lit(3)).try_cast("bigint") - 1).alias("start_pos"), F.get(f, F.lit(4)).try_cast("bigint").alias("end_pos"),
        F.get(f, F.lit(6)).alias("strand"), attribute("Name").alias("name"), attribute("Parent").alias("parent"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    return rows.where(F.size(F.split("value", "\t")) == 9).select(gff_line(F.col("value")).alias("g")).select("g.*")


def from_memory(spark: SparkSession, sequences: str | list[str]) -> DataFrame:
    """(row_id, sequence) of one sequence, several, or the file a string names."""
    if isinstance(sequences, str):
        if os.path.exists(os.path.expanduser(sequences)):
            return read_one(spark, sequences)
        sequences = [sequences]
    if not isinstance(sequences, list) or not all(isinstance(s, str) for s in sequences):
        raise ValueError("sequences must be a string, a list of strings or a file")
    return spark.createDataFrame(list(enumerate(sequences)), "row_id bigint, sequence string")
