"""Writing results. All sinks are distributed writes; files are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, id_col: str = "row_id") -> None:
    """JSON lines, one object a row, keyed by the identifier."""
    df.select(id_col, *[c for c in df.columns if c != id_col]).write.mode("overwrite").json(path)


def write_metrics(long: DataFrame, path: str) -> None:
    """JSON lines of (keys..., metric, value); curves and other nested columns aren't written."""
    flat = [f.name for f in long.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    long.select(*flat).write.mode("overwrite").json(path)


def write_bed(df: DataFrame, path: str) -> None:
    """Tab-separated chrom, start and end, then the other columns, without a header."""
    first = ["chrom", "start_pos", "end_pos"]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_fasta(df: DataFrame, path: str, name: str, seq: str = "sequence") -> None:
    record = F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq))
    df.where(F.col(seq).isNotNull()).select(record.alias("value")).write.mode("overwrite").text(path)


def write_token_lists(lists: DataFrame, path: str) -> None:
    """Parquet of the lists, and their sizes beside it."""
    lists.write.mode("overwrite").parquet(f"{path}/lists")
    lists.select(*[c for c in lists.columns if c != "tags"]).write.mode("overwrite").parquet(f"{path}/sizes")
