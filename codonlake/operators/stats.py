"""Descriptive statistics of labelled sequences: one aggregation each, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.functions import sequence as sq
from codonlake.session import spread


def drop_missing(df: DataFrame, seq: str = "sequence", label: str = "label") -> DataFrame:
    """Rows whose sequence isn't null or white space only and whose label isn't null."""
    return df.where(F.regexp_replace(seq, r"\s", "") != "").where(F.col(label).isNotNull())


def length_stats(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Rows, and least, largest, mean and median length, by group; a null sequence has length 0."""
    n = F.length(F.coalesce(seq, F.lit("")))
    return df.select(*by, n.alias("__n")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("__n").alias("min_len"), F.max("__n").alias("max_len"),
        F.round(F.avg("__n"), 6).alias("mean_len"), F.percentile("__n", 0.5).alias("median_len"),
    )


def length_histogram(df: DataFrame, by: str, seq: str, width: int) -> DataFrame:
    """Rows by group and bin of ``width`` letters."""
    bin_ = F.floor(F.length(F.coalesce(seq, F.lit(""))) / width).cast("bigint").alias("bin")
    return df.groupBy(by, bin_).agg(F.count(F.lit(1)).alias("n"))


def length_histogram_bins(df: DataFrame, by: str, seq: str, bins: int) -> DataFrame:
    """Rows by group and bin, ``bins`` equal bins from the least to the largest length."""
    sized = df.select(by, F.length(F.coalesce(seq, F.lit(""))).alias("__n"))
    counts = sized.groupBy(by, "__n").agg(F.count(F.lit(1)).alias("__c"))
    ends = sized.agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("__n") - F.col("__lo")) * float(bins) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)))).cast("bigint")
    return counts.crossJoin(F.broadcast(ends)).groupBy(by, bin_.alias("bin")).agg(F.sum("__c").alias("n"))


def gc_boxplot(df: DataFrame, by: str, seq: str) -> DataFrame:
    """Five-number summary of GC content by group."""
    five = F.percentile("__gc", [0.0, 0.25, 0.5, 0.75, 1.0])
    got = df.select(by, sq.gc_content(F.col(seq)).alias("__gc")).groupBy(by).agg(five.alias("p"))
    return got.select(by, *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def label_distribution(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows and share of each label by group."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 9))


def base_composition(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    counts = df.select(*by, *sq.base_counts(F.col(seq)))
    return counts.groupBy(*by).agg(*[F.sum(f"n_{b}").alias(f"n_{b}") for b in (*"acgtn", "other")])


def kmer_counts(df: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """Uses of each k-mer and rows that have it: counted by row before the shuffle, so no distinct is needed."""
    each = spread(df.select(id_col, seq)).select(id_col, F.explode(sq.kmers(F.col(seq), k)).alias("kmer"))
    by_row = each.groupBy(id_col, "kmer").agg(F.count(F.lit(1)).alias("__n"))
    return by_row.groupBy("kmer").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_rows"))


def kmer_topk(df: DataFrame, by: str, seq: str, k: int, top: int) -> DataFrame:
    """The ``top`` most frequent k-mers of each group; ties in k-mer order."""
    counts = spread(df.select(by, seq)).select(by, F.explode(sq.kmers(F.col(seq), k)).alias("kmer")).groupBy(by, "kmer").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "kmer"))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
