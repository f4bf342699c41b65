"""Augmentation of labelled sequences. Each source row is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.functions.sequence import reverse_complement
from codonlake.operators.sampling import places


def with_reverse_complement(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Every row and a copy with the reverse complement; ``is_rc`` tells them apart."""
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    return df.select("*", both.alias("is_rc")).withColumn(seq, F.when(F.col("is_rc"), reverse_complement(F.col(seq))).otherwise(F.col(seq)))


def concat_reverse_complement(df: DataFrame, seq: str = "sequence", sep: str = "") -> DataFrame:
    return df.withColumn(seq, F.concat(F.col(seq), F.lit(sep), reverse_complement(F.col(seq))))


def reverse_complement_some(df: DataFrame, id_col: str, ratio: float, by: list[str], seq: str = "sequence", seed: int = 0) -> DataFrame:
    """The reverse complement on exactly int(rows * ratio) rows of each group."""
    p = places(df, id_col, by, seed)
    chosen = F.col("place") < F.floor(F.col("size") * ratio)
    return p.withColumn(seq, F.when(chosen, reverse_complement(F.col(seq))).otherwise(F.col(seq))).drop("place", "size")


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return df.unionByName(more, allowMissingColumns=True)
