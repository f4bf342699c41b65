"""Counts, letters and order-free checksums of all substitutions of each sequence, without making the mutants.

The digests take nearly all of the time and SQL has no step of a digest, so a Java function goes on with many side by side.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonlake.session import java_function, spread

#: Digests that go on side by side, and letters whose mutants are kept at a time.
LANES, LETTERS = 1 << 10, 1 << 18

_SUMS = ("n", "letters", "mutants", "names")


def substitution_sums(df: DataFrame, id_col: str, seq: str, alphabet: str = "ACGT") -> DataFrame:
    """(id, n, letters, mutants, names) of what ``mutagenesis.substitutions`` gives: how many, their letters, and the sums
    of the first 32 bits of the MD5 digests of the mutants and of their names."""
    name = java_function(df.sparkSession, Path(__file__).with_name("MutantSums.java"), T.ArrayType(T.LongType()))
    sums = F.call_udf(name, F.col(seq), F.lit(alphabet), F.lit(LANES), F.lit(LETTERS))
    rows = spread(df.where(F.length(seq) > 0).select(id_col, seq)).select(id_col, sums.alias("sums"))
    return rows.groupBy(id_col).agg(*[F.sum(F.col("sums")[k]).alias(c) for k, c in enumerate(_SUMS)])
