"""The letters of a split row, read from whichever of its two fields holds the sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The nucleotide letters with the ambiguity codes of the public IUPAC alphabet.
IUPAC = "ACGTURYSWKMBDHVN"

#: A field with other letters counts as a sequence only if it has this many letters; label words are shorter.
LEAST_OTHER = 12


def only_letters(field: Column) -> Column:
    """The letters A to Z of a field in upper case; empty for null."""
    return F.coalesce(F.regexp_replace(F.upper(field), "[^A-Z]+", ""), F.lit(""))


def with_letters(df: DataFrame, keep: list[str], sequence: str = "sequence", label: str = "label", out: str = "letters") -> DataFrame:
    """The columns ``keep`` and the letters of each row.

    The sequence is the field that has nucleotide letters only; of two such fields, the longer; of none, the
    ``sequence`` field if it has at least LEAST_OTHER letters. Rows without such a field have no letters ("").
    """
    pure = f"^[{IUPAC}]+$"
    two = df.select(*[df[c] for c in keep], only_letters(df[sequence]).alias("__a"), only_letters(df[label]).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    chosen = (
        F.when(a.rlike(pure) & (~b.rlike(pure) | (F.length(a) >= F.length(b))), a)
        .when(b.rlike(pure), b)
        .when(F.length(a) >= LEAST_OTHER, a)
        .otherwise(F.lit(""))
    )
    # An exploded array of one keeps filters on the letters above it, so the letters are made once, not again for each.
    return two.select(*keep, F.explode(F.array(chosen)).alias(out))
