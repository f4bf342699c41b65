"""Pooling of token vectors: one vector for each sequence from those of its tokens.

Rows are tokens: a key, a place, a vector and, where there is one, a mask that is 1 for tokens that count. Sums, extremes
and chosen rows are combined before they are shuffled, so a sequence of any length is fine. A null vector doesn't count.
A sequence none of whose tokens count has no vector, except for the first token (``cls``), which is taken whatever its mask.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("mean", "max", "first", "last", "cls")


def pool(df: DataFrame, by: list[str], place: str, vector: str, how: str = "mean", mask: str | None = None) -> DataFrame:
    """(by..., pooled): ``mean`` and ``max`` by component, or the vector of the ``first`` or ``last`` token that counts, or
    of the very first (``cls``)."""
    if how not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    rows = df.where(F.col(vector).isNotNull())
    if mask is not None and how != "cls":
        rows = rows.where(F.col(mask) == 1)
    v = F.col(vector).cast("array<double>")
    if how in ("first", "last", "cls"):
        return rows.groupBy(*by).agg((F.max_by if how == "last" else F.min_by)(v, place).alias("pooled"))
    parts = rows.select(*by, F.posexplode(v).alias("__i", "__x"))
    each = parts.groupBy(*by, "__i").agg((F.avg if how == "mean" else F.max)("__x").alias("__x"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__v")).select(*by, F.col("__v.__x").alias("pooled"))
