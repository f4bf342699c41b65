"""Shuffling, exact sampling, splitting and folding by a fixed arithmetic hash.

The order is that of ``hash31(id, seed)``, ties by id: the same on every cluster and in every SQL dialect. Places in that
order are exact and distributed: rows are counted by group and hash range, and only the rows of one range are ordered
together, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
#: One above the largest hash.
MODULUS = 1 << 31


def hash31(id_: Column, seed: int = 0) -> Column:
    """A hash below 2^31 by a linear congruence. The identifier is reduced first, so one of any size or sign is fine."""
    return F.pmod((F.pmod(id_.cast("bigint"), F.lit(MODULUS)) + seed % MODULUS) * 1103515245 + 12345, F.lit(MODULUS))


def places(df: DataFrame, id_col: str, by: list[str], seed: int = 0) -> DataFrame:
    """Add ``place`` (from 0, in hash order within the group) and ``size`` (rows of the group)."""
    h = df.withColumn("__h", hash31(F.col(id_col), seed)).withColumn("__range", F.floor(F.col("__h") / (MODULUS // RANGES)).cast("int"))
    counts = h.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("size"))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__h", id_col)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by] + [F.col("__range") == F.col("__r")]
    joined = h.withColumn("__own", own).join(counts, same)
    return joined.withColumn("place", F.col("__before") + F.col("__own")).drop("__h", "__range", "__r", "__own", "__before", *[f"__k_{c}" for c in by])


def shuffle(df: DataFrame, id_col: str, by: list[str], seed: int = 0) -> DataFrame:
    """Rows with their place in the shuffled order."""
    return places(df, id_col, by, seed).drop("size")


def sample(df: DataFrame, id_col: str, ratio: float, by: list[str], seed: int = 0) -> DataFrame:
    """Exactly int(rows * ratio) rows of each group."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be above 0 and at most 1")
    return places(df, id_col, by, seed).where(F.col("place") < F.floor(F.col("size") * ratio)).drop("place", "size")


def split(df: DataFrame, id_col: str, test: float = 0.2, val: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``part``: ceil(rows * (test + val)) rows are held out, of which ceil(held out * val / (test + val)) are
    ``val`` and the others ``test``; the rest is ``train``."""
    if test < 0 or val < 0 or not 0 < test + val < 1:
        raise ValueError("test and val must be shares that leave rows to train on")
    held = F.ceil(F.round(F.col("size") * (test + val), 9))
    n_val = F.ceil(F.round(held * (val / (test + val)), 9)) if val else F.lit(0)
    part = F.when(F.col("place") >= held, "train").when(F.col("place") < n_val, "val").otherwise("test")
    return places(df, id_col, [], seed).withColumn("part", part).drop("place", "size")


def folds(df: DataFrame, id_col: str, k: int, by: list[str], seed: int = 42) -> DataFrame:
    """Add ``fold``: 0 to k - 1, in equal parts of each group (a label, for stratified folds)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return places(df, id_col, by, seed).withColumn("fold", (F.col("place") % k).cast("int")).drop("place", "size")


def head(df: DataFrame, id_col: str, n: int, by: list[str]) -> DataFrame:
    """The ``n`` rows of least id in each group. The window stops at n rows a group before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(id_col))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def batch_ids(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """Add ``batch`` from consecutive ids."""
    return df.withColumn("batch", F.floor(F.col(id_col) / size).cast("bigint"))


def bases(df: DataFrame, id_col: str, length: Column, n_share: float = 0.0, seed: int = 0, out: str = "sequence") -> DataFrame:
    """Add a generated sequence: each base from a hash of the row, its place and the seed."""
    def base(i: Column) -> Column:
        h = hash31(hash31(F.pmod(F.col(id_col).cast("bigint"), F.lit(MODULUS)) * 7919 + i, seed) + i, seed)
        return F.when(h % 10_000 < int(n_share * 10_000), "N").otherwise(F.substring(F.lit("ACGT"), (F.floor(h / 65536) % 4).cast("int") + 1, F.lit(1)))

    made = F.array_join(F.transform(F.sequence(F.lit(1), length), base), "")
    return df.withColumn(out, F.when(length > 0, made).otherwise(""))


def generate(spark, n: int, least: int, most: int, gc: tuple[float, float] = (0.0, 1.0), n_share: float = 0.0, multiple: int = 0, seed: int = 0, tries: int = 32) -> DataFrame:
    """(row_id, sequence): ``n`` generated sequences of ``least`` to ``most`` letters.

    A length is rounded up to a multiple, or down where that exceeds ``most``. GC limits are met by taking the first of
    ``tries`` sequences that meets them; if a row has none, the action fails, it doesn't loop.
    """
    from codonlake.functions.sequence import gc_content

    ids = spark.range(n).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1 if gc != (0.0, 1.0) else 0))).alias("__t"))
    key = F.col("row_id") * tries + F.col("__t")
    size = F.lit(least) + hash31(key, seed + 1) % (most - least + 1)
    if multiple:
        up = F.ceil(size / multiple) * multiple
        size = F.when(up > most, up - multiple).otherwise(up)
    made = bases(ids.withColumn("__k", key).withColumn("__n", size.cast("int")), "__k", F.col("__n"), n_share, seed)
    fits = gc_content(F.col("sequence")).between(*gc)
    best = made.groupBy("row_id").agg(F.min_by(F.when(fits, F.col("sequence")), F.when(fits, F.col("__t"))).alias("sequence"))
    return best.withColumn("sequence", F.coalesce("sequence", F.raise_error(F.lit("no generated sequence meets the GC limits"))))
