"""The data of charts: each operator gives the frame a chart is drawn from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radar(long: DataFrame, by: str) -> DataFrame:
    """(by, metric, place, angle, x, y): metrics in order round the circle, the first again at the end."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("metric")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    p = long.select(by, "metric", "value", rank.alias("rank"), n.alias("n"))
    closed = p.select(by, "metric", "value", "n", F.explode(F.when(F.col("rank") == 0, F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.array(F.col("rank").cast("bigint")))).alias("place"))
    angle = F.col("place") * 2 * math.pi / F.col("n")
    return closed.select(by, "metric", "place", angle.alias("angle"), (F.col("value") * F.cos(angle)).alias("x"), (F.col("value") * F.sin(angle)).alias("y"))


def axis_key(pos: Column, base: Column, width: int) -> Column:
    """A position padded with zeros, so that keys sort as numbers, and its base. A longer position is never cut."""
    digits = pos.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(digits))), digits, base)


def key_width(df: DataFrame, seq: str, least: int = 6) -> int:
    """Digits of the last position of the longest sequence, ``least`` at least."""
    longest = df.agg(F.max(F.length(seq))).first()[0] or 1
    return max(least, len(str(longest - 1)))


def mutation_map(effects: DataFrame, id_col: str, width: int) -> DataFrame:
    """(id, key, base, score): substitution scores, with 0 at the reference base; keys have positions of ``width`` digits."""
    key = axis_key(F.col("pos"), F.col("ref"), width).alias("key")
    own = effects.select(id_col, key, F.col("alt").alias("base"), "score", "ref")
    cells = F.array(F.struct(F.col("base"), F.col("score")), F.struct(F.col("ref").alias("base"), F.lit(0.0).alias("score")))
    # The reference base's own cell comes with the first other base of its position, so no position is looked for twice.
    first = F.col("base") == F.when(F.col("ref") == "A", "C").otherwise("A")
    return own.select(id_col, "key", F.explode(F.when(first, cells).otherwise(F.slice(cells, 1, 1))).alias("c")).select(id_col, "key", "c.base", "c.score")


def padded_matrix(df: DataFrame, id_col: str, values: str, size: int) -> DataFrame:
    """(id, place, value): arrays as long rows of the same number, null past their end."""
    places = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("place")
    return df.select(id_col, F.col(values).alias("__v"), places).select(id_col, "place", F.get("__v", F.col("place")).cast("double").alias("value"))


def density(df: DataFrame, x: str, y: str, cells: int = 32) -> DataFrame:
    """(cx, cy, n, density): rows by cell of a ``cells`` by ``cells`` grid, smoothed by a Gaussian kernel over the grid: a
    binned estimate of density, whose kernel is one cell wide and covers all cells.

    The kernel runs over cells, a fixed number, not over pairs of rows.
    """
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, a, b: F.least(F.lit(cells - 1), F.floor(F.try_divide((F.col(c) - F.col(a)) * float(cells), F.col(b) - F.col(a)))).cast("int")
    binned = df.crossJoin(F.broadcast(ends)).groupBy(cell(x, "x0", "x1").alias("cx"), cell(y, "y0", "y1").alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    other = binned.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("n").alias("on"))
    near = binned.crossJoin(F.broadcast(other))  # at most cells to the fourth power of pairs, whatever the rows
    dx, dy = F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")
    return near.groupBy("cx", "cy", "n").agg(F.sum(F.col("on") * F.exp(-(dx * dx + dy * dy) / 2.0)).alias("density"))


def principal_components(df: DataFrame, id_col: str, vector: str, k: int = 2) -> DataFrame:
    """(id, pc array): the first components of standardised vectors, by the library's distributed PCA."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    scaled = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(v).transform(v)
    return PCA(k=k, inputCol="__s", outputCol="__p").fit(scaled).transform(scaled).select(id_col, vector_to_array("__p").alias("pc"))


def attention_frame(df: DataFrame, id_col: str, weights: str) -> DataFrame:
    """(id, q, k, w) from a matrix of attention weights, without the first and last token on either side."""
    rows = df.select(id_col, F.size(weights).alias("__n"), F.posexplode(weights).alias("q", "__row"))
    cells = rows.select(id_col, "__n", "q", F.posexplode("__row").alias("k", "w"))
    inside = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("__n") - 1)
    return cells.where(inside("q") & inside("k")).select(id_col, "q", "k", "w")


def log_series(log: DataFrame, step: str, keys: list[str]) -> DataFrame:
    """(step, key, value): a training log as series, without entries that have no step or value."""
    cols = [F.col(k).cast("double").alias(k) for k in keys]
    return log.where(F.col(step).isNotNull()).select(step, *cols).unpivot([step], keys, "key", "value").where("value is not null")
