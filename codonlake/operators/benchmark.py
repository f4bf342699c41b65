"""Comparing models over datasets and folds, and what their comparison tables are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(models: DataFrame, datasets: DataFrame, folds: int = 1) -> DataFrame:
    """Every model with every dataset and fold: the plan of a benchmark. Both sides are registries."""
    return models.crossJoin(datasets).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def long_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, value) from a column for each metric."""
    values = [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(keys, values, "metric", "value")


def selected(long: DataFrame, metrics: list[str]) -> DataFrame:
    """The named metrics; all of them if ``all`` is named."""
    return long if "all" in metrics else long.where(F.col("metric").isin(metrics))


def fold_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, mean, sd): over folds, with the population standard deviation."""
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def outcome_counts(df: DataFrame, by: list[str], failed: str) -> DataFrame:
    """(by..., total, succeeded, failed)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col(failed)).alias("succeeded"), F.count_if(failed).alias("failed"))


def memory_estimate(parameters: F.Column, batch: int, length: int, hidden: int, layers: int, bytes_each: int = 4) -> F.Column:
    """Bytes for weights and activations of a forward pass."""
    return parameters * bytes_each + F.lit(batch * length * hidden * layers * bytes_each)


def rollup_metrics(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, mean): by label, and over all with a null label."""
    return df.rollup(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def interpolated(points: DataFrame, by: list[str], x: str, y: str, grid: list[float]) -> DataFrame:
    """(by..., x, y): a curve's value at each place of ``grid`` by linear interpolation; beyond its ends, the end's.

    Of the points between two places only the outer ones matter, so a curve comes down to a few points before it is looked
    at as a whole.
    """
    places = sorted({float(g) for g in grid})
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    known = points.select(*by, point.alias("p"))
    px = F.col("p.x")
    # 2i + 1 at a place, 2i below place i and above the one before.
    part = F.coalesce(*[F.when(px < g, 2 * i).when(px == g, 2 * i + 1) for i, g in enumerate(places)], F.lit(2 * len(places)))
    ends = known.groupBy(*by, F.when(px.isNotNull() & ~F.isnan(px), part).alias("__part")).agg(F.max("p").alias("hi"), F.max_by("p", F.struct(-px, F.col("p.y"))).alias("lo"))
    least = lambda i: F.max_by(F.when(F.col("__part") > 2 * i, F.col("lo")), F.when(F.col("__part") > 2 * i, -F.col("__part")))
    most = lambda i: F.max(F.when(F.col("__part") <= 2 * i + 1, F.col("hi")))
    cells = [F.struct(F.lit(float(g)).alias("x"), most(i).alias("l"), least(i).alias("h")) for g in grid for i in [places.index(float(g))]]
    at = ends.groupBy(*by).agg(F.array(*cells).alias("__c")).select(*by, F.explode("__c").alias("c")).select(*by, "c.*")
    share = F.try_divide(F.col("x") - F.col("l.x"), F.col("h.x") - F.col("l.x"))
    value = F.when(F.col("l").isNull(), F.col("h.y")).when(F.col("h").isNull() | share.isNull(), F.col("l.y")).otherwise(F.col("l.y") + share * (F.col("h.y") - F.col("l.y")))
    return at.select(*by, "x", value.alias("y"))
