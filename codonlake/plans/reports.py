"""Queries on benchmark tables, chart data and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.operators import benchmark as be
from codonlake.operators import metrics as me
from codonlake.operators import mutagenesis as mu
from codonlake.operators import plotdata as pl
from codonlake.operators import sampling as sa
from codonlake.plans.datasets import hash_sql
from codonlake.plans.evaluation import _COUNTS, _RATES, SCORED, STEPS, scored
from codonlake.plans.mutants import EFFECTS
from codonlake.plans.registry import query
from codonlake.session import cut, read_table, shared_dir
from codonlake.streaming import predict as st

_METRICS = ("accuracy", "precision", "recall", "f1", "mcc")
_WIDE = f"c AS (SELECT model, split, {_COUNTS} FROM scored GROUP BY model, split), wide AS (SELECT model, split, {_RATES} FROM c), bench AS (SELECT model, split, metric, round(value, 6) AS value FROM (SELECT model, split, {', '.join(_METRICS)} FROM wide) UNPIVOT (value FOR metric IN ({', '.join(_METRICS)})))"


def _bench(spark, sf) -> DataFrame:
    wide = me.binary_rates(me.binary_counts(scored(spark, sf), ["model", "split"], "y", "pred"), ["model", "split"]).select("model", "split", *_METRICS)
    return be.long_metrics(wide, ["model", "split"]).withColumn("value", F.round("value", 6))


@query("bench_runs", "SELECT DISTINCT model, task, fold FROM predictions CROSS JOIN (SELECT DISTINCT task FROM label_names) CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)")
def bench_runs(spark, sf):
    return be.runs(read_table(spark, sf, "predictions").select("model").distinct(), read_table(spark, sf, "label_names").select("task").distinct(), 3)


@query("bench_long", f"WITH {SCORED}, {_WIDE} SELECT * FROM bench")
def bench_long(spark, sf):
    return _bench(spark, sf)


@query("bench_selected", f"WITH {SCORED}, {_WIDE} SELECT * FROM bench WHERE metric IN ('f1', 'mcc')")
def bench_selected(spark, sf):
    return be.selected(_bench(spark, sf), ["f1", "mcc"])


_FOLDS = f"folds AS (SELECT *, (row_number() OVER (PARTITION BY model, y ORDER BY {hash_sql(42)}, row_id) - 1) % 5 AS fold FROM scored), fc AS (SELECT model, fold, {_COUNTS} FROM folds GROUP BY model, fold), fr AS (SELECT model, fold, {_RATES} FROM fc), fl AS (SELECT model, metric, value FROM (SELECT model, fold, {', '.join(_METRICS)} FROM fr) UNPIVOT (value FOR metric IN ({', '.join(_METRICS)})))"


@query("cv_mean_std", f"WITH {SCORED}, {_FOLDS} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM fl GROUP BY model, metric")
def cv_mean_std(spark, sf):
    f = sa.folds(scored(spark, sf), "row_id", 5, ["model", "y"])
    wide = me.binary_rates(me.binary_counts(f, ["model", "fold"], "y", "pred"), ["model", "fold"]).select("model", "fold", *_METRICS)
    out = be.fold_summary(be.long_metrics(wide, ["model", "fold"]), ["model"])
    return out.select("model", "metric", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("label_rollup", f"WITH {SCORED} SELECT y, count(*) AS n, round(avg(margin), 6) AS mean FROM scored GROUP BY ROLLUP (y)")
def label_rollup(spark, sf):
    out = be.rollup_metrics(scored(spark, sf), "y", "margin")
    return out.select("y", "n", F.round("mean", 6).alias("mean"))


@query("registry_summary", "SELECT task, count(*) AS n_labels, min(label_name) AS first_name, max(label_name) AS last_name FROM label_names GROUP BY task")
def registry_summary(spark, sf):
    return read_table(spark, sf, "label_names").groupBy("task").agg(F.count(F.lit(1)).alias("n_labels"), F.min("label_name").alias("first_name"), F.max("label_name").alias("last_name"))


@query("plot_bars", f"WITH {SCORED}, {_WIDE} SELECT model, metric, round(avg(value), 9) AS value FROM bench GROUP BY model, metric")
def plot_bars(spark, sf):
    return _bench(spark, sf).groupBy("model", "metric").agg(F.round(F.avg("value"), 9).alias("value"))


@query("plot_radar", f"WITH {SCORED}, {_WIDE}, d AS (SELECT split, model, metric, value, row_number() OVER (PARTITION BY split, model ORDER BY metric) - 1 AS place, count(*) OVER (PARTITION BY split, model) AS n FROM bench), z AS (SELECT * FROM d UNION ALL SELECT split, model, metric, value, n, n FROM d WHERE place = 0) SELECT split, model, metric, place, round(place * 2 * pi() / n, 6) AS angle, round(value * cos(place * 2 * pi() / n), 6) AS x, round(value * sin(place * 2 * pi() / n), 6) AS y FROM z")
def plot_radar(spark, sf):
    out = pl.radar(_bench(spark, sf).select(F.struct("split", "model").alias("key"), "metric", "value"), "key")
    return out.select("key.split", "key.model", "metric", "place", *[F.round(c, 6).alias(c) for c in ("angle", "x", "y")])


_GRID = [i / 20 for i in range(21)]


@query("plot_curves", f"WITH {SCORED}, {STEPS}, pts AS (SELECT model, cn / all_n::double AS x, max(cp / all_p::double) AS y FROM steps GROUP BY ALL), grid AS (SELECT model, i / 20.0::double AS g FROM (SELECT DISTINCT model FROM pts) CROSS JOIN (SELECT unnest(range(0, 21)) AS i)), a AS (SELECT grid.model, g, arg_max({{'x': x, 'y': y}}, x) FILTER (x <= g) AS l, arg_min({{'x': x, 'y': y}}, x) FILTER (x >= g) AS h FROM grid JOIN pts USING (model) GROUP BY ALL) SELECT model, g AS x, round(CASE WHEN l IS NULL THEN h.y WHEN h IS NULL OR h.x = l.x THEN l.y ELSE l.y + (g - l.x) / (h.x - l.x) * (h.y - l.y) END, 6) AS y FROM a")
def plot_curves(spark, sf):
    rows = cut(scored(spark, sf).select("model", "y", "margin"))  # read three times
    out = be.interpolated(me.roc_points(rows, ["model"], "y", "margin"), ["model"], "fpr", "tpr", _GRID)
    return out.select("model", "x", F.round("y", 6).alias("y"))


@query("plot_mut_heatmap", f"WITH {EFFECTS}, c AS (SELECT row_id, pos, ref, alt AS base, score FROM scored UNION ALL SELECT DISTINCT row_id, pos, ref, ref, 0 FROM scored) SELECT lpad(pos::varchar, 6, '0') || ref AS key, base, count(*) AS n, round(sum(score), 5) AS total FROM c GROUP BY ALL")
def plot_mut_heatmap(spark, sf):
    dev = read_table(spark, sf, "dev")
    m = pl.mutation_map(mu.effects(dev, "row_id", "sequence"), "row_id", pl.key_width(dev, "sequence"))
    return m.groupBy("key", "base").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 5).alias("total"))


@query("plot_mut_lines", f"WITH {EFFECTS}, p AS (SELECT row_id, pos, sum(CASE WHEN score >= 0 THEN score ELSE 0 END) AS gain, sum(CASE WHEN score < 0 THEN -score ELSE 0 END) AS loss FROM scored GROUP BY row_id, pos), l AS (SELECT pos, 'gain' AS kind, gain AS v FROM p UNION ALL SELECT pos, 'loss', loss FROM p) SELECT pos, kind, count(*) AS n, round(avg(v), 6) AS score FROM l GROUP BY pos, kind")
def plot_mut_lines(spark, sf):
    p = mu.gain_loss(mu.site_effects(read_table(spark, sf, "dev"), "row_id", "sequence"), "row_id")
    long = be.long_metrics(p, ["row_id", "pos"])
    return long.groupBy("pos", F.col("metric").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("score"))


@query("plot_attr_matrix", "SELECT row_id, model, place::int AS place, count(*) AS n, round(sum(CASE WHEN isnan(v) THEN 0 ELSE v END), 6) AS value FROM (SELECT row_id, model, place, logits[place + 1] AS v FROM predictions CROSS JOIN (SELECT unnest([0, 1, 2]) AS place) WHERE logits IS NOT NULL) GROUP BY ALL")
def plot_attr_matrix(spark, sf):
    p = read_table(spark, sf, "predictions").where("logits is not null").select(F.struct("row_id", "model").alias("id"), "logits")
    m = pl.padded_matrix(p, "id", "logits", 3)
    return m.groupBy("id.row_id", "id.model", "place").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.nanvl("value", F.lit(0.0))), 6).alias("value"))


@query("plot_density", "WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem), b AS (SELECT least(31, floor((l_quantity - x0) * 32 / (x1 - x0)))::int AS cx, least(31, floor((l_extendedprice - y0) * 32 / (y1 - y0)))::int AS cy, count(*) AS n FROM lineitem, e GROUP BY ALL) SELECT a.cx, a.cy, a.n, round(sum(o.n * exp(-((a.cx - o.cx) ** 2 + (a.cy - o.cy) ** 2) / 2.0::double)), 4) AS density FROM b a CROSS JOIN b o GROUP BY a.cx, a.cy, a.n")
def plot_density(spark, sf):
    d = pl.density(read_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return d.select("cx", "cy", "n", F.round("density", 4).alias("density"))


@query("plot_embeddings")
def plot_embeddings(spark, sf):
    pc = pl.principal_components(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return pc.select("vec_id", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 4).alias("pc2"))


@query("train_log_series", "SELECT event_id AS step, key, value FROM (SELECT event_id, value AS loss, CASE WHEN event_type = 'view' THEN value / 10 END AS rate FROM events WHERE event_id IS NOT NULL) UNPIVOT (value FOR key IN (loss, rate))")
def train_log_series(spark, sf):
    log = read_table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.when(F.col("event_type") == "view", F.col("value") / 10).alias("rate"))
    return pl.log_series(log, "step", ["loss", "rate"])


def _stream(spark, sf) -> DataFrame:
    schema = read_table(spark, sf, "predictions").schema
    one_file = os.path.isfile(f"{sf}/predictions.parquet".removeprefix("file://"))
    return st.read_stream(spark, sf, schema, "predictions.parquet") if one_file else st.read_stream(spark, f"{sf}/predictions.parquet", schema)


def _paths(spark) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


_ERROR = "CASE WHEN logits IS NULL THEN 'no scores' WHEN len(logits) <> 2 THEN 'wrong number of scores' WHEN isnan(logits[1]) OR isnan(logits[2]) THEN 'scores are not numbers' END"


@query("stream_predict_rows", f"SELECT row_id, model, scored_at, received_at, error, round(CASE WHEN error IS NULL THEN 1 / (1 + exp(logits[1] - logits[2])) END, 9) AS prob FROM (SELECT *, {_ERROR} AS error FROM predictions)")
def stream_predict_rows(spark, sf):
    rows = st.predicted(_stream(spark, sf)).select("row_id", "model", "scored_at", "received_at", "error", F.round("prob", 9).alias("prob"))
    return st.run_once(rows, *_paths(spark))


@query("stream_predict_counts", f"SELECT model, count(*) AS total, sum((error IS NULL)::int)::bigint AS succeeded, sum((error IS NOT NULL)::int)::bigint AS failed FROM (SELECT *, {_ERROR} AS error FROM predictions) GROUP BY model")
def stream_predict_counts(spark, sf):
    return st.run_once(st.outcome_counts(st.predicted(_stream(spark, sf)), "model"), *_paths(spark), mode="complete")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, scored_at) AS start, model, count(*) AS n FROM predictions GROUP BY ALL")
def stream_windows(spark, sf):
    stream = _stream(spark, sf).withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    counts = st.windowed_counts(stream, "scored_at", "model", late="36500 days")
    return st.run_once(counts, *_paths(spark), mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
