"""Queries on predictions by task, pooling of token vectors, and metrics of several labels, outputs and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake.functions import vectors as vec
from codonlake.operators import intervals as iv
from codonlake.operators import metrics as me
from codonlake.operators import pooling, scoring, suites
from codonlake.plans.evaluation import SCORED, TAGS, _spans, r, scored, tags
from codonlake.plans.mutants import EFFECTS
from codonlake.plans.registry import query
from codonlake.plans.texts import PAIRS, normal_sql, pairs, words_sql
from codonlake.session import read_table
from codonlake.sources import files, presets

_VECTORS = "vec AS (SELECT label, vec_id, (vec_id % 3 <> 0)::int AS mask, [x::double for x in embedding] AS v FROM embeddings)"


def _pooled(spark, sf, how: str):
    e = read_table(spark, sf, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    return pooling.pool(e, ["label"], "vec_id", "embedding", how, "mask").select("label", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


def _by_place(f: str) -> str:
    return f"WITH {_VECTORS}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec WHERE mask = 1), m AS (SELECT label, i, {f}(x) AS x FROM u GROUP BY ALL) SELECT label, list(round(x, 6) ORDER BY i) AS pooled FROM m GROUP BY label"


@query("pool_masked_mean", _by_place("avg"))
def pool_masked_mean(spark, sf):
    return _pooled(spark, sf, "mean")


@query("pool_masked_max", _by_place("max"))
def pool_masked_max(spark, sf):
    return _pooled(spark, sf, "max")


@query("pool_masked_ends", f"WITH {_VECTORS}, a AS (SELECT label, arg_min(v, vec_id) FILTER (mask = 1) AS f, arg_max(v, vec_id) FILTER (mask = 1) AS l, arg_min(v, vec_id) AS c FROM vec GROUP BY label) SELECT label, [round(x, 6) for x in f] AS first, [round(x, 6) for x in l] AS last, [round(x, 6) for x in c] AS cls FROM a")
def pool_masked_ends(spark, sf):
    parts = [_pooled(spark, sf, how).withColumnRenamed("pooled", how) for how in ("first", "last", "cls")]
    return parts[0].join(parts[1], "label").join(parts[2], "label")


@query("argmax_multiclass", "SELECT row_id, model, scored_at, received_at, list_position(logits, list_max(logits)) - 1 AS pred, round(1 / list_sum([exp(x - list_max(logits)) for x in logits]), 9) AS prob FROM predictions WHERE len(logits) = 2 AND NOT isnan(logits[1]) AND NOT isnan(logits[2])")
def argmax_multiclass(spark, sf):
    p = read_table(spark, sf, "predictions").where(vec.is_scored(F.col("logits"), 2))
    return p.select("row_id", "model", "scored_at", "received_at", scoring.class_prediction(F.col("logits")).alias("p")).select("row_id", "model", "scored_at", "received_at", "p.pred", F.round("p.prob", 9).alias("prob"))


@query("regression_scores", f"WITH {SCORED} SELECT row_id, model, logits[1] AS score FROM scored")
def regression_scores(spark, sf):
    return scored(spark, sf).select("row_id", "model", scoring.reduced(scoring.linked(F.col("logits"), "regression"), "first").alias("score"))


@query("score_links", f"WITH {SCORED}, z AS (SELECT *, list_sum([exp(x - list_max(logits)) for x in logits]) AS z FROM scored) SELECT row_id, model, [round(1 / (1 + exp(-x)), 9) for x in logits] AS single, [round(exp(x - list_max(logits)) / z, 9) for x in logits] AS shares, list_position(logits, list_max(logits)) - 1 AS best, logits AS plain FROM z")
def score_links(spark, sf):
    nine = lambda c: F.transform(c, lambda x: F.round(x, 9))
    v = F.col("logits")
    return scored(spark, sf).select("row_id", "model", nine(scoring.linked(v, "binary")).alias("single"), nine(scoring.linked(v, "multiclass")).alias("shares"), scoring.linked(v, "token").alias("best"), scoring.linked(v, "regression").alias("plain"))


@query("token_labels", f"WITH {SCORED}, t AS (SELECT row_id, model, unnest(logits) AS x, generate_subscripts(logits, 1) - 1 AS place FROM scored) SELECT row_id, model, place, CASE WHEN x > 0 THEN 'B-UTR' ELSE 'O' END AS label, round(1 / (1 + exp(-abs(x))), 9) AS score FROM t")
def token_labels(spark, sf):
    tokens = F.transform("logits", lambda x: F.array(F.lit(0.0), x))
    found = scored(spark, sf).select("row_id", "model", F.posexplode(scoring.token_prediction(tokens, ["O", "B-UTR"])).alias("place", "p"))
    return found.select("row_id", "model", "place", "p.label", F.round("p.score", 9).alias("score"))


@query("pseudo_log_likelihood", f"WITH {EFFECTS}, o AS (SELECT row_id, pos, 1 + sum((mutant / (1 - mutant)) / (raw / (1 - raw))) AS z FROM scored WHERE ref IN ('A', 'C', 'G', 'T') GROUP BY row_id, pos) SELECT row_id, round(-sum(ln(z)), 5) AS pll, count(*) AS n FROM o GROUP BY row_id")
def pseudo_log_likelihood(spark, sf):
    return r(scoring.masked_log_likelihood(read_table(spark, sf, "dev"), "row_id", "sequence"), "row_id", "n", digits=5)


@query("m_token_summary", f"WITH {TAGS}, t AS {_spans('y')}, p AS {_spans('pred')}, c AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t JOIN p USING (row, kind, a, b)) AS nb) SELECT round(nb / np::double, 6) AS precision, round(nb / nt::double, 6) AS recall, round(2 * nb / (nt + np)::double, 6) AS f1, (SELECT round(avg((y = pred)::int), 6) FROM tags) AS accuracy FROM c")
def m_token_summary(spark, sf):
    t = tags(spark, sf)
    ignored = t.where("y = 'O'").select("row", F.lit(-1).cast(t.schema["place"].dataType).alias("place"), F.lit(me.IGNORED).alias("y"), "pred").distinct()
    return r(me.token_summary(t.unionByName(ignored), "row", "place", "y", "pred"))


_AREAS = f"WITH {SCORED}, z AS (SELECT model, i AS label, (y = i)::int AS t, logits[i + 1] AS v FROM scored CROSS JOIN (SELECT unnest([0, 1]) AS i)), st AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY model, label) AS ap, sum(n) OVER (PARTITION BY model, label) AS an FROM (SELECT model, label, v, sum(t) AS p, sum(1 - t) AS n FROM z GROUP BY ALL) WINDOW w AS (PARTITION BY model, label ORDER BY v DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT model, label, sum(p * (an - cn + n / 2.0::double)) / (any_value(ap) * any_value(an)) AS auroc, sum(p / ap::double * cp / (cp + cn)::double) AS auprc FROM st GROUP BY ALL)"


@query("m_label_areas", _AREAS + " SELECT model, label, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM a")
def m_label_areas(spark, sf):
    rows = me.label_rows(scored(spark, sf), ["model"], "y", "logits")
    keys = ["model", "label"]
    return r(me.auroc(rows, keys, "y", "score").join(me.average_precision(rows, keys, "y", "score"), keys), *keys)


@query("m_mean_label_areas", _AREAS + " SELECT model, round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc FROM a GROUP BY model")
def m_mean_label_areas(spark, sf):
    return r(me.mean_of_labels(scored(spark, sf), ["model"], "y", "logits"), "model")


@query(
    "m_regression_outputs",
    """WITH o AS (SELECT l_suppkey % 3 AS g, i, [l_quantity, l_extendedprice / 1000, 1.0][i + 1]::double AS y, [l_quantity + l_discount * 10, l_tax * 100 + l_quantity, l_discount][i + 1]::double AS p
FROM lineitem CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)), k AS (SELECT *, rank() OVER (PARTITION BY g, i ORDER BY y) + (count(*) OVER (PARTITION BY g, i, y) - 1) / 2.0::double AS ry,
rank() OVER (PARTITION BY g, i ORDER BY p) + (count(*) OVER (PARTITION BY g, i, p) - 1) / 2.0::double AS rp FROM o), e AS (SELECT g, i, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae,
CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - p) ** 2) / var_pop(y) END AS r2, CASE WHEN var_pop(y) > 0 THEN corr(y, p) END AS pearson, CASE WHEN var_pop(y) > 0 THEN corr(ry, rp) END AS spearman FROM k GROUP BY g, i)
SELECT g, round(avg(mse), 5) AS mse, round(avg(mae), 5) AS mae, round(avg(r2), 5) AS r2, round(avg(pearson), 5) AS pearson, round(avg(spearman), 5) AS spearman FROM e GROUP BY g""",
)
def m_regression_outputs(spark, sf):
    d = lambda c: F.expr(c).cast("double")
    li = read_table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("g"), F.array(d("l_quantity"), d("l_extendedprice / 1000"), F.lit(1.0)).alias("y"),
        F.array(d("l_quantity + l_discount * 10"), d("l_tax * 100 + l_quantity"), d("l_discount")).alias("pred"),
    )
    return r(me.regression_outputs(li, ["g"], "y", "pred"), "g", digits=5)


@query("header_sniff_txt", "SELECT file_name, contains(line, 'sequence') AS named_sequence, contains(line, 'label') AS named_label FROM dev_lines WHERE line_no = 1")
def header_sniff_txt(spark, sf):
    lines = read_table(spark, sf, "dev_lines").where("line_no = 1")
    return lines.select("file_name", *files.header_names(F.col("line"), "sequence", "label"))


@query("preset_tasks", "SELECT DISTINCT label_name AS name, task FROM label_names")
def preset_tasks(spark, sf):
    registry = read_table(spark, sf, "label_names").groupBy("label_name").agg(F.collect_set("task").alias("tasks"))
    return presets.tasks(registry, "label_name", "tasks").withColumnRenamed("label_name", "name")


@query("preset_for_task", "SELECT label_name AS name FROM label_names WHERE task = 'binary' GROUP BY label_name")
def preset_for_task(spark, sf):
    registry = read_table(spark, sf, "label_names").groupBy("label_name").agg(F.collect_set("task").alias("tasks"))
    return presets.for_task(registry, "tasks", "binary").select(F.col("label_name").alias("name"))


@query("plot_annotations", f"WITH {TAGS}, d AS (SELECT DISTINCT row, y, place FROM tags WHERE y <> 'O'), g AS (SELECT row, y, place, place - row_number() OVER (PARTITION BY row, y ORDER BY place) AS run FROM d) SELECT row, y, min(place) AS island_start, max(place) + 1 AS island_end FROM g GROUP BY row, y, run")
def plot_annotations(spark, sf):
    return iv.islands(tags(spark, sf).where("y <> 'O'").select("row", "y", "place"), ["row", "y"], "place")


@query("m_error_rates", f"WITH {PAIRS}, w AS (SELECT pred, ref, {words_sql('pred')} AS p, {words_sql('ref')} AS r FROM pairs), k AS (SELECT *, list_distinct(list_concat(p, r)) AS d FROM w) SELECT round(sum(levenshtein(array_to_string([chr(64 + list_position(d, x)::int) for x in p], ''), array_to_string([chr(64 + list_position(d, x)::int) for x in r], '')))::double / sum(len(r)), 9) AS wer, round(sum(levenshtein(pred, ref))::double / sum(length(ref)), 9) AS cer FROM k")
def m_error_rates(spark, sf):
    return r(suites.FAMILIES[suites.XTREME_S["mls"]](pairs(spark, sf), [], "ref", "pred"), digits=9)


@query("m_simplification_exact", f"WITH {PAIRS} SELECT round(100 * avg(({normal_sql('pred')} = {normal_sql('ref')})::int), 6) AS exact FROM pairs")
def m_simplification_exact(spark, sf):
    d = pairs(spark, sf).select(F.concat("ref", F.lit(" item")).alias("source"), "pred", F.array("ref").alias("refs"))
    return suites.simplification(d, "source", "pred", "refs").select(F.round("exact", 6).alias("exact"))
