"""Queries on metric suites, reliability, encoding and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake.functions import encode as en
from codonlake.functions import sequence as sq
from codonlake.operators import suites as su
from codonlake.operators import training as tr
from codonlake.plans.evaluation import _COUNTS, _PER, _RATES, CLASSES, REGR, SCORED, classes, regr, scored
from codonlake.plans.registry import query
from codonlake.plans.scalar import _HAS, IDS_SQL, _some
from codonlake.session import read_table


def _long(df, *keys):
    return df.select(*keys, "metric", F.round("value", 6).alias("value"))


@query("m_glue_mrpc", f"WITH {SCORED}, c AS (SELECT model, {_COUNTS} FROM scored GROUP BY model), rates AS (SELECT model, {_RATES} FROM c) SELECT model, metric, round(value, 6) AS value FROM (SELECT model, accuracy, f1 FROM rates) UNPIVOT (value FOR metric IN (accuracy, f1))")
def m_glue_mrpc(spark, sf):
    return _long(su.evaluate(scored(spark, sf), "glue/mrpc", ["model"]), "model")


@query("m_glue_stsb", f"WITH {REGR}, k AS (SELECT g, y, pred, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::double AS ry, rank() OVER (PARTITION BY g ORDER BY pred) + (count(*) OVER (PARTITION BY g, pred) - 1) / 2.0::double AS rp FROM regr), v AS (SELECT g, corr(y, pred) AS pearson, corr(ry, rp) AS spearman FROM k GROUP BY g) SELECT g, metric, round(value, 6) AS value FROM v UNPIVOT (value FOR metric IN (pearson, spearman))")
def m_glue_stsb(spark, sf):
    return _long(su.evaluate(regr(spark, sf), "glue/stsb", ["g"]), "g")


@query("m_super_glue_cb", f"WITH {CLASSES}, {_PER}, a AS (SELECT g, avg((y = pred)::int)::double AS accuracy FROM classes GROUP BY g), f AS (SELECT g, avg(f1) AS f1 FROM pc GROUP BY g) SELECT g, metric, round(value, 6) AS value FROM (SELECT g, accuracy, f1 FROM a JOIN f USING (g)) UNPIVOT (value FOR metric IN (accuracy, f1))")
def m_super_glue_cb(spark, sf):
    return _long(su.evaluate(classes(spark, sf), "super_glue/cb", ["g"]), "g")


@query("m_question_scores", f"WITH {SCORED}, classes AS (SELECT row_id AS g, y, pred FROM scored), {_PER}, a AS (SELECT avg(f) AS macro_f1 FROM (SELECT g, avg(f1) AS f FROM pc GROUP BY g)), b AS (SELECT avg(ok) AS all_correct FROM (SELECT g, min((y = pred)::int)::double AS ok FROM classes GROUP BY g)), c AS (SELECT {_COUNTS} FROM classes), d AS (SELECT {_RATES} FROM c) SELECT round(macro_f1, 6) AS macro_f1, round(all_correct, 6) AS all_correct, round(d.f1, 6) AS answer_f1 FROM a, b, d")
def m_question_scores(spark, sf):
    out = su.question_scores(scored(spark, sf), "row_id", "y", "pred")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m_dispersion_within", "WITH d AS (SELECT user_id, value - lag(value) OVER w AS d, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - value AS fall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), q AS (SELECT user_id, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.75) AS b, quantile_cont(d, 0.05) AS l, stddev_pop(d) AS sd, max(fall) AS drawdown FROM d GROUP BY user_id) SELECT user_id, round(any_value(b - a), 6) AS iqr, round(quantile_cont(abs(d - m), 0.5), 6) AS mad, round(any_value(sd), 6) AS sd, round(any_value(drawdown), 6) AS drawdown, round(avg(CASE WHEN d <= l THEN d END), 6) AS cvar FROM d JOIN q USING (user_id) WHERE d IS NOT NULL GROUP BY user_id")
def m_dispersion_within(spark, sf):
    out = su.dispersion_within_runs(read_table(spark, sf, "events"), "user_id", "event_id", "value")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("m_dispersion_across", "SELECT event_id % 40 AS step, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY ALL")
def m_dispersion_across(spark, sf):
    e = read_table(spark, sf, "events").select((F.col("event_id") % 40).alias("step"), "value")
    out = su.dispersion_across_runs(e, "step", "value")
    return out.select("step", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_ENC = f"SELECT row_id, ids, len(ids) AS n FROM (SELECT row_id, [x + 5 for x in {IDS_SQL}] AS ids FROM dev WHERE {_HAS})"


@query("token_encode", f"SELECT row_id, list_concat(list_concat([1], ids[1:298]), list_concat([2], [0 for i in range(0, 298 - least(n, 298))])) AS input_ids, list_concat([1 for i in range(0, least(n, 298) + 2)], [0 for i in range(0, 298 - least(n, 298))]) AS mask, list_concat(list_concat([-100], [x % 2 for x in ids[1:298]]), list_concat([-100], [-100 for i in range(0, 298 - least(n, 298))])) AS tags FROM ({_ENC})")
def token_encode(spark, sf):
    rows = _some(spark, sf).select("row_id", F.transform(sq.base_ids(F.col("sequence")), lambda x: x + 5).alias("ids"))
    tags = F.transform("ids", lambda x: x % 2)
    return rows.select("row_id", en.encode(F.col("ids"), 300).alias("input_ids"), en.mask(F.col("ids"), 300).alias("mask"), en.aligned_labels(tags, 300).alias("tags"))


@query("multi_sequence_separator", "SELECT row_id, replace(concat(sequence, '|', label), '|', '[SEP]') AS text FROM dev WHERE sequence IS NOT NULL AND label IS NOT NULL")
def multi_sequence_separator(spark, sf):
    both = F.concat("sequence", F.lit("|"), "label")
    return read_table(spark, sf, "dev").where("sequence is not null and label is not null").select("row_id", en.with_separator(both, "|", "[SEP]").alias("text"))


@query("kmer_features", "WITH u AS (SELECT row_id, upper(sequence) AS s FROM dev WHERE sequence IS NOT NULL), k AS (SELECT row_id, greatest(length(s) - 1, 1) AS n, [substr(s, i, 2) for i in range(1, length(s))] AS ks FROM u) SELECT row_id, [round(len(list_filter(ks, lambda y: y = a))::double / n, 9) for a in ['AA', 'AC', 'AG', 'AT', 'CA', 'CC', 'CG', 'CT', 'GA', 'GC', 'GG', 'GT', 'TA', 'TC', 'TG', 'TT']] AS shares FROM k")
def kmer_features(spark, sf):
    rows = read_table(spark, sf, "dev").where("sequence is not null").select("row_id", tr.kmer_features(F.col("sequence"), 2).alias("f"))
    return rows.select("row_id", F.transform("f", lambda x: F.round(x, 9)).alias("shares"))


@query("kmer_classifier")
def kmer_classifier(spark, sf):
    label = F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")
    y = F.when(label.isin("1", "promoter"), 1).when(label.isin("0", "notpromoter"), 0)
    train, test = (read_table(spark, sf, t).select("row_id", "sequence", y.alias("y")) for t in ("train", "test"))
    model = tr.fit_classifier(train, maxIter=10)
    return tr.predict(model, test).select("row_id", "y", F.transform("logits", lambda x: F.round(x, 4)).alias("logits"))
