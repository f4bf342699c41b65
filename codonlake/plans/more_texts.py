"""Further text and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonlake.functions import text as tx
from codonlake.functions import vectors as vec
from codonlake.operators import metrics as me
from codonlake.operators import text_metrics as tm
from codonlake.plans.evaluation import RUN, SCORED, _NEAR, cosine_top10, scored
from codonlake.plans.registry import query
from codonlake.plans.texts import DOCS, docs, grams_sql, pairs, tokens_sql
from codonlake.session import cut, read_table


@query("m_sacrebleu", f"WITH {DOCS}, {grams_sql('docs', tokens_sql('pred'), tokens_sql('ref'), 4)}, o AS (SELECT n, sum(matches) AS m, sum(pt) AS t FROM m GROUP BY n), k AS (SELECT *, sum((m = 0)::int) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS miss FROM o), l AS (SELECT sum(len(p))::double AS c, sum(len(r))::double AS r FROM p) SELECT round(100 * CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END * exp((SELECT sum(ln(CASE WHEN m > 0 THEN m / t ELSE 1 / (2.0::double ** miss * t) END)) FROM k) / 4), 6) AS bleu FROM l")
def m_sacrebleu(spark, sf):
    d = cut(docs(spark, sf).select("id", tx.tokens_13a(F.col("pred")).alias("p"), tx.tokens_13a(F.col("ref")).alias("r")))
    out = tm.smoothed_bleu(tm.ngram_matches(d, "id", F.col("p"), F.col("r"), 4), tm.lengths(d, F.col("p"), F.col("r"), "closest"))
    return out.select(F.round("bleu", 6).alias("bleu"))


@query("m_nist")
def m_nist(spark, sf):
    return tm.nist(docs(spark, sf), "id", tx.words(F.lower("pred")), tx.words(F.lower("ref"))).select(F.round("nist", 6).alias("nist"))


@query("m_meteor_exact")
def m_meteor_exact(spark, sf):
    return pairs(spark, sf).select("id", F.round(tm.word_alignment_score(F.col("pred"), F.col("ref")), 6).alias("score"))


@query("m_muc", "WITH c AS (SELECT l_suppkey AS k, l_partkey % 50 AS r FROM lineitem), a AS (SELECT count(*) AS m, count(DISTINCT r) AS n FROM c GROUP BY k), b AS (SELECT count(*) AS m, count(DISTINCT k) AS n FROM c GROUP BY r), s AS (SELECT (SELECT sum(m - n)::double / sum(m - 1) FROM b) AS p, (SELECT sum(m - n)::double / sum(m - 1) FROM a) AS r) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def m_muc(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("r"))
    out = tm.muc(li, "l_orderkey", "k", "r")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m_cuad_curve", "WITH s AS (SELECT value AS s, sum((event_type = 'click')::int) AS c, count(*) AS n FROM events GROUP BY value), t AS (SELECT sum(c) AS total FROM s), x AS (SELECT s, sum(c) OVER w / total::double AS r, sum(c) OVER w / sum(n) OVER w::double AS p FROM s, t WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), e AS (SELECT s, r, max(p) OVER (ORDER BY s DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM x), a AS (SELECT r, p, (r - coalesce(lag(r) OVER (ORDER BY s DESC), 0)) * (p + coalesce(lag(p) OVER (ORDER BY s DESC), 1)) / 2 AS a FROM e) SELECT round(sum(a), 6) AS aupr, round(max(CASE WHEN r >= 0.8::double THEN p END), 6) AS p_at_80, round(max(CASE WHEN r >= 0.9::double THEN p END), 6) AS p_at_90 FROM a")
def m_cuad_curve(spark, sf):
    e = read_table(spark, sf, "events").select("value", (F.col("event_type") == "click").alias("ok"))
    out = tm.answer_curve(e, "value", "ok")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m_auroc_ovo", f"WITH {SCORED}, z AS (SELECT model, y AS a, 1 - y AS b, 1 AS t, logits[y + 1] AS v FROM scored UNION ALL SELECT model, 1 - y, y, 0, logits[2 - y] FROM scored), st AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model, a) AS ap, sum(n) OVER (PARTITION BY model, a) AS an FROM (SELECT model, a, v, sum(t) AS p, sum(1 - t) AS n FROM z GROUP BY model, a, v) WINDOW w AS (PARTITION BY model, a ORDER BY v DESC ROWS UNBOUNDED PRECEDING)), u AS (SELECT model, a, sum(p * (an - cn + n / 2.0::double)) / (any_value(ap) * any_value(an)) AS auroc FROM st GROUP BY model, a) SELECT model, round(avg(auroc), 6) AS auroc FROM u GROUP BY model")
def m_auroc_ovo(spark, sf):
    out = me.pairwise_auroc(scored(spark, sf), ["model"], "y", "logits")
    return out.select("model", F.round("auroc", 6).alias("auroc"))


def _run(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("qid"), F.col("l_partkey").alias("doc")).agg(F.max("l_extendedprice").alias("score"), F.max((F.col("l_quantity") % 3).cast("int")).alias("rel"))


@query("m_bpref", f"WITH {RUN}, c AS (SELECT *, sum((rel <= 0)::int) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS above, sum((rel <= 0)::int) OVER (PARTITION BY qid) AS n0 FROM h WHERE n_rel > 0) SELECT qid, round(sum(CASE WHEN rel > 0 THEN 1 - CASE WHEN least(n_rel, n0) > 0 THEN least(above, n_rel, n0) / least(n_rel, n0)::double ELSE 0 END ELSE 0 END) / any_value(n_rel), 6) AS bpref FROM c GROUP BY qid")
def m_bpref(spark, sf):
    r = _run(spark, sf)
    return me.bpref(r.select("qid", "doc", "score"), r.select("qid", "doc", "rel")).select("qid", F.round("bpref", 6).alias("bpref"))


@query("m_gm_map", f"WITH {RUN}, a AS (SELECT qid, sum(CASE WHEN rel > 0 THEN hits / rank::double ELSE 0 END) / any_value(n_rel) AS ap FROM h WHERE n_rel > 0 GROUP BY qid) SELECT round(exp(avg(ln(greatest(ap, 1e-5)))), 6) AS mean FROM a")
def m_gm_map(spark, sf):
    r = _run(spark, sf)
    ap = me.ranking(r.select("qid", "doc", "score"), r.select("qid", "doc", "rel"), (5,))
    return me.geometric_mean(ap, "ap").select(F.round("mean", 6).alias("mean"))


@query("m_precision_at_10", f"SELECT id, round(sum((other % 5 = id % 5)::int) / 10.0::double, 6) AS precision FROM ({_NEAR}) GROUP BY id")
def m_precision_at_10(spark, sf):
    top = cosine_top10(spark, sf).withColumn("ok", F.col("other") % 5 == F.col("id") % 5)
    return me.precision_at(top, "ok", "id").select("id", F.round("precision", 6).alias("precision"))


@query("minmax_attributions", "SELECT row_id, model, [CASE WHEN list_max(logits) - list_min(logits) <= 1e-12 THEN 0.0 ELSE round((x - list_min(logits)) / (list_max(logits) - list_min(logits) + 1e-8), 6) END for x in logits] AS scaled, scored_at, received_at FROM predictions WHERE len(logits) = 2 AND NOT isnan(logits[1]) AND NOT isnan(logits[2])")
def minmax_attributions(spark, sf):
    p = read_table(spark, sf, "predictions").where(vec.is_scored(F.col("logits"), 2))
    return p.select("row_id", "model", F.transform(vec.min_max(F.col("logits")), lambda x: F.round(x, 6)).alias("scaled"), "scored_at", "received_at")


@query("m_ter")
def m_ter(spark, sf):
    return tm.ter(pairs(spark, sf), F.col("pred"), F.col("ref")).select(F.round("ter", 6).alias("ter"))


@query("m_lea", "WITH c AS (SELECT l_suppkey AS k, l_partkey % 50 AS r, count(*)::double AS n FROM lineitem GROUP BY ALL), s AS (SELECT n, sum(n) OVER (PARTITION BY k) AS nk, sum(n) OVER (PARTITION BY r) AS nr FROM c), t AS (SELECT sum(nr * CASE WHEN nr = 1 THEN (nk = 1)::int ELSE n * (n - 1) / (nr * (nr - 1)) END) / sum(n) AS p, sum(nk * CASE WHEN nk = 1 THEN (nr = 1)::int ELSE n * (n - 1) / (nk * (nk - 1)) END) / sum(n) AS r FROM s) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM t")
def m_lea(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("r"))
    out = tm.lea(li, "l_orderkey", "k", "r")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
