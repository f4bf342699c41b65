"""Queries on predictions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.functions import vectors as vec
from codonlake.operators import metrics as me
from codonlake.operators import scoring
from codonlake.plans.registry import query
from codonlake.session import read_table

_LABEL = "regexp_replace(lower(label), '[^a-z0-9]', '', 'g')"
#: The newest complete score of each row and model, with the row's label where it is readable.
SCORED = f"""
truth AS (
  SELECT row_id, split, CASE WHEN l IN ('1', 'promoter') THEN 1 WHEN l IN ('0', 'notpromoter') THEN 0 END AS y
  FROM (SELECT row_id, 'dev' AS split, {_LABEL} AS l FROM dev UNION ALL SELECT row_id, 'test', {_LABEL} FROM test)
), usable AS (
  SELECT row_id, model, logits, scored_at, received_at FROM predictions WHERE len(logits) = 2 AND NOT isnan(logits[1]) AND NOT isnan(logits[2])
), newest AS (
  SELECT row_id, model, arg_max(logits, (scored_at, received_at, logits[1], logits[2])) AS logits FROM usable GROUP BY row_id, model
), scored AS (
  SELECT row_id, model, split, y, logits, logits[2] - logits[1] AS margin, CASE WHEN logits[2] > logits[1] THEN 1 ELSE 0 END AS pred
  FROM newest JOIN truth USING (row_id) WHERE y IS NOT NULL
)"""


def scored(spark, sf) -> DataFrame:
    label = F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")
    y = F.when(label.isin("1", "promoter"), 1).when(label.isin("0", "notpromoter"), 0)
    parts = [read_table(spark, sf, t).select("row_id", F.lit(t).alias("split"), y.alias("y")) for t in ("dev", "test")]
    truth = parts[0].unionByName(parts[1]).where("y is not null")
    usable = read_table(spark, sf, "predictions").where(vec.is_scored(F.col("logits"), 2))
    newest = usable.groupBy("row_id", "model").agg(F.max_by("logits", F.struct("scored_at", "received_at", F.col("logits")[0], F.col("logits")[1])).alias("logits"))
    both = newest.join(truth, "row_id")
    return both.select("*", (F.col("logits")[1] - F.col("logits")[0]).alias("margin"), vec.argmax(F.col("logits")).alias("pred"))


def r(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def rs(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("softmax_binary", f"WITH {SCORED} SELECT row_id, model, round(1 / (1 + exp(-margin)), 9) AS prob, (1 / (1 + exp(-margin)) > 0.5)::int AS pred FROM scored")
def softmax_binary(spark, sf):
    p = scored(spark, sf).select("row_id", "model", scoring.binary_prediction(F.col("logits")).alias("p"))
    return p.select("row_id", "model", F.round("p.prob", 9).alias("prob"), "p.pred")


@query("label_names_of_predictions", f"WITH {SCORED} SELECT model, label_name, count(*) AS n FROM scored JOIN label_names ON label_names.label = pred AND task = 'binary' GROUP BY ALL")
def label_names_of_predictions(spark, sf):
    names = read_table(spark, sf, "label_names").where("task = 'binary'").select(F.col("label").alias("pred"), "label_name")
    return scored(spark, sf).join(names, "pred").groupBy("model", "label_name").agg(F.count(F.lit(1)).alias("n"))


@query("seq_logit_reduce", f"WITH {SCORED} SELECT model, round(avg(list_sum(logits)), 6) AS total, round(avg(list_max(logits)), 6) AS largest, round(avg(list_min(logits)), 6) AS least, round(avg(logits[1]), 6) AS first, round(avg(logits[-1]), 6) AS last FROM scored GROUP BY model")
def seq_logit_reduce(spark, sf):
    how = {"total": "sum", "largest": "max", "least": "min", "first": "first", "last": "last"}
    return r(scored(spark, sf).groupBy("model").agg(*[F.avg(scoring.reduced(F.col("logits"), h)).alias(n) for n, h in how.items()]), "model")


@query("scrub_probabilities", "SELECT row_id, model, scored_at, received_at, [CASE WHEN isnan(x) OR x = '-infinity'::double THEN 0.0 WHEN x = 'infinity'::double THEN 1.0 ELSE x END for x in logits] AS clean FROM predictions")
def scrub_probabilities(spark, sf):
    return read_table(spark, sf, "predictions").select("row_id", "model", "scored_at", "received_at", F.transform("logits", vec.scrubbed).alias("clean"))


_RATES = "(tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc, tp / (tp + fn) AS tpr, tn / (tn + fp) AS tnr, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr"
_COUNTS = "sum((y = 1 AND pred = 1)::int)::double AS tp, sum((y <> 1 AND pred = 1)::int)::double AS fp, sum((y = 1 AND pred <> 1)::int)::double AS fn, sum((y <> 1 AND pred <> 1)::int)::double AS tn"


@query("m_binary", f"WITH {SCORED}, c AS (SELECT model, split, {_COUNTS} FROM scored GROUP BY model, split), rates AS (SELECT model, split, {_RATES} FROM c) SELECT model, split, {rs('accuracy', 'precision', 'recall', 'f1', 'mcc', 'tpr', 'tnr', 'fpr', 'fnr')} FROM rates")
def m_binary(spark, sf):
    return r(me.binary_rates(me.binary_counts(scored(spark, sf), ["model", "split"], "y", "pred"), ["model", "split"]), "model", "split")


STEPS = "steps AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model) AS all_p, sum(n) OVER (PARTITION BY model) AS all_n FROM (SELECT model, margin AS score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY model, margin) WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query("m_auroc", f"WITH {SCORED}, {STEPS} SELECT model, round(sum(p * (all_n - cn + n / 2.0::double)) / (any_value(all_p) * any_value(all_n)), 6) AS auroc FROM steps GROUP BY model")
def m_auroc(spark, sf):
    return r(me.auroc(scored(spark, sf), ["model"], "y", "margin"), "model")


@query("m_auprc", f"WITH {SCORED}, {STEPS} SELECT model, round(sum(p / all_p::double * (cp / (cp + cn)::double)), 6) AS auprc FROM steps GROUP BY model")
def m_auprc(spark, sf):
    return r(me.average_precision(scored(spark, sf), ["model"], "y", "margin"), "model")


@query("m_roc_points", f"WITH {SCORED}, {STEPS} SELECT model, round(score, 6) AS threshold, round(cn / all_n::double, 6) AS fpr, round(cp / all_p::double, 6) AS tpr FROM steps")
def m_roc_points(spark, sf):
    return r(me.roc_points(scored(spark, sf), ["model"], "y", "margin"), "model")


@query("m_pr_points", f"WITH {SCORED}, {STEPS} SELECT model, round(score, 6) AS threshold, round(cp / (cp + cn)::double, 6) AS precision, round(cp / all_p::double, 6) AS recall FROM steps")
def m_pr_points(spark, sf):
    return r(me.pr_points(scored(spark, sf), ["model"], "y", "margin"), "model")


@query("m_brier", f"WITH {SCORED} SELECT model, round(avg((1 / (1 + exp(-margin)) - y) ** 2), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-margin)) ELSE 1 / (1 + exp(margin)) END)), 6) AS log_loss, round(avg(-(CASE WHEN y = 1 THEN 0.25::double ELSE 0.75::double END) * (1 - CASE WHEN y = 1 THEN 1 / (1 + exp(-margin)) ELSE 1 / (1 + exp(margin)) END) ** 2 * ln(CASE WHEN y = 1 THEN 1 / (1 + exp(-margin)) ELSE 1 / (1 + exp(margin)) END)), 6) AS focal FROM scored GROUP BY model")
def m_brier(spark, sf):
    p, y = vec.sigmoid(F.col("margin")), F.col("y")
    own = F.when(y == 1, p).otherwise(vec.sigmoid(-F.col("margin")))
    return r(scored(spark, sf).groupBy("model").agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-F.log(own)).alias("log_loss"), F.avg(vec.focal_loss(p, y)).alias("focal")), "model")


@query("m_confusion", f"WITH {SCORED} SELECT model, y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model, y)::double, 6) AS of_row, round(count(*) / sum(count(*)) OVER (PARTITION BY model, pred)::double, 6) AS of_column, round(count(*) / sum(count(*)) OVER (PARTITION BY model)::double, 6) AS of_all FROM scored GROUP BY model, y, pred")
def m_confusion(spark, sf):
    return r(me.confusion(scored(spark, sf), ["model"], "y", "pred"), "model", "y", "pred", "n")


#: Five-class labels: the rank of an order's priority, with a prediction that is right for some.
CLASSES = "classes AS (SELECT o_orderstatus AS g, o_orderpriority[1]::int AS y, CASE WHEN (o_orderkey * 31 + o_custkey) % 10 < 6 THEN o_orderpriority[1]::int ELSE ((o_orderkey * 7 + o_custkey) % 6 + 1)::int END AS pred FROM orders)"


def classes(spark, sf):
    y = F.substring("o_orderpriority", 1, 1).cast("int")
    pred = F.when((F.col("o_orderkey") * 31 + F.col("o_custkey")) % 10 < 6, y).otherwise(((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 6 + 1).cast("int"))
    return read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), y.alias("y"), pred.alias("pred"))


_PER = "cc AS (SELECT g, label, sum(h)::double AS tp, sum(t)::double AS n_true, sum(p)::double AS n_pred FROM (SELECT g, y AS label, 1 AS t, 0 AS p, (y = pred)::int AS h FROM classes UNION ALL SELECT g, pred, 0, 1, 0 FROM classes) GROUP BY g, label), tot AS (SELECT *, sum(n_true) OVER (PARTITION BY g) AS total FROM cc), pc AS (SELECT g, label, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS precision, CASE WHEN n_true = 0 THEN 0 ELSE tp / n_true END AS recall, 2 * tp / (n_true + n_pred) AS f1, n_true AS support FROM tot)"


@query("m_per_class", f"WITH {CLASSES}, {_PER} SELECT g, label, {rs('precision', 'recall', 'f1')}, support::bigint AS support FROM pc")
def m_per_class(spark, sf):
    return r(me.per_class(classes(spark, sf), ["g"], "y", "pred"), "g", "label", "support")


@query("m_multiclass_macro", f"WITH {CLASSES}, {_PER} SELECT g, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pc GROUP BY g")
def m_multiclass_macro(spark, sf):
    return r(me.averaged(classes(spark, sf), ["g"], "y", "pred", "macro"), "g")


@query("m_multiclass_micro", f"WITH {CLASSES}, {_PER} SELECT g, round(sum(tp) / sum(n_pred), 6) AS precision, round(sum(tp) / sum(n_true), 6) AS recall, round(2 * sum(tp) / (sum(n_true) + sum(n_pred)), 6) AS f1 FROM tot GROUP BY g")
def m_multiclass_micro(spark, sf):
    return r(me.averaged(classes(spark, sf), ["g"], "y", "pred", "micro"), "g")


@query("m_multiclass_weighted", f"WITH {CLASSES}, {_PER} SELECT g, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM pc GROUP BY g")
def m_multiclass_weighted(spark, sf):
    return r(me.averaged(classes(spark, sf), ["g"], "y", "pred", "weighted"), "g")


@query("m_multiclass_rates", f"WITH {CLASSES}, {_PER}, q AS (SELECT g, tp, n_true - tp AS fn, n_pred - tp AS fp, total - n_true - n_pred + tp AS tn FROM tot) SELECT g, round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END), 6) AS tpr, round(avg(tn / (tn + fp)), 6) AS tnr, round(avg(fp / (fp + tn)), 6) AS fpr, round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / (tp + fn) END), 6) AS fnr FROM q GROUP BY g")
def m_multiclass_rates(spark, sf):
    return r(me.macro_rates(classes(spark, sf), ["g"], "y", "pred"), "g")


@query("m_multiclass_mcc", f"WITH {CLASSES}, {_PER} SELECT g, round((sum(tp) * any_value(total) - sum(n_true * n_pred)) / (sqrt(any_value(total) ** 2 - sum(n_pred ** 2)) * sqrt(any_value(total) ** 2 - sum(n_true ** 2))), 6) AS mcc FROM tot GROUP BY g")
def m_multiclass_mcc(spark, sf):
    return r(me.multiclass_mcc(classes(spark, sf), ["g"], "y", "pred"), "g")


@query("m_mean_iou", f"WITH {CLASSES}, {_PER} SELECT g, round(avg(tp / (n_true + n_pred - tp)), 6) AS mean_iou FROM tot GROUP BY g")
def m_mean_iou(spark, sf):
    return r(me.mean_iou(classes(spark, sf), ["g"], "y", "pred"), "g")


@query("m_auroc_ovr", f"WITH {CLASSES}, s AS (SELECT g, lab, (y = lab)::int AS y, ((y * 37 + pred * 11) % 17 + (pred = lab)::int * 8) AS margin FROM classes CROSS JOIN (SELECT unnest(range(1, 6)) AS lab)), st AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY g, lab) AS all_p, sum(n) OVER (PARTITION BY g, lab) AS all_n FROM (SELECT g, lab, margin, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY ALL) WINDOW w AS (PARTITION BY g, lab ORDER BY margin DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT g, lab, sum(p * (all_n - cn + n / 2.0::double)) / (any_value(all_p) * any_value(all_n)) AS auroc FROM st GROUP BY g, lab) SELECT g, round(avg(auroc), 6) AS auroc FROM a GROUP BY g")
def m_auroc_ovr(spark, sf):
    c = classes(spark, sf).select("g", "y", "pred", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("lab"))
    margin = (F.col("y") * 37 + F.col("pred") * 11) % 17 + (F.col("pred") == F.col("lab")).cast("int") * 8
    s = c.select("g", "lab", margin.alias("margin"), (F.col("y") == F.col("lab")).cast("int").alias("y"))
    return r(me.auroc(s, ["g", "lab"], "y", "margin").groupBy("g").agg(F.avg("auroc").alias("auroc")), "g")


#: Three labels of a line item, with noisy predictions.
MULTI = "multi AS (SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, [(l_discount > 0.05)::int, (l_tax > 0.04)::int, (l_quantity > 25)::int] AS y, [((l_discount > 0.05) <> (l_orderkey % 5 = 0))::int, ((l_tax > 0.04) <> (l_partkey % 4 = 0))::int, ((l_quantity > 25) <> (l_suppkey % 3 = 0))::int] AS pred FROM lineitem), long AS (SELECT g, id, i AS label, y[i] AS y, pred[i] AS pred FROM multi CROSS JOIN (SELECT unnest([1, 2, 3]) AS i))"


def multi(spark, sf):
    li = read_table(spark, sf, "lineitem")
    flip = lambda c, k: ((c) != k).cast("int")
    a, b, c = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 25
    return li.select(
        F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(a.cast("int"), b.cast("int"), c.cast("int")).alias("y"),
        F.array(flip(a, F.col("l_orderkey") % 5 == 0), flip(b, F.col("l_partkey") % 4 == 0), flip(c, F.col("l_suppkey") % 3 == 0)).alias("pred"),
    )


@query("m_multilabel", f"WITH {MULTI}, c AS (SELECT g, label, {_COUNTS} FROM long GROUP BY g, label), rates AS (SELECT g, {_RATES} FROM c) SELECT g, {', '.join(f'round(avg({x}), 6) AS {x}' for x in ('accuracy', 'precision', 'recall', 'f1', 'mcc', 'tpr', 'tnr', 'fpr', 'fnr'))} FROM rates GROUP BY g")
def m_multilabel(spark, sf):
    long = me.long_labels(multi(spark, sf), ["g"], "y", "pred")
    each = me.binary_rates(me.binary_counts(long, ["g", "label"], "y", "pred"), ["g"])
    return r(each.groupBy("g").agg(*[F.avg(c).alias(c) for c in each.columns if c != "g"]), "g")


@query("m_multilabel_micro", f"WITH {MULTI}, c AS (SELECT g, {_COUNTS} FROM long GROUP BY g), rates AS (SELECT g, {_RATES} FROM c) SELECT g, {rs('precision', 'recall', 'f1')} FROM rates")
def m_multilabel_micro(spark, sf):
    long = me.long_labels(multi(spark, sf), ["g"], "y", "pred")
    return r(me.binary_rates(me.binary_counts(long, ["g"], "y", "pred"), ["g"]).select("g", "precision", "recall", "f1"), "g")


@query("m_multilabel_samples", f"WITH {MULTI}, c AS (SELECT g, id, {_COUNTS} FROM long GROUP BY g, id), rates AS (SELECT g, {_RATES} FROM c) SELECT g, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM rates GROUP BY g")
def m_multilabel_samples(spark, sf):
    return r(me.samples_f1(me.long_labels(multi(spark, sf), ["g", "id"], "y", "pred"), ["g"], "id"), "g")


@query("m_multilabel_subset", f"WITH {MULTI} SELECT g, round(avg((y = pred)::int), 6) AS accuracy FROM multi GROUP BY g")
def m_multilabel_subset(spark, sf):
    return r(multi(spark, sf).groupBy("g").agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("accuracy")), "g")


@query("m_hamming", f"WITH {MULTI} SELECT g, round(avg((y <> pred)::int), 6) AS hamming FROM long GROUP BY g")
def m_hamming(spark, sf):
    return r(me.long_labels(multi(spark, sf), ["g"], "y", "pred").groupBy("g").agg(F.avg((F.col("y") != F.col("pred")).cast("int")).alias("hamming")), "g")


@query("multilabel_long", f"WITH {MULTI} SELECT label::int - 1 AS label, y, pred, count(*) AS n FROM long GROUP BY ALL")
def multilabel_long(spark, sf):
    return me.long_labels(multi(spark, sf), [], "y", "pred").groupBy("label", "y", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("multilabel_threshold", f"WITH {SCORED} SELECT row_id, model, [(1 / (1 + exp(-x)) > 0.5)::int for x in logits] AS labels FROM scored")
def multilabel_threshold(spark, sf):
    return scored(spark, sf).select("row_id", "model", scoring.label_prediction(F.col("logits")).alias("labels"))


REGR = "regr AS (SELECT l_returnflag AS g, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity * 1500 AS pred FROM lineitem)"


def regr(spark, sf):
    return read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"))


@query("m_regression", f"WITH {REGR} SELECT g, round(avg((y - pred) ** 2), 3) AS mse, round(avg(abs(y - pred)), 6) AS mae, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)), 3) AS r2, round(corr(y, pred), 6) AS pearson FROM regr GROUP BY g")
def m_regression(spark, sf):
    m = me.regression(regr(spark, sf), ["g"], "y", "pred")
    return m.select("g", F.round("mse", 3).alias("mse"), F.round("mae", 6).alias("mae"), "r2", F.round("pearson", 6).alias("pearson"))


@query("m_regression_multi", "WITH t AS (SELECT i, CASE i WHEN 1 THEN l_extendedprice WHEN 2 THEN l_quantity ELSE 1.0::double END AS y, CASE i WHEN 1 THEN l_quantity * 1400 WHEN 2 THEN l_discount * 500 ELSE l_tax END AS p FROM lineitem CROSS JOIN (SELECT unnest([1, 2, 3]) AS i)), m AS (SELECT i, avg(abs(y - p)) AS mae, CASE WHEN stddev_pop(y) > 0 AND stddev_pop(p) > 0 THEN corr(y, p) END AS pearson FROM t GROUP BY i) SELECT round(avg(mae), 6) AS mae, round(avg(pearson), 6) AS pearson FROM m")
def m_regression_multi(spark, sf):
    li = read_table(spark, sf, "lineitem")
    t = li.select(F.posexplode(F.array(F.struct(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1400).alias("p")), F.struct(F.col("l_quantity").alias("y"), (F.col("l_discount") * 500).alias("p")), F.struct(F.lit(1.0).alias("y"), F.col("l_tax").alias("p")))).alias("i", "z")).select("i", "z.*")
    m = t.groupBy("i").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), me.pearson("y", "p").alias("pearson"))
    return r(m.agg(F.avg("mae").alias("mae"), F.avg("pearson").alias("pearson")))


@query("m_spearman", f"WITH {REGR}, k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::double AS ry, rank() OVER (PARTITION BY g ORDER BY pred) + (count(*) OVER (PARTITION BY g, pred) - 1) / 2.0::double AS rp FROM regr) SELECT g, round(corr(ry, rp), 6) AS spearman FROM k GROUP BY g")
def m_spearman(spark, sf):
    return r(me.spearman(regr(spark, sf), ["g"], "y", "pred"), "g")


@query("m_mape", f"WITH {REGR} SELECT g, round(avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape FROM regr GROUP BY g")
def m_mape(spark, sf):
    return r(regr(spark, sf).groupBy("g").agg(me.mape(F.col("y"), F.col("pred")).alias("mape")), "g")


@query("m_smape", f"WITH {REGR} SELECT g, round(avg(2 * abs(y - pred) / (greatest(abs(y), 2.220446049250313e-16) + greatest(abs(pred), 2.220446049250313e-16))), 6) AS smape FROM regr GROUP BY g")
def m_smape(spark, sf):
    return r(regr(spark, sf).groupBy("g").agg(me.smape(F.col("y"), F.col("pred")).alias("smape")), "g")


@query("m_mase", f"WITH {REGR}, k AS (SELECT g, abs(y - pred) AS e, abs(y - lag(y, 2) OVER (PARTITION BY g ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, y)) AS n FROM regr) SELECT g, round(avg(e) / avg(n), 6) AS mase FROM k GROUP BY g")
def m_mase(spark, sf):
    return r(me.mase(regr(spark, sf), ["g"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"], "y", "pred", 2), "g")


@query("m_pass_at_k", "WITH t AS (SELECT user_id, count(*)::int AS n, sum((event_type = 'error')::int)::int AS c FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN c = 0 THEN 0 WHEN n - c < 5 THEN 1 ELSE 1 - list_product([1 - 5.0::double / i for i in range(n - c + 1, n + 1)]) END, 6) AS pass_at_5 FROM t")
def m_pass_at_k(spark, sf):
    t = read_table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).cast("int").alias("c"))
    return t.select("user_id", F.round(vec.pass_at_k(F.col("n"), F.col("c"), 5), 6).alias("pass_at_5"))


_EMB = "[x::double for x in embedding]"


def _rounded(digits: int):
    return lambda x: F.round(x, digits)


@query("attention_norms", f"WITH v AS (SELECT vec_id, {_EMB} AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS hi, list_min(v) AS lo, list_avg(v) AS mean, list_stddev_pop(v) AS sd, list_sum([abs(x) for x in v]) AS a1, sqrt(list_sum([x * x for x in v])) AS a2, list_sum([exp(x - list_max(v)) for x in v]) AS z FROM v) SELECT vec_id, [round(exp(x - hi) / z, 9) for x in v] AS softmax, [round((x - lo) / (hi - lo + 1e-8), 6) for x in v] AS minmax, [round(x / a1, 9) for x in v] AS l1, [round(x / a2, 9) for x in v] AS l2, [round((x - mean) / sd, 6) for x in v] AS z, round(-list_sum([exp(x - hi) / z * ln(exp(x - hi) / z) for x in v]), 6) AS entropy FROM m")
def attention_norms(spark, sf):
    v = F.col("v")
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    whole = [F.transform(f(v), _rounded(d)).alias(n) for n, f, d in (("softmax", vec.softmax, 9), ("minmax", vec.min_max, 6), ("l1", vec.l1, 9), ("l2", vec.l2, 9), ("z", vec.z_scores, 6))]
    return e.select("vec_id", *whole, F.round(vec.entropy(vec.softmax(v)), 6).alias("entropy"))


@query("minmax_norm", f"WITH v AS (SELECT vec_id, {_EMB} AS v FROM embeddings) SELECT vec_id, [round((x - list_min(v)) / (list_max(v) - list_min(v) + 1e-8), 6) for x in v] AS scaled FROM v")
def minmax_norm(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.transform(vec.min_max(F.col("v")), lambda x: F.round(x, 6)).alias("scaled"))


@query("pool_mean", f"SELECT label, i, round(avg(v), 6) AS mean FROM (SELECT label, unnest({_EMB}) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def pool_mean(spark, sf):
    e = read_table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("pool_first_last", f"SELECT label, arg_min({_EMB}, vec_id) AS first, arg_max({_EMB}, vec_id) AS last FROM embeddings GROUP BY label")
def pool_first_last(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return read_table(spark, sf, "embeddings").groupBy("label").agg(F.min_by(v, "vec_id").alias("first"), F.max_by(v, "vec_id").alias("last"))


@query("pool_center", f"WITH n AS (SELECT vec_id, label, {_EMB} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), c AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM n WHERE r BETWEEN n // 2 - 4 AND n // 2 + 5) SELECT label, i, round(avg(x), 6) AS mean FROM c GROUP BY label, i")
def pool_center(spark, sf):
    w = Window.partitionBy("label")
    half = F.floor(F.col("n") / 2)
    e = read_table(spark, sf, "embeddings").select("label", "embedding", F.row_number().over(w.orderBy("vec_id")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    c = e.where(F.col("r").between(half - 4, half + 5)).select("label", F.posexplode("embedding").alias("i", "x"))
    return c.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("zscore_outliers", "WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey), z AS (SELECT l_suppkey, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM m) SELECT l_suppkey, round(z, 6) AS z, z > 1.5 AS outlier FROM z")
def zscore_outliers(spark, sf):
    m = read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("v"))
    return me.outliers(m, "v").select("l_suppkey", F.round("z", 6).alias("z"), "outlier")


_NEAR = f"WITH m AS (SELECT i, avg(x) AS mean FROM (SELECT unnest({_EMB}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i), mm AS (SELECT list(mean ORDER BY i) AS mean FROM m), v AS (SELECT vec_id, [{_EMB}[i] - mean[i] for i in range(1, len(embedding) + 1)] AS v FROM embeddings, mm), s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT id, other, rank, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) WHERE rank <= 10"


@query("cosine_top10", _NEAR)
def cosine_top10(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    mean = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
    centred = e.crossJoin(F.broadcast(mean)).select("vec_id", F.zip_with("v", "ms", lambda x, m: x - m["m"]).alias("v"))
    top = me.nearest(centred.where("vec_id % 100 = 0"), centred, "vec_id", "v", 10)
    return top.select("id", "other", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("mahalanobis")
def mahalanobis(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return r(me.mahalanobis(e, "vec_id", "v", e), "vec_id", digits=4)


@query("seq_logprob", "WITH t AS (SELECT user_id, event_id, (user_id + event_id) % 4 AS tok, [value / 10, value / 20, (event_id % 7) / 3.0::double, 1.0::double] AS lg FROM events), k AS (SELECT *, lead(tok) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM t) SELECT user_id, round(sum(lg[nxt + 1] - list_max(lg) - ln(list_sum([exp(x - list_max(lg)) for x in lg]))), 5) AS log_prob, count(*) AS n FROM k WHERE nxt IS NOT NULL GROUP BY user_id")
def seq_logprob(spark, sf):
    e = read_table(spark, sf, "events")
    lg = F.array(F.col("value") / 10, F.col("value") / 20, (F.col("event_id") % 7) / F.lit(3.0), F.lit(1.0))
    t = e.select("user_id", "event_id", ((F.col("user_id") + F.col("event_id")) % 4).cast("int").alias("tok"), lg.alias("lg"))
    return r(scoring.sequence_log_prob(t, "user_id", "event_id", "tok", "lg"), "user_id", "n", digits=5)


TAGS = "tags AS (SELECT user_id AS row, event_id AS place, CASE event_type WHEN 'click' THEN 'B-UTR' WHEN 'view' THEN 'I-UTR' WHEN 'error' THEN 'O' ELSE 'I-CDS' END AS y, CASE WHEN event_id % 9 = 0 THEN 'O' WHEN event_type = 'click' THEN 'B-UTR' WHEN event_type = 'view' THEN 'I-UTR' WHEN event_type = 'error' THEN 'B-CDS' ELSE 'I-CDS' END AS pred FROM events)"


def _spans(tag: str) -> str:
    return f"(SELECT row, kind, min(place) AS a, max(place) + 1 AS b, arg_min(opens, place) AS opens FROM (SELECT *, sum(broken) OVER (PARTITION BY row ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT row, place, kind, opens, CASE WHEN opens = 1 OR kind IS NULL OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY row ORDER BY place) THEN 1 ELSE 0 END AS broken FROM (SELECT row, place, CASE WHEN {tag} <> 'O' THEN substr({tag}, 3) END AS kind, (left({tag}, 2) = 'B-')::int AS opens FROM tags))) WHERE kind IS NOT NULL GROUP BY row, kind, run HAVING arg_min(opens, place) = 1)"


def tags(spark, sf):
    e = read_table(spark, sf, "events")
    t = F.col("event_type")
    y = F.when(t == "click", "B-UTR").when(t == "view", "I-UTR").when(t == "error", "O").otherwise("I-CDS")
    pred = F.when(F.col("event_id") % 9 == 0, "O").when(t == "click", "B-UTR").when(t == "view", "I-UTR").when(t == "error", "B-CDS").otherwise("I-CDS")
    return e.select(F.col("user_id").alias("row"), F.col("event_id").alias("place"), y.alias("y"), pred.alias("pred"))


@query("m_token_entities", f"WITH {TAGS}, t AS {_spans('y')}, p AS {_spans('pred')}, j AS (SELECT coalesce(t.kind, p.kind) AS kind, t.row AS tr, p.row AS pr FROM t FULL JOIN p ON t.row = p.row AND t.kind = p.kind AND t.a = p.a AND t.b = p.b) SELECT kind, count(tr) AS n_true, count(pr) AS n_pred, sum((tr IS NOT NULL AND pr IS NOT NULL)::int)::bigint AS n_both, round(CASE WHEN count(pr) = 0 THEN 0 ELSE sum((tr IS NOT NULL AND pr IS NOT NULL)::int) / count(pr)::double END, 6) AS precision, round(CASE WHEN count(tr) = 0 THEN 0 ELSE sum((tr IS NOT NULL AND pr IS NOT NULL)::int) / count(tr)::double END, 6) AS recall, round(2 * sum((tr IS NOT NULL AND pr IS NOT NULL)::int) / (count(tr) + count(pr))::double, 6) AS f1 FROM j GROUP BY kind")
def m_token_entities(spark, sf):
    t = tags(spark, sf)
    return r(me.entity_scores(me.entity_spans(t, "row", "place", "y"), me.entity_spans(t, "row", "place", "pred"), "row"), "kind", "n_true", "n_pred", "n_both")


@query("m_token_report", f"WITH {TAGS}, classes AS (SELECT 'all' AS g, y, pred FROM tags), {_PER} SELECT label, {rs('precision', 'recall', 'f1')}, support::bigint AS support FROM pc")
def m_token_report(spark, sf):
    return r(me.per_class(tags(spark, sf), [], "y", "pred"), "label", "support")


RUN = "run AS (SELECT l_suppkey % 20 AS qid, l_partkey AS doc, max(l_extendedprice) AS score, max((l_quantity % 3)::int) AS rel FROM lineitem GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc) AS best FROM run), h AS (SELECT *, sum((rel > 0)::int) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits, sum((rel > 0)::int) OVER (PARTITION BY qid) AS n_rel FROM rk)"


def _ranking(spark, sf, depths=(5, 10, 100)):
    run = read_table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("qid"), F.col("l_partkey").alias("doc")).agg(F.max("l_extendedprice").alias("score"), F.max((F.col("l_quantity") % 3).cast("int")).alias("rel"))
    return me.ranking(run.select("qid", "doc", "score"), run.select("qid", "doc", "rel"), depths)


@query("m_map", f"WITH {RUN} SELECT qid, round(sum(CASE WHEN rel > 0 THEN hits / rank::double ELSE 0 END) / any_value(n_rel), 6) AS ap, round(sum((rel > 0 AND rank <= n_rel)::int) / any_value(n_rel)::double, 6) AS r_precision FROM h WHERE n_rel > 0 GROUP BY qid")
def m_map(spark, sf):
    return r(_ranking(spark, sf).select("qid", "ap", "r_precision"), "qid")


@query("m_mrr", f"WITH {RUN} SELECT qid, round(max(CASE WHEN rel > 0 THEN 1 / rank::double ELSE 0 END), 6) AS rr FROM h WHERE n_rel > 0 GROUP BY qid")
def m_mrr(spark, sf):
    return r(_ranking(spark, sf).select("qid", "rr"), "qid")


@query("m_precision_at_k", f"WITH {RUN} SELECT qid, " + ", ".join(f"round(sum((rel > 0 AND rank <= {k})::int) / {k}::double, 6) AS p_{k}" for k in (5, 10, 100)) + " FROM h WHERE n_rel > 0 GROUP BY qid")
def m_precision_at_k(spark, sf):
    return r(_ranking(spark, sf).select("qid", "p_5", "p_10", "p_100"), "qid")


@query("m_ndcg", f"WITH {RUN} SELECT qid, " + ", ".join(f"round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= {k} AND rel > 0 THEN rel / log2(best + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (5, 10, 100)) + " FROM h WHERE n_rel > 0 GROUP BY qid")
def m_ndcg(spark, sf):
    return r(_ranking(spark, sf).select("qid", "ndcg_5", "ndcg_10", "ndcg_100"), "qid")
