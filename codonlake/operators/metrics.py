"""Evaluation metrics as grouped aggregations.

Every metric takes rows and the columns to group by (none for one value), so many models or splits are evaluated in one
pass. Metrics that need an order first aggregate to distinct scores, so the window runs over those, not over rows.
A metric that isn't defined (one class only, no spread) is null; a ratio 0/0 in precision, recall and F1 is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codonlake.session import running_totals

def _zero_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _count(c: Column) -> Column:
    return F.count_if(c)


def binary_counts(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., tp, fp, fn, tn)."""
    t, p = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(_count(t & p).alias("tp"), _count(~t & p).alias("fp"), _count(t & ~p).alias("fn"), _count(~t & ~p).alias("tn"))


def binary_rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1, MCC and the four rates from ``binary_counts``."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    norm = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        *by, F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), _zero_ratio(tp, tp + fp).alias("precision"), _zero_ratio(tp, tp + fn).alias("recall"),
        _zero_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _zero_ratio(tp * tn - fp * fn, norm).alias("mcc"),
        F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(tn, tn + fp).alias("tnr"), F.try_divide(fp, fp + tn).alias("fpr"), F.try_divide(fn, fn + tp).alias("fnr"),
    )


def score_steps(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """(by..., score, p, n, cp, cn, tp_all, fp_all): positives and negatives at each distinct score, running sums from
    the highest score, and totals."""
    steps = df.groupBy(*by, F.col(score).alias("score")).agg(_count(F.col(y) == 1).alias("p"), _count(F.col(y) != 1).alias("n"))
    run = running_totals(steps, by, "score", {"p": "cp", "n": "cn"}, descending=True)
    totals = df.groupBy(*by).agg(_count(F.col(y) == 1).alias("all_p"), _count(F.col(y) != 1).alias("all_n"))
    if not by:
        return run.crossJoin(F.broadcast(totals))
    named = totals.select(*[F.col(c).alias(f"__t_{c}") for c in by], "all_p", "all_n")
    return run.join(named, [F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in by]).drop(*[f"__t_{c}" for c in by])


def auroc(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """(by..., auroc): the chance that a positive scores above a negative, ties counted half."""
    s = score_steps(df, by, y, score)
    wins = F.sum(F.col("p") * (F.col("all_n") - F.col("cn") + F.col("n") / 2))
    return s.groupBy(*by).agg(F.try_divide(wins, (F.first("all_p") * F.first("all_n")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """(by..., auprc): the sum over distinct thresholds of the gain in recall times the precision."""
    s = score_steps(df, by, y, score)
    return s.groupBy(*by).agg(F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("auprc"))


def roc_points(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    s = score_steps(df, by, y, score)
    return s.select(*by, F.col("score").alias("threshold"), F.try_divide("cn", "all_n").alias("fpr"), F.try_divide("cp", "all_p").alias("tpr"))


def pr_points(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    s = score_steps(df, by, y, score)
    return s.select(*by, F.col("score").alias("threshold"), (F.col("cp") / (F.col("cp") + F.col("cn"))).alias("precision"), F.try_divide("cp", "all_p").alias("recall"))


def confusion(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., y, pred, n, of_row, of_column, of_all)."""
    c = df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda *k: F.col("n") / F.sum("n").over(Window.partitionBy(*by, *k))
    return c.select("*", share("y").alias("of_row"), share("pred").alias("of_column"), share().alias("of_all"))


def class_counts(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., label, tp, n_true, n_pred, total) of every label seen in truth or prediction."""
    c = df.groupBy(*by, F.col(y).alias("__y"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    sides = c.select(*by, F.explode(F.array(
        F.struct(F.col("__y").alias("label"), F.col("__n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("__y") == F.col("__p"), F.col("__n")).otherwise(0).alias("h")),
        F.struct(F.col("__p").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("__n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )).alias("s")).select(*by, "s.*")
    out = sides.where("label is not null").groupBy(*by, "label").agg(F.sum("h").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    return out.withColumn("total", F.sum("n_true").over(Window.partitionBy(*by)))


def per_class(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., label, precision, recall, f1, support)."""
    c = class_counts(df, by, y, pred)
    return c.select(*by, "label", _zero_ratio(F.col("tp"), F.col("n_pred")).alias("precision"), _zero_ratio(F.col("tp"), F.col("n_true")).alias("recall"), _zero_ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")).alias("f1"), F.col("n_true").alias("support"))


def averaged(df: DataFrame, by: list[str], y: str, pred: str, how: str) -> DataFrame:
    """(by..., precision, recall, f1) by ``macro``, ``micro`` or ``weighted`` averaging."""
    if how == "micro":
        tp, t, p = (F.sum(c) for c in ("tp", "n_true", "n_pred"))
        return class_counts(df, by, y, pred).groupBy(*by).agg(_zero_ratio(tp, p).alias("precision"), _zero_ratio(tp, t).alias("recall"), _zero_ratio(2 * tp, t + p).alias("f1"))
    each = per_class(df, by, y, pred)
    if how == "macro":
        return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    if how == "weighted":
        return each.groupBy(*by).agg(*[_zero_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])
    raise ValueError(f"unknown averaging {how}")


def macro_rates(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., tpr, tnr, fpr, fnr): one-against-rest rates averaged over labels."""
    tp, t, p, n = (F.col(c).cast("double") for c in ("tp", "n_true", "n_pred", "total"))
    fp, fn = p - tp, t - tp
    tn = n - t - fp
    c = class_counts(df, by, y, pred).select(*by, _zero_ratio(tp, t).alias("tpr"), _zero_ratio(tn, tn + fp).alias("tnr"), _zero_ratio(fp, fp + tn).alias("fpr"), _zero_ratio(fn, t).alias("fnr"))
    return c.groupBy(*by).agg(*[F.avg(x).alias(x) for x in ("tpr", "tnr", "fpr", "fnr")])


def multiclass_mcc(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., mcc) from the sums of the confusion matrix; 0 if truth or prediction has one label."""
    c = class_counts(df, by, y, pred).groupBy(*by).agg(
        F.sum("tp").cast("double").alias("c"), F.first("total").cast("double").alias("s"), F.sum(F.col("n_true").cast("double") * F.col("n_pred")).alias("tp"),
        F.sum(F.col("n_pred").cast("double") * F.col("n_pred")).alias("pp"), F.sum(F.col("n_true").cast("double") * F.col("n_true")).alias("tt"),
    )
    s2 = F.col("s") * F.col("s")
    return c.select(*by, _zero_ratio(F.col("c") * F.col("s") - F.col("tp"), F.sqrt(s2 - F.col("pp")) * F.sqrt(s2 - F.col("tt"))).alias("mcc"))


def pearson(y: Column | str, p: Column | str) -> Column:
    """Correlation as an aggregate; null if either side doesn't vary."""
    return F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def regression(df: DataFrame, by: list[str], y: str, pred: str, digits: int | None = 3) -> DataFrame:
    """(by..., mse, mae, r2, pearson); r2 is rounded to ``digits`` unless that is None."""
    e = F.col(y) - F.col(pred)
    g = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("__e"), (F.var_pop(y) * F.count(y)).alias("__t"), pearson(y, pred).alias("pearson"))
    r2 = 1 - F.try_divide("__e", "__t")
    return g.select(*by, "mse", "mae", (F.round(r2, digits) if digits is not None else r2).alias("r2"), "pearson")


def mean_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Distinct values of each group with their average rank from 1."""
    v = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    run = running_totals(v, by, value, {"__c": "__upto"})
    return run.select(*by, value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(out))


def spearman(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., spearman): correlation of average ranks, over distinct pairs weighted by their rows."""
    pairs = df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("__w"))
    ranked = pairs.join(mean_rank(df, by, y, "ry"), [*by, y]).join(mean_rank(df, by, pred, "rp"), [*by, pred])
    w, a, b = F.col("__w"), F.col("ry"), F.col("rp")
    m = ranked.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    n = F.col("n")
    va, vb, ab = n * F.col("aa") - F.col("a") * F.col("a"), n * F.col("bb") - F.col("b") * F.col("b"), n * F.col("ab") - F.col("a") * F.col("b")
    return m.select(*by, F.try_divide(ab, F.sqrt(va) * F.sqrt(vb)).alias("spearman"))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16)))


def smape(y: Column, p: Column) -> Column:
    eps = F.lit(2.220446049250313e-16)
    return F.avg(2 * F.abs(y - p) / (F.greatest(F.abs(y), eps) + F.greatest(F.abs(p), eps)))


def mase(df: DataFrame, by: list[str], order: list[str], y: str, pred: str, period: int = 1) -> DataFrame:
    """(by..., mase): mean absolute error over that of repeating the value ``period`` places before."""
    naive = F.abs(F.col(y) - F.lag(y, period).over(Window.partitionBy(*by).orderBy(*order)))
    e = df.select(*by, F.abs(F.col(y) - F.col(pred)).alias("__e"), naive.alias("__n"))
    return e.groupBy(*by).agg(F.try_divide(F.avg("__e"), F.greatest(F.avg("__n"), F.lit(2.220446049250313e-16))).alias("mase"))


def mean_iou(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., mean_iou): intersection over union by label, averaged over labels that occur."""
    c = class_counts(df, by, y, pred).select(*by, (F.col("tp") / (F.col("n_true") + F.col("n_pred") - F.col("tp"))).alias("iou"))
    return c.groupBy(*by).agg(F.avg("iou").alias("mean_iou"))


def long_labels(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """(keys..., label, y, pred) from arrays of true and predicted labels."""
    return df.select(*keys, F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(pred).alias("pred"))).alias("label", "z")).select(*keys, "label", F.col("z.y").alias("y"), F.col("z.pred").alias("pred"))


def samples_f1(long: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by..., precision, recall, f1) of multi-label rows, averaged over rows."""
    c = binary_counts(long, [*by, row], "y", "pred")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = c.select(*by, _zero_ratio(tp, tp + fp).alias("precision"), _zero_ratio(tp, tp + fn).alias("recall"), _zero_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def entity_spans(tokens: DataFrame, row: str, place: str, tag: str) -> DataFrame:
    """(row, kind, span_start, span_end) of the entities of B-/I-/O tags, strictly: an I- tag goes on with the entity
    before it only if that has its kind; any other I- tag begins none."""
    w = Window.partitionBy(row).orderBy(place)
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substring(tag, 3, 1000))
    t = tokens.select(row, place, tag, kind.alias("__kind"), F.when(F.col(tag).startswith("B-"), 1).otherwise(0).alias("__b"), F.lag(kind).over(w).alias("__before"))
    broken = (F.col("__b") == 1) | F.col("__kind").isNull() | ~F.col("__kind").eqNullSafe(F.col("__before"))
    run = F.sum(F.when(broken, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = t.withColumn("__run", run).where("__kind is not null").groupBy(row, "__run", F.col("__kind").alias("kind"))
    found = runs.agg(F.min(place).alias("span_start"), (F.max(place) + 1).alias("span_end"), F.max_by("__b", -F.col(place)).alias("__opens"))
    return found.where("__opens = 1").select(row, "kind", "span_start", "span_end")


def entity_scores(true: DataFrame, pred: DataFrame, row: str) -> DataFrame:
    """(kind, n_true, n_pred, n_both, precision, recall, f1) of entity spans that agree in place and kind."""
    keys = [row, "kind", "span_start", "span_end"]
    both = true.select(*keys, F.lit(1).alias("t")).join(pred.select(*keys, F.lit(1).alias("p")), keys, "full_outer")
    c = both.groupBy("kind").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("n_both"))
    hit = F.col("n_both")
    return c.select("*", _zero_ratio(hit, F.col("n_pred")).alias("precision"), _zero_ratio(hit, F.col("n_true")).alias("recall"), _zero_ratio(2 * hit, F.col("n_true") + F.col("n_pred")).alias("f1"))


def mahalanobis(df: DataFrame, id_col: str, vector: str, reference: DataFrame) -> DataFrame:
    """(id, mahalanobis): squared distance of each vector to the reference vectors, less their grand mean.

    All places of a vector count. A vector that is null or holds a null has a null distance and is left out of the
    reference; vectors of several lengths are an error; with fewer than two reference vectors all distances are null. The
    covariance is added up from partial sums of Arrow batches about the means, so the driver gets one number for each pair
    of places, whatever the rows, and inverts it.
    """
    import numpy as np

    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    used = reference.where(whole(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    rows = df.select(F.col(id_col), F.when(whole(vector), F.col(vector).cast("array<double>")).alias("v"))
    lengths = {r["n"] for r in used.select(F.size("v").alias("n")).union(rows.where("v is not null").select(F.size("v").alias("n"))).distinct().limit(2).collect()}
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    size = lengths.pop() if lengths else 0
    n = used.count()
    if n < 2 or size == 0:
        return rows.select(id_col, F.lit(None).cast("double").alias("mahalanobis"))
    means = np.zeros(size)
    for r in used.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect():
        means[r["i"]] = r["m"]
    upper = np.triu_indices(size)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["place", "x"])

    cov = np.zeros((size, size))
    for r in used.mapInArrow(gram, "place bigint, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
        i, j = upper[0][r["place"]], upper[1][r["place"]]
        cov[i, j] = cov[j, i] = r["x"] / (n - 1)
    inverse, mean = np.linalg.pinv(cov), float(means.mean())

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            known = v.is_valid().to_numpy(zero_copy_only=False)
            x = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean
            got = np.zeros(len(known))
            got[known] = ((x @ inverse) * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, mask=~known)], [id_col, "mahalanobis"])

    return rows.mapInArrow(distances, StructType([rows.schema[id_col], StructField("mahalanobis", DoubleType())]))


def ranking(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (5, 10, 15, 20, 30, 100, 200, 500, 1000)) -> DataFrame:
    """Per query: average precision, reciprocal rank, R-precision, precision and NDCG at depths.

    ``run`` (qid, doc, score), ``qrels`` (qid, doc, rel). Ties in score are ranked by document. Documents without a
    judgement count as not relevant; queries without a relevant document are left out.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    ranked = run.select("qid", "doc", rank.alias("rank")).join(qrels, ["qid", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc"))
    ideal = qrels.where("rel > 0").withColumn("rank", ideal_rank)
    gain = F.col("rel") / F.log2(F.col("rank") + 1.0)
    best = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"), *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"ideal_{k}") for k in depths])
    r = ranked.withColumn("hits", hits).join(best, "qid")
    relevant = F.col("rel") > 0
    aggs = [F.first("n_rel").alias("n_rel"), (F.sum(F.when(relevant, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.first("n_rel")).alias("ap"), F.max(F.when(relevant, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"),
            (F.sum(F.when(relevant & (F.col("rank") <= F.col("n_rel")), 1).otherwise(0)) / F.first("n_rel")).alias("r_precision")]
    for k in depths:
        aggs.append((F.sum(F.when(relevant & (F.col("rank") <= k), 1).otherwise(0)) / k).alias(f"p_{k}"))
        aggs.append((F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)) / F.first(f"ideal_{k}")).alias(f"ndcg_{k}"))
    return r.groupBy("qid").agg(*aggs)


def nearest(left: DataFrame, right: DataFrame, id_col: str, vector: str, top: int) -> DataFrame:
    """(id, other, similarity, rank): the ``top`` most similar rows of ``right`` for each row of ``left`` by cosine.

    ``right`` is taken in blocks: each left row keeps its best of a block, and the bests of the blocks are merged, so no
    task holds all pairs of a row.
    """
    from codonlake.functions import vectors as vec

    blocks = 16
    l_ = left.select(F.col(id_col).alias("id"), F.col(vector).alias("__a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__k"))
    r_ = right.select(F.col(id_col).alias("other"), F.col(vector).alias("__b"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("__k"))
    sims = l_.join(r_, "__k").where("id <> other").select("id", "__k", "other", F.round(vec.cosine(F.col("__a"), F.col("__b")), 9).alias("similarity"))
    best = lambda *k: F.row_number().over(Window.partitionBy("id", *k).orderBy(F.desc("similarity"), "other"))
    part = sims.withColumn("__r", best("__k")).where(F.col("__r") <= top)
    return part.select("id", "other", "similarity", best().alias("rank")).where(F.col("rank") <= top)


def pairwise_auroc(df: DataFrame, by: list[str], y: str, scores: str) -> DataFrame:
    """(by..., auroc): for each pair of classes, the mean of both one-against-one areas, averaged over pairs.

    ``scores`` is an array with a score for each class, numbered from 0.
    """
    classes = F.sequence(F.lit(0), F.size(scores) - 1)
    own = df.select(*by, F.col(y).alias("__y"), F.col(scores).alias("__s"), F.explode(classes).alias("__o")).where("__o <> __y")
    rows = own.select(*by, F.explode(F.array(
        F.struct(F.col("__y").alias("a"), F.col("__o").alias("b"), F.lit(1).alias("t"), F.get("__s", F.col("__y")).alias("v")),
        F.struct(F.col("__o").alias("a"), F.col("__y").alias("b"), F.lit(0).alias("t"), F.get("__s", F.col("__o")).alias("v")),
    )).alias("z")).select(*by, "z.*")
    return auroc(rows, [*by, "a", "b"], "t", "v").groupBy(*by).agg(F.avg("auroc").alias("auroc"))


def bpref(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, bpref): for each relevant document found, one less the share of judged irrelevant documents above it."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    n = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("r"), F.count_if(F.col("rel") <= 0).alias("n")).where("r > 0")
    judged = run.select("qid", "doc", rank.alias("rank")).join(qrels, ["qid", "doc"])
    above = F.sum((F.col("rel") <= 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = judged.withColumn("above", above).join(n, "qid")
    least = F.least("r", "n")
    term = F.when(F.col("rel") > 0, 1 - F.when(least > 0, F.least("above", least) / least).otherwise(0.0)).otherwise(0.0)
    return part.groupBy("qid").agg((F.sum(term) / F.first("r")).alias("bpref"))


def geometric_mean(df: DataFrame, value: str, least: float = 1e-5) -> DataFrame:
    """(mean): the geometric mean, values below ``least`` counted as it."""
    return df.agg(F.exp(F.avg(F.log(F.greatest(F.col(value), F.lit(least))))).alias("mean"))


def precision_at(top: DataFrame, relevant: str, by: str, k: int = 10) -> DataFrame:
    """(by, precision) of ranked rows (by, rank, ...) with a flag for relevant ones."""
    return top.where(F.col("rank") <= k).groupBy(by).agg((F.count_if(relevant) / k).alias("precision"))


#: The label of tokens that aren't to be scored.
IGNORED = "-100"


def token_summary(tokens: DataFrame, row: str, place: str, y: str, pred: str) -> DataFrame:
    """(precision, recall, f1, accuracy): entities of all kinds together, and the share of tokens with the right tag. Tokens
    labelled -100 are dropped first."""
    used = tokens.where(F.col(y).isNull() | (F.col(y).cast("string") != IGNORED))
    kinds = entity_scores(entity_spans(used, row, place, y), entity_spans(used, row, place, pred), row)
    sums = kinds.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_true", "n_pred", "n_both")])
    hit = F.col("n_both")
    micro = sums.select(_zero_ratio(hit, F.col("n_pred")).alias("precision"), _zero_ratio(hit, F.col("n_true")).alias("recall"), _zero_ratio(2 * hit, F.col("n_true") + F.col("n_pred")).alias("f1"))
    return micro.crossJoin(used.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy")))


def label_rows(df: DataFrame, by: list[str], y: str, scores: str, many: bool = False) -> DataFrame:
    """(by..., label, y, score): each label of each row against the rest, from a class number and its scores, or with
    ``many`` from an array of 0 and 1."""
    each = df.select(*by, F.col(y).alias("__y"), F.posexplode(scores).alias("label", "score"))
    truth = F.get("__y", F.col("label")) if many else (F.col("__y") == F.col("label"))
    return each.select(*by, "label", truth.cast("int").alias("y"), "score").where("y is not null and score is not null")


def mean_of_labels(df: DataFrame, by: list[str], y: str, scores: str, many: bool = False) -> DataFrame:
    """(by..., auroc, auprc): areas of each label against the rest, averaged over labels that have both sides."""
    rows = label_rows(df, by, y, scores, many)
    keys = [*by, "label"]
    areas = auroc(rows, keys, "y", "score").join(average_precision(rows, keys, "y", "score"), keys)
    return areas.where("auroc is not null").groupBy(*by).agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))


def regression_outputs(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., mse, mae, r2, pearson, spearman) of arrays of outputs: the means over outputs; correlations over those that
    vary on both sides, 0 if none does."""
    long = long_labels(df, by, y, pred)
    keys = [*by, "label"]
    each = regression(long, keys, "y", "pred", None).join(spearman(long, keys, "y", "pred"), keys)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("mse", "mae", "r2")], mean("pearson"), mean("spearman"))


def outliers(df: DataFrame, value: str, limit: float = 1.5) -> DataFrame:
    """``df`` with ``z``, the value less the mean in sample standard deviations, and ``outlier``, whether that is above the
    limit."""
    s = df.agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", z).withColumn("outlier", F.col("z") > limit).drop("__mean", "__sd")
