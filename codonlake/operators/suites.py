"""Metric suites by task name, and run-to-run reliability. Each suite is a choice among the metrics of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.operators import benchmark as be
from codonlake.functions import text as tx
from codonlake.operators import metrics as me
from codonlake.operators import text_metrics as tm

# The metric family of each sub-task of the public suites.
GLUE = {"cola": "mcc", "stsb": "correlation", "mrpc": "accuracy_f1", "qqp": "accuracy_f1"} | dict.fromkeys(
    ("sst2", "mnli", "mnli_mismatched", "mnli_matched", "qnli", "rte", "wnli", "hans"), "accuracy"
)
SUPER_GLUE = {"axb": "mcc", "cb": "accuracy_macro_f1"} | dict.fromkeys(("copa", "rte", "wic", "wsc", "boolq", "axg"), "accuracy")
XTREME_S = {"fleurs-lang_id": "accuracy", "minds14": "accuracy_f1", "covost2": "corpus_score", "fleurs-asr": "error_rates", "mls": "error_rates", "voxpopuli": "error_rates", "babel": "error_rates"}
XNLI = {"xnli": "accuracy"}
TASKS = {
    "binary": "binary", "multiclass": "multiclass", "multi_class": "multiclass", "regression": "regression",
    "binary_classification": "binary", "multi_class_classification": "multiclass",
}


def accuracy(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def _join(by: list[str], *parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p) if not by else out.join(p, by)
    return out


def _accuracy_f1(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return me.binary_rates(me.binary_counts(df, by, y, pred), by).select(*by, "accuracy", "f1")


def _mcc(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return me.multiclass_mcc(df, by, y, pred)


def _correlation(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return _join(by, me.regression(df, by, y, pred).select(*by, "pearson"), me.spearman(df, by, y, pred))


def _accuracy_macro_f1(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return _join(by, accuracy(df, by, y, pred), me.averaged(df, by, y, pred, "macro").select(*by, "f1"))


def _multiclass(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    parts = [accuracy(df, by, y, pred), me.multiclass_mcc(df, by, y, pred), me.macro_rates(df, by, y, pred)]
    for how in ("macro", "micro", "weighted"):
        a = me.averaged(df, by, y, pred, how)
        parts.append(a.select(*by, *[F.col(c).alias(f"{how}_{c}") for c in ("precision", "recall", "f1")]))
    return _join(by, *parts)


def _corpus_score(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    if by:
        raise ValueError("a corpus score is of a whole table")
    d = df.select(F.lit(1).alias("id"), tx.tokens_13a(F.col(pred)).alias("p"), tx.tokens_13a(F.col(y)).alias("r"))
    return tm.smoothed_bleu(tm.ngram_matches(d, "id", F.col("p"), F.col("r"), 4), tm.lengths(d, F.col("p"), F.col("r"), "closest"))


def error_rates(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    """(by..., wer, cer): edits of words and of characters over those of the references."""
    p, r = tx.words(F.col(pred)), tx.words(F.col(y))
    wer = F.try_divide(F.sum(tx.word_distance(p, r)), F.sum(F.size(r)))
    return df.groupBy(*by).agg(wer.alias("wer"), F.try_divide(F.sum(F.levenshtein(pred, y)), F.sum(F.length(y))).alias("cer"))


def simplification(df: DataFrame, source: str, pred: str, refs: str) -> DataFrame:
    """(sari, bleu, exact), each from 0 to 100: simplification scores of a whole table; ``refs`` is an array of texts, and
    ``exact`` is the share of texts that equal a reference as normalised answers."""
    right = F.exists(refs, lambda x: tx.normal_answer(x) == tx.normal_answer(F.col(pred)))
    rows = df.select(tm.sari(F.col(source), F.col(pred), F.col(refs)).alias("s"), right.cast("double").alias("e")).agg(F.avg("s").alias("sari"), (100 * F.avg("e")).alias("exact"))
    d = df.select(F.lit(1).alias("id"), tx.tokens_13a(F.col(pred)).alias("p"), F.transform(refs, tx.tokens_13a).alias("r"))
    score = tm.smoothed_bleu(tm.ngram_matches(d, "id", F.col("p"), F.col("r"), 4), tm.lengths(d, F.col("p"), F.col("r"), "closest"))
    return rows.crossJoin(score).select("sari", "bleu", "exact")


FAMILIES: dict[str, Callable[[DataFrame, list[str], str, str], DataFrame]] = {
    "accuracy": accuracy, "accuracy_f1": _accuracy_f1, "mcc": _mcc, "correlation": _correlation, "corpus_score": _corpus_score, "error_rates": error_rates, "accuracy_macro_f1": _accuracy_macro_f1,
    "binary": lambda df, by, y, pred: me.binary_rates(me.binary_counts(df, by, y, pred), by), "multiclass": _multiclass,
    "regression": lambda df, by, y, pred: _join(by, me.regression(df, by, y, pred), me.spearman(df, by, y, pred)),
}


def evaluate(df: DataFrame, task: str, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """(by..., metric, value): the metrics of a task, of ``glue/NAME``, ``super_glue/NAME``, ``xtreme_s/NAME`` or ``xnli``."""
    suite, _, name = task.partition("/")
    known = {"glue": GLUE, "super_glue": SUPER_GLUE, "xtreme_s": XTREME_S, "xnli": XNLI}.get(suite, TASKS)
    family = known.get(name or suite)
    if family is None:
        raise ValueError(f"no metrics for task {task}")
    return be.long_metrics(FAMILIES[family](df, by, y, pred), by)


def question_scores(df: DataFrame, question: str, y: str, pred: str) -> DataFrame:
    """(macro_f1, all_correct, answer_f1) of answers that belong to questions: the mean over questions of the macro F1 of
    their answers, the share of questions with all answers right, and the F1 of all answers."""
    per = me.averaged(df, [question], y, pred, "macro").agg(F.avg("f1").alias("macro_f1"))
    whole = df.groupBy(question).agg(F.min((F.col(y) == F.col(pred)).cast("double")).alias("ok")).agg(F.avg("ok").alias("all_correct"))
    flat = me.binary_rates(me.binary_counts(df, [], y, pred), []).select(F.col("f1").alias("answer_f1"))
    return per.crossJoin(whole).crossJoin(flat)


def dispersion_within_runs(df: DataFrame, run: str, step: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(run, iqr, mad, sd, drawdown, cvar): spread of the changes from step to step, the largest fall below the best value
    so far, and the mean of the worst ``alpha`` of changes."""
    w = Window.partitionBy(run).orderBy(step)
    d = df.select(run, (F.col(value) - F.lag(value).over(w)).alias("d"), (F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)).alias("fall"))
    q = d.groupBy(run).agg(F.percentile("d", [0.25, 0.5, 0.75, alpha]).alias("q"), F.stddev_pop("d").alias("sd"), F.max("fall").alias("drawdown"))
    both = d.where("d is not null").join(q, run)
    out = both.groupBy(run).agg(F.first("q").alias("q"), F.first("sd").alias("sd"), F.first("drawdown").alias("drawdown"), F.percentile(F.abs(F.col("d") - F.col("q")[1]), 0.5).alias("mad"), F.avg(F.when(F.col("d") <= F.col("q")[3], F.col("d"))).alias("cvar"))
    return out.select(run, (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mad", "sd", "drawdown", "cvar")


def dispersion_across_runs(df: DataFrame, step: str, value: str) -> DataFrame:
    """(step, iqr, sd, median): spread over runs at each step."""
    q = df.groupBy(step).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("q"), F.stddev_pop(value).alias("sd"))
    return q.select(step, (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "sd", F.col("q")[1].alias("median"))
