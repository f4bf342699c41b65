"""Scoring sequences: the native k-mer scorer, the protocol for models of one's own, and predictions from scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions import vectors as vec

K = 3
#: Score units of the native scorer in one unit of logit.
SCALE = 10.0


def kmer_weight(kmer: str) -> float:
    """The native scorer's weight of a 3-mer, from its number in base 4; 0 with a letter outside A, C, G and T."""
    if len(kmer) != K or set(kmer) - set("ACGT"):
        return 0.0
    code = 0
    for b in kmer:
        code = code * 4 + "ACGT".index(b)
    return ((code * 37 + 11) % 101 - 50) / 100


def base_codes(letters: Column) -> Column:
    """The place of each letter in ACGT, -1 for any other, from an array of letters."""
    return F.transform(letters, lambda c: (F.call_function("instr", F.lit("ACGT"), c) - 1).cast("int"))


def kmer_weights(codes: Column) -> Column:
    """The weights of all overlapping 3-mers in order, from ``base_codes``; empty for fewer than 3."""
    n = F.size(codes)
    each = F.transform(F.sequence(F.lit(0), n - K), lambda i: weight_of_codes(F.get(codes, i), F.get(codes, i + 1), F.get(codes, i + 2)))
    return F.when(n >= K, each).otherwise(F.array().cast("array<double>"))


def weight_sum(seq: Column) -> Column:
    """The sum of the weights of all overlapping 3-mers; 0.0 for shorter sequences."""
    return F.when(F.length(seq) >= K, vec.let(base_codes(F.split(seq, "")), lambda c: vec.total(kmer_weights(c)))).otherwise(F.lit(0.0))


def weight_of_codes(a: Column, b: Column, c: Column) -> Column:
    """The weight of three bases by their places in ACGT; 0.0 where one is negative or null."""
    table = F.array(*[F.lit(kmer_weight("".join(m))) for m in product("ACGT", repeat=K)])
    return F.when((a >= 0) & (b >= 0) & (c >= 0), F.get(table, a * 16 + b * 4 + c)).otherwise(F.lit(0.0))


def probability(score: Column) -> Column:
    return vec.sigmoid(score / SCALE)


def score_with(df: DataFrame, model: Callable[[], Callable[[pd.Series], pd.Series]], seq: str = "sequence", out: str = "logits") -> DataFrame:
    """Add the logits a model gives to each sequence. ``model`` is called once in a worker and returns what is applied
    to each batch: a series of sequences to a series of lists of floats."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = model()
        for b in batches:
            yield b.assign(**{out: apply(b[seq])})

    return df.mapInPandas(run, schema)


def binary_prediction(logits: Column, threshold: float = 0.5) -> Column:
    """Struct (prob, pred): probability of class 1 and whether it is above the threshold."""
    p = vec.softmax(logits)[1]
    return F.struct(p.alias("prob"), (p > threshold).cast("int").alias("pred"))


def class_prediction(logits: Column) -> Column:
    p = vec.softmax(logits)
    return F.struct(F.array_max(p).alias("prob"), vec.argmax(logits).alias("pred"))


def label_prediction(logits: Column, threshold: float = 0.5) -> Column:
    """For each label of a multi-label score, whether its own probability is above the threshold."""
    return F.transform(logits, lambda x: (vec.sigmoid(x) > threshold).cast("int"))


def named_scores(names: list[str], probs: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), probs)


def sequence_log_prob(tokens: DataFrame, by: str, place: str, token: str, logits: str) -> DataFrame:
    """Log-probability of each sequence under a left-to-right model: the scores at a place are for the next token."""
    from pyspark.sql import Window

    following = F.lead(token).over(Window.partitionBy(by).orderBy(place))
    each = tokens.withColumn("__next", following).where("__next is not null")
    lp = F.get(vec.log_softmax(F.col(logits)), F.col("__next"))
    return each.groupBy(by).agg(F.sum(lp).alias("log_prob"), F.count(F.lit(1)).alias("n"))


def linked(logits: Column, task: str) -> Column:
    """Scores of a task from logits: sigmoid of each (binary, multilabel), softmax (multiclass), the place of the largest
    (token), or the logits as they are (regression and all others)."""
    if task in ("binary", "multilabel"):
        return F.transform(logits, vec.sigmoid)
    if task == "multiclass":
        return vec.softmax(logits)
    if task == "token":
        return vec.argmax(logits)
    return logits


#: Ways to make one number of a score vector.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": vec.total, "mean": lambda v: F.try_divide(vec.total(v), F.size(v)), "max": F.array_max, "min": F.array_min,
    "first": lambda v: F.get(v, F.lit(0)), "last": lambda v: F.try_element_at(v, F.lit(-1)),
}


def reduced(scores: Column, how: str) -> Column:
    """A score vector as one number."""
    if how not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {', '.join(REDUCTIONS)}")
    return REDUCTIONS[how](scores)


def token_prediction(logits: Column, names: list[str]) -> Column:
    """Structs (label, score) of each token from its logits: the name of the likeliest class and its probability."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(logits, lambda t: F.struct(F.get(labels, vec.argmax(t)).alias("label"), F.array_max(vec.softmax(t)).alias("score")))


def masked_log_likelihood(df: DataFrame, id_col: str, seq: str) -> DataFrame:
    """(id, pll, n): the sum over the A, C, G and T of a sequence of the log-probability of each, with that base masked, among
    the four that may stand there; scores are those of the native scorer with each base filled in. Other letters are not
    masked. Everything of a position comes from its own row; only sums are shuffled."""
    from codonlake.operators.mutagenesis import BASES, site_effects

    odds = lambda p: p / (1 - p)
    others = [F.coalesce(odds(F.col(f"m_{b.lower()}")) / odds(F.col("raw")), F.lit(0.0)) for b in BASES]
    total = F.lit(1.0)
    for o in others:
        total = total + o
    sites = site_effects(df, id_col, seq).where(F.col("ref").isin(list(BASES)))
    return sites.groupBy(id_col).agg(F.sum(-F.log(total)).alias("pll"), F.count(F.lit(1)).alias("n"))
