"""Functions of score vectors (arrays of doubles) as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(v: Column) -> Column:
    """Stable softmax; the largest score is subtracted first."""
    exps = lambda w: let(F.array_max(w), lambda top: F.transform(w, lambda x: F.exp(x - top)))
    return let(v, lambda w: let(exps(w), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))))


def log_softmax(v: Column) -> Column:
    norm = lambda w, top: top + F.log(total(F.transform(w, lambda y: F.exp(y - top))))
    return let(v, lambda w: let(let(F.array_max(w), lambda top: norm(w, top)), lambda n: F.transform(w, lambda x: x - n)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(v: Column) -> Column:
    """Place of the first largest score."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def scrubbed(x: Column) -> Column:
    """NaN becomes 0, infinity 1 and minus infinity 0."""
    return F.when(F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)


def is_scored(v: Column, n: int) -> Column:
    """Whether a score vector is there, has ``n`` entries and no NaN."""
    return v.isNotNull() & (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def min_max(v: Column) -> Column:
    """Scores scaled to 0..1; zeros if they hardly differ."""
    ends = lambda w: F.struct(F.array_min(w).alias("low"), (F.array_max(w) - F.array_min(w)).alias("spread"))
    one = lambda x, z: F.when(z["spread"] <= 1e-12, 0.0).otherwise((x - z["low"]) / (z["spread"] + 1e-8))
    return let(v, lambda w: let(ends(w), lambda z: F.transform(w, lambda x: one(x, z))))


def l1(v: Column) -> Column:
    return let(v, lambda w: let(total(F.transform(w, F.abs)), lambda n: F.transform(w, lambda x: F.try_divide(x, n))))


def l2(v: Column) -> Column:
    return let(v, lambda w: let(F.sqrt(total(F.transform(w, lambda x: x * x))), lambda n: F.transform(w, lambda x: F.try_divide(x, n))))


def log1p(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > -1, F.log1p(x)))


def z_scores(v: Column) -> Column:
    """Scores less their mean, in population standard deviations; zeros if they don't differ."""
    sd = lambda w, mean: F.sqrt(total(F.transform(w, lambda x: (x - mean) * (x - mean))) / F.size(w))
    one = lambda x, mean, s: F.when(s == 0, 0.0).otherwise((x - mean) / s)
    return let(v, lambda w: let(total(w) / F.size(w), lambda mean: let(sd(w, mean), lambda s: F.transform(w, lambda x: one(x, mean, s)))))


def entropy(v: Column) -> Column:
    """Entropy of a distribution, in nats; zero entries count nothing."""
    return -total(F.transform(v, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def log2_ratio(mutant: Column, raw: Column) -> Column:
    """log2(mutant / raw); null where the ratio isn't positive."""
    r = F.try_divide(mutant, raw)
    return F.when(r > 0, F.log2(r))


def focal_loss(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Binary focal loss of a probability ``p`` for the label ``y``."""
    pt = F.when(y == 1, p).otherwise(1 - p)
    at = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -at * F.pow(1 - pt, F.lit(gamma)) * F.log(F.greatest(pt, F.lit(1e-12)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate of the chance that one of ``k`` samples passes, of ``n`` of which ``c`` pass."""
    misses = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - misses)
