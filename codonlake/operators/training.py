"""The native stand-in for model training: linear models on k-mer counts, by the distributed library."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.functions.sequence import kmers
from codonlake.functions.vectors import let


def kmer_features(seq: Column, k: int) -> Column:
    """Shares of all 4^k k-mers of A, C, G and T, as an array in k-mer order; zeros for short sequences."""
    names = ["".join(m) for m in product("ACGT", repeat=k)]
    all_ = F.array(*[F.lit(x) for x in names])
    share = lambda found: F.transform(all_, lambda x: F.size(F.filter(found, lambda y: y == x)) / F.greatest(F.size(found), F.lit(1)))
    return let(kmers(seq, k), share)


def fit_classifier(df: DataFrame, seq: str = "sequence", label: str = "y", k: int = 2, **params: float):
    """A logistic regression of a 0/1 label on k-mer shares; returns a model for ``predict``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(label).isNotNull() & F.col(seq).isNotNull()).select(array_to_vector(kmer_features(F.col(seq), k)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(**params).fit(rows)


def predict(model, df: DataFrame, seq: str = "sequence", k: int = 2) -> DataFrame:
    """``df`` with ``logits`` (two scores) of a fitted classifier."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("features", array_to_vector(kmer_features(F.coalesce(F.col(seq), F.lit("")), k)))
    return model.transform(rows).withColumn("logits", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")
