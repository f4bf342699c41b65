"""Datasets of several partitions, whose identifiers are large, and identifiers of any sign."""

import pytest
from pyspark.sql import functions as F

from codonlake.dataset import SequenceDataset
from codonlake.operators import sampling as sa


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts") / "rows.parquet")
    rows = spark.range(0, 400, 1, 4).select(F.concat(F.lit("ACGT"), F.lpad(F.conv("id", 10, 4), 6, "0")).alias("sequence"), (F.col("id") % 2).cast("int").alias("label"))
    rows.write.parquet(folder)
    return SequenceDataset.load(spark, folder)


def test_four_parts_sample_split_and_shuffle(loaded):
    assert loaded.df.agg(F.max("row_id")).first()[0] > 1 << 33
    assert loaded.sample(0.5).df.count() == 200
    parts = {r["split"]: r["count"] for r in loaded.split_data(0.2, 0.1).df.groupBy("split").count().collect()}
    assert parts == {"train": 280, "test": 80, "val": 40}
    assert sorted(r["place"] for r in loaded.shuffle(3).df.collect()) == list(range(400))
    assert {r["count"] for r in sa.folds(loaded.df, "row_id", 5, []).groupBy("fold").count().collect()} == {80}
    changed = loaded.reverse_complement_some(0.25).df.select("row_id", F.col("sequence").alias("s")).join(loaded.df, "row_id").where("s <> sequence").count()
    assert 90 <= changed <= 100  # a palindrome is its own reverse complement


@pytest.mark.parametrize("low", [-(1 << 62), -50, 1 << 40, (1 << 63) - 101])
def test_identifiers_of_any_size(spark, low):
    df = spark.range(100).select((F.col("id") + F.lit(low)).alias("row_id"))
    assert sa.sample(df, "row_id", 0.3, [], seed=7).count() == 30
    made = sa.bases(df, "row_id", F.lit(8)).collect()
    assert all(len(r["sequence"]) == 8 for r in made)


def test_hash_is_that_of_the_plain_congruence(spark):
    got = spark.range(5).select(sa.hash31(F.col("id"), 42).alias("h")).collect()
    assert [r["h"] for r in got] == [((i + 42) * 1103515245 + 12345) % 2**31 for i in range(5)]
