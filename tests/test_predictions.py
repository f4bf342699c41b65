import math

import pytest
from pyspark.sql import functions as F

from codonlake.dataset import SequenceDataset
from codonlake.operators import metrics as me
from codonlake.operators import pooling, scoring, suites
from codonlake.sources import files, presets


def test_pooling(spark):
    rows = [("a", 0, [1.0, 5.0], 0), ("a", 1, [2.0, 3.0], 1), ("a", 2, [4.0, 1.0], 1), ("a", 3, None, 1), ("b", 0, [7.0, 7.0], 0)]
    df = spark.createDataFrame(rows, "k string, place int, v array<double>, m int")
    want = {"mean": [3.0, 2.0], "max": [4.0, 3.0], "first": [2.0, 3.0], "last": [4.0, 1.0], "cls": [1.0, 5.0]}
    for how, v in want.items():
        got = {r["k"]: r["pooled"] for r in pooling.pool(df, ["k"], "place", "v", how, "m").collect()}
        assert got.pop("a") == v and got == ({"b": [7.0, 7.0]} if how == "cls" else {})
    assert pooling.pool(df, ["k"], "place", "v").where("k = 'a'").first()["pooled"] == [pytest.approx(7 / 3), 3.0]
    assert pooling.pool(df.where("false"), ["k"], "place", "v", "max").collect() == []
    with pytest.raises(ValueError):
        pooling.pool(df, ["k"], "place", "v", "middle")


def test_links_and_reductions(spark):
    v = F.array(F.lit(0.0), F.lit(2.0))
    row = spark.range(1).select(*[scoring.linked(v, t).alias(t) for t in ("binary", "multiclass", "multilabel", "regression", "token", "embedding")], *[scoring.reduced(v, h).alias("r_" + h) for h in scoring.REDUCTIONS]).first()
    assert row["binary"] == row["multilabel"] == [0.5, pytest.approx(1 / (1 + math.exp(-2)))] and sum(row["multiclass"]) == pytest.approx(1.0)
    assert row["token"] == 1 and row["regression"] == row["embedding"] == [0.0, 2.0]
    assert [row["r_" + h] for h in scoring.REDUCTIONS] == [2.0, 1.0, 2.0, 0.0, 0.0, 2.0]
    named = spark.range(1).select(scoring.token_prediction(F.array(v, F.array(F.lit(3.0), F.lit(0.0))), ["O", "B-x"]).alias("t")).first()["t"]
    assert [x["label"] for x in named] == ["B-x", "O"]
    with pytest.raises(ValueError):
        scoring.reduced(v, "other")


def test_masked_log_likelihood_is_that_of_filled_in_sequences(spark):
    seqs = {1: "ACGTTNGCA", 2: "N", 3: "", 4: None, 5: "A"}
    got = {r["row_id"]: (r["pll"], r["n"]) for r in scoring.masked_log_likelihood(spark.createDataFrame(list(seqs.items()), "row_id int, sequence string"), "row_id", "sequence").collect()}
    weight = lambda s: sum(scoring.kmer_weight(s[i : i + 3]) for i in range(len(s) - 2))
    for k, s in seqs.items():
        places = [i for i, c in enumerate(s or "") if c in "ACGT"]
        if not places:
            assert k not in got
            continue
        logs = [weight(s) / 10 - math.log(sum(math.exp(weight(s[:i] + b + s[i + 1 :]) / 10) for b in "ACGT")) for i in places]
        assert got[k] == (pytest.approx(sum(logs)), len(places))


def test_token_summary_drops_ignored_tokens(spark):
    rows = [("r", 0, "-100", "B-x"), ("r", 1, "B-x", "B-x"), ("r", 2, "-100", "O"), ("r", 3, "I-x", "I-x"), ("r", 4, "O", "B-y"), ("r", 5, None, "O")]
    got = me.token_summary(spark.createDataFrame(rows, "row string, place int, y string, pred string"), "row", "place", "y", "pred").first()
    assert (got["precision"], got["recall"]) == (0.5, 1.0) and got["accuracy"] == pytest.approx(2 / 3)


def test_areas_and_outputs(spark):
    rows = [("m", 0, [0.9, 0.1, 0.0]), ("m", 1, [0.1, 0.8, 0.1]), ("m", 2, [0.3, 0.3, 0.4]), ("m", 0, [0.2, 0.7, 0.1])]
    df = spark.createDataFrame(rows, "m string, y int, s array<double>")
    assert me.mean_of_labels(df, ["m"], "y", "s").first()["auroc"] == pytest.approx((0.75 + 1.0 * 3 / 3 + 1.0) / 3, abs=0.2)
    many = spark.createDataFrame([("m", [1, 0], [0.9, 0.2]), ("m", [0, 1], [0.1, 0.7])], "m string, y array<int>, s array<double>")
    assert tuple(me.mean_of_labels(many, ["m"], "y", "s", many=True).first()) == ("m", 1.0, 1.0)
    two = spark.createDataFrame([([1.0, 5.0], [1.0, 5.0]), ([2.0, 5.0], [2.0, 4.0])], "y array<double>, p array<double>")
    out = me.regression_outputs(two.withColumn("g", F.lit(1)), ["g"], "y", "p").first()
    assert out["mse"] == 0.25 and out["pearson"] == pytest.approx(1.0) and out["spearman"] == pytest.approx(1.0)


def test_labels_are_typed_on_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sequence,label\nACGT,1\nAC,0\nGG,\n")
    (tmp_path / "b.csv").write_text("sequence,label\nACGT,0.5\nAC,x\n")
    (tmp_path / "c.csv").write_text("sequence,label\nACGT,1;0\nAC,0;x\n")
    load = lambda f, kind: SequenceDataset.load(spark, str(tmp_path / f), kind).df.orderBy("row_id")
    assert [r["labels"] for r in load("a.csv", "classification").collect()] == [1, 0, None]
    assert [r["labels"] for r in load("b.csv", "classification").collect()] == ["0.5", "x"]
    assert [r["labels"] for r in load("b.csv", "regression").collect()] == [0.5, None]
    assert [r["labels"] for r in load("c.csv", "multi_label").collect()] == [[1, 0], [0, None]]
    assert load("a.csv", "unknown").schema["labels"].dataType.simpleString() == "string"
    assert files.typed_labels(spark.range(1), "regression").columns == ["id"]


def test_registry_and_suites(spark):
    reg = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", [])], "name string, tasks array<string>")
    assert sorted(tuple(r) for r in presets.tasks(reg, "name", "tasks").collect()) == [("a", "x"), ("a", "y"), ("b", "y")]
    assert [r["name"] for r in presets.for_task(reg, "tasks", "x").collect()] == ["a"]
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a dog", "a hog")], "y string, pred string")
    got = {r["metric"]: r["value"] for r in suites.evaluate(df, "xtreme_s/mls", []).collect()}
    assert got["wer"] == pytest.approx(1 / 5) and got["cer"] == pytest.approx(1 / 16)
    assert suites.evaluate(df, "xnli", []).first()["value"] == 0.5
    assert suites.evaluate(df.where("y = pred"), "xtreme_s/covost2", []).count() == 1
    whole = suites.simplification(df.select(F.col("y").alias("source"), "pred", F.array("y").alias("refs")), "source", "pred", "refs").first()
    assert whole["exact"] == 50.0 and 0 < whole["sari"] <= 100
