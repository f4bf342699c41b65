import math

import pytest
from pyspark.sql import functions as F

from codonlake.functions import encode as en
from codonlake.operators import plotdata as pl
from codonlake.operators import suites as su
from codonlake.operators import text_metrics as tm
from codonlake.operators import training as tr
from codonlake.service import Service
from codonlake.session import broadcast_if_small, cut, running_totals, shared_dir


def test_encode(spark):
    row = spark.range(1).select(F.array(F.lit(7), F.lit(8), F.lit(9)).alias("ids"))
    get = lambda e: row.select(e.alias("x")).first()["x"]
    ids = F.col("ids")
    assert get(en.encode(ids, 7)) == [1, 7, 8, 9, 2, 0, 0] and get(en.encode(ids, 4)) == [1, 7, 8, 2]
    assert get(en.encode(ids, 6, en.Specials(cls=None, sep=None, eos=3), "left")) == [0, 0, 7, 8, 9, 3]
    assert get(en.mask(ids, 6)) == [1, 1, 1, 1, 1, 0] and get(en.aligned_labels(ids, 6)) == [-100, 7, 8, 9, -100, -100]
    with pytest.raises(ValueError):
        en.encode(ids, 1)


def test_suites(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", 0, 0), ("b", 1, 1)], "g string, y int, pred int")
    got = {(r["g"], r["metric"]): r["value"] for r in su.evaluate(df, "glue/mrpc", ["g"]).collect()}
    assert got[("a", "accuracy")] == 0.5 and math.isclose(got[("a", "f1")], 2 / 3) and got[("b", "f1")] == 1.0
    assert su.evaluate(df, "multiclass", []).count() == 15 and su.evaluate(df, "binary", []).where("metric = 'mcc'").count() == 1
    q = su.question_scores(df, "g", "y", "pred").first()
    assert q["all_correct"] == 0.5 and math.isclose(q["answer_f1"], 0.8)
    with pytest.raises(ValueError):
        su.evaluate(df, "nothing", [])


def test_reliability(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 2, 1, 5, 3])], "run int, step int, value double")
    r = su.dispersion_within_runs(df, "run", "step", "value").first()
    assert r["drawdown"] == 2.0 and r["iqr"] == 2.5 - (-1.25)
    assert r["cvar"] == -2.0 and math.isclose(r["sd"], math.sqrt(sum((x - 0.75) ** 2 for x in (2, -1, 4, -2)) / 4))


def test_chart_data(spark):
    radar = pl.radar(spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0)], "g string, metric string, value double"), "g").orderBy("place").collect()
    assert [r["metric"] for r in radar] == ["a", "b", "a"] and math.isclose(radar[1]["x"], -2.0)
    a = spark.createDataFrame([(1, [[0.1] * 4] * 4)], "id int, w array<array<double>>")
    assert pl.attention_frame(a, "id", "w").count() == 4
    m = pl.padded_matrix(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "id", "v", 3).orderBy("place").collect()
    assert [r["value"] for r in m] == [1.0, None, None]
    d = pl.density(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "x double, y double"), "x", "y").collect()
    assert len(d) == 1 and d[0]["n"] == 2


def test_unsupported_metrics_say_so():
    with pytest.raises(NotImplementedError):
        tm.unsupported("bleurt")


def test_classifier_learns(spark):
    rows = [(i, "GC" * 20 if i % 2 else "AT" * 20, i % 2) for i in range(60)] + [(99, None, 1), (100, "GC", None)]
    df = spark.createDataFrame(rows, "row_id int, sequence string, y int")
    model = tr.fit_classifier(df, k=2, maxIter=20)
    got = tr.predict(model, df.where("y is not null"), k=2).where("row_id < 60").select("y", (F.col("logits")[1] > F.col("logits")[0]).alias("p")).collect()
    assert all(r["p"] == bool(r["y"]) for r in got)


def test_service(spark):
    s = Service(spark, {"broken": lambda df: df.select(F.raise_error(F.lit("out of order")).alias("logits"), "*")}, timeout=60)
    got = s.predict(["ACGTACGT", "hello"])
    assert got["success"] and 0 < got["value"][0]["prob"] < 1 and got["value"][1]["error"] == "not a DNA sequence"
    many = s.predict_models("ACGT", ["native", "broken", "missing"])
    assert many["succeeded"] == 1 and many["failed"] == 2 and many["results"]["missing"]["error"]["kind"] == "ValueError"
    assert len(s.mutagenesis("ACGT", [0, 2])["value"]["effects"]) == 6 and len(s.combinations("ACGT", [0, 3])["value"]) == 16
    assert not s.combinations("ACGT", list(range(4)) + [9])["success"] and len(s.interpret("ACGTA")["value"]["scaled"]) == 5
    assert s.health()["models"] == 2 and not s.predict([])["success"]
    with pytest.raises(ValueError):
        Service(spark, timeout=0)


def test_cut_and_checked_broadcast(spark):
    df = spark.range(100).select(F.col("id"), F.lit(None).cast("string").alias("s"))
    again = cut(df)
    assert again.schema.simpleString() == df.schema.simpleString() and again.count() == 100 and shared_dir(spark)
    plan = lambda d: d.join(broadcast_if_small(df, 1000), "id")._jdf.queryExecution().toString()
    assert "broadcast" in plan(again).lower()
    hinted = broadcast_if_small(df, 10)
    assert hinted is df


def test_running_totals_over_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(g, k, rng.randint(0, 9)) for g in ("a", None, "b") for k in rng.sample(range(1000), 150)] + [("c", 1, 4)]
    df = spark.createDataFrame([(g, float(k), v) for g, k, v in rows], "g string, k double, v int")
    for down in (False, True):
        got = {(r["g"], r["k"]): r["s"] for r in running_totals(df, ["g"], "k", {"v": "s"}, down, 8).collect()}
        assert got == {(g, float(k)): sum(w for h, j, w in rows if h == g and (j >= k if down else j <= k)) for g, k, _ in rows}
    one = df.where("g = 'a'")
    assert running_totals(one, [], "k", {"v": "s"}).agg(F.max("s")).first()[0] == one.agg(F.sum("v")).first()[0]
    assert running_totals(df.where("false"), [], "k", {"v": "s"}).collect() == []


def test_task_settings():
    from codonlake.config import TaskSettings, from_mapping

    assert TaskSettings("multi_class_classification", 3).label_names == ("class_0", "class_1", "class_2") and TaskSettings("binary_classification").kind == "binary"
    assert TaskSettings("regression", 5).labels == 1 and TaskSettings("mask").labels is None
    assert from_mapping({"task": {"task_type": "multilabel", "num_labels": 2, "more": 1}}).extra == {"more": 1}
    for bad in ({"kind": "other"}, {"kind": "multiclass", "labels": 1}, {"threshold": 2}):
        with pytest.raises(ValueError):
            TaskSettings(**bad)
