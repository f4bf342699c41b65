import math
import random

import pytest
from pyspark.sql import functions as F

from codonlake.dataset import SequenceDataset, evaluation_split, kind_of
from codonlake.functions import sequence as sq
from codonlake.functions import text as tx
from codonlake.functions import vectors as vec
from codonlake.operators import benchmark as be
from codonlake.operators import intervals as iv
from codonlake.operators import metrics as me
from codonlake.operators import mutagenesis as mu
from codonlake.operators import sampling as sa
from codonlake.operators import scoring
from codonlake.operators import text_metrics as tm
from codonlake.sources import files, sinks
from codonlake.streaming import predict as st


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("s,gc", [("ACGT", 0.5), ("", 0.0), ("NNNN", 0.0), ("GGcc", 1.0), ("AUGC", 0.5), ("GC-A", 0.5), ("N", 0.0)])
def test_gc(spark, s, gc):
    assert one(spark, sq.gc_content(F.col("s")), s=s) == gc


def test_sequence_functions(spark):
    f = lambda e, s: one(spark, e(F.col("s")), s=s)
    assert f(sq.reverse_complement, "ACgtNx") == "xNacGT"
    assert f(lambda c: sq.kmer_text(c, 3), "acgta") == "ACG CGT GTA" and f(lambda c: sq.kmer_text(c, 9), "ACGT") == "" and f(lambda c: sq.kmers(c, 1), "") == []
    assert f(sq.base_ids, "ACGTUNX-.z01") == [0, 1, 2, 3, 3, 4, 4, -1, -1, 4, 4, 4]
    assert f(lambda c: sq.padded_ids(c, 3), "AC") == [0, 1, -1] and f(lambda c: sq.padded_ids(c, 3, "left"), "A") == [-1, -1, 0] and f(lambda c: sq.padded_ids(c, 2), "ACG") == [0, 1]
    assert f(lambda c: sq.decode_ids(sq.base_ids(c)), "AC-GU") == "ACGT"
    assert f(lambda c: sq.is_valid(c, 3, 5, (0.4, 0.6)), "acgt") and not f(lambda c: sq.is_valid(c, letters="ACGT"), "ACGN") and not f(lambda c: sq.is_valid(c, 5), "ACGT")
    assert f(sq.is_dna, "acN") and not f(sq.is_dna, "ac\n") and not f(sq.is_dna, "")
    assert f(lambda c: sq.one_hot(sq.base_ids(c), unknown=0.25), "AN") == [[1.0, 0.0, 0.0, 0.0], [0.25] * 4]


def test_vectors(spark):
    v = lambda e, x: one(spark, e(F.array(*[F.lit(float(y)) for y in x])), a=1)
    assert v(vec.softmax, [1000, 1000]) == [0.5, 0.5] and v(vec.argmax, [1, 3, 3]) == 1
    assert v(vec.min_max, [2, 2]) == [0.0, 0.0] and v(vec.z_scores, [1, 1]) == [0.0, 0.0] and v(vec.l1, [1, -3]) == [0.25, -0.75]
    assert math.isclose(v(vec.log_softmax, [0, 0])[0], -math.log(2)) and v(lambda a: vec.is_scored(a, 2), [1, math.nan]) is False
    assert one(spark, vec.log2_ratio(F.lit(1.0), F.lit(0.0)), a=1) is None and one(spark, vec.pass_at_k(F.lit(5), F.lit(0), 2), a=1) == 0.0 and one(spark, vec.pass_at_k(F.lit(3), F.lit(2), 2), a=1) == 1.0


def mutants(s):
    out = {f"mut_{i}_{b}_{x}": s[:i] + x + s[i + 1 :] for i, b in enumerate(s) for x in "ACGT" if x != b}
    return out


def weights(s):
    return sum(scoring.kmer_weight(s[i : i + 3]) for i in range(len(s) - 2))


def test_mutants_and_effects(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTNa") for _ in range(n)) for n in (1, 2, 3, 7, 30)] + ["", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "row_id bigint, sequence string")
    got = {(r["row_id"], r["name"]): r["mutant"] for r in mu.substitutions(df, "row_id", "sequence").collect()}
    assert got == {(i, k): v for i, s in enumerate(seqs) if s for k, v in mutants(s).items()}
    assert {r["mutant"] for r in mu.deletions(df.where("row_id = 3"), "row_id", "sequence", 2, True).collect()} == {seqs[3][:i] + "NN" + seqs[3][i + 2 :] for i in range(6)}
    assert len(mu.insertions(df.where("row_id = 5"), "row_id", "sequence", "TT").collect()) == 1
    assert {r["mutant"] for r in mu.cuts(df.where("row_id = 3"), "row_id", "sequence", -3).collect()} == {seqs[3], seqs[3][:4]}
    for r in mu.effects(df, "row_id", "sequence").collect():
        s = seqs[r["row_id"]]
        m = s[: r["pos"]] + r["alt"] + s[r["pos"] + 1 :]
        p = lambda x: 1 / (1 + math.exp(-weights(x) / 10))
        assert math.isclose(r["raw"], p(s)) and math.isclose(r["mutant"], p(m)) and math.isclose(r["score"], math.log2(p(m) / p(s)), abs_tol=1e-12) and r["ref"] == s[r["pos"]]


def brute_hotspots(scores, width, pct):
    import numpy as np
    import pandas as pd

    rolled = pd.Series(np.abs(scores)).rolling(width, center=True, min_periods=1).mean()
    hot = (rolled >= np.percentile(rolled, pct)).tolist()
    runs = [(i, next((j for j in range(i, len(hot)) if not hot[j]), len(hot))) for i in range(len(hot)) if hot[i] and (i == 0 or not hot[i - 1])]
    out = []
    for a, b in runs:
        mid = (a + b) // 2
        w = (min(max(0, mid - width // 2), a), max(min(mid + width // 2, len(scores)), b))
        if not (out and w[0] >= out[-1][0] and w[1] <= out[-1][1]):
            out.append(w)
    return out


def test_hotspots(spark):
    rng = random.Random(4)
    for width in (4, 5, 10):
        data = {i: [rng.choice([-8, -4, -1, 0, 1, 2, 16]) for _ in range(n)] for i, n in enumerate((1, 5, 40, 200))}
        df = spark.createDataFrame([(i, p, float(x)) for i, xs in data.items() for p, x in enumerate(xs)], "row_id bigint, pos int, score double")
        got = {}
        for r in mu.hotspots(df, "row_id", width).collect():
            got.setdefault(r["row_id"], []).append((r["hot_start"], r["hot_end"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: brute_hotspots(xs, width, 90) for i, xs in data.items()}


def test_position_scores(spark):
    df = spark.createDataFrame([(1, 0, "A", "C", -2.0), (1, 0, "A", "G", 2.0), (1, 0, "A", "T", None), (1, 1, "C", "A", math.nan)], "id int, pos int, ref string, alt string, score double")
    assert {r["pos"]: r["score"] for r in mu.position_scores(df, "id").collect()} == {0: -2.0, 1: 0.0}
    with pytest.raises(ValueError):
        mu.position_scores(df, "id", "other")


def test_binary_metrics_on_ties_and_one_class(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.9), (1, 1, 0.8), (1, 0, 0.1), (1, 1, 0.5), (1, 0, 0.2), (2, 1, 0.3)]
    df = spark.createDataFrame(rows, "g int, y int, s double").withColumn("pred", (F.col("s") > 0.45).cast("int"))
    auc = {r["g"]: r["auroc"] for r in me.auroc(df, ["g"], "y", "s").collect()}
    pos, neg = [0.9, 0.8, 0.5], [0.9, 0.1, 0.2]
    assert math.isclose(auc[1], sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 9) and auc[2] is None
    r = {x["g"]: x for x in me.binary_rates(me.binary_counts(df, ["g"], "y", "pred"), ["g"]).collect()}
    assert r[1]["precision"] == 0.75 and r[1]["recall"] == 1.0 and r[2]["tnr"] is None and r[2]["f1"] == 0.0
    ap = {x["g"]: x["auprc"] for x in me.average_precision(df, ["g"], "y", "s").collect()}
    assert math.isclose(ap[1], 1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 4)


def test_regression_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    r = me.regression(df, [], "y", "p").first()
    assert r["mse"] == 2.5 and r["r2"] is None and r["pearson"] is None and me.spearman(df, [], "y", "p").first()["spearman"] is None


def spans(tags):
    out, kind, start = set(), None, None
    for i, t in enumerate([*tags, "O"]):
        if kind and t != f"I-{kind}":
            out.add((kind, start, i))
            kind = None
        if t.startswith("B-"):
            kind, start = t[2:], i
    return out


def test_entities_strictly(spark):
    rng = random.Random(2)
    data = [(r, i, rng.choice(["O", "B-x", "I-x", "B-y", "I-y"])) for r in range(30) for i in range(12)]
    df = spark.createDataFrame(data, "row int, place int, tag string")
    got = {tuple(r) for r in me.entity_spans(df, "row", "place", "tag").collect()}
    assert got == {(r, *s) for r in range(30) for s in spans([t for a, _, t in data if a == r])}


def test_overlaps_equal_nested_loops(spark):
    rng = random.Random(3)
    make = lambda n: [(f"chr{rng.randint(1, 2)}", a, a + rng.choice([0, 1, 50, 5000])) for a in (rng.randint(0, 9000) for _ in range(n))]
    a, b = sorted(set(make(80))), sorted(set(make(80)))
    schema = "chrom string, start_pos bigint, end_pos bigint"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = {(x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    got = [(tuple(r[:3]), tuple(r[3:])) for r in iv.overlaps(da, db).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = [tuple(r) for r in iv.overlaps(da, db, "left").collect()]
    assert len(left) == len(want) + len([x for x in a if not any(p[0] == x for p in want)])


def test_places_and_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    rows = sorted((r["place"], r["row_id"]) for r in sa.shuffle(df, "row_id", [], 5).collect())
    assert [p for p, _ in rows] == list(range(1000))
    assert [i for _, i in rows] == sorted(range(1000), key=lambda i: (((i + 5) * 1103515245 + 12345) % 2147483648, i))
    assert sa.sample(df, "row_id", 0.333, ["g"]).groupBy("g").count().where("count = 166").count() == 2
    parts = {r["part"]: r["count"] for r in sa.split(df, "row_id").groupBy("part").count().collect()}
    assert parts == {"train": 700, "test": 200, "val": 100}
    assert {r["count"] for r in sa.folds(df, "row_id", 5, ["g"]).groupBy("g", "fold").count().collect()} == {100}
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            sa.sample(df, "row_id", bad, [])
    with pytest.raises(ValueError):
        sa.split(df, "row_id", 0.9, 0.2)


def test_generated_sequences(spark):
    got = [r["sequence"] for r in sa.generate(spark, 200, 10, 40, (0.3, 0.7), 0.1, 4, seed=1).collect()]
    assert len(got) == 200 and len(set(got)) > 150 and all(10 <= len(s) <= 40 and len(s) % 4 == 0 and set(s) <= set("ACGTN") for s in got)
    with pytest.raises(Exception, match="GC limits"):
        sa.generate(spark, 5, 30, 30, (0.99, 1.0)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x|1\nACGT\nAC\n>y|0\r\nGG\r\n>empty|1\n\n>z\nTT")
    assert sorted(tuple(r) for r in files.read(spark, str(tmp_path / "a.fasta")).collect()) == [("ACGTAC", "1"), ("GG", "0"), ("TT", "z")]
    (tmp_path / "a.csv").write_text("seq,label\nACGT,1\nGG,0\n")
    assert sorted(tuple(r) for r in files.read(spark, str(tmp_path / "a.csv"), seq_col="seq", label_col="label").collect()) == [("ACGT", "1"), ("GG", "0")]
    (tmp_path / "b.tsv").write_text("ACGT\t1\nGG 0\nX\n")
    assert sorted(tuple(r) for r in files.read(spark, str(tmp_path / "b.tsv")).collect()) == [("ACGT", "1")]
    (tmp_path / "c.txt").write_text("ACGT 1 x\n\nonly\nGG\t0\n")
    assert files.read(spark, str(tmp_path / "c.txt")).count() == 2
    (tmp_path / "d.json").write_text('{"sequence": "AC", "labels": 1}\n')
    both = files.read(spark, {"train": str(tmp_path / "a.fasta"), "dev": [str(tmp_path / "a.fasta")]})
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 3, "dev": 3}
    assert files.read(spark, str(tmp_path / "d.json")).first()["sequence"] == "AC"
    (tmp_path / "e.gff3").write_text("##gff\nchr1\ts\texon\t11\t20\t.\t-\t.\tID=a;Parent=iso.1,iso.2;Name=n\n\nbad line\n")
    assert [tuple(r) for r in files.read_gff(spark, str(tmp_path / "e.gff3")).collect()] == [("chr1", "exon", 10, 20, "-", "n", "iso.1")]
    (tmp_path / "f.bed").write_text("1\t0\t5\tname\n")
    assert tuple(files.read_bed(spark, str(tmp_path / "f.bed"), "name string", {"1": "chr1"}).first()) == ("chr1", 0, 5, "name")
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "g.arrow"), "wb") as sink, pa.ipc.new_file(sink, pa.schema([("sequence", pa.string())])) as w:
        w.write_batch(pa.record_batch([["AC", "GT"]], ["sequence"]))
    assert files.read(spark, str(tmp_path / "g.arrow")).count() == 2
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "x.pkl"))
    out = spark.createDataFrame([(1, "ACGT"), (2, None)], "row_id int, sequence string")
    sinks.write_fasta(out, str(tmp_path / "out"), "row_id")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [">1", "ACGT"]


def test_dataset(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sequence,labels\n" + "\n".join(f"{'ACGT' * (i + 1)},{i % 2}" for i in range(20)))
    d = SequenceDataset.load(spark, str(tmp_path / "a.csv"), "classification")
    assert d.validate(least=20).df.count() == 16 and d.statistics().first()["median_len"] == 42.0 and [len(b) for b in d.batches(8)] == [8, 8, 4]
    s = d.split_data(0.2, 0.2)
    assert {r["split"]: r["n"] for r in s.statistics().collect()} == {"train": 12, "test": 4, "val": 4}
    with pytest.raises(ValueError):
        s.split_data()
    with pytest.raises(TypeError):
        SequenceDataset(None)
    assert d.encode(6).first()["input_ids"] == [0, 1, 2, 3, -1, -1] and kind_of("array<double>", 2) == "multi_label" and evaluation_split(["train", "dev", "test"]) == "dev"


def test_text_functions(spark):
    f = lambda e, s: one(spark, e(F.col("s")), s=s)
    assert f(tx.normal_answer, "The  Cat, a dog!") == "cat dog" and f(tx.tokens_13a, 'Hi, "x" 3.14.') == ["Hi", ",", '"', "x", '"', "3.14", "."]
    d = lambda a, b: one(spark, tx.word_distance(tx.words(F.col("a")), tx.words(F.col("b"))), a=a, b=b)
    assert d("a b c", "a x c d") == 2 and d("", "a b") == 2 and d("a", "a") == 0
    assert tm.common_subsequence("abcde", "xbxde") == 3 and tm.sari_score(["a", "b"], ["a", "b"], [["a", "b"]]) == 1.0


def test_interpolated(spark):
    pts = spark.createDataFrame([("m", 0.0, 0.0), ("m", 0.5, 1.0), ("m", 0.5, 0.8)], "g string, x double, y double")
    assert {r["x"]: r["y"] for r in be.interpolated(pts, ["g"], "x", "y", [0.0, 0.25, 0.5, 1.0]).collect()} == {0.0: 0.0, 0.25: 0.5, 0.5: 1.0, 1.0: 1.0}


def test_interpolated_takes_no_window_over_a_curve(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(2, 9) / rng.choice([10, 20]), rng.random()) for g in "ab" for _ in range(40)] + [("b", None, 0.5), ("c", None, 0.5), ("d", 0.45, 0.7)]
    grid = [i / 20 for i in range(21)]
    out = be.interpolated(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), ["g"], "x", "y", grid)
    got = {(r["g"], r["x"]): r["y"] for r in out.collect()}
    want = {}
    for g in "abcd":
        top = {x: max(v for h, w, v in rows if h == g and w == x) for h, x, _ in rows if h == g and x is not None}
        for x in grid:
            low, high = max((w for w in top if w <= x), default=None), min((w for w in top if w >= x), default=None)
            want[g, x] = None if not top else top[high] if low is None else top[low] if high in (None, low) else top[low] + (x - low) / (high - low) * (top[high] - top[low])
    assert got.keys() == want.keys() and all(v == got[k] or abs(v - got[k]) < 1e-12 for k, v in want.items())
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_ranking(spark):
    run = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 1.0)], "qid int, doc string, score double")
    rel = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "z", 1), (2, "q", 0)], "qid int, doc string, rel int")
    r = me.ranking(run, rel, (2,)).collect()
    assert len(r) == 1 and math.isclose(r[0]["ap"], (1 / 2 + 2 / 3) / 3) and r[0]["rr"] == 0.5 and r[0]["p_2"] == 0.5
    assert math.isclose(r[0]["ndcg_2"], (1 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", [0.0, 1.0]), (2, "m", None), (3, "n", [math.nan, 1.0])], "row_id int, model string, logits array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: st.run_once(st.predicted(st.read_stream(spark, str(tmp_path / "in"), df.schema)).select("row_id", "pred", "error"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r["row_id"]: (r["pred"], r["error"]) for r in run().collect()} == {1: (1, None), 2: (None, "no scores"), 3: (None, "scores are not numbers")}
    df.limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().count() == 4


def test_score_protocol(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "ACG")], "row_id int, sequence string")
    got = scoring.score_with(df, lambda: lambda s: pd.Series([[float(len(x)), 0.0] for x in s])).first()
    assert got["logits"] == [3.0, 0.0]


def test_all_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120
