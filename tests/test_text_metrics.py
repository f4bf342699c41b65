import math
import random
from collections import Counter

from pyspark.sql import functions as F

from codonlake.functions import text as tx
from codonlake.operators import metrics as me
from codonlake.operators import text_metrics as tm

PAIRS = [(1, "the cat sat on the mat", "the cat is on the mat"), (2, "a b c d e", "a b c d e"), (3, "", "x y"), (4, None, "z"), (5, "q", None)]


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def counts(n):
    m = t = r = 0
    for _, p, ref in PAIRS:
        a, b = grams((p or "").split(), n), grams((ref or "").split(), n)
        m, t, r = m + sum((a & b).values()), t + sum(a.values()), r + sum(b.values())
    return m, t, r


def frame(spark):
    return spark.createDataFrame(PAIRS, "id int, pred string, ref string")


def matched(spark, most=4):
    return tm.ngram_matches(frame(spark), "id", tx.words(F.col("pred")), tx.words(F.col("ref")), most)


def test_bleu_and_gleu(spark):
    lengths = frame(spark).select(F.size(tx.words(F.col("pred"))).alias("pred_length"), F.size(tx.words(F.col("ref"))).alias("ref_length"))
    want = math.exp(sum(math.log(counts(n)[0] / counts(n)[1]) for n in range(1, 5)) / 4)
    c, r = counts(1)[1], counts(1)[2]
    want *= 1 if c > r else math.exp(1 - r / c)
    assert math.isclose(tm.bleu(matched(spark), lengths).first()["bleu"], want)
    assert math.isclose(tm.smoothed_bleu(matched(spark), lengths).first()["bleu"], 100 * want)
    g = {r["id"]: r["gleu"] for r in tm.gleu(matched(spark), "id").collect()}
    assert g[2] == 1.0 and g[3] == 0.0 and set(g) == {1, 2, 3, 4, 5}
    assert tm.bleu(matched(spark).where("n = 9"), lengths).first()["bleu"] == 0.0


def test_rouge(spark):
    got = {(r["id"], r["n"]): r["rouge"] for r in tm.rouge_n(matched(spark, 2), "id").collect()}
    assert math.isclose(got[(1, 1)], 5 / 6) and math.isclose(got[(1, 2)], 3 / 5) and got[(3, 1)] == 0.0
    lcs = {r["id"]: r["x"] for r in frame(spark).select("id", tm.rouge_l(F.col("pred"), F.col("ref")).alias("x")).collect()}
    assert math.isclose(lcs[1], 5 / 6) and lcs[2] == 1.0 and lcs[4] == 0.0


def test_meteor_stage(spark):
    got = {r["id"]: r["x"] for r in frame(spark).select("id", tm.word_alignment_score(F.col("pred"), F.col("ref")).alias("x")).collect()}
    assert math.isclose(got[2], 1 - 0.5 * (1 / 5) ** 3) and got[3] == 0.0 and 0 < got[1] < 1


def test_nist_of_equal_texts_is_their_information(spark):
    df = spark.createDataFrame([(1, "a b", "a b")], "id int, pred string, ref string")
    assert math.isclose(tm.nist(df, "id", tx.words(F.col("pred")), tx.words(F.col("ref"))).first()["nist"], 1.0)


def test_nist_takes_no_row_for_each_n_gram(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))), " ".join(rng.choices("abcdefghij", k=rng.randint(0, 40)))) for i in range(60)] + [(60, None, "a b"), (61, "a b", None), (62, "ab a\u00e9 b", "ab a\u00e9 b")]
    df = spark.createDataFrame(rows, "id int, pred string, ref string").repartition(3)
    grams = lambda t, n: Counter(tuple((t or "").split()[i : i + n]) for i in range(len((t or "").split()) - n + 1))
    known = sum((grams(r, n) for _, _, r in rows for n in range(1, 6)), Counter())
    c, words = (sum(len((t or "").split()) for t in side) for side in list(zip(*rows, strict=True))[1:])
    want = 0.0
    for n in range(1, 6):
        hits = sum(k * math.log2((known[g[:-1]] if n > 1 else words) / known[g]) for _, p, r in rows for g, k in (grams(p, n) & grams(r, n)).items())
        want += hits / sum(grams(p, n).total() for _, p, _ in rows)
    out = tm.nist(df, "id", tx.words(F.col("pred")), tx.words(F.col("ref")))
    assert math.isclose(out.first()["nist"], want * math.exp(math.log(0.5) / math.log(1.5) ** 2 * math.log(min(1, c / words)) ** 2), rel_tol=1e-9)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_answers(spark):
    df = spark.createDataFrame([(1, "The cat!", "cat"), (2, "a dog", "cat"), (3, "the", ""), (4, "x y", "y z")], "id int, p string, r string")
    got = {r["id"]: (r["exact"], r["f1"]) for r in tm.answer_f1(df, "id", "p", "r").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 1.0), 4: (0.0, 0.5)}


def test_threshold(spark):
    df = spark.createDataFrame([(0.1, 1.0, False), (0.2, 0.0, True), (0.3, 1.0, False), (0.4, 0.0, True)], "s double, g double, n boolean")
    r = tm.best_threshold(df, "s", "g", "n").first()
    assert r["best"] == 3.0 and r["threshold"] == 0.1
    r = tm.best_threshold(df.where("n"), "s", "g", "n").first()
    assert r["best"] == 2.0 and r["threshold"] == 0.0


def test_clusterings(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y")], "m int, k string, r string")
    m = tm.muc(df, "m", "k", "r").first()
    assert m["recall"] == 0.5 and m["precision"] == 0.5
    b = tm.b_cubed(df, "m", "k", "r").first()
    assert math.isclose(b["precision"], (1 + 1 + 0.5 + 0.5) / 4) and math.isclose(b["recall"], (2 / 3 + 2 / 3 + 1 / 3 + 1) / 4)


def test_answer_curve(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True)], "s double, ok boolean")
    r = tm.answer_curve(df, "s", "ok").first()
    assert math.isclose(r["aupr"], 0.5 * 1 + 0.5 * (2 / 3 + 2 / 3) / 2) and math.isclose(r["p_at_80"], 2 / 3)


def test_formulas(spark):
    f = lambda a, b: spark.range(1).select(tm.same_expression(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert f("$\\boxed{ \\tfrac{1}{2} }$", "\\frac{1}{2}") and f("0.5", ".5") and not f("1", "2")


def test_pairwise_area(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.4, 0.6]), (1, [0.5, 0.5]), (1, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "y int, s array<double>")
    zero = sum(a[0] > b[0] for y, a in rows if y == 0 for z, b in rows if z == 1) / 4
    one = sum(b[1] > a[1] for y, a in rows if y == 0 for z, b in rows if z == 1) / 4
    assert math.isclose(me.pairwise_auroc(df, [], "y", "s").first()["auroc"], (zero + one) / 2)


def test_bpref_and_geometric_mean(spark):
    run = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "qid int, doc string, score double")
    rel = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 1)], "qid int, doc string, rel int")
    assert me.bpref(run, rel).first()["bpref"] == 0.0
    assert me.bpref(run, rel.where("doc <> 'a'")).first()["bpref"] == 1.0
    assert math.isclose(me.geometric_mean(spark.createDataFrame([(0.0,), (1.0,)], "v double"), "v").first()["mean"], math.sqrt(1e-5))


def test_edits_with_shifts(spark):
    e = lambda a, b: tm.edits_with_shifts(a.split(), b.split())
    assert e("a b c", "a b c") == 0 and e("d e a b c", "a b c d e") == 1 and e("a x c", "a b c") == 1 and e("", "a b") == 2 and e("a", "") == 1
    assert math.isclose(tm.ter(frame(spark), F.col("pred"), F.col("ref")).first()["ter"], (1 + 0 + 2 + 1 + 1) / 14)


def test_link_based_clusters(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "z")], "m int, k string, r string")
    r = tm.lea(df, "m", "k", "r").first()
    assert math.isclose(r["recall"], (3 * (1 / 3) + 1) / 4) and math.isclose(r["precision"], (2 * 1 + 0 + 1) / 4)
