"""Published example values of the text metrics, several references, and words of any white space."""

import random

import pytest
from pyspark.sql import functions as F

from codonlake.functions import text as tx
from codonlake.operators import text_metrics as tm

SCHEMA = "id int, pred string, refs array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def tokens(df):
    return df.select("id", tx.tokens_13a(F.col("pred")).alias("p"), F.transform("refs", tx.tokens_13a).alias("r"))


def test_bleu_takes_the_reference_that_has_an_n_gram_most(spark):
    df = tokens(frame(spark, [("hello there general kenobi", ["hello there general kenobi", "hello there !"]), ("foo bar foobar", ["foo bar foobar"])]))
    out = tm.bleu(tm.ngram_matches(df, "id", F.col("p"), F.col("r"), 4), tm.lengths(df, F.col("p"), F.col("r"))).first()
    assert out["bleu"] == pytest.approx(1.0) and out["brevity"] == pytest.approx(1.0) and out["ratio"] == pytest.approx(7 / 6)


def test_corpus_score_with_closest_lengths(spark):
    df = tokens(frame(spark, [("hello there general kenobi", ["hello there general kenobi", "hello there !"]), ("on our way to ankh morpork", ["goodbye ankh morpork", "ankh morpork"])]))
    out = tm.smoothed_bleu(tm.ngram_matches(df, "id", F.col("p"), F.col("r"), 4), tm.lengths(df, F.col("p"), F.col("r"), "closest")).first()
    assert out["bleu"] == pytest.approx(39.76353643835252)


def test_corpus_gleu_takes_the_best_reference(spark):
    hyp1 = "It is a guide to action which ensures that the rubber duck always disobeys the commands of the cat".split()
    ref1 = "It is the guiding principle which guarantees the rubber duck forces never being under the command of the cat".split()
    hyp2 = "he read the book because he was interested in world history".split()
    ref2 = "he was interested in world history because he read the book".split()
    df = spark.createDataFrame([(1, hyp1, [ref1]), (2, hyp2, [ref2])], "id int, p array<string>, r array<array<string>>")
    assert tm.corpus_gleu(tm.ngram_matches(df, "id", F.col("p"), F.col("r"), 4), "id").first()["gleu"] == pytest.approx(0.44, abs=0.005)


def test_sari_of_the_published_example(spark):
    refs = ["About 95 species are currently known.", "About 95 species are now accepted.", "95 species are now accepted."]
    df = frame(spark, [("About 95 you now get in.", refs), (None, refs), ("x", [])])
    got = {r["id"]: r["x"] for r in df.select("id", tm.sari(F.lit("About 95 species are currently accepted."), F.col("pred"), F.col("refs")).alias("x")).collect()}
    assert got[0] == pytest.approx(26.953601953601954) and got[1] is None and got[2] is None
    keep_only = tm.sari_score(list("aaab"), list("ab"), [list("aaab")])
    assert 0 < keep_only < 1


def test_rouge_words(spark):
    row = spark.range(1).select(tx.rouge_words(F.lit("Hello, WORLD-2!  naïve")).alias("a"), tx.words(F.lit("a　b c d")).alias("b"), tm.rouge_l(F.lit("The Cat sat."), F.lit("the cat, sat")).alias("c")).first()
    assert row["a"] == ["hello", "world", "2", "na", "ve"] and row["b"] == list("abcd") and row["c"] == 1.0


def test_common_subsequence_is_that_of_the_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert tm.common_subsequence(a, b) == table(a, b)


def test_many_distinct_words(spark):
    many = " ".join(f"w{i}" for i in range(2000))
    d = spark.createDataFrame([(many, many + " x")], "a string, b string").select(tx.word_distance(tx.words(F.col("a")), tx.words(F.col("b"))).alias("d")).first()["d"]
    assert d == 1
    far = spark.range(1).select(tx.word_distance(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (i * 0 + i).cast("string")), F.array(F.lit("1"), F.lit("3"))).alias("d")).first()["d"]
    assert far == 1


def test_empty_and_null(spark):
    df = frame(spark, [(None, None), ("", [""]), ("a", [])])
    t = tokens(df)
    assert {(r["id"], r["n"], r["matches"]) for r in tm.ngram_matches(t, "id", F.col("p"), F.col("r"), 2).collect()} == {(2, 1, 0)}
    assert tm.lengths(t, F.col("p"), F.col("r"), "closest").count() == 3
    assert tm.ngram_matches(t.where("false"), "id", F.col("p"), F.col("r"), 2).collect() == []
