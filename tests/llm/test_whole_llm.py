import pytest

from codonlake.llm import mixing, near, overlap, pieces, sentences
from codonlake.llm.sentences import Model

M = Model(frozenset(), frozenset({"The", "We", "Then"}), frozenset({"the", "we", "then"}))


def cut(text, model=M):
    return [text[a:b] for a, b in sentences.split(text, model)]


@pytest.mark.parametrize("word", ["no", "max", "min", "art", "gen", "col", "ref", "st", "p"])
def test_the_document_decides_before_the_list(word):
    parts = [f"It is set to {word}.", "Abel stops.", f"Where {word} is seen, all is well."]
    assert cut(" ".join(parts)) == parts
    parts = [f"See {word}. 5 of it.", f"That is the {word}.", "Then we stop.", f"The {word}. Abel value is high."]
    assert cut(" ".join(parts)) == parts


def test_all_documents_decide_before_the_list():
    text = "The answer is no. Abel stops."
    assert cut(text, Model(plain=frozenset({"no"}))) == ["The answer is no.", "Abel stops."]
    assert cut("The answer is no. We stop.", Model(frozenset({"no"}), M.starters, M.lower)) == ["The answer is no.", "We stop."]
    assert cut(text) == [text]
    text = "Ask Dr. Brastov, as Dr Abel did. See Fig 3 and Fig. Three."
    assert cut(text) == ["Ask Dr. Brastov, as Dr Abel did.", "See Fig 3 and Fig. Three."]


def test_plain_uses_of_all_documents(spark):
    texts = ["There is no way, or no."] * 3 + ["Ask Dr Abel and Dr. Abel."] * 3
    model = sentences.corpus_model(spark.createDataFrame([(t,) for t in [*texts, "No, no such thing"]], "text string"))
    assert "Dr" not in model.plain and "no" in model.plain


def mixed(spark, rows, aims):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame(aims, "source string, target_share double, max_repeats int")
    return {r["source"]: r for r in mixing.shares(mixing.mixture(docs, targets), targets).collect()}


@pytest.mark.parametrize("absent", [0.2, 0.35, 0.5])
@pytest.mark.parametrize("texts", [0, 1])
def test_a_source_almost_without_texts_does_not_empty_the_mixture(spark, absent, texts):
    rows = [(i, f"text {i} " + "of some words " * (1 + i % 9), ("faq", "notes")[i % 2]) for i in range(400)] + [(1000 + i, "one more", "tutorial") for i in range(texts)]
    rest = 1 - absent
    got = mixed(spark, rows, [("faq", rest * 0.6, 2), ("notes", rest * 0.4, 2), ("tutorial", absent, 2)])
    assert got["tutorial"]["n_texts"] == texts and (got["tutorial"]["share"] == 0) == (texts == 0)
    assert got["faq"]["n_texts"] + got["notes"]["n_texts"] > 100
    assert got["faq"]["n_tokens"] / got["notes"]["n_tokens"] == pytest.approx(1.5, rel=0.05)


def test_the_size_of_a_mixture():
    size = mixing.mixture_size
    assert size({"b": 1000}, {"a": (0.9, 2), "b": (0.1, 2)}) == 1000 and size({}, {"a": (1.0, 2)}) == 0
    assert size({"a": 0, "b": 1000, "c": 100}, {"a": (0.2, 2), "b": (0.4, 1), "c": (0.4, 1)}) == pytest.approx(250)
    assert size({"a": 10, "b": 100_000}, {"a": (0.9, 1), "b": (0.1, 1)}) == pytest.approx(100 / 9)


def test_gaps_come_from_the_pieces(spark):
    text = "ACGT" * 240 + "N" * 90 + "ACGT" * 300 + "N" * 1500 + "ACGT" * 50
    got = pieces.gaps(pieces.split_oversized(spark.createDataFrame([(1, text, "1")], "row_id bigint, sequence string, label string"), 1000, 100))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 960, 1050), (1, 2250, 3750)]
    assert "(?=N{10})" in got._jdf.queryExecution().optimizedPlan().toString()


def test_two_blocks_lose_no_more_than_one_did():
    lost = lambda n: 0.75**n + n * 0.25 * 0.75 ** (n - 1)
    assert near.AGREE == overlap.AGREE == 2
    assert lost(near.BANDS) <= 0.75**32 and lost(overlap.SEGMENTS) <= 0.75**24
