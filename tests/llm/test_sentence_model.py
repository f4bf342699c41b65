import random
import time

import pytest

from codonlake.llm import sentences
from codonlake.llm.sentences import Model

WORDS = "The the We we approx zq seq. et al. Dr. no no. No. Fig. 3 e.g. U.S. A. B. Then then, Haupt-Str. usw. sample data (of two) \"All is well.\" Long-word ca. 12.5 10. см. рис. 这是。 好。".split()
SCHEMA = "doc_id bigint, text string"


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40))) + rng.choice([".", "?", "", "…"]) for _ in range(rng.randrange(1, 5))]
        out.append(rng.choice([" ", "\n\n", "\n"]).join(parts))
    return out


def test_a_text_asks_for_all_it_needs():
    rng = random.Random(9)
    for t in [*texts(300, 1), "x" * 200 + ". Then", "A.B." * 50 + " We go. https://a.b/" + "c.D" * 100 + " end. We"]:
        words = sorted({w.strip(".,()\"") for w in t.split()} | sentences.questions(t))
        model = Model(*(frozenset(w for w in words if rng.random() < 0.4) for _ in range(4)))
        asked = sentences.questions(t)
        few = Model(*(frozenset(x & asked) for x in (model.abbreviations, model.starters, model.lower, model.plain)))
        assert sentences.split(t, few) == sentences.split(t, model), t


def test_join_and_broadcast_give_the_same(spark):
    rows = [(i, t) for i, t in enumerate(texts(80, 2))] + [(500, None), (501, ""), (None, "No id. We stay."), (502, "Copy. We. The end."), (503, "Copy. We. The end.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted((tuple(r) for r in sentences.sentences(df, model_rows=m).collect()), key=str) for m in (0, 10_000)]
    assert got[0] == got[1] and len(got[0]) > 200


def test_more_documents_do_not_weaken_what_is_known(spark):
    own = [(i, f"We saw zq. and more of zq. {i} here. The zq. We think.") for i in range(6)] + [(6, "The zq. Abel value. We go on.")]
    others = [(1000 + i, f"Word{i} stands in row{i} of this list, with value{i}.") for i in range(10_000)]
    few, many = (spark.createDataFrame(own + others[:n], SCHEMA) for n in (10, 10_000))
    got = [sorted(tuple(r) for r in sentences.sentences(d).where("id < 1000").collect()) for d in (few, many)]
    assert got[0] == got[1]
    assert "zq" in sentences.corpus_model(many).abbreviations


def test_links_and_words_of_any_length():
    link = "https://example.org/" + "a.B?c=" * 2000
    assert [a for a, _ in sentences.split(f"See {link} now. Then stop.", Model())] == [0, len(link) + 10]
    for n in (30, 39, 41, 100, 5000):
        word = "x" * n
        assert len(sentences.split(f"The {word}. Then stop.", Model())) == 2
        dotted = "a." * n
        assert len(sentences.split(f"The {dotted}b. Then stop.", Model())) == 1
        assert len(sentences.split(f"The {word}-vgl. Then stop.", Model())) == 1
        assert len(sentences.split("The " + "7" * n + ". Then stop.", Model())) == 1
        key = "Y" + word
        assert len(sentences.split(f"{key} stands.\n\nOf 5. {key} stands.", Model(lower=frozenset({sentences.entry(key.lower())})))) == 3
    assert sentences.entry("a" * 64) == "a" * 64 and len(sentences.entry("a" * 65)) == 33


def test_a_name_after_an_abbreviation_begins_no_sentence():
    text = "Brastov was there.\n\nWe asked zq. Brastov and zq. 5 people. They saw zq. We left, as we had."
    got = [text[a:b] for a, b in sentences.split(text, Model(starters=frozenset({"We", "Brastov", "They"})))]
    assert got == ["Brastov was there.", "We asked zq. Brastov and zq. 5 people.", "They saw zq.", "We left, as we had."]


@pytest.mark.parametrize("unit", ["A.B", "ab.Cd", "x:// .", "No.", "…A", "7.", "(a. "])
def test_one_endless_word_takes_linear_time(unit):
    def seconds(n):
        began = time.time()
        sentences.split(unit * n, Model())
        sentences.questions(unit * n)
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 14 * seconds(20_000) + 1


def test_both_ways_to_find_abbreviations(monkeypatch):
    for t in texts(200, 5):
        with monkeypatch.context() as m:
            m.setattr(sentences, "_LONG", 0)
            other = sentences.split(t, Model(starters=frozenset({"The"})))
        assert other == sentences.split(t, Model(starters=frozenset({"The"})))
