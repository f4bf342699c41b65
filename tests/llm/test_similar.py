import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonlake.llm import blocking, near, overlap, sketch

SCHEMA = "row_id bigint, sequence string, label string, source string, tid int, side string, h string, id string, letters string"


def frame(spark, data):
    return spark.createDataFrame([(i, s, label, "src", 1, "a", "b", "c", "d") for i, s, label in data], SCHEMA)


def letters(s, label):
    a, b = (re.sub("[^A-Z]", "", (x or "").upper()) for x in (s, label))
    pure = re.compile("[ACGTURYSWKMBDHVN]+").fullmatch
    if pure(a) and (not pure(b) or len(a) >= len(b)):
        return a
    return b if pure(b) else a if len(a) >= 12 else ""


def sim(a, b):
    x, y = ({t[i : i + 12] for i in range(len(t) - 11)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def family(rng, n, length, rate):
    base = [rng.choice("ACGT") for _ in range(length)]
    return ["".join(rng.choice("ACGT") if rng.random() < rate else c for c in base) for _ in range(n)]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    seqs = [s for _ in range(12) for s in family(rng, 5, rng.choice([60, 150, 300]), 0.02)]
    seqs += ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(40)]
    long = "".join(rng.choice("ACGTN") for _ in range(300_000))
    seqs += [long, long[:150_000] + "A" + long[150_000:], "ACGT", "ACGTACGTACG", "A" * 300, "A" * 290, "GAA" * 60, "GAA" * 55 + "C"]
    rows = [(i + 1, s, "1") for i, s in enumerate(seqs)]
    rows += [(900, " " + seqs[0].lower() + "-", "0"), (901, "1", seqs[1]), (902, None, None), (903, None, "1"), (904, "", ""), (905, seqs[0], "promoter"), (None, seqs[0], "1")]
    return rows


def test_packed_runs_are_exact():
    text = "ACGTNNRYACGTACGTT"
    for width in range(1, 13):
        got = sketch.pack(np.frombuffer(text.encode(), np.uint8), width).tolist()
        want = [sum((ord(c) & 31) << (5 * (width - 1 - i)) for i, c in enumerate(text[j : j + width])) for j in range(len(text) - width + 1)]
        assert got == want


def test_sketches_fill_and_estimate():
    rng = random.Random(1)
    a, b = family(rng, 2, 400, 0.01)
    x, y = sketch.shingles(a), sketch.shingles(b)
    sx, sy = (sketch.sketch(np.zeros(len(v), int), v, 1, 2000)[0] for v in (x, y))
    assert (sx != sketch.EMPTY).all()
    assert abs((sx == sy).mean() - sketch.similarity(x, y)) < 0.06
    one = sketch.shingles("A" * 50)
    assert len(one) == 1 and (sketch.sketch(np.zeros(1, int), one, 1, 64) != sketch.EMPTY).all()


def test_parts_of_a_batch_give_each_text_its_runs(monkeypatch):
    monkeypatch.setattr(sketch, "CHUNK", 50)
    texts = ["ACGTACGTACGTA", "ACG", "", "G" * 200, "ACGTTGCAACGTTT", None, "TTTTTTTTTTTTC"]
    got = {}
    for use, row, codes in sketch.text_parts(pa.array(texts), 12):
        for k, u in enumerate(use):
            got[int(u)] = codes[row == k].tolist()
    assert sorted(got) == [0, 3, 4, 6]
    for k, v in got.items():
        assert v == sketch.pack(np.frombuffer(texts[k].encode(), np.uint8), 12).tolist()


def test_near_duplicates_are_those_of_brute_force(spark, data):
    got = {(r[0], r[1]) for r in near.near_duplicates(frame(spark, data)).collect()}
    known = [(i, letters(s, x)) for i, s, x in data if i is not None]
    want = {(min(i, j), max(i, j)) for i, a in known for j, b in known if i < j and a != b and sim(a, b) >= 0.5}
    assert got == want and len(want) > 50


def test_overlaps_are_those_of_brute_force(spark, data):
    ev, tr = data[::2], data[1::2] + [(2000, "ACGT", "1"), (2001, "acgtacgtacg", "0"), (2002, "ACGT", "0")]
    found = overlap.overlaps([frame(spark, ev[:30]), frame(spark, ev[30:])], frame(spark, tr))
    got = sorted((r[0], r[1]) for r in found.collect())
    a, b = ([(i, letters(s, x)) for i, s, x in rows if i is not None] for rows in (ev, tr))
    want = sorted((i, j) for i, x in a for j, y in b if x and y and (x == y or sim(x, y) >= 0.5))
    assert got == want and len(want) > 40
    rows = spark.createDataFrame([(i, "dev", "s" if i % 2 else None) for i, _ in a], "id bigint, split string, source string")
    counts = {r["source"]: r for r in overlap.overlap_counts(found, rows).collect()}
    assert sum(c["n_matches"] for c in counts.values()) == len(want)
    assert sum(c["n_overlapping"] for c in counts.values()) == len({i for i, _ in want})


def test_hot_blocks_lose_no_pair(spark):
    shared = [(7, h, h % 2) for h in range(40)] + [(8, h, h % 2) for h in range(40)] + [(9, 1, 1)]
    records = spark.createDataFrame([(k, h << 1 | s) for k, h, s in shared + shared[:5]], "key bigint, hs bigint")
    blocks = blocking.shared_blocks(records, True)
    got = {tuple(r) for r in blocking.candidates(blocks, True, 2, cell=3).collect()}
    assert got == {(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)}
    one = spark.createDataFrame([(k, h << 1) for k, h, _ in shared], "key bigint, hs bigint")
    got = [tuple(r) for r in blocking.candidates(blocking.shared_blocks(one, False), False, 1, cell=3).collect()]
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


@pytest.mark.parametrize("agree", [1, 2])
@pytest.mark.parametrize("two_sides", [False, True])
def test_salted_records_and_large_blocks_give_the_pairs_of_brute_force(spark, two_sides, agree):
    rng = random.Random(11)
    held = {h: {1} | ({2} if h % 3 == 0 else set()) | {rng.randrange(10, 60) for _ in range(3)} | {100 + h} for h in range(150)}
    side = {h: h % 2 if two_sides else 0 for h in held}
    records = [(k, h << 1 | side[h]) for h, ks in held.items() for k in sorted(ks)]
    rng.shuffle(records)
    out = []
    for part in range(3):  # three sketching tasks, with copies of some records
        salted = blocking.Salting(local=5)
        mine = records[part::3] + records[:40]
        for i in range(0, len(mine), 50):
            keys, hs = salted(np.array([k for k, _ in mine[i : i + 50]], np.int64), np.array([x for _, x in mine[i : i + 50]], np.int64))
            out += list(zip(keys.tolist(), hs.tolist(), strict=True))
    blocks = blocking.shared_blocks(spark.createDataFrame(out, "key bigint, hs bigint"), two_sides)
    assert blocks.where("hot").count() > 100 and blocks.where("not hot").count() > 0
    sizes = spark.createDataFrame(out, "key bigint, hs bigint").groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes < 60  # no group of the shuffle has the 150 texts of block 1
    got = sorted(tuple(r) for r in blocking.candidates(blocks, two_sides, agree, cell=7).collect())
    pairs = [(a, b) for a in held for b in held if (side[a] < side[b] if two_sides else a < b)]
    assert got == sorted(p for p in pairs if len(held[p[0]] & held[p[1]]) >= agree)


def test_half_of_all_texts_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(blocking, "LOCAL", 8)
    rng = random.Random(4)
    insert = "".join(rng.choice("ACGT") for _ in range(60))
    alone = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [alone(30) + insert + alone(30) for _ in range(80)] + [alone(120) for _ in range(60)]
    seqs += [s[:50] + "A" + s[50:] for s in seqs[:10]] + family(rng, 25, 200, 0.01)
    data = [(i, s, "1") for i, s in enumerate(seqs)]
    got = {(r[0], r[1]) for r in near.near_duplicates(frame(spark, data)).collect()}
    assert got == {(i, j) for i, a, _ in data for j, b, _ in data if i < j and a != b and sim(a, b) >= 0.5}


def test_rows_of_a_hot_text_are_spread(spark):
    left = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(20 if k == 1 else 3)], "k bigint, x bigint")
    right = spark.createDataFrame([(k, i) for k in (1, 2, 4) for i in range(35 if k == 2 else 4)], "k bigint, y bigint")
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    for both in (False, True):
        assert sorted(tuple(r) for r in blocking.joined_rows(left, right, ["k"], "x", "y", both, rows=6).collect()) == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near.near_duplicates(none).collect() == []
    assert overlap.overlaps([none], none).collect() == []
    assert overlap.overlaps([frame(spark, [(1, "ACGT" * 10, "1")])], none).collect() == []
