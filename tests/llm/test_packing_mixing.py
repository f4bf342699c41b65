import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from codonlake.llm import mixing, packing, tokens
from codonlake.session import rank_within

DOCS = "doc_id bigint, text string, source string, id string, n_tokens string, size int, rank int, rate int"


def docs(spark, data):
    return spark.createDataFrame([(*d, "a", "b", 1, 2, 3) for d in data], DOCS)


def some_docs(n=300, seed=2):
    rng = random.Random(seed)
    words = "the a split of train dev rows promoter sequence labels tokens mean".split()
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 90, 400]))), rng.choice(["faq", "FAQ ", "lab note", "lab_note", None, "odd"])) for i in range(n)]
    return out + [(9000, None, "faq"), (9001, "", "faq"), (9002, "word " * 9000, "faq"), (None, "no id", "faq"), (9003, "same text", "faq"), (9004, "same text", "odd"), (9005, "same text", "lab-note")]


def brute_best_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b[0] >= length]
            if fits:
                min(fits, key=lambda b: b[0])[0] -= length
            else:
                bins.append([capacity - length])
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_over_counts_equals_best_fit_over_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(25)}
    plan = packing.best_fit(counts, capacity)
    used = collections.Counter()
    placed = collections.Counter()
    spans = collections.defaultdict(list)
    for length, rank, n, first, offset in plan:
        placed[length] += n
        for k in range(n):
            used[first + k] += length
            spans[first + k].append((offset, offset + length))
    assert placed == counts and max(used.values()) <= capacity
    assert len(used) == brute_best_fit(counts, capacity) == max(used) + 1
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][1] <= capacity


def test_packed_texts(spark):
    data = some_docs()
    rows = packing.pack(docs(spark, data), 128).collect()
    enc = tokens.encoding(tokens.TOKENIZER)
    sizes = {i: len(enc.encode_ordinary(t)) for i, t, _ in data if i is not None and t is not None}
    by, load = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
        if r["container_id"] >= 0:
            load[r["container_id"]].append((r["container_offset"], r["n_tokens"]))
    assert set(by) == set(sizes)
    for i, ps in by.items():
        assert sum(p["n_tokens"] for p in ps) == sizes[i] and len(ps) == max(1, math.ceil(sizes[i] / 128))
        assert sorted(p["token_start"] for p in ps) == [k * 128 for k in range(len(ps))]
        assert (ps[0]["container_id"] == -1) == (sizes[i] == 0)
    for slots in load.values():
        slots.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(slots, slots[1:], strict=False)) and sum(slots[-1]) <= 128
    full = packing.fill(packing.pack(docs(spark, data), 128), 128).first()
    assert full["n_containers"] == len(load) and full["share_filled"] > 0.9


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, []), 100).collect() == []
    assert packing.fill(packing.pack(docs(spark, []), 100), 100).first()["share_filled"] is None


def test_ranks_don_t_depend_on_one_task(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("g"))
    got = rank_within(df, ["g"], [F.col("id")], 1000, "r", rows_per_task=50).collect()
    for g in (True, False):
        assert sorted(r["r"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


TARGETS = [("faq", 0.6, 2), ("Lab Note", 0.4, 4)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixture_reaches_its_shares(spark):
    data = some_docs(1500)
    mixed = mixing.mixture(docs(spark, data), targets(spark))
    rows = {r["id"]: r for r in mixed.collect()}
    caps = {"faq": 2, "lab_note": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] and abs(r["copies"] - r["rate"]) < 1 for r in rows.values())
    assert 9000 not in rows and 9001 not in rows and 9003 in rows and 9004 not in rows and 9005 not in rows
    shares = {r["source"]: r for r in mixing.shares(mixed, targets(spark)).collect()}
    assert abs(shares["faq"]["share"] - 0.6) < 0.01 and abs(shares["lab_note"]["share"] - 0.4) < 0.01


def test_rates_are_exponential_in_length(spark):
    mixed = mixing.mixture(docs(spark, some_docs(800)), targets(spark), total=30_000.0).where("rate < 2 and source = 'faq'").select("n_tokens", F.log("rate").alias("l")).distinct().collect()
    ratio = [r["l"] / r["n_tokens"] for r in mixed]
    assert len(ratio) > 5 and max(ratio) - min(ratio) < 1e-6 * max(abs(x) for x in ratio)


def test_targets_that_can_t_be_met(spark):
    data = [d for d in some_docs(600) if d[0] != 9002]
    t = targets(spark, [*TARGETS, ("missing", 0.1, 3)])
    mixed = mixing.mixture(docs(spark, data), t)
    shares = {r["source"]: r for r in mixing.shares(mixed, t).collect()}
    assert shares["missing"]["share"] == 0 and shares["missing"]["n_texts"] == 0
    assert abs(shares["faq"]["n_tokens"] / shares["lab_note"]["n_tokens"] - 1.5) < 0.05
    assert mixing.wanted_tokens({"a": 10, "b": 100}, {"a": (0.5, 2), "b": (0.5, 1)}, 100) == {"a": 20.0, "b": 50.0}
    assert mixing.mixture_size({"a": 10, "b": 100}, {"a": (0.1, 1), "b": (0.9, 1)}, 0.15) == pytest.approx(110)


def test_mix_nothing(spark):
    assert mixing.mixture(docs(spark, []), targets(spark)).collect() == []
    assert mixing.mixture(docs(spark, some_docs(20)), targets(spark, [])).collect() == []
