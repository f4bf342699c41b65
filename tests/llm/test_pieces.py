import random
import re

import pytest
from pyspark.sql import functions as F

from codonlake.llm import pieces

SCHEMA = "row_id bigint, sequence string, label string, letters string, cores string, id string"


def frame(spark, data):
    return spark.createDataFrame([(i, s, "1", "x", "y", "z") for i, s in data], SCHEMA)


def long_rows():
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    return [
        (1, base(1000)), (2, base(1001)), (3, base(500) + "N" * 30 + base(900)), (4, "N" * 3000), (5, base(300) + "N" * 9 + base(1500)),
        (6, ("N" * 12 + base(80)) * 60), (7, base(30_000) + "N" * 50), (8, None), (9, ""), (10, base(880) + "N" * 40 + base(600)), (None, base(2000)),
        (11, "acgt-" * 400), (12, base(950) + "N" * 2000 + base(950)),
    ]


def test_pieces_cover_fit_and_overlap(spark):
    data = dict(long_rows())
    for capacity, overlap in ((1000, 100), (512, 64), (300, 0)):
        rows = pieces.pieces(pieces.split_oversized(frame(spark, long_rows()), capacity, overlap), overlap).collect()
        by = {}
        for r in rows:
            by.setdefault(r["id"], []).append(r)
        letters = {i: re.sub("[^A-Z]", "", (s or "").upper()) for i, s in data.items() if i is not None}
        assert set(by) == {i for i, s in letters.items() if len(s) > capacity}
        for i, ps in by.items():
            ps.sort(key=lambda r: r["piece_no"])
            text = letters[i]
            assert ps[0]["piece_start"] == 0 and ps[-1]["piece_end"] == len(text) and ps[-1]["boundary"] == "end"
            for p in ps:
                assert p["piece"] == text[p["piece_start"] : p["piece_end"]] and len(p["piece"]) <= capacity
            for a, b in zip(ps, ps[1:], strict=False):
                assert b["piece_start"] == a["piece_end"] - overlap and b["piece_end"] > a["piece_end"]
                at = a["piece_end"]
                if a["boundary"] == "after_gap":
                    assert text[at - 10 : at] == "N" * 10 and text[at] != "N"
                elif a["boundary"] == "before_gap":
                    assert text[at : at + 10] == "N" * 10 and text[at - 1] != "N"
                else:
                    assert a["boundary"] == "letter"
                    from_ = a["piece_end"] - len(a["piece"]) + (overlap if a["piece_no"] else 0)
                    window = text[from_ + overlap + 1 : at]
                    assert not re.search("(?<!N)N{10}", text[from_ + overlap + 1 : at + 1]) or window.startswith("N")


def test_gaps_are_those_of_brute_force(spark):
    got = sorted(tuple(r) for r in pieces.gaps(pieces.split_oversized(frame(spark, long_rows()), 1000, 100)).collect())
    want = []
    for i, s in long_rows():
        text = re.sub("[^A-Z]", "", (s or "").upper())
        if i is not None and len(text) > 1000:
            want += [(i, m.start(), m.end()) for m in re.finditer("N{10,}", text)] or [(i, -1, -1)]
    assert got == sorted(want)


def test_limits_that_make_no_sense():
    for capacity, overlap in ((100, 50), (100, -1), (8, 0)):
        with pytest.raises(ValueError):
            pieces.cut_pattern(capacity, overlap)


def test_empty_and_repeated(spark):
    assert pieces.gaps(pieces.split_oversized(frame(spark, []), 1000, 100)).collect() == []
    twice = frame(spark, [(1, "ACGT" * 300)] * 2)
    assert [tuple(r) for r in pieces.gaps(pieces.split_oversized(twice, 1000, 100)).collect()] == [(1, -1, -1)] * 2


def test_time_grows_with_the_letters_not_with_their_square(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.col("id").alias("row_id"), F.repeat(F.lit("ACGTTGCA" * 125 + "N" * 24), n).alias("sequence"), F.lit("1").alias("label"))
        began = time.time()
        got = pieces.pieces(pieces.split_oversized(df, 1000, 100), 100).agg(F.sum(F.length("piece")), F.count("piece")).first()
        return time.time() - began, got

    seconds(200)
    short, few = seconds(1000)
    long, many = seconds(4000)
    assert abs(many[1] / few[1] - 4) < 0.1 and long < 10 * short + 2
