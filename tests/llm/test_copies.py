import re

from codonlake.llm import copies

SCHEMA = "row_id bigint, sequence string, label string, id string, h1 int, kept_id string"


def rows(spark, data):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in data], SCHEMA)


def brute(data):
    groups = {}
    for i, s, label in data:
        if i is None:
            continue
        parts = sorted(re.sub(r"[\W_]", "", (x or "").lower()) for x in (s, label))
        if all(parts):
            groups.setdefault(tuple(parts), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in sorted(g) if i > min(g))


DATA = [
    (1, "ACGT", "1"), (2, " ac-gt\n", "(1)"), (3, "1", "ACGT"), (4, "ACGT", "0"), (5, None, "1"), (6, "--", "1"), (7, "ACGT", ""),
    (8, "acgt ", "'1'"), (None, "ACGT", "1"), (9, "ACGT" * 50_000, "1"), (10, "acgt " * 50_000, "1."), (11, "é", "1"), (12, "É", "1"),
    (13, "A", "B"), (14, "AB", ""), (15, "", "AB"),
]


def test_same_as_brute_force(spark):
    got = sorted(tuple(r) for r in copies.hidden_copies(rows(spark, DATA), "row_id", ["sequence", "label"]).collect())
    assert got == brute(DATA) == [(1, 2), (1, 3), (1, 8), (9, 10), (11, 12)]


def test_hot_keys_take_two_levels_and_give_the_same(spark):
    data = [(i, "ACGT" if i % 3 else f"ACGT{i}", "1") for i in range(1, 400)]
    df = rows(spark, data)
    keys = copies.canonical_keys(df, "row_id", ["sequence", "label"])
    assert copies.hot_keys(keys, 399, 8, 20).count() == 1
    hot = sorted(tuple(r) for r in copies.hidden_copies(df, "row_id", ["sequence", "label"], hot_parts=8, hot_least=20, salts=4).collect())
    assert hot == brute(data)


def test_records_count_their_copies(spark):
    got = {r["kept_id"]: (r["n_copies"], r["sequence"]) for r in copies.records(rows(spark, DATA), "row_id", ["sequence", "label"]).collect()}
    assert got[1] == (4, "ACGT") and got[4] == (1, "ACGT") and got[9][0] == 2


def test_empty_table(spark):
    assert copies.hidden_copies(rows(spark, []), "row_id", ["sequence", "label"]).collect() == []


def test_repeated_rows(spark):
    data = [(1, "A", "1"), (1, "A", "1"), (2, "a", "1")]
    assert sorted(tuple(r) for r in copies.hidden_copies(rows(spark, data), "row_id", ["sequence", "label"]).collect()) == [(1, 2)]


def test_records_of_repeated_identifiers(spark):
    data = [(1, "a", "1"), (1, "A", "1"), (1, "C", "1"), (1, "C", "1"), (2, "c.", "1"), (3, "G", "1")]
    got = sorted(tuple(r) for r in copies.records(rows(spark, data), "row_id", ["sequence", "label"]).collect())
    assert got == [(1, 2, "A", "1"), (1, 3, "C", "1"), (3, 1, "G", "1")]


def test_a_third_of_the_rows_in_one_key_by_default(spark):
    data = [(i, "ACGT" if i % 3 == 0 else f"ACGT{i // 2}", "1") for i in range(1, 3000)]
    df = rows(spark, data)
    keys = copies.canonical_keys(df, "row_id", ["sequence", "label"])
    assert copies.hot_keys(keys, len(data), hot_parts=4).count() == 1
    assert sorted(tuple(r) for r in copies.hidden_copies(df, "row_id", ["sequence", "label"]).collect()) == brute(data)
