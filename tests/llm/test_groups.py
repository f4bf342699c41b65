import random

from codonlake.llm import groups
from tests.llm.test_similar import data, frame, letters, sim  # noqa: F401


def brute_roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    links += [(b, a) for a, b in links[:20]] + links[:5]
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == brute_roots({x for p in real for x in p}, real)
    assert groups.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_groups_are_those_of_brute_force(spark, data):  # noqa: F811
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in groups.near_duplicate_groups(frame(spark, data)).collect()}
    known = {i: letters(s, x) for i, s, x in data if i is not None}
    long = {i: t for i, t in known.items() if len(t) >= 12}
    texts = sorted(set(long.values()))
    links = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if sim(a, b) >= 0.5]
    first = {t: min(i for i, x in long.items() if x == t) for t in texts}
    roots = brute_roots(set(first.values()), [(first[a], first[b]) for a, b in links])
    count = {t: sum(t in p for p in links) for t in texts}
    assert got == {i: (roots[first[t]], count[t]) if len(t) >= 12 else (i, 0) for i, t in known.items()}
    assert groups.near_duplicate_groups(frame(spark, [])).collect() == []
