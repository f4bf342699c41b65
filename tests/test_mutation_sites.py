import math
import random
from hashlib import md5

import pytest

from codonlake.functions import sequence as sq
from codonlake.operators import mutagenesis as mu
from codonlake.operators import mutant_sums as ms
from codonlake.operators import scoring
from codonlake.plans import registry
from codonlake.plans.mutants import summary
from pyspark.sql import functions as F

SEQS = {1: "ACGTTGCA", 2: "acgtN", 3: "", 4: None, 5: "A", 6: "AC", 7: "GGGCCN-ACT\nA", 8: "A😀CG", 9: "".join(random.Random(2).choice("ACGT") for _ in range(300))}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(SEQS.items()), "row_id bigint, sequence string")


def weight(s):
    return sum(scoring.kmer_weight(s[i : i + 3]) for i in range(len(s) - 2))


def score(s, i, b):
    p = lambda w: 1 / (1 + math.exp(-w / 10))
    return math.log2(p(weight(s[:i] + b + s[i + 1 :])) / p(weight(s)))


def brute():
    return {(r, i): {b: score(s, i, b) for b in "ACGT" if b != c} for r, s in SEQS.items() for i, c in enumerate(s or "")}


def test_wide_and_long_effects_are_those_of_whole_mutants(df):
    want = brute()
    got = {}
    for r in mu.effects(df, "row_id", "sequence").collect():
        got.setdefault((r["row_id"], r["pos"]), {})[r["alt"]] = r["score"]
        assert r["ref"] == SEQS[r["row_id"]][r["pos"]]
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    sites, long = mu.site_effects(df, "row_id", "sequence"), mu.effects(df, "row_id", "sequence")
    for f in (mu.position_scores, lambda d, i: mu.position_scores(d, i, "mean"), mu.gain_loss, lambda d, i: mu.strongest_base(d, i, 9)):
        a, b = ({(r["row_id"], r["pos"]): tuple(round(x, 8) if isinstance(x, float) else x for x in r.asDict().values()) for r in f(d, "row_id").select("row_id", "pos", "*").collect()} for d in (sites, long))
        assert {k: sorted(map(str, v)) for k, v in a.items()} == {k: sorted(map(str, v)) for k, v in b.items()}
    plan = mu.position_scores(sites, "row_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the spreading of the rows


def test_occlusion_is_that_of_masked_sequences(df):
    for width in (1, 4):
        got = {(r["row_id"], r["pos"]): r["attribution"] for r in mu.occlusion(df, "row_id", "sequence", width).collect()}
        want = {}
        for r, s in SEQS.items():
            lost = [weight(s) - weight(s[:i] + "N" * width + s[i + width :]) for i in range(len(s) - width + 1)] if s else []
            for p in range(len(s or "") if lost else 0):
                own = lost[max(0, p - width + 1) : p + 1]
                want[r, p] = sum(own) / len(own)
        assert got == pytest.approx(want, abs=1e-9)


def test_contributions_are_one_hot(df):
    rows = mu.contributions(mu.site_effects(df.where("row_id = 1"), "row_id", "sequence"), "row_id").collect()
    assert all([c for c in "acgt" if r[c] != 0.0] in ([], [SEQS[1][r["pos"]].lower()]) for r in rows) and len(rows) == 8


def test_k_mers_of_any_text(df):
    got = {r["row_id"]: r["k"] for r in df.select("row_id", sq.kmers(F.col("sequence"), 3).alias("k")).collect()}
    assert got == {r: None if s is None else [s.upper()[i : i + 3] for i in range(len(s) - 2)] for r, s in SEQS.items()}


MORE = SEQS | {10 + n: "".join(random.Random(n).choice("ACGTacN") for _ in range(n)) for n in (54, 55, 56, 63, 64, 65, 119, 120, 129, 700)} | {8000: "é" + "ACGT" * 40, 8001: None, 8002: "\x00A"}


def whole_mutants_and_sums(spark, tmp_path, alphabet, name):
    dev = spark.createDataFrame([*MORE.items(), (9, "ACG")], "row_id bigint, sequence string").repartition(2)
    dev.write.parquet(str(tmp_path / "dev.parquet"))
    out = registry.queries()[name](spark, str(tmp_path))
    want = sorted(tuple(r) for r in summary(mu.substitutions(dev, "row_id", "sequence", alphabet)).collect())
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) == len(MORE) - 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan  # no row for each mutant


def test_sums_of_substitutions_with_n_are_those_of_whole_mutants(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ms, "LETTERS", 500)
    whole_mutants_and_sums(spark, tmp_path, "ACGTN", "mut_subst_n")


def test_sums_of_substitutions_are_those_of_whole_mutants(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ms, "LANES", 100)
    whole_mutants_and_sums(spark, tmp_path, "ACGT", "mut_subst")


def test_long_mutants_are_digested_by_a_function_in_the_jvm(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ms, "LETTERS", 640)  # a long sequence goes in several lots
    seqs = {n: "".join(random.Random(n).choice("ACGT") for _ in range(n)) for n in (639, 640, 641, 2500)}
    spark.createDataFrame([*seqs.items()], "row_id bigint, sequence string").write.parquet(str(tmp_path / "dev.parquet"))
    check = lambda text: int(md5(text.encode()).hexdigest()[:8], 16)
    want = {}
    for r, s in seqs.items():
        sites = [(p, ref, alt) for p, ref in enumerate(s) for alt in "ACGT" if alt != ref]
        want[r] = (r, len(sites), len(sites) * len(s), sum(check(s[:p] + alt + s[p + 1 :]) for p, _, alt in sites), sum(check(f"mut_{p}_{ref}_{alt}") for p, ref, alt in sites))
    for session in (spark, spark, spark.newSession()):
        out = registry.queries()["mut_subst"](session, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MutantSums(") == 1 and "Arrow" not in plan and "Python" not in plan
        assert {r["row_id"]: tuple(r) for r in out.collect()} == want
