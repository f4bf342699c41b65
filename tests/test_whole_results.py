import numpy as np
import pytest

from codonlake.operators import metrics as me
from codonlake.plans import registry


def test_mahalanobis_takes_whole_vectors(spark, tmp_path):
    v = np.random.default_rng(5).normal(1.0, 2.0, (300, 64)) * np.linspace(0.5, 3, 64)
    x = v - v.mean()
    want = ((x @ np.linalg.pinv(np.cov(v.T))) * x).sum(axis=1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(300, None), (301, [None] + [1.0] * 63)], "vec_id bigint, embedding array<double>").repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["mahalanobis"] for r in registry.queries()["mahalanobis"](spark, str(tmp_path)).collect()}
    assert got.pop(300) is None and got.pop(301) is None
    assert [got[i] for i in range(300)] == pytest.approx(want, abs=1e-3)
    named = df.selectExpr("cast(vec_id as string) name", "embedding")
    assert me.mahalanobis(named, "name", "embedding", df.limit(1)).where("mahalanobis is null").count() == 302
    with pytest.raises(ValueError):
        me.mahalanobis(df.selectExpr("vec_id", "slice(embedding, 1, 8) embedding"), "vec_id", "embedding", df)


def test_overlap_left_join_takes_all_genes(spark, tmp_path):
    genes = [("chr1", a, a + 50, "+", f"g{a}", "gene") for a in (100, 200, 301, 402)]
    parts = [("chr1", a, a + 10, "+", f"e{a}", "exon") for a in (90, 145, 205, 340, 345, 460, 2000)] + [("chr2", 205, 215, "+", "e2", "exon")]
    spark.createDataFrame(genes + parts, "chrom string, start_pos bigint, end_pos bigint, strand string, gene string, feature string").coalesce(1).write.parquet(str(tmp_path / "intervals.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["overlap_left_join"](spark, str(tmp_path)).collect())
    want = {90: -1, 145: 100, 205: 200, 340: 301, 345: 301, 460: -1, 2000: -1}
    assert got == sorted([("chr1", a, a + 10, f"e{a}", b, b + 50 if b >= 0 else -1) for a, b in want.items()] + [("chr2", 205, 215, "e2", -1, -1)])


def test_whole_values_are_returned(spark):
    sf = "/root/testdata/sf0.001"
    q = registry.queries()
    assert {"attention_norms", "kmer_features", "plot_radar"} <= set(registry.oracle_sql())
    row = q["attention_norms"](spark, sf).first()
    assert all(len(row[c]) == 64 for c in ("softmax", "minmax", "l1", "l2", "z"))
    assert len(q["kmer_features"](spark, sf).first()["shares"]) == 16
    assert {r["split"] for r in q["plot_radar"](spark, sf).select("split").distinct().collect()} == {"dev", "test"}
