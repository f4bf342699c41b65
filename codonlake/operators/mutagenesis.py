"""Saturation mutagenesis: generating mutants, their effects, and what they say about each position.

Mutants are generated by exploding positions, so nothing but the row's own sequence is needed. The effect of a
substitution under an additive k-mer scorer is found from the few letters around it; whole mutants are only made where
they are asked for. Sequences keep their case; a null sequence has no mutants.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.functions import vectors as vec
from codonlake.operators import scoring
from codonlake.session import spread


BASES = "ACGT"


def _positions(df: DataFrame, id_col: str, seq: str, last: Column, step: int = 1) -> DataFrame:
    """(id, __s, pos): positions from 0 to ``last`` by ``step``."""
    rows = spread(df.where(F.col(seq).isNotNull()).select(id_col, seq)).select(id_col, F.col(seq).alias("__s"), last.alias("__last")).where("__last >= 0")
    return rows.select(id_col, "__s", F.explode(F.sequence(F.lit(0), F.col("__last"), F.lit(step))).alias("pos"))


def substitution_sites(df: DataFrame, id_col: str, seq: str, alphabet: str = "ACGT", positions: list[int] | None = None) -> DataFrame:
    """(id, __s, pos, ref, alt): every base other than the reference base, at all or the named positions."""
    sites = _positions(df, id_col, seq, F.length(seq) - 1)
    if positions is not None:
        sites = sites.where(F.col("pos").isin(positions))
    ref = F.substring("__s", F.col("pos") + 1, F.lit(1))
    each = sites.select(id_col, "__s", "pos", ref.alias("ref"), F.explode(F.array(*[F.lit(b) for b in alphabet])).alias("alt"))
    return each.where(F.col("ref") != F.col("alt"))


def substitutions(df: DataFrame, id_col: str, seq: str, alphabet: str = "ACGT", positions: list[int] | None = None) -> DataFrame:
    """(id, name, mutant) of every substitution."""
    s = substitution_sites(df, id_col, seq, alphabet, positions)
    mutant = F.concat(F.substring("__s", F.lit(1), F.col("pos")), F.col("alt"), F.substring("__s", F.col("pos") + 2, F.length("__s")))
    return s.select(id_col, F.concat_ws("_", F.lit("mut"), "pos", "ref", "alt").alias("name"), mutant.alias("mutant"))


def deletions(df: DataFrame, id_col: str, seq: str, size: int, fill: bool = False) -> DataFrame:
    s = _positions(df, id_col, seq, F.length(seq) - size)
    mutant = F.concat(F.substring("__s", F.lit(1), F.col("pos")), F.lit("N" * size if fill else ""), F.substring("__s", F.col("pos") + 1 + size, F.length("__s")))
    return s.select(id_col, F.concat_ws("_", F.lit("del"), "pos", F.lit(size)).alias("name"), mutant.alias("mutant"))


def insertions(df: DataFrame, id_col: str, seq: str, inserted: str) -> DataFrame:
    s = _positions(df, id_col, seq, F.length(seq))
    mutant = F.concat(F.substring("__s", F.lit(1), F.col("pos")), F.lit(inserted), F.substring("__s", F.col("pos") + 1, F.length("__s")))
    return s.select(id_col, F.concat_ws("_", F.lit("ins"), "pos", F.lit(inserted)).alias("name"), mutant.alias("mutant"))


def cuts(df: DataFrame, id_col: str, seq: str, size: int) -> DataFrame:
    """Suffixes from every ``size``-th letter, or with a negative size prefixes that lose as many."""
    step = abs(size)
    s = _positions(df, id_col, seq, F.length(seq) - step, step)
    mutant = F.substring("__s", F.col("pos") + 1, F.length("__s")) if size > 0 else F.substring("__s", F.lit(1), F.length("__s") - F.col("pos"))
    return s.select(id_col, F.concat_ws("_", F.lit("cut"), "pos", F.lit(size)).alias("name"), mutant.alias("mutant"))


def parse_name(name: Column) -> Column:
    """Struct (kind, pos, ref, alt) of a mutant's name; ref and alt are null unless it is a substitution."""
    part = F.split(name, "_")
    sub = part[0] == "mut"
    return F.struct(part[0].alias("kind"), part[1].try_cast("int").alias("pos"), F.when(sub, part[2]).alias("ref"), F.when(sub, F.get(part, F.lit(3))).alias("alt"))


def site_effects(df: DataFrame, id_col: str, seq: str) -> DataFrame:
    """One row a position: (id, pos, ref, raw, m_a, m_c, m_g, m_t, s_a, s_c, s_g, s_t): the probability of the sequence, and
    for each other base the probability after the substitution and log2 of their ratio; null at the reference base.

    A substitution changes the k-mers that cover it only, so their weights are compared, not whole sequences. All of a
    position comes from its own row, so what is said about a position takes no shuffle.
    """
    rows = spread(df.where(F.length(seq) > 0).select(id_col, seq))
    # A mark on either side stands for what isn't there; it has no weight, as any letter outside ACGT.
    around = F.regexp_extract_all(F.concat(F.lit("--"), F.col(seq), F.lit("--")), F.lit("(?s)(?![\\uDC00-\\uDFFF])(?=(.{5}))"), F.lit(1))
    raw = rows.select(id_col, scoring.weight_sum(F.col(seq)).alias("__raw"), around.alias("__a")).where(F.size("__a") > 0)
    sites = raw.select(id_col, "__raw", F.posexplode("__a").alias("pos", "__m"))
    digit = lambda i: F.call_function("instr", F.lit(BASES), F.substring("__m", i, 1))
    place = reduce(lambda code, i: code * 5 + digit(i), range(2, 6), digit(1)) * len(BASES)
    placed = sites.select(id_col, "pos", F.substring("__m", 3, 1).alias("ref"), "__raw", scoring.probability(F.col("__raw")).alias("raw"), place.alias("__at"))
    table = F.split(F.lit(_shifts()), ",").cast("array<double>")
    mutant = [F.when(F.col("ref") != b, scoring.probability(F.col("__raw") + F.get(table, F.col("__at") + i))).alias(f"m_{b.lower()}") for i, b in enumerate(BASES)]
    probs = placed.select(id_col, "pos", "ref", "raw", *mutant)
    return probs.select("*", *[vec.log2_ratio(F.col(f"m_{b.lower()}"), F.col("raw")).alias(f"s_{b.lower()}") for b in BASES])


@cache
def _shifts() -> str:
    """What each base in the middle of each five letters (ACGT and one mark for all others) adds to the weight of the three
    k-mers that cover it, by the number of the five letters and the base, joined."""
    total = lambda m: sum(scoring.kmer_weight(m[i : i + scoring.K]) for i in range(3))
    fives = ("".join(m) for m in product("-" + BASES, repeat=5))
    return ",".join(repr(total(m[:2] + b + m[3:]) - total(m)) for m in fives for b in BASES)


def effects(df: DataFrame, id_col: str, seq: str) -> DataFrame:
    """(id, pos, ref, alt, raw, mutant, score, diff): probability before and after each substitution under the native
    scorer, log2 of their ratio and their difference."""
    cells = F.array(*[F.struct(F.lit(b).alias("alt"), F.col(f"m_{b.lower()}").alias("mutant"), F.col(f"s_{b.lower()}").alias("score")) for b in BASES])
    each = site_effects(df, id_col, seq).select(id_col, "pos", "ref", "raw", F.explode(cells).alias("c")).where("c.alt <> ref")
    return each.select(id_col, "pos", "ref", "c.alt", "raw", "c.mutant", "c.score", (F.col("c.mutant") - F.col("raw")).alias("diff"))


def _site_scores() -> list[tuple[str, Column]]:
    return [(b, F.col(f"s_{b.lower()}")) for b in BASES]


def _added(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _is_wide(eff: DataFrame) -> bool:
    return "s_a" in eff.columns


def effect_summary(sites: DataFrame, id_col: str) -> DataFrame:
    """(id, n, mean_score, mean_diff, most, least) of all substitutions of each row, from ``site_effects``."""
    scores = [s for _, s in _site_scores()]
    diffs = [F.col(f"m_{b.lower()}") - F.col("raw") for b in BASES]
    known = lambda cs: _added([F.coalesce(c, F.lit(0.0)) for c in cs])
    count = lambda cs: _added([c.isNotNull().cast("bigint") for c in cs])
    site = sites.select(id_col, count(diffs).alias("n"), count(scores).alias("ns"), known(scores).alias("s"), known(diffs).alias("d"), F.greatest(*scores).alias("hi"), F.least(*scores).alias("lo"))
    sums = site.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("ns").alias("ns"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.max("hi").alias("most"), F.min("lo").alias("least"))
    return sums.select(id_col, "n", F.try_divide("s", "ns").alias("mean_score"), F.try_divide("d", "n").alias("mean_diff"), "most", "least")


def position_scores(eff: DataFrame, id_col: str, strategy: str = "maxabs") -> DataFrame:
    """(id, pos, score): one score a position. ``maxabs`` (also ``min`` and ``max``): the signed score of the largest
    size, the first base in order on ties; ``mean``: their mean. Scores that aren't numbers count as 0.

    ``eff`` is ``site_effects``, which takes no shuffle, or long rows (id, pos, alt, score) of any scorer.
    """
    if strategy not in ("maxabs", "min", "max", "mean"):
        raise ValueError(f"unknown strategy {strategy}")
    if _is_wide(eff):
        # A null at the reference base is left out; one elsewhere (a ratio that isn't positive) counts as 0.
        scores = [F.when(F.col("ref") != b, F.when(s.isNull() | F.isnan(s), 0.0).otherwise(s)) for b, s in _site_scores()]
        if strategy == "mean":
            value = _added([F.coalesce(s, F.lit(0.0)) for s in scores]) / _added([s.isNotNull().cast("int") for s in scores])
            return eff.select(id_col, "pos", value.alias("score"))
        sizes = eff.select(id_col, "pos", *[s.alias(f"v{i}") for i, s in enumerate(scores)]).withColumn("__m", F.greatest(*[F.abs(F.col(f"v{i}")) for i in range(len(BASES))]))
        return sizes.select(id_col, "pos", F.coalesce(*[F.when(F.abs(F.col(f"v{i}")) == F.col("__m"), F.col(f"v{i}")) for i in range(len(BASES))]).alias("score"))
    score = F.when(F.col("score").isNull() | F.isnan("score"), 0.0).otherwise(F.col("score"))
    value = F.avg(score) if strategy == "mean" else F.max_by(score, F.struct(F.abs(score), -F.expr("instr('ACGTN', alt)")))
    return eff.groupBy(id_col, "pos").agg(value.alias("score"))


def gain_loss(eff: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, gain, loss): the sum of positive scores and of the sizes of negative ones, from either form of effects."""
    if _is_wide(eff):
        gain = _added([F.when(s > 0, s).otherwise(0.0) for _, s in _site_scores()])
        loss = _added([F.when(s < 0, -s).otherwise(0.0) for _, s in _site_scores()])
        return eff.select(id_col, "pos", gain.alias("gain"), loss.alias("loss"))
    s = F.col("score")
    return eff.groupBy(id_col, "pos").agg(F.sum(F.when(s >= 0, s).otherwise(0.0)).alias("gain"), F.sum(F.when(s < 0, -s).otherwise(0.0)).alias("loss"))


def strongest_base(eff: DataFrame, id_col: str, digits: int | None = None) -> DataFrame:
    """(id, pos, ref, alt, score): the substitution with the highest score at each position, the first base in order on
    ties; scores may be rounded to ``digits`` before. From either form of effects."""
    if _is_wide(eff):
        scores = [(b, F.round(s, digits) if digits is not None else s) for b, s in _site_scores()]
        top = eff.select(id_col, "pos", "ref", F.greatest(*[s for _, s in scores]).alias("score"), *[s.alias(f"v_{b}") for b, s in scores])
        return top.select(id_col, "pos", "ref", F.coalesce(*[F.when(F.col(f"v_{b}") == F.col("score"), b) for b in BASES]).alias("alt"), "score")
    score = F.round("score", digits) if digits is not None else F.col("score")
    best = F.max_by(F.struct("ref", "alt", score.alias("score")), F.struct(score.alias("score"), -F.expr("instr('ACGTN', alt)")))
    return eff.groupBy(id_col, "pos").agg(best.alias("b")).select(id_col, "pos", "b.*")


def rolling_mean(df: DataFrame, by: str, place: str, value: Column, width: int, out: str = "rolling") -> DataFrame:
    """Centred rolling mean; at the ends, of what there is."""
    w = Window.partitionBy(by).orderBy(place).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.avg(value).over(w))


def hot_islands(scores: DataFrame, id_col: str, width: int = 10, percentile: float = 90.0) -> DataFrame:
    """(id, n, island_start, island_end): unbroken runs of positions whose rolling mean of sizes reaches the percentile."""
    rolled = rolling_mean(scores, id_col, "pos", F.abs("score"), width)
    limits = rolled.groupBy(id_col).agg(F.percentile("rolling", percentile / 100).alias("__limit"), F.count(F.lit(1)).alias("n"))
    hot = rolled.join(limits, id_col).where(F.col("rolling") >= F.col("__limit"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    return hot.withColumn("__run", run).groupBy(id_col, "n", "__run").agg(F.min("pos").alias("island_start"), (F.max("pos") + 1).alias("island_end")).drop("__run")


def hotspots(scores: DataFrame, id_col: str, width: int = 10, percentile: float = 90.0) -> DataFrame:
    """(id, hot_start, hot_end): the islands, widened to the window around their middle; an island that then lies in the
    one kept before it is dropped."""
    half = width // 2
    isl = hot_islands(scores, id_col, width, percentile)
    mid = F.floor((F.col("island_start") + F.col("island_end")) / 2)
    wide = isl.select(
        id_col, "island_start",
        F.least(F.greatest(F.lit(0), mid - half), F.col("island_start")).cast("bigint").alias("a"),
        F.greatest(F.least(mid + half, F.col("n")), F.col("island_end")).cast("bigint").alias("b"),
    )
    rows = wide.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("island_start", "a", "b"))).alias("w"))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def keep(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) > 0) & (x["a"] >= last["a"]) & (x["b"] <= last["b"]), kept).otherwise(F.concat(kept, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b")))))

    return rows.select(id_col, F.explode(F.aggregate("w", empty, keep)).alias("k")).select(id_col, F.col("k.a").alias("hot_start"), F.col("k.b").alias("hot_end"))


def hypothetical_scores(sites: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, a, c, g, t, ref, at_ref): the score of each base at each position, 0 at the reference base, and less
    the mean of the others as the reference base's own contribution; from ``site_effects``."""
    own = [F.coalesce(s, F.lit(0.0)) for _, s in _site_scores()]
    n = _added([s.isNotNull().cast("int") for _, s in _site_scores()])
    return sites.select(id_col, "pos", *[s.alias(b.lower()) for b, s in zip(BASES, own, strict=True)], "ref", (-F.try_divide(_added(own), n)).alias("at_ref"))


def contributions(sites: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, a, c, g, t): the one-hot letters times the reference base's own contribution, 0 at all other bases."""
    h = hypothetical_scores(sites, id_col)
    return h.select(id_col, "pos", *[F.when(F.col("ref") == b, F.col("at_ref")).otherwise(0.0).alias(b.lower()) for b in BASES])


def occlusion(df: DataFrame, id_col: str, seq: str, width: int = 1) -> DataFrame:
    """(id, pos, attribution): the score lost when a window is masked by N, averaged over the windows that cover the
    position. A mask takes the weights of all k-mers that touch it, so the loss of each window is a short sum over the
    row's own k-mers and nothing is shuffled."""
    reach = scoring.K - 1
    rows = spread(df.where(F.col(seq).isNotNull() & (F.length(seq) >= width) & (F.length(seq) > 0)).select(id_col, seq))
    n = F.length(seq)

    def part(values: Column, first: Column, last: Column) -> Column:
        """The values from place ``first`` to ``last``, counted from 0, as far as they are there."""
        low, high = F.greatest(first, F.lit(0)), F.least(last, F.size(values) - 1)
        return F.slice(values, low + 1, F.greatest(high - low + 1, F.lit(0)))

    mean = lambda v: vec.total(v) / F.size(v)
    lost = lambda w: F.transform(F.sequence(F.lit(0), n - width), lambda s: vec.total(part(w, s - reach, s + width - 1)))
    each = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda p: mean(part(x, p - width + 1, p)))
    codes = scoring.base_codes(F.split(seq, ""))
    out = vec.let(codes, lambda c: vec.let(scoring.kmer_weights(c), lambda w: vec.let(lost(w), each)))
    return rows.select(id_col, F.posexplode(out).alias("pos", "attribution"))
