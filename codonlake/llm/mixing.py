"""Mixing sources to target weights.

Texts are used 0, 1 or more times so that each source contributes its target share of all tokens, no text more often
than its source's ``max_repeats``, and the shares actually reached are reported.

Method: entropy balancing. The rates of the texts are those nearest (in relative entropy) to using each text once, among
all rates that give each source its tokens: rate = exp(multiplier of the source * tokens / mean tokens), at most the
cap. The multipliers are the solution of the convex dual, one token constraint a source, found by Newton steps kept in
brackets; each step is one distributed sum over the table of (source, tokens) cells, which stands for all texts, as
texts of one cell have one rate. Rates are rounded to copies by carrying the fractions from cell to cell in order of
length: the copies of a source differ from its rates by less than one text in all, and texts of a cell that get one copy
more are chosen by rank in a hashed order.

The mixture's size is ``total`` tokens. By default it is the largest size, not above that of all usable texts, at which
every source that has usable texts and a cap above 0 gets its share, so the targets go before the size: a source with
few tokens and a large share makes the mixture small. A source without usable texts never limits the size; nor does one
that would allow less than ``NEARLY`` of all usable tokens, as long as such sources and all that allow less have at most
``MOST_SHORT`` of the weights. ``slack`` allows a larger size, at which the sources that limit it most fall short, as long
as they have at most ``slack`` of the target weights together. Sources that fall short are used up to their caps, and the
others keep the proportions of their targets.

A source with one text that is a good part of its tokens may so miss its share by that text.

Defined results: names of sources are compared in lower case, with runs of spaces, hyphens and underscores as one
underscore. Rows with a null identifier or text, texts without tokens, and rows whose source is null or has no target
are not used. Equal texts are one text, with the smallest identifier among rows whose source has a target. A target
without texts is reported with share 0. An empty table gives an empty mixture. Columns beside those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm.tokens import TOKENIZER, with_token_counts
from codonlake.session import cut, rank_within

#: Sources with a target at most: they are handled one by one on the driver.
MOST_SOURCES = 10_000
#: Part of all usable tokens below which the size isn't brought by sources that have at most MOST_SHORT of the weights.
NEARLY, MOST_SHORT = 0.01, 0.5
STEPS = 60
CLOSE = 1e-7


def plain_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Target share and most repeats by source, from the rows of the target table."""
    rows = targets.select(plain_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    return {r["s"]: (float(r["target_share"]), max(0, int(r["max_repeats"] or 0))) for r in rows}


def mixture_size(pool: dict[str, int], targets: dict[str, tuple[float, int]], slack: float = 0.0) -> float:
    """The default size, from the usable tokens of each source."""
    weight = sum(share for share, _ in targets.values())
    most = sorted((cap * pool.get(s, 0) / share * weight, share) for s, (share, cap) in targets.items())
    short, usable = 0.0, float(sum(pool.values()))
    for size, share in most:
        short += share
        if size <= 0:
            continue
        if size < NEARLY * usable and short <= MOST_SHORT * weight * (1 + 1e-9):
            continue
        if short > slack * weight * (1 + 1e-9):
            return min(size, usable)
    return usable


def wanted_tokens(pool: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens each source has to give: its share of ``total``, or all its cap allows."""
    weight = sum(share for share, _ in targets.values())
    return {s: min(float(cap * pool.get(s, 0)), total * share / weight) for s, (share, cap) in targets.items()}


def _rates(cells: DataFrame, multipliers: dict[str, float], caps: dict[str, int], means: dict[str, float]) -> DataFrame:
    """``cells`` with the rate of each cell."""
    rows = [(s, float(m), float(caps[s]), float(means[s])) for s, m in multipliers.items()]
    sources = cells.sparkSession.createDataFrame(rows, "source string, multiplier double, cap double, mean double")
    power = F.least(F.lit(700.0), F.col("multiplier") * F.col("n_tokens") / F.col("mean"))
    return cells.join(F.broadcast(sources), "source").withColumn("rate", F.when(F.isnan("multiplier"), F.col("cap")).otherwise(F.least("cap", F.exp(power))))


def solve(cells: DataFrame, sums: dict[str, tuple[int, int]], want: dict[str, float], caps: dict[str, int]) -> dict[str, float]:
    """The multiplier of each source; NaN stands for a source that is used up to its cap.

    ``sums``: tokens and texts of each source with texts.
    """
    means = {s: t / n for s, (t, n) in sums.items()}
    found = {s: math.nan for s in sums if want[s] >= caps[s] * sums[s][0] * (1 - 1e-12)}
    found |= {s: -math.inf for s in sums if s not in found and want[s] <= 0}
    at = {s: math.log(max(want[s], 1e-300) / sums[s][0]) for s in sums if s not in found}
    low, high = dict.fromkeys(at, -math.inf), dict.fromkeys(at, math.inf)
    for _ in range(STEPS):
        if not at:
            break
        x = F.col("n_tokens") / F.col("mean")
        part = _rates(cells, at, caps, means)
        slope = F.when(F.col("rate") < F.col("cap"), F.col("n") * F.col("rate") * F.col("n_tokens") * x).otherwise(0.0)
        for r in part.groupBy("source").agg(F.sum(F.col("n") * F.col("rate") * F.col("n_tokens")).alias("f"), F.sum(slope).alias("g")).collect():
            s, miss = r["source"], r["f"] - want[r["source"]]
            if abs(miss) <= CLOSE * want[s]:
                found[s] = at.pop(s)
                continue
            low[s], high[s] = (at[s], high[s]) if miss < 0 else (low[s], at[s])
            step = at[s] - miss / r["g"] if r["g"] > 0 else math.inf
            if not low[s] < step < high[s]:
                bounds = low[s], high[s]
                step = sum(bounds) / 2 if all(map(math.isfinite, bounds)) else at[s] + (1.0 if miss < 0 else -1.0)
            at[s] = step
    return found | at


def pool_of(df: DataFrame, targets: dict[str, tuple[float, int]], id_col: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, n_tokens, h1, h2) of each distinct text that may be used, written once."""
    named = df.select(df[id_col].cast("bigint").alias("id"), plain_source(df[source]).alias("source"), df[text].alias("text"))
    use = named.where(F.col("id").isNotNull() & F.col("source").isin(list(targets)) & (F.length("text") > 0))
    use = use.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    sized = with_token_counts(use, "text", ["id", "source", "h1", "h2"], tokenizer).where("n_tokens > 0")
    first = sized.groupBy("h1", "h2").agg(F.min(F.struct("id", "source", "n_tokens")).alias("x"))
    return cut(first.select("x.*", "h1", "h2"))


def mixture(df: DataFrame, targets: DataFrame, total: float | None = None, slack: float = 0.0, **columns: str) -> DataFrame:
    """(id, source, n_tokens, rate, copies) of every text that is used at least once."""
    aims = targets_of(targets)
    pool = pool_of(df, aims, **columns)
    cells = cut(pool.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    sums = {r["source"]: (int(r["t"]), int(r["c"])) for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("c")).collect()}
    caps = {s: cap for s, (_, cap) in aims.items()}
    tokens = {s: t for s, (t, _) in sums.items()}
    want = wanted_tokens(tokens, aims, mixture_size(tokens, aims, slack) if total is None else float(total))
    rated = _rates(cells, solve(cells, sums, want, caps), caps, {s: t / n for s, (t, n) in sums.items()})
    by_length = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.sum(F.col("n") * (F.col("rate") - F.floor("rate"))).over(by_length)
    rated = rated.withColumn("sum", F.floor(carried + 1e-9)).withColumn("more", F.col("sum") - F.coalesce(F.lag("sum").over(Window.partitionBy("source").orderBy("n_tokens")), F.lit(0)))
    rounded = cut(rated.select("source", "n_tokens", "rate", F.floor("rate").alias("base"), F.least("more", "n").alias("more")))
    ranked = rank_within(pool, ["source", "n_tokens"], [F.col("h1"), F.col("h2")], sum(n for _, n in sums.values()), "rank")
    both = ranked.join(rounded, ["source", "n_tokens"])
    copies = (F.col("base") + (F.col("rank") < F.col("more")).cast("int")).cast("int")
    return both.select("id", "source", "n_tokens", "rate", copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, most_copies, largest_text, n_tokens, share, capped, mixture_tokens):
    what each target got. ``capped`` sources can give no more, as each of their texts is used as often as allowed, or
    there are none."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies"), F.max("n_tokens").alias("largest_text"),
        F.sum(F.col("copies").cast("bigint") * F.col("n_tokens")).alias("n_tokens"), F.min("rate").alias("__least"),
    )
    rows = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")
    rows = rows.na.fill(0, ["n_texts", "most_copies", "largest_text", "n_tokens"])
    all_ = F.sum("n_tokens").over(Window.partitionBy())
    capped = F.coalesce(F.col("__least") >= F.col("max_repeats"), F.lit(True))
    return rows.select("*", F.coalesce(F.try_divide(F.col("n_tokens"), all_), F.lit(0.0)).alias("share"), capped.alias("capped"), all_.alias("mixture_tokens")).drop("__least")


def kept_promises(shared: DataFrame) -> DataFrame:
    """(source, has_texts, within_cap, share_met) of a mixture of the default size, from its ``shares``. A share counts as
    met if it is off by no more than the rounding to whole texts allows: one text of the source, and its share of one text
    of every source."""
    everything = Window.partitionBy()
    present = F.sum(F.when(F.col("n_texts") > 0, F.col("target_share"))).over(everything)
    share = F.col("target_share") / present
    off = F.abs(F.col("n_tokens") - share * F.col("mixture_tokens"))
    met = (F.col("n_texts") > 0) & (off <= F.col("largest_text") + share * F.sum("largest_text").over(everything) + 1)
    return shared.select("source", (F.col("n_texts") > 0).alias("has_texts"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), met.alias("share_met"))
