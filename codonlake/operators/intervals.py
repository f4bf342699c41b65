"""Genomic intervals: half-open, counted from 0.

Overlaps are found by an equi-join on chromosome and bin, with a pair kept in the first bin both share, so no pair comes
twice and no nested loop is needed. Bins are wide against most intervals; a long interval takes one row a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def plain_chrom(c: Column) -> Column:
    """``chr`` and the name in lower case, without a prefix of its own or leading zeros."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^chr", "")
    return F.concat(F.lit("chr"), F.regexp_replace(bare, "^0+(?=.)", ""))


def plain(df: DataFrame) -> DataFrame:
    """Even spelling of chrom and feature; an unknown strand is null; repeated rows once."""
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand"))
    return df.select(plain_chrom(F.col("chrom")).alias("chrom"), "start_pos", "end_pos", strand.alias("strand"), "gene", F.lower(F.trim("feature")).alias("feature")).distinct()


def overlaps(left: DataFrame, right: DataFrame, how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Pairs of rows whose (chrom, start_pos, end_pos) overlap. Columns of ``right`` come with the prefix ``r_``.

    With ``how="left"`` a left row without a partner comes once, with start and end -1 and nulls otherwise. Empty
    intervals overlap nothing. Rows of ``left`` must differ.
    """
    own = list(left.columns)
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor((F.col("end_pos") - 1) / bin_size)))
    l_ = left.where("start_pos < end_pos").select("*", bins().alias("__bin"))
    r_ = right.where("start_pos < end_pos").select("*", bins().alias("__bin"))
    r_ = r_.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("__bin").alias("r___bin"))
    meet = (F.col("chrom") == F.col("r_chrom")) & (F.col("__bin") == F.col("r___bin")) & (F.col("start_pos") < F.col("r_end_pos")) & (F.col("r_start_pos") < F.col("end_pos"))
    first = F.col("__bin") == F.floor(F.greatest("start_pos", "r_start_pos") / bin_size)
    pairs = l_.join(r_, meet & first).drop("__bin", "r___bin")
    if how == "inner":
        return pairs
    if how != "left":
        raise ValueError("how must be inner or left")
    alone = left.join(pairs.select(*own).distinct(), [left[c].eqNullSafe(pairs[c]) for c in own], "left_anti")
    fill = [F.lit(-1).cast("bigint").alias(f"r_{c}") if c in ("start_pos", "end_pos") else F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in right.columns]
    return pairs.unionByName(alone.select(*own, *fill))


def islands(df: DataFrame, by: list[str], place: str) -> DataFrame:
    """(by..., island_start, island_end): unbroken runs of distinct whole-number places."""
    once = df.select(*by, place).distinct()
    run = F.col(place) - F.row_number().over(Window.partitionBy(*by).orderBy(place))
    return once.withColumn("__run", run).groupBy(*by, "__run").agg(F.min(place).alias("island_start"), (F.max(place) + 1).alias("island_end")).drop("__run")


def introns(exons: DataFrame, by: list[str]) -> DataFrame:
    """(by..., intron_start, intron_end, intron_no): gaps between consecutive exons, numbered along the strand."""
    w = Window.partitionBy(*by).orderBy("start_pos", "end_pos")
    gaps = exons.select(*by, "strand", "start_pos", F.lag("end_pos").over(w).alias("__last")).where("__last < start_pos")
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(F.col("strand") == "-", -F.col("start_pos")).otherwise(F.col("start_pos"))))
    return gaps.select(*by, F.col("__last").alias("intron_start"), F.col("start_pos").alias("intron_end"), number.alias("intron_no"))


def longest_isoform(exons: DataFrame, gene: str, isoform: str) -> DataFrame:
    """(gene, isoform, exon_length): the isoform with the most exon letters; the last by name on ties."""
    sums = exons.groupBy(gene, isoform).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("exon_length"))
    return sums.groupBy(gene).agg(F.max(F.struct("exon_length", isoform)).alias("m")).select(gene, f"m.{isoform}", "m.exon_length")


def tiles(df: DataFrame, width: int) -> DataFrame:
    """Each interval cut into tiles of ``width``, with ``tile`` from 0; the last may be shorter."""
    n = F.floor((F.col("end_pos") - F.col("start_pos") - 1) / width)
    each = df.where("start_pos < end_pos").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("tile"))
    start = F.col("start_pos") + F.col("tile") * width
    return each.withColumn("__s", start).withColumn("end_pos", F.least(F.col("end_pos"), F.col("__s") + width)).withColumn("start_pos", F.col("__s")).drop("__s")


def iob_tags(tokens: DataFrame, annotation: DataFrame, by: str) -> DataFrame:
    """(by, start_pos, end_pos, tag): the tag of each token from the first annotation it overlaps, by start, end and
    feature: B- where the feature differs from that of the token before, I- where it goes on, O without one."""
    hit = overlaps(tokens.select(by, "chrom", "start_pos", "end_pos").distinct(), annotation.select("chrom", "start_pos", "end_pos", "feature"), "left")
    one = hit.groupBy(by, "chrom", "start_pos", "end_pos").agg(F.min(F.struct("r_start_pos", "r_end_pos", "r_feature")).alias("a"))
    name = F.col("a.r_feature")
    before = F.lag(name).over(Window.partitionBy(by).orderBy("start_pos", "end_pos"))
    tag = F.when(name.isNull(), "O").when(name.eqNullSafe(before), F.concat(F.lit("I-"), name)).otherwise(F.concat(F.lit("B-"), name))
    return one.select(by, "start_pos", "end_pos", tag.alias("tag"))


def token_lists(tagged: DataFrame, by: str) -> DataFrame:
    """(by, tags, n_tokens): the tags of a gene in order. A list is as long as its gene has tokens."""
    got = tagged.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "tag"))).alias("t"))
    return got.select(by, F.transform("t", lambda x: x["tag"]).alias("tags"), F.size("t").alias("n_tokens"))


def fetch_windows(windows: DataFrame, chroms: DataFrame, context: int = 0) -> DataFrame:
    """``windows`` (chrom, start_pos, end_pos, ...) with the letters of ``chroms`` (chrom, sequence).

    With ``context`` the window is widened to that length around its middle. Places past either end are dots.
    """
    more = F.greatest(F.lit(0), F.lit(context) - (F.col("end_pos") - F.col("start_pos"))) if context else F.lit(0)
    left = F.floor(more / 2)
    w = windows.withColumn("__a", F.col("start_pos") - left).withColumn("__b", F.col("end_pos") + more - left)
    both = w.join(chroms.select("chrom", F.col("sequence").alias("__seq")), "chrom")
    n = F.length("__seq")
    before = F.least(F.greatest(F.lit(0), -F.col("__a")), F.col("__b") - F.col("__a"))
    inside = F.substring("__seq", (F.greatest(F.col("__a"), F.lit(0)) + 1).cast("int"), F.greatest(F.lit(0), F.least(F.col("__b"), n) - F.greatest(F.col("__a"), F.lit(0))).cast("int"))
    padded = F.rpad(F.concat(F.repeat(F.lit("."), before.cast("int")), inside), (F.col("__b") - F.col("__a")).cast("int"), ".")
    return both.withColumn("letters", padded).drop("__a", "__b", "__seq")
