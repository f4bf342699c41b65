"""Splitting oversized sequences at natural boundaries.

A sequence with more letters than ``capacity`` is cut into pieces of at most ``capacity`` letters, at assembly gaps
(unbroken runs of at least ``gap`` N) where one is in reach; consecutive pieces share exactly ``overlap`` letters.

Method: bounded-quantifier regular expressions, extracted by SQL array functions. The new letters of each piece are one
match; the alternatives, in order of boundary strength, take as many letters as the limit allows: all that is left, up to
behind the last gap in reach, up to the last gap that begins in reach, or else up to the limit. A match is longer than
the overlap unless it is the last, so the last ``overlap`` letters of the match before are what a piece shares with the
piece before it, and no piece lies within another. No piece is taken from the whole sequence, and positions are running
sums over the matches in two levels, so very long sequences don't cost the square of their pieces.

Defined results: rows with a null identifier, and rows whose letters don't exceed ``capacity`` (also rows without
letters), have no pieces and no gaps. Repeated rows are cut each on its own. Columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonlake.llm.letters import with_letters

GAP = 10


def cut_pattern(capacity: int, overlap: int, gap: int = GAP) -> str:
    """The expression whose successive matches are the new letters of each piece."""
    least, step = overlap + 1, capacity - overlap
    if overlap < 0 or step < least or step <= gap:
        raise ValueError("capacity must exceed twice the overlap, and the gap length")

    def alternatives(limit: int) -> list[str]:
        return [
            f"[^$]{{1,{limit}}}$",
            f"[^$]{{{max(0, least - gap)},{limit - gap}}}N{{{gap}}}(?!N)",
            f"[^$]{{{least},{limit}}}(?<!N)(?=N{{{gap}}})",
            f"[^$]{{1,{limit}}}",
        ]

    return "|".join(["^(?:" + "|".join(alternatives(capacity)) + ")", *alternatives(step)])


def running_sums(values: Column) -> Column:
    """The sums of the first 1, 2, ... n values, in about n * sqrt(n) steps."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    last = F.ceil(F.size(values) / width).cast("int") - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * width + 1, width))
    before = F.aggregate(chunks, F.array(zero), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
    sums = F.transform(F.arrays_zip(F.slice(before, F.lit(1), last + 1).alias("b"), chunks.alias("c")), lambda z: F.transform(z["c"], lambda x, i: z["b"] + total(F.slice(z["c"], F.lit(1), i + 1))))
    return F.when(F.size(values) > 0, F.flatten(sums)).otherwise(F.array().cast("array<bigint>"))


def split_oversized(df: DataFrame, capacity: int, overlap: int, id_col: str = "row_id", gap: int = GAP) -> DataFrame:
    """(id, cores, core_ends, gaps) of every row with more than ``capacity`` letters; ``cores`` holds the new letters of
    each piece, ``gaps`` the start and end of each assembly gap in them, joined."""
    rows = with_letters(df.where(df[id_col].isNotNull()), [id_col]).where(F.length("letters") > capacity)
    long = rows.select(F.col(id_col).cast("bigint").alias("id"), "letters")
    sizes = lambda c: F.transform(c, lambda x: F.length(x).cast("bigint"))
    got = long.withColumn("cores", F.regexp_extract_all("letters", F.lit(cut_pattern(capacity, overlap, gap)), F.lit(0)))
    got = got.withColumn("joined", F.array_join("cores", ""))
    got = got.withColumn("n_runs", F.regexp_extract_all("joined", F.lit(f"N{{{gap},}}"), F.lit(0)))
    got = got.withColumn("between", F.slice(F.split("joined", f"N{{{gap},}}", -1), F.lit(1), F.size("n_runs")))
    got = got.withColumn("core_ends", running_sums(sizes(F.col("cores")))).withColumn("run_sizes", sizes(F.col("n_runs")))
    got = got.withColumn("run_ends", running_sums(F.zip_with(sizes(F.col("between")), "run_sizes", lambda a, b: a + b)))
    gaps = F.zip_with("run_ends", "run_sizes", lambda e, s: F.struct((e - s).alias("gap_start"), e.alias("gap_end")))
    return got.select("id", "cores", "core_ends", gaps.alias("gaps"))


def gaps(split: DataFrame) -> DataFrame:
    """(id, gap_start, gap_end) of every gap; -1 and -1 for an oversized row without one."""
    none = F.array(F.struct(F.lit(-1).cast("bigint").alias("gap_start"), F.lit(-1).cast("bigint").alias("gap_end")))
    return split.select("id", F.explode(F.when(F.size("gaps") > 0, F.col("gaps")).otherwise(none)).alias("g")).select("id", "g.gap_start", "g.gap_end")


def pieces(split: DataFrame, overlap: int, gap: int = GAP) -> DataFrame:
    """(id, piece_no, piece_start, piece_end, boundary, piece): the pieces in order, numbered from 0.

    ``boundary`` says what the piece ends at: ``end``, ``after_gap``, ``before_gap`` or ``letter``.
    """
    core = lambda i: F.get("cores", i)
    known = lambda c: F.coalesce(c, F.lit(""))

    def boundary(i: Column) -> Column:
        following = core(i + 1)
        return (
            F.when(following.isNull(), "end")
            .when(core(i).endswith("N" * gap) & ~following.startswith("N"), "after_gap")
            .when(following.startswith("N" * gap) & ~core(i).endswith("N"), "before_gap")
            .otherwise("letter")
        )

    def piece(e: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0).cast("bigint"), e - F.length(core(i)) - overlap)
        before = F.right(known(core(i - 1)), F.lit(overlap)) if overlap else F.lit("")
        return F.struct(i.alias("piece_no"), start.alias("piece_start"), e.alias("piece_end"), boundary(i).alias("boundary"), F.concat(before, core(i)).alias("piece"))

    return split.select("id", F.explode(F.transform("core_ends", piece)).alias("p")).select("id", "p.*")
