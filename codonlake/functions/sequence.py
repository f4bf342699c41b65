"""Sequence functions as Column expressions; all stay in generated code or built-in array functions.

A null sequence gives null. Positions count from 0, as everywhere in this engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codonlake.functions.vectors import let


def gc_content(seq: Column) -> Column:
    """Share of G and C among all letters but N, U read as T; 0.0 if nothing is left. Other characters count as length."""
    u = F.replace(F.upper(seq), F.lit("N"), F.lit(""))
    n = F.length(u)
    gc = 2 * n - F.length(F.replace(u, F.lit("G"), F.lit(""))) - F.length(F.replace(u, F.lit("C"), F.lit("")))
    return F.when(n == 0, F.lit(0.0)).otherwise(gc / n)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column, reverse: bool = True, complemented: bool = True) -> Column:
    """Case is kept; characters other than A, C, G and T stay as they are."""
    out = F.reverse(seq) if reverse else seq
    return complement(out) if complemented else out


def kmers(seq: Column, k: int) -> Column:
    """Overlapping upper-case k-mers in order; empty if the sequence is shorter than k. One pass over the sequence, which
    stops at every character but the second half of one beyond the first plane."""
    every = F.lit(f"(?s)(?![\\uDC00-\\uDFFF])(?=(.{{{k}}}))")
    return F.regexp_extract_all(F.upper(seq), every, F.lit(1))


def kmer_text(seq: Column, k: int) -> Column:
    return F.array_join(kmers(seq, k), " ")


def is_valid(seq: Column, least: int = 1, most: int = 500_000_000, gc: tuple[float, float] = (0.0, 1.0), letters: str = "ACGTN") -> Column:
    """Length and GC content within inclusive limits, and no upper-cased letter outside ``letters``."""
    g = gc_content(seq)
    return F.length(seq).between(least, most) & (g >= gc[0]) & (g <= gc[1]) & (F.translate(F.upper(seq), letters, "") == "")


def is_dna(seq: Column) -> Column:
    """One or more of A, C, G, T and N in either case, and nothing else."""
    return (F.length(seq) > 0) & (F.translate(F.upper(seq), "ACGTN", "") == "")


def characters(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.when(seq.isNotNull(), F.array().cast("array<string>")))


def base_ids(seq: Column) -> Column:
    """A 0, C 1, G 2, T and U 3, padding marks (- and .) -1, everything else 4."""
    def code(x: Column) -> Column:
        return F.when(x == "A", 0).when(x == "C", 1).when(x == "G", 2).when(x.isin("T", "U"), 3).when(x.isin("-", "."), -1).otherwise(4)

    return F.transform(characters(F.upper(seq)), code)


def padded_ids(seq: Column, length: int, side: str = "right") -> Column:
    """``base_ids`` cut or padded with -1 to ``length``."""
    ids = F.slice(base_ids(seq), F.lit(1), F.lit(length))
    pad = F.array_repeat(F.lit(-1), F.lit(length) - F.size(ids))
    return F.concat(ids, pad) if side == "right" else F.concat(pad, ids)


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != -1).cast("int"))


def one_hot(ids: Column, width: int = 4, unknown: float = 0.0, padding: float = 0.0) -> Column:
    """A vector for each id: 1.0 at the base; N and padding are constant vectors."""
    def vector(x: Column) -> Column:
        return F.array(*[F.when(x == j, 1.0).when(x == -1, padding).when(x >= width, unknown).otherwise(0.0) for j in range(width)])

    return F.transform(ids, vector)


def decode_ids(ids: Column) -> Column:
    """The letters of ids; padding is skipped."""
    kept = F.filter(ids, lambda x: x != -1)
    return F.array_join(F.transform(kept, lambda x: F.substring(F.lit("ACGTN"), x + 1, F.lit(1))), "")


def ids_reverse_complement(ids: Column) -> Column:
    return F.reverse(F.transform(ids, lambda x: F.when(x.between(0, 3), 3 - x).otherwise(x)))


def base_counts(seq: Column) -> list[Column]:
    """Counts of A, C, G, T (with U), N and everything else, as named columns."""
    u = F.replace(F.upper(seq), F.lit("U"), F.lit("T"))
    counts = {b: (F.length(u) - F.length(F.replace(u, F.lit(b), F.lit("")))).cast("bigint") for b in "ACGTN"}
    other = F.length(F.translate(u, "ACGTN", "")).cast("bigint")
    return [*[c.alias(f"n_{b.lower()}") for b, c in counts.items()], other.alias("n_other")]


def token_places(tokens: Column) -> Column:
    """Structs (token, start, end): character places of tokens laid end to end. The length of what stands before a token is
    that of the joined tokens before it, added up in chunks, so long lists don't cost the square of their tokens."""
    sizes = F.transform(tokens, lambda t: F.length(t).cast("bigint"))
    return let(running_sums(sizes), lambda ends: F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (F.get(ends, i) - F.length(t)).alias("token_start"), F.get(ends, i).alias("token_end"))))


def running_sums(values: Column) -> Column:
    """The sums of the first 1, 2, ... n whole numbers, in about n * sqrt(n) steps."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))

    def of(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.array(zero), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
        within = lambda c, b: F.transform(c, lambda x, i: b + total(F.slice(c, F.lit(1), i + 1)))
        return let(before, lambda bs: F.flatten(F.transform(chunks, lambda c, k: within(c, F.get(bs, k)))))

    chunks = lambda v, w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda k: F.slice(v, k * w + 1, w))
    made = let(values, lambda v: let(width, lambda w: let(chunks(v, w), of)))
    return F.when(F.size(values) > 0, made).otherwise(F.array().cast("array<bigint>"))


def strand_place(anchor: Column, offset: Column, strand: Column) -> Column:
    """Genomic place of an offset: counted down from the anchor on the minus strand."""
    return F.when(strand == "-", anchor - offset).otherwise(anchor + offset)


def whole_numbers(text: Column, sep: str = ",") -> Column:
    """The whole numbers of a separated list; entries that are none are null."""
    return F.transform(F.split(text, sep), lambda x: F.trim(x).try_cast("int"))
