"""Pairs of texts that share a block, and the exact check of such pairs.

Both similarity joins bring rows ``(tid, letters)`` here, ``tid`` being a hash of the text, so that copies of a text are
one text from the start. Sketching puts out one record a block: a 64-bit block key and the low 47 bits of ``tid`` with
the side as the lowest bit. The records take one shuffle. There, copies of a record and blocks held by one text alone
(nearly all) are dropped by streaming windows; only the rest is written and joined.

Hot blocks. A sketching task counts its records in a table of fixed size. Once a block has more than about LOCAL records
in a task, its further records are salted: they go to one of SALTS groups by their text, and a mark in the block's own
group tells that it is hot. So no task of the shuffle holds more than LOCAL records of a block from each sketching task
and a part of the rest, and the exact size of a hot block comes from partial counts. Blocks of more than CELL texts, hot
or not, aren't expanded into pairs. Where two blocks have to agree, their texts are joined over pairs of blocks instead:
each text of a large block puts out one record for each other block it shares with any text, and texts that agree in
such a pair of blocks are candidates. What is still large then consists of texts that agree in two blocks; it is spread
over parts of about CELL texts, and each pair of parts is a group of its own. No candidate is lost in any of this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm import sketch
from codonlake.session import BROADCAST_ROWS, cut

#: Texts of one side of a join group at most, about.
CELL = 512
#: Records of a block in one sketching task from which on they are salted, groups they are salted into, counters of a task.
LOCAL, SALTS, COUNTERS = 64, 127, 1 << 20
#: Rows of a text from which on a join of rows spreads it.
ROWS = 1 << 17
#: Bits of a text's hash in a record. A clash of two hashes only adds a candidate.
TEXT_BITS = 47
#: 64-bit words of the bit table that tells which rows are likely to be in a pair.
FILTER_WORDS = 1 << 17


def short_id(tid: Column) -> Column:
    return tid.bitwiseAND(F.lit((1 << TEXT_BITS) - 1))


def block_records(texts: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], t: int, width: int) -> DataFrame:
    """(key, hs) of every block of every text in ``texts`` (tid bigint, side int, letters string).

    ``keys_of`` turns sketches (rows by t) into block keys (rows by blocks).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salted = Salting()
        for b in batches:
            hs = ((b.column("tid").to_numpy() & ((1 << TEXT_BITS) - 1)) << 1) | b.column("side").to_numpy()
            once = np.zeros(len(hs), bool)
            once[np.unique(hs, return_index=True)[1]] = True
            for use, row, codes in sketch.text_parts(b.column("letters"), width):
                if not once[use].all():
                    new = np.cumsum(once[use]) - 1
                    keep = once[use][row]
                    row, codes, use = new[row[keep]], codes[keep], use[once[use]]
                    if not len(use):
                        continue
                keys = keys_of(sketch.sketch(row, codes, len(use), t))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in salted(keys.T.ravel(), np.tile(hs[use], keys.shape[1]))], ["key", "hs"])

    return texts.select("tid", F.col("side").cast("bigint").alias("side"), "letters").mapInArrow(run, "key bigint, hs bigint")


class Salting:
    """Salts the records of blocks that are hot in one sketching task, by counters that several blocks may share: a block
    taken for hot only goes the way of hot blocks."""

    def __init__(self, local: int | None = None):
        self.local, self.records = LOCAL if local is None else local, 0
        self.counts = np.zeros(COUNTERS, np.int32)

    def __call__(self, keys: np.ndarray, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (sketch.mix(keys.view(np.uint64), 3) >> np.uint64(32)).astype(np.int64) % COUNTERS
        self.records += len(keys)
        self.counts += np.bincount(place, minlength=COUNTERS).astype(np.int32)
        hot = self.counts[place] > self.local + 4 * self.records // COUNTERS
        if not hot.any():
            return keys, hs
        marked = np.unique(keys[hot])
        salt = np.where(hot, 1 + hs // 2 % SALTS, 0)
        return np.concatenate([keys ^ (salt * SALT_STEP), marked]), np.concatenate([hs | salt << (TEXT_BITS + 1), np.full(len(marked), -1)])


#: What a salt is multiplied by to change a key; no product exceeds 63 bits.
SALT_STEP = 0x0101010101010101


def shared_blocks(records: DataFrame, two_sides: bool) -> DataFrame:
    """(key, h, side, n0, n1, hot) of the blocks that can give pairs, written to the shared folder. A record of a hot block
    may stand there twice, and the numbers of texts are null."""
    by_key = Window.partitionBy("key").orderBy("hs")
    once = records.withColumn("__last", F.lag("hs").over(by_key)).where("__last is null or __last <> hs").select("key", "hs")
    side = F.col("hs").bitwiseAND(F.lit(1))
    number = lambda c: F.sum(c.cast("bigint")).over(Window.partitionBy("key"))
    real = F.col("hs") >= 0
    counted = once.select("key", "hs", *[number(real & (side == s)).alias(f"n{s}") for s in (0, 1)], number(~real).alias("marks"))
    salt = F.shiftright("hs", TEXT_BITS + 1)
    hot = (F.col("marks") > 0) | (salt > 0)
    kept = counted.where(real & (hot | F.expr("n0 > 0 and n1 > 0" if two_sides else "n0 > 1")))
    h = F.shiftright(F.col("hs").bitwiseAND(F.lit((1 << (TEXT_BITS + 1)) - 1)), 1)
    key = F.col("key").bitwiseXOR(salt * F.lit(SALT_STEP))
    return cut(kept.select(key.alias("key"), h.alias("h"), side.alias("side"), *[F.when(~hot, F.col(n)).alias(n) for n in ("n0", "n1")], hot.alias("hot")))


def pairs_in_blocks(rows: DataFrame, two_sides: bool, cell: int) -> DataFrame:
    """(key, ha, hb): all pairs of the blocks in ``rows`` (key, h, side, n0, n1), those of large blocks in cells."""
    n1 = F.col("n1") if two_sides else F.col("n0")
    parts = rows.select("key", "h", "side", F.ceil(F.col("n0") / cell).alias("m0"), F.ceil(n1 / cell).alias("m1"))
    left, right = (parts.where("side = 0"), parts.where("side = 1")) if two_sides else (parts, parts)
    own = lambda m: F.pmod(F.xxhash64("h"), F.col(m)).alias("own")
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1)).alias("other")
    a = left.select("key", F.col("h").alias("ha"), own("m0"), every("m1")).withColumnsRenamed({"own": "i", "other": "j"})
    b = right.select("key", F.col("h").alias("hb"), own("m1"), every("m0")).withColumnsRenamed({"own": "j", "other": "i"})
    return a.join(b, ["key", "i", "j"]).where(F.lit(True) if two_sides else F.col("ha") < F.col("hb")).select("key", "ha", "hb")


def with_sizes(rows: DataFrame, two_sides: bool) -> DataFrame:
    """``rows`` (key, h, side), each once, with the texts of either side in their block, of blocks that can give pairs. The
    counts are combined before they are shuffled."""
    once = rows.distinct()
    sizes = once.groupBy("key").agg(*[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)])
    return once.join(sizes.where("n0 > 0 and n1 > 0" if two_sides else "n0 > 1"), "key")


def candidates(shared: DataFrame, two_sides: bool, agree: int = 1, cell: int = CELL) -> DataFrame:
    """(ha, hb): the pairs of texts that share at least ``agree`` blocks. With two sides, a is of side 0, b of side 1."""
    is_large = F.col("hot") | (F.greatest("n0", "n1") > cell)
    small, large = shared.where(~is_large), shared.where(is_large).select("key", "h", "side")
    a = (small.where("side = 0") if two_sides else small).select("key", F.col("h").alias("ha"))
    b = (small.where("side = 1") if two_sides else small).select("key", F.col("h").alias("hb"))
    order = F.lit(True) if two_sides else F.col("ha") < F.col("hb")
    pairs = a.join(b, "key").where(order).select("ha", "hb")
    enough = lambda p: p.groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= agree).select("ha", "hb")
    if not large.take(1):
        return enough(pairs)
    if agree != 2:
        return enough(pairs.unionByName(pairs_in_blocks(with_sizes(large, two_sides), two_sides, cell).select("ha", "hb")))
    each = large.distinct().select(F.col("key").alias("k1"), "h", "side")
    others = shared.select(F.col("key").alias("k2"), "h", "side", is_large.alias("large2")).distinct()
    both = each.join(others, ["h", "side"]).where((F.col("k1") < F.col("k2")) | ((F.col("k1") > F.col("k2")) & ~F.col("large2")))
    doubles = with_sizes(both.select(F.xxhash64("k1", "k2").alias("key"), "h", "side"), two_sides)
    return enough(pairs).unionByName(pairs_in_blocks(doubles, two_sides, cell).select("ha", "hb")).distinct()


def joined_rows(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, count_left: bool = False, rows: int = ROWS) -> DataFrame:
    """The inner join of two tables over ``keys``. Keys with more than ``rows`` rows on the right (counted before the shuffle;
    with ``count_left`` also on the left) are spread over parts by that side's identifier, and the other side's rows go to
    each part. ``left`` is counted only where it is a written table; else adaptive execution splits its large parts."""
    one = lambda df, a, b: df.select(*keys, F.lit(a).alias("__l"), F.lit(b).alias("__r"))
    counted = one(right, 0, 1).unionByName(one(left, 1, 0)) if count_left else one(right, 0, 1)
    sizes = counted.groupBy(*keys).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r")).where((F.col("l") > rows) | (F.col("r") > rows))
    sizes = sizes.select(*keys, F.ceil(F.col("l") / rows).alias("__ml"), F.ceil(F.col("r") / rows).alias("__mr"))
    few = sizes.limit(BROADCAST_ROWS + 1).collect()
    if not few:
        return left.join(right, keys)
    hot = F.broadcast(sizes.sparkSession.createDataFrame(few, sizes.schema)) if len(few) <= BROADCAST_ROWS else cut(sizes)

    def spread_rows(df: DataFrame, id_: str, own: str, part: str, other: str, every: str) -> DataFrame:
        m = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1).cast("bigint")), F.lit(1).cast("bigint"))
        marked = df.join(hot, keys, "left").withColumn(part, F.pmod(F.xxhash64(id_), m(own)))
        return marked.withColumn(every, F.explode(F.sequence(F.lit(0).cast("bigint"), m(other) - 1))).drop("__ml", "__mr")

    a = spread_rows(left, left_id, "__ml", "__pl", "__mr", "__pr")
    b = spread_rows(right, right_id, "__mr", "__pr", "__ml", "__pl")
    return a.join(b, [*keys, "__pl", "__pr"]).drop("__pl", "__pr")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(tid_a, tid_b, similarity) of the pairs (ha, hb) that reach ``least``, by their whole texts (tid, h, letters)."""
    a = texts.select(F.col("h").alias("ha"), F.col("tid").alias("tid_a"), F.col("letters").alias("letters_a"))
    b = texts.select(F.col("h").alias("hb"), F.col("tid").alias("tid_b"), F.col("letters").alias("letters_b"))
    both = pairs.join(a, "ha").join(b, "hb").where("tid_a <> tid_b").select("tid_a", "tid_b", "letters_a", "letters_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            found: list[tuple[int, int, float]] = []
            size = 0
            for ta, tb, la, lb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 4_000_000:
                    seen, size = {}, 0
                for key, text in ((ta, la), (tb, lb)):
                    if key not in seen:
                        seen[key] = sketch.shingles(text, width)
                        size += len(text)
                x, y = seen[ta], seen[tb]
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                s = sketch.similarity(x, y)
                if s >= least:
                    found.append((ta, tb, s))
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["tid_a", "tid_b", "similarity"])

    return both.mapInArrow(run, "tid_a bigint, tid_b bigint, similarity double")


def endpoints(pairs: DataFrame) -> DataFrame:
    """(h): the texts that are in some pair."""
    return pairs.select(F.col("ha").alias("h")).union(pairs.select(F.col("hb").alias("h"))).distinct()


def rows_of(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows (with h) of the texts ``ends``, and perhaps a few others.

    A bit table of fixed size (FILTER_WORDS words, whatever the data) with a bit for each text is broadcast, so rows are
    dropped where they are read and their letters aren't shuffled. It passes some rows of other texts, which no pair
    names. More texts than an eighth of its bits would pass too many; they are joined instead.
    """
    if ends.count() > 8 * FILTER_WORDS:
        return rows.join(ends, "h", "left_semi")
    bit = F.col("h").bitwiseAND(F.lit(63)).cast("int")
    word = F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS)).alias("__word")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = ends.select(word, one.alias("m")).groupBy("__word").agg(F.bit_or("m").alias("__bits"))
    near = rows.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(one) != 0)
    return near.drop("__word", "__bits")


def one_text_each(rows: DataFrame) -> DataFrame:
    """(tid, h, letters): each text of ``rows`` once; copies are combined before the shuffle."""
    return rows.groupBy("tid", "h").agg(F.first("letters").alias("letters"))
