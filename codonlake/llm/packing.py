"""Filling fixed-capacity containers with texts.

Texts, measured in tokens, are assigned to containers of ``capacity`` tokens. A text that exceeds the capacity becomes
full pieces and a rest; no other text is split.

Method: length-histogram planning. Only the number of pieces of each length goes to the driver (at most ``capacity``
rows, whatever the data). Best fit, longest lengths first, is run over these counts: a step fills as many equal
containers as there are pieces, so the plan has some rows a length, however many texts there are. A plan row gives the
pieces of one length whose ranks lie in a range their containers and offsets. The pieces are ranked within their length
without gathering a length in one task, and take their slots by a join on length and rank.

Defined results: rows with a null identifier or a null text are left out. Texts without tokens take no room: they come
out with container -1 and offset 0. Repeated rows are packed each on its own. An empty table gives an empty result.
Columns beside those named are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonlake.llm.tokens import TOKENIZER, with_token_counts
from codonlake.session import cut, rank_within

Slot = tuple[int, int, int, int, int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Rows (length, first rank, pieces, first container, offset) of a best-fit-decreasing packing.

    ``room`` keeps, by free space, ranges of containers (first, number). A piece goes where the least space fits it, and
    the next piece of the same length goes to the same container while it fits, so ranges are filled as wholes.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    plan: list[Slot] = []
    containers = 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            else:
                space, first, n = capacity, containers, -(-left // (capacity // length))
                containers += n
            each = space // length
            full = min(n, left // each)
            used = [(full, each)] if full else []
            left -= full * each
            if full < n and left < each and left:
                used.append((1, left))
                left = 0
            for many, times in used:
                for k in range(times):
                    plan.append((length, rank, many, first, capacity - space + k * length))
                    rank += many
                give(space - times * length, first, many)
                first, n = first + many, n - many
            give(space, first, n)
    return plan


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece_no, token_start, n_tokens, container_id, container_offset): each piece and its place."""
    return pack_sizes(token_sizes(df, id_col, text, tokenizer), capacity)


def token_sizes(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, size) of each text, written once."""
    rows = df.where(df[id_col].isNotNull()).select(df[id_col].cast("bigint").alias("id"), df[text].alias("text"))
    return cut(with_token_counts(rows, "text", ["id"], tokenizer, "size"))


def pack_sizes(sizes: DataFrame, capacity: int) -> DataFrame:
    spark = sizes.sparkSession
    empty = sizes.where("size = 0").select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"), F.lit(-1).cast("bigint").alias("container_id"), F.lit(0).alias("container_offset"))
    parts = sizes.where("size > 0").select("id", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("piece_no"))
    items = parts.select("id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * capacity).alias("n_tokens"))
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, capacity)
    slots = spark.createDataFrame(plan, "length int, first_rank bigint, pieces bigint, first_container bigint, offset int")
    ranked = rank_within(items, ["n_tokens"], [F.col("id"), F.col("piece_no")], sum(counts.values()), "rank")
    # The plan has a few rows for each length, so its size is bounded by the capacity, not by the number of texts.
    placed = ranked.join(F.broadcast(slots), (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("pieces")))
    out = placed.select("id", "piece_no", "token_start", "n_tokens", (F.col("first_container") + F.col("rank") - F.col("first_rank")).alias("container_id"), F.col("offset").alias("container_offset"))
    return out.unionByName(empty)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, n_containers, n_pieces, n_tokens, share_filled) of a packing."""
    each = packed.where("container_id >= 0").groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sums = each.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    return sums.select(F.lit(capacity).alias("capacity"), "*", F.expr(f"try_divide(n_tokens, n_containers * {capacity})").alias("share_filled"))


def kept_promises(packed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, n_texts, n_overfull, n_overlapping, n_needless_splits, n_gaps): texts that were placed, and what must be 0:
    containers beyond their capacity, pieces that begin within another, texts cut without need, pieces that don't follow
    one another."""
    inside = Window.partitionBy("container_id").orderBy("container_offset")
    places = packed.where("container_id >= 0").withColumn("before", F.lag(F.col("container_offset") + F.col("n_tokens")).over(inside))
    count = lambda c: F.count_if(c).alias("n")
    loads = places.groupBy("container_id").agg(F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("load"))
    texts = packed.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("size"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count_distinct("token_start").alias("starts"))
    gaps = (F.col("end") != F.col("size")) | (F.col("starts") != F.col("k"))
    parts = [
        ("n_texts", texts.agg(F.count(F.lit(1)).alias("n"))), ("n_overfull", loads.agg(count((F.col("end") > capacity) | (F.col("load") > capacity)))),
        ("n_overlapping", places.agg(count(F.col("before") > F.col("container_offset")))),
        ("n_needless_splits", texts.agg(count(F.col("k") > F.greatest(F.lit(1), F.ceil(F.col("size") / capacity))))), ("n_gaps", texts.agg(count(gaps))),
    ]
    out = packed.sparkSession.range(1).select(F.lit(capacity).alias("capacity"))
    for name, part in parts:
        out = out.crossJoin(part.withColumnRenamed("n", name))
    return out
