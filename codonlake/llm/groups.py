"""Groups of near-duplicate records: every row with the group it belongs to.

Texts that are similar (``near.similar_texts``) are linked, and a group holds what links connect. Rows with equal letters
are of one group. Nothing is expanded into pairs of rows: a text stands for its copies until the end.

Method: the links are turned into stars round the least text of each group by alternating two steps, each a minimum by
text, combined before it is shuffled, and a join: first every text passes its larger neighbours to its least neighbour,
then every text passes its smaller ones. When nothing changes any more, each text points to the least of its group. The
driver sees two numbers a step. A text with very many links or copies is spread over several join groups.

Defined results: rows with a null identifier are left out. Rows with fewer than ``width`` letters have a group of their
own and no links. A row whose text has no similar text is in the group of its copies. An empty table gives an empty
result. Columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm import blocking, letters, near
from codonlake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the least node of what is connected with it."""

    def passed(edges: DataFrame, larger: bool) -> DataFrame:
        """Edges (v, m), v > m: neighbours of each text (v > u, else v < u and u itself), passed to its least neighbour."""
        both = edges if not larger else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = blocking.joined_rows(least, both, ["u"], "m", "v").select("v", "m", "u")
        if larger:
            return moved.where("v > u").select("v", "m")
        return moved.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).where("v <> m")

    def written(edges: DataFrame) -> DataFrame:
        """Edges (u, v), u > v, each once."""
        return cut(edges.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")))
    was = None
    while was != (now := state(edges)):
        was = now
        edges = written(passed(written(passed(edges, True)), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(df: DataFrame, id_col: str = "row_id", width: int = near.WIDTH, **params: float) -> DataFrame:
    """(id, group_id, n_links): each row, the least identifier of its group, and the number of texts similar to its own."""
    pairs = cut(near.similar_texts(df, id_col, width, **params)[0])
    ends = pairs.select(F.col("tid_a").alias("tid")).unionByName(pairs.select(F.col("tid_b").alias("tid")))
    linked = components(pairs.select(F.col("tid_a").alias("a"), F.col("tid_b").alias("b"))).withColumnRenamed("node", "tid").join(ends.groupBy("tid").agg(F.count(F.lit(1)).alias("n_links")), "tid")
    lettered = letters.with_letters(df.where(df[id_col].isNotNull()), [id_col])
    rows = cut(lettered.select(F.col(id_col).cast("bigint").alias("id"), F.when(F.length("letters") >= width, F.xxhash64("letters")).alias("tid")))
    long = rows.where("tid is not null")
    texts = long.groupBy("tid").agg(F.min("id").alias("least")).join(linked, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    least = texts.groupBy("root").agg(F.min("least").alias("group_id"))
    groups = blocking.joined_rows(least, cut(texts.select("tid", "root", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))), ["root"], "group_id", "tid")
    out = blocking.joined_rows(groups, long, ["tid"], "group_id", "id").select("id", "group_id", "n_links")
    return out.unionByName(rows.where("tid is null").select("id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))
