"""Duplicates hidden by formatting differences.

Rows whose fields hold the same content, apart from white space, letter case, punctuation and the order of the fields,
are copies of one record. The record keeps the smallest identifier of its copies.

Method: each row becomes a 128-bit canonical key. Partial counts, combined before the shuffle, give the exact number of
rows of every key; the keys that hold more than one part in ``HOT_PARTS`` of all rows (and more than one row) are hot, at
any size of the table, and at most ``HOT_PARTS`` keys can be. Hot keys are aggregated in two levels over salted keys, and
their minima (at most ``HOT_PARTS`` rows) are broadcast back to their rows. All other keys take one shuffle, in which a streaming window finds the minimum.

Defined results: rows with a null identifier, or with any field that is null or has no letter or digit, belong to no
record and are left out. Equal identifiers count as separate rows. An empty table gives an empty result. Columns beside
the identifier and the fields are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonlake.session import cut

#: A key is hot if it holds more than one HOT_PARTS-th of all rows, so there are no more hot keys than this.
HOT_PARTS = 1024
#: Parts a hot key's rows are spread over.
SALTS = 64


def canonical(field: Column) -> Column:
    """A field's letters and digits in lower case."""
    return F.regexp_replace(F.lower(field), r"[^\p{L}\p{N}]", "")


def canonical_keys(df: DataFrame, id_col: str, fields: list[str], keep: bool = False) -> DataFrame:
    """(id, h1, h2): two independent 64-bit hashes of the sorted canonical fields of each row that has content; with
    ``keep`` also ``written``, the fields as they stand."""
    parts = F.array_sort(F.array(*[canonical(df[f]) for f in fields]))
    as_is = [F.struct(*[df[f].alias(f) for f in fields]).alias("written")] if keep else []
    plain = df.where(df[id_col].isNotNull()).select(df[id_col].cast("bigint").alias("id"), parts.alias("parts"), *as_is)
    full = plain.where(~F.exists("parts", lambda p: p.isNull() | (p == "")))
    return full.select("id", F.xxhash64("parts").alias("h1"), F.xxhash64(F.lit("second"), F.col("parts")).alias("h2"), *[c for c in ("written",) if keep])


def hot_keys(keys: DataFrame, rows: int, hot_parts: int = HOT_PARTS, hot_least: int = 1) -> DataFrame | None:
    """The keys over the limit, at most ``hot_parts``, as a local table; None if there are none."""
    limit = max(rows // hot_parts, hot_least)
    found = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("h1", "h2").collect()
    return keys.sparkSession.createDataFrame(found, "h1 bigint, h2 bigint").coalesce(1) if found else None


def members(df: DataFrame, id_col: str, fields: list[str], hot_parts: int = HOT_PARTS, hot_least: int = 1, salts: int = SALTS) -> DataFrame:
    """(h1, h2, kept_id, id): every row that belongs to a record, with the record's key and smallest identifier."""
    keys = cut(canonical_keys(df, id_col, fields))
    hot = hot_keys(keys, keys.count(), hot_parts, hot_least)
    cold = keys if hot is None else keys.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    ordered = Window.partitionBy("h1", "h2").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cold.select("h1", "h2", F.first("id").over(ordered).alias("kept_id"), "id")
    if hot is None:
        return out
    rows = keys.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    salted = rows.groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("least"))
    least = salted.groupBy("h1", "h2").agg(F.min("least").alias("kept_id"))
    return out.unionByName(rows.join(F.broadcast(least), ["h1", "h2"]).select("h1", "h2", "kept_id", "id"))


def hidden_copies(df: DataFrame, id_col: str, fields: list[str], **limits: int) -> DataFrame:
    """(kept_id, copy_id): one row for each member of a record except the kept one. Of rows that share the smallest
    identifier none is listed, as they can't be told apart."""
    return members(df, id_col, fields, **limits).where("id > kept_id").select("kept_id", F.col("id").alias("copy_id"))


def records(df: DataFrame, id_col: str, fields: list[str], **limits: int) -> DataFrame:
    """(kept_id, n_copies, fields...): one row a record, with the kept row's fields as they were written; of several rows
    with that identifier, the least fields."""
    counts = members(df, id_col, fields, **limits).groupBy("h1", "h2", "kept_id").agg(F.count(F.lit(1)).alias("n_copies"))
    written = canonical_keys(df, id_col, fields, keep=True).withColumnRenamed("id", "kept_id")
    joined = counts.join(written, ["h1", "h2", "kept_id"])
    return joined.groupBy("h1", "h2", "kept_id").agg(F.first("n_copies").alias("n_copies"), F.min("written").alias("w")).select("kept_id", "n_copies", "w.*")
