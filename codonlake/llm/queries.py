"""The queries of this package, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm import copies, groups, mixing, near, overlap, packing, pieces, sentences
from codonlake.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CANON = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_KEYS = f"""
keyed AS (
  SELECT row_id, sequence, label, {_CANON.format("sequence")} AS a, {_CANON.format("label")} AS b FROM dev
), grouped AS (
  SELECT *, min(row_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS kept,
         count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS n
  FROM keyed WHERE a <> '' AND b <> ''
)"""


@query("p1_found", f"WITH {_KEYS} SELECT kept AS kept_row_id, row_id AS copy_row_id FROM grouped WHERE row_id > kept")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = copies.hidden_copies(read_table(spark, sf, "dev"), "row_id", ["sequence", "label"])
    return found.select(F.col("kept_id").alias("kept_row_id"), F.col("copy_id").alias("copy_row_id"))


@query("p1_records", f"WITH {_KEYS} SELECT row_id AS kept_row_id, n AS n_copies, sequence, label FROM grouped WHERE row_id = kept")
def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return copies.records(read_table(spark, sf, "dev"), "row_id", ["sequence", "label"]).withColumnRenamed("kept_id", "kept_row_id")


def _letters(table: str, name: str = "lettered") -> str:
    """CTEs that give (row_id, source, letters) of a split."""
    return f"""
{name}_f AS (
  SELECT row_id, source, regexp_replace(upper(coalesce(sequence, '')), '[^A-Z]', '', 'g') AS a,
         regexp_replace(upper(coalesce(label, '')), '[^A-Z]', '', 'g') AS b FROM {table}
), {name}_p AS (
  SELECT *, regexp_full_match(a, '[ACGTURYSWKMBDHVN]+') AS pa, regexp_full_match(b, '[ACGTURYSWKMBDHVN]+') AS pb FROM {name}_f
), {name} AS (
  SELECT row_id, source, CASE WHEN pa AND (NOT pb OR length(a) >= length(b)) THEN a WHEN pb THEN b WHEN length(a) >= 12 THEN a ELSE '' END AS letters FROM {name}_p
)"""


def _runs(source: str, name: str) -> str:
    """CTEs with the distinct runs of 12 letters of each text, and their number."""
    return f"""
{name}_r AS (
  SELECT DISTINCT letters, unnest([substr(letters, i, 12) for i in range(1, length(letters) - 10)]) AS run FROM (SELECT DISTINCT letters FROM {source} WHERE length(letters) >= 12)
), {name}_n AS (SELECT letters, count(*) AS n FROM {name}_r GROUP BY letters)"""


_NEAR_TEXTS = f"""{_letters("dev")}, {_runs("lettered", "t")}, common AS (
  SELECT a.letters AS la, b.letters AS lb, count(*) AS c FROM t_r a JOIN t_r b ON a.run = b.run AND a.letters < b.letters GROUP BY ALL
), near AS (
  SELECT la, lb FROM common JOIN t_n x ON x.letters = la JOIN t_n y ON y.letters = lb WHERE c >= 0.5::double * (x.n + y.n - c)
)"""

_NEAR = f"""WITH {_NEAR_TEXTS}
SELECT least(a.row_id, b.row_id) AS row_id_a, greatest(a.row_id, b.row_id) AS row_id_b
FROM near JOIN lettered a ON a.letters = la JOIN lettered b ON b.letters = lb"""

_OVERLAP = f"""WITH {_letters("(SELECT * FROM dev UNION ALL SELECT * FROM test)", "ev")}, {_letters("train", "tr")}, {_runs("ev", "e")}, {_runs("tr", "t")}, common AS (
  SELECT a.letters AS la, b.letters AS lb, count(*) AS c FROM e_r a JOIN t_r b ON a.run = b.run AND a.letters <> b.letters GROUP BY ALL
), near AS (
  SELECT la, lb FROM common JOIN e_n x ON x.letters = la JOIN t_n y ON y.letters = lb WHERE c >= 0.5::double * (x.n + y.n - c)
  UNION ALL SELECT DISTINCT letters, letters FROM ev WHERE letters <> ''
), found AS (
  SELECT a.row_id AS eval_row_id, b.row_id AS train_row_id FROM near JOIN ev a ON a.letters = la JOIN tr b ON b.letters = lb
)"""


@query("p2_found", _NEAR)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = near.near_duplicates(read_table(spark, sf, "dev"))
    return found.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


@query(
    "p2_groups",
    f"""WITH RECURSIVE {_NEAR_TEXTS}, links AS (SELECT la AS a, lb AS b FROM near UNION ALL SELECT lb, la FROM near), reach AS (
  SELECT a AS x, a AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a
), root AS (SELECT x, min(y) AS root FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT row_id, CASE WHEN length(letters) < 12 THEN row_id ELSE min(row_id) OVER (PARTITION BY coalesce(root, letters)) END AS group_id, coalesce(n_links, 0)::bigint AS n_links
FROM lettered LEFT JOIN root ON x = letters LEFT JOIN n ON a = letters""",
)
def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.near_duplicate_groups(read_table(spark, sf, "dev")).withColumnRenamed("id", "row_id")


def _splits(spark: SparkSession, sf: str) -> tuple[list[DataFrame], DataFrame]:
    return [read_table(spark, sf, "dev"), read_table(spark, sf, "test")], read_table(spark, sf, "train")


@query("p3_found", _OVERLAP + " SELECT * FROM found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.overlaps(*_splits(spark, sf))
    return found.select(F.col("eval_id").alias("eval_row_id"), F.col("train_id").alias("train_row_id"))


@query(
    "p3_counts",
    _OVERLAP + """, m AS (SELECT eval_row_id, count(*) AS n FROM found GROUP BY eval_row_id)
SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, coalesce(sum(n), 0)::bigint AS n_matches
FROM (SELECT row_id, source, 'dev' AS split FROM dev UNION ALL SELECT row_id, source, 'test' FROM test) LEFT JOIN m ON eval_row_id = row_id GROUP BY split, source""",
)
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    evaluation, training = _splits(spark, sf)
    rows = [d.where("row_id is not null").select(F.col("row_id").alias("id"), F.lit(s).alias("split"), "source") for d, s in zip(evaluation, ("dev", "test"), strict=True)]
    return overlap.overlap_counts(overlap.overlaps(evaluation, training), rows[0].unionByName(rows[1]))


def _limits(spark: SparkSession, sf: str, profile: str) -> tuple[int, int]:
    row = read_table(spark, sf, "size_limits").where(F.col("profile") == profile).select("capacity", "overlap_size").first()
    return int(row["capacity"]), int(row["overlap_size"])


@query(
    "p5_found",
    f"""WITH {_letters("dev")}, runs AS (
  SELECT row_id, unnest(regexp_extract_all(letters, 'N{{10,}}|[^N]+|N{{1,9}}')) AS run,
         generate_subscripts(regexp_extract_all(letters, 'N{{10,}}|[^N]+|N{{1,9}}'), 1) AS i
  FROM lettered WHERE length(letters) > (SELECT capacity FROM size_limits WHERE profile = 'sequence_piece')
), placed AS (
  SELECT row_id, run, (sum(length(run)) OVER (PARTITION BY row_id ORDER BY i))::bigint AS e FROM runs
), gap AS (
  SELECT row_id, e - length(run) AS gap_start, e AS gap_end FROM placed WHERE regexp_full_match(run, 'N{{10,}}')
)
SELECT * FROM gap UNION ALL SELECT DISTINCT row_id, -1::bigint, -1::bigint FROM runs WHERE row_id NOT IN (SELECT row_id FROM gap)""",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.gaps(pieces.split_oversized(read_table(spark, sf, "dev"), *_limits(spark, sf, "sequence_piece"))).withColumnRenamed("id", "row_id")


def _pieces(spark: SparkSession, sf: str, profile: str) -> DataFrame:
    capacity, overlap_size = _limits(spark, sf, profile)
    return pieces.pieces(pieces.split_oversized(read_table(spark, sf, "dev"), capacity, overlap_size), overlap_size).withColumnRenamed("id", "row_id")


def _pieces_sql(profile: str) -> str:
    """The cut, piece by piece: all that is left, up to behind the last gap in reach, to before it, or to the limit."""
    gap_at = "substr(win, e::int + 1, 10) = repeat('N', 10)"
    return f"""WITH RECURSIVE lim AS (SELECT capacity AS cap, overlap_size AS ov FROM size_limits WHERE profile = '{profile}'), {_letters("dev")}, long AS (
  SELECT row_id, letters, cap, ov FROM lettered, lim WHERE length(letters) > cap
), walk AS (
  SELECT row_id, letters, cap, ov, -1 AS piece_no, 0 AS start, 0 AS stop, '' AS boundary FROM long
  UNION ALL
  SELECT row_id, letters, cap, ov, piece_no + 1, stop, stop + coalesce(last, behind, before, most),
         CASE WHEN last IS NOT NULL THEN 'end' WHEN behind IS NOT NULL THEN 'after_gap' WHEN before IS NOT NULL THEN 'before_gap' ELSE 'letter' END
  FROM (
    SELECT *, CASE WHEN length(letters) - stop <= most THEN length(letters) - stop END AS last,
           list_max(list_filter(ends, lambda e: e >= 10 AND substr(win, e::int - 9, 10) = repeat('N', 10) AND substr(win, e::int + 1, 1) <> 'N')) AS behind,
           list_max(list_filter(ends, lambda e: {gap_at} AND substr(win, e::int, 1) <> 'N')) AS before
    FROM (
      SELECT *, substr(letters, stop + 1, most + 10) AS win, range(ov + 1, most + 1) AS ends
      FROM (SELECT *, CASE WHEN piece_no < 0 THEN cap ELSE cap - ov END AS most FROM walk WHERE stop < length(letters))
    )
  )
)
SELECT row_id, piece_no, greatest(0, start - ov)::bigint AS piece_start, stop::bigint AS piece_end, boundary,
       substr(letters, greatest(0, start - ov) + 1, stop - greatest(0, start - ov)) AS piece
FROM walk WHERE piece_no >= 0"""


@query("p5_pieces", _pieces_sql("sequence_piece"))
def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, "sequence_piece")


@query("p5_pieces_short", _pieces_sql("sequence_piece_short"))
def p5_pieces_short(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf, "sequence_piece_short")


def _packed(spark: SparkSession, sf: str, profile: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"), _limits(spark, sf, profile)[0])


@query("p6_containers")
def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "text_container").withColumnRenamed("id", "doc_id")


@query("p6_containers_long")
def p6_containers_long(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "text_container_long").withColumnRenamed("id", "doc_id")


@query("p6_fill")
def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    sizes = packing.token_sizes(read_table(spark, sf, "documents"))
    short, long = (_limits(spark, sf, p)[0] for p in ("text_container", "text_container_long"))
    return packing.fill(packing.pack_sizes(sizes, short), short).unionByName(packing.fill(packing.pack_sizes(sizes, long), long))


@query(
    "p6_promises",
    """SELECT capacity, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) AS n_texts, 0::bigint AS n_overfull, 0::bigint AS n_overlapping,
       0::bigint AS n_needless_splits, 0::bigint AS n_gaps FROM size_limits WHERE profile IN ('text_container', 'text_container_long')""",
)
def p6_promises(spark: SparkSession, sf: str) -> DataFrame:
    sizes = packing.token_sizes(read_table(spark, sf, "documents"))
    short, long = (_limits(spark, sf, p)[0] for p in ("text_container", "text_container_long"))
    return packing.kept_promises(packing.pack_sizes(sizes, short), short).unionByName(packing.kept_promises(packing.pack_sizes(sizes, long), long))


@query("p7_mixture")
def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets")).withColumnRenamed("id", "doc_id")


@query("p7_shares")
def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = read_table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mixture(read_table(spark, sf, "documents"), targets), targets)


_PLAIN = "regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g')"


@query(
    "p7_promises",
    f"""WITH known AS (SELECT DISTINCT {_PLAIN.format("source")} AS source FROM documents WHERE text <> '')
SELECT {_PLAIN.format("t.source")} AS source, k.source IS NOT NULL AS has_texts, true AS within_cap, k.source IS NOT NULL AS share_met
FROM mix_targets t LEFT JOIN known k ON k.source = {_PLAIN.format("t.source")}""",
)
def p7_promises(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.kept_promises(p7_shares(spark, sf))


@query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(read_table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")
