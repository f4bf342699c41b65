"""Queries on sequence functions, filters and row statistics of the split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import sequence as sq
from codonlake.operators import stats
from codonlake.plans.registry import query
from codonlake.session import read_table


GC_SQL = "(CASE WHEN replace(upper({0}), 'N', '') = '' THEN 0.0::double ELSE (length(replace(upper({0}), 'N', '')) - length(translate(replace(upper({0}), 'N', ''), 'GC', '')))::double / length(replace(upper({0}), 'N', '')) END)"


def gc_sql(c: str) -> str:
    return GC_SQL.format(c)


SPLITS_SQL = "(SELECT 'dev' AS split, * FROM dev UNION ALL BY NAME SELECT 'test' AS split, * FROM test UNION ALL BY NAME SELECT 'train' AS split, * FROM train)"


def splits(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The three splits as one table with the split's name."""
    parts = [read_table(spark, sf, t).select(*columns, F.lit(t).alias("split")) for t in ("dev", "test", "train")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("seq_gc", f"SELECT row_id, round({gc_sql('sequence')}, 9) AS gc FROM dev")
def seq_gc(spark, sf):
    return read_table(spark, sf, "dev").select("row_id", F.round(sq.gc_content(F.col("sequence")), 9).alias("gc"))


def rev_sql(c: str) -> str:
    """Reversed by code points: the plain function keeps line ends of two characters together."""
    return f"replace(reverse(replace({c}, chr(13) || chr(10), chr(1) || chr(2))), chr(2) || chr(1), chr(10) || chr(13))"


@query("seq_revcomp", f"SELECT row_id, translate({rev_sql('sequence')}, 'ACGTacgt', 'TGCAtgca') AS rc FROM dev")
def seq_revcomp(spark, sf):
    return read_table(spark, sf, "dev").select("row_id", sq.reverse_complement(F.col("sequence")).alias("rc"))


@query("seq_complement_only", "SELECT row_id, translate(sequence, 'ACGTacgt', 'TGCAtgca') AS c FROM dev")
def seq_complement_only(spark, sf):
    return read_table(spark, sf, "dev").select("row_id", sq.reverse_complement(F.col("sequence"), reverse=False).alias("c"))


@query("seq_reverse_only", f"SELECT row_id, {rev_sql('sequence')} AS r FROM dev")
def seq_reverse_only(spark, sf):
    return read_table(spark, sf, "dev").select("row_id", sq.reverse_complement(F.col("sequence"), complemented=False).alias("r"))


KMERS_SQL = "[upper(substr({0}, i, {1})) for i in range(1, length({0}) - {1} + 2)]"


@query("seq_kmers", f"SELECT row_id, array_to_string({KMERS_SQL.format('sequence', 6)}, ' ') AS kmers FROM dev WHERE sequence IS NOT NULL")
def seq_kmers(spark, sf):
    return read_table(spark, sf, "dev").where("sequence is not null").select("row_id", sq.kmer_text(F.col("sequence"), 6).alias("kmers"))


@query("kmer_counts", f"SELECT kmer, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM (SELECT row_id, unnest({KMERS_SQL.format('sequence', 5)}) AS kmer FROM dev) GROUP BY kmer")
def kmer_counts(spark, sf):
    return stats.kmer_counts(read_table(spark, sf, "dev"), "row_id", "sequence", 5)


@query("kmer_topk", f"SELECT split, kmer, n, rank FROM (SELECT split, kmer, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, kmer) AS rank FROM (SELECT split, unnest({KMERS_SQL.format('sequence', 4)}) AS kmer FROM {SPLITS_SQL}) GROUP BY split, kmer) WHERE rank <= 20")
def kmer_topk(spark, sf):
    return stats.kmer_topk(splits(spark, sf, "sequence"), "split", "sequence", 4, 20)


IDS_SQL = "[CASE WHEN x = 'A' THEN 0 WHEN x = 'C' THEN 1 WHEN x = 'G' THEN 2 WHEN x IN ('T', 'U') THEN 3 WHEN x IN ('-', '.') THEN -1 ELSE 4 END for x in string_split(upper(sequence), '')]"
_HAS = "sequence IS NOT NULL AND sequence <> ''"


def _some(spark, sf):
    return read_table(spark, sf, "dev").where("sequence is not null and sequence <> ''")


@query("onehot_ids", f"SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS}")
def onehot_ids(spark, sf):
    return _some(spark, sf).select("row_id", sq.base_ids(F.col("sequence")).alias("ids"))


@query("onehot_padded_mask", f"SELECT row_id, ids, [CASE WHEN x = -1 THEN 0 ELSE 1 END for x in ids] AS mask FROM (SELECT row_id, list_resize(ids[1:512], 512, -1) AS ids FROM (SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS}))")
def onehot_padded_mask(spark, sf):
    return _some(spark, sf).select("row_id", sq.padded_ids(F.col("sequence"), 512).alias("ids")).select("*", sq.attention_mask(F.col("ids")).alias("mask"))


@query("onehot_padded_left", f"SELECT row_id, list_concat([-1 for i in range(0, 512 - len(ids[1:512]))], ids[1:512]) AS ids FROM (SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS})")
def onehot_padded_left(spark, sf):
    return _some(spark, sf).select("row_id", sq.padded_ids(F.col("sequence"), 512, "left").alias("ids"))


@query("onehot_vectors", f"SELECT row_id, sum(v[1])::double AS a, sum(v[2])::double AS c, sum(v[3])::double AS g, sum(v[4])::double AS t, count(*) AS n FROM (SELECT row_id, unnest([[(x = 0 OR x > 3)::int * (CASE WHEN x > 3 THEN 0.25::double ELSE 1.0::double END), (x = 1 OR x > 3)::int * (CASE WHEN x > 3 THEN 0.25::double ELSE 1.0::double END), (x = 2 OR x > 3)::int * (CASE WHEN x > 3 THEN 0.25::double ELSE 1.0::double END), (x = 3 OR x > 3)::int * (CASE WHEN x > 3 THEN 0.25::double ELSE 1.0::double END)] for x in ids]) AS v FROM (SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS})) GROUP BY row_id")
def onehot_vectors(spark, sf):
    v = _some(spark, sf).select("row_id", F.explode(sq.one_hot(sq.base_ids(F.col("sequence")), unknown=0.25)).alias("v"))
    return v.groupBy("row_id").agg(*[F.sum(F.col("v")[j]).alias(b) for j, b in enumerate("acgt")], F.count(F.lit(1)).alias("n"))


@query("onehot_decode", f"SELECT row_id, array_to_string([substr('ACGTN', x + 1, 1) for x in ids if x <> -1], '') AS decoded FROM (SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS})")
def onehot_decode(spark, sf):
    return _some(spark, sf).select("row_id", sq.decode_ids(sq.base_ids(F.col("sequence"))).alias("decoded"))


@query("idx_revcomp", f"SELECT row_id, list_reverse([CASE WHEN x BETWEEN 0 AND 3 THEN 3 - x ELSE x END for x in ids]) AS ids FROM (SELECT row_id, {IDS_SQL} AS ids FROM dev WHERE {_HAS})")
def idx_revcomp(spark, sf):
    return _some(spark, sf).select("row_id", sq.ids_reverse_complement(sq.base_ids(F.col("sequence"))).alias("ids"))


_BASES_SQL = ", ".join(f"sum(length(u) - length(replace(u, '{b}', '')))::bigint AS n_{b.lower()}" for b in "ACGTN")


@query("base_composition", f"SELECT split, source, {_BASES_SQL}, sum(length(translate(u, 'ACGTN', '')))::bigint AS n_other FROM (SELECT split, source, translate(upper(sequence), 'U', 'T') AS u FROM {SPLITS_SQL}) GROUP BY split, source")
def base_composition(spark, sf):
    return stats.base_composition(splits(spark, sf, "source", "sequence"), ["split", "source"], "sequence")


@query("validate_len_gc", f"SELECT row_id, split FROM {SPLITS_SQL} WHERE length(sequence) BETWEEN 20 AND 6000 AND {gc_sql('sequence')} BETWEEN 0.4 AND 0.6 AND translate(upper(sequence), 'ACGTN', '') = ''")
def validate_len_gc(spark, sf):
    return splits(spark, sf, "row_id", "sequence").where(sq.is_valid(F.col("sequence"), 20, 6000, (0.4, 0.6))).select("row_id", "split")


@query("validate_alphabet", f"SELECT row_id, split FROM {SPLITS_SQL} WHERE length(sequence) BETWEEN 1 AND 500000000 AND {gc_sql('sequence')} BETWEEN 0 AND 1 AND translate(upper(sequence), 'ACGTNRYSWKM', '') = ''")
def validate_alphabet(spark, sf):
    return splits(spark, sf, "row_id", "sequence").where(sq.is_valid(F.col("sequence"), letters="ACGTNRYSWKM")).select("row_id", "split")


@query("drop_missing", f"SELECT row_id, split FROM {SPLITS_SQL} WHERE regexp_replace(sequence, '\\s', '', 'g') <> '' AND label IS NOT NULL")
def drop_missing(spark, sf):
    return stats.drop_missing(splits(spark, sf, "row_id", "sequence", "label")).select("row_id", "split")


@query("dna_regex_guard", "SELECT row_id, regexp_full_match(sequence, '[ACGTacgtNn]+') AS is_dna FROM dev WHERE sequence IS NOT NULL")
def dna_regex_guard(spark, sf):
    return read_table(spark, sf, "dev").where("sequence is not null").select("row_id", sq.is_dna(F.col("sequence")).alias("is_dna"))


_LEN = "min(length(coalesce(sequence, ''))) AS min_len, max(length(coalesce(sequence, ''))) AS max_len, round(avg(length(coalesce(sequence, ''))), 6) AS mean_len, quantile_cont(length(coalesce(sequence, '')), 0.5)::double AS median_len"


@query("length_stats", f"SELECT source, count(*) AS n, {_LEN} FROM {SPLITS_SQL} GROUP BY source")
def length_stats(spark, sf):
    return stats.length_stats(splits(spark, sf, "sequence", "source"), ["source"], "sequence")


@query("length_stats_by_split", f"SELECT split, count(*) AS n, {_LEN} FROM {SPLITS_SQL} GROUP BY split")
def length_stats_by_split(spark, sf):
    return stats.length_stats(splits(spark, sf, "sequence"), ["split"], "sequence")


@query("length_histogram", "SELECT label, (length(coalesce(sequence, '')) // 50)::bigint AS bin, count(*) AS n FROM dev GROUP BY ALL")
def length_histogram(spark, sf):
    return stats.length_histogram(read_table(spark, sf, "dev"), "label", "sequence", 50)


@query("length_histogram_60", "SELECT label, least(59, floor((n - lo) * 60.0::double / greatest(hi - lo, 1)))::bigint AS bin, count(*) AS n FROM (SELECT label, length(coalesce(sequence, '')) AS n, min(length(coalesce(sequence, ''))) OVER () AS lo, max(length(coalesce(sequence, ''))) OVER () AS hi FROM dev) GROUP BY ALL")
def length_histogram_60(spark, sf):
    return stats.length_histogram_bins(read_table(spark, sf, "dev"), "label", "sequence", 60)


@query("gc_boxplot", f"SELECT label, " + ", ".join(f"round(quantile_cont(gc, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))) + f" FROM (SELECT label, {gc_sql('sequence')} AS gc FROM dev WHERE sequence IS NOT NULL) GROUP BY label")
def gc_boxplot(spark, sf):
    return stats.gc_boxplot(read_table(spark, sf, "dev").where("sequence is not null"), "label", "sequence")


@query("gc_vs_label", f"SELECT row_id, round({gc_sql('sequence')}, 9) AS gc, try_cast(trim(label) AS double) AS y FROM dev WHERE sequence IS NOT NULL AND label IS NOT NULL AND try_cast(trim(label) AS double) IS NOT NULL")
def gc_vs_label(spark, sf):
    y = F.trim("label").try_cast("double")
    return read_table(spark, sf, "dev").where("sequence is not null").where(y.isNotNull()).select("row_id", F.round(sq.gc_content(F.col("sequence")), 9).alias("gc"), y.alias("y"))


@query("label_distribution", f"SELECT split, label, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (PARTITION BY split), 9) AS share FROM {SPLITS_SQL} GROUP BY split, label")
def label_distribution(spark, sf):
    return stats.label_distribution(splits(spark, sf, "label"), "split", "label")


@query("split_lengths", f"SELECT split, count(*) AS n FROM {SPLITS_SQL} GROUP BY split")
def split_lengths(spark, sf):
    return splits(spark, sf, "row_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("token_offsets", "SELECT row_id, i - 1 AS idx, t AS token, (sum(length(t)) OVER w)::bigint - length(t) AS token_start, (sum(length(t)) OVER w)::bigint AS token_end FROM (SELECT row_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT row_id, regexp_extract_all(sequence, '[^N]{1,40}|N+') AS toks FROM dev)) WINDOW w AS (PARTITION BY row_id ORDER BY i)")
def token_offsets(spark, sf):
    tokens = F.regexp_extract_all("sequence", F.lit("[^N]{1,40}|N+"), F.lit(0))
    placed = read_table(spark, sf, "dev").select("row_id", tokens.alias("toks")).select("row_id", F.posexplode(sq.token_places(F.col("toks"))).alias("idx", "t"))
    return placed.select("row_id", F.col("idx").cast("bigint").alias("idx"), "t.*")


@query("parse_numbers", "SELECT o_orderkey, [try_cast(trim(x) AS int) for x in string_split(concat(o_custkey, ', ', o_orderkey % 7, ',x', ',', o_orderpriority), ',')] AS numbers FROM orders")
def parse_numbers(spark, sf):
    text = F.concat_ws("", "o_custkey", F.lit(", "), F.col("o_orderkey") % 7, F.lit(",x,"), "o_orderpriority")
    return read_table(spark, sf, "orders").select("o_orderkey", sq.whole_numbers(text).alias("numbers"))
