"""Queries on augmentation, sampling, splitting, folding, labels and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.functions import sequence as sq
from codonlake.operators import augment as au
from codonlake.operators import intervals as iv
from codonlake.operators import sampling as sa
from codonlake.plans.registry import query
from codonlake.plans.scalar import SPLITS_SQL, rev_sql, splits
from codonlake.session import read_table

RC = f"translate({rev_sql('sequence')}, 'ACGTacgt', 'TGCAtgca')"


def hash_sql(seed: int = 0) -> str:
    return f"(((row_id + {seed})::hugeint * 1103515245 + 12345) % 2147483648)::bigint"


def placed_sql(by: str, source: str, seed: int = 0) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY {hash_sql(seed)}, row_id) - 1 AS place, count(*) OVER ({part}) AS size FROM {source})"


def _sums(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


@query("augment_rc", f"SELECT row_id, sequence, false AS is_rc FROM dev UNION ALL SELECT row_id, {RC}, true FROM dev")
def augment_rc(spark, sf):
    return au.with_reverse_complement(read_table(spark, sf, "dev").select("row_id", "sequence"))


@query("concat_rc", f"SELECT row_id, sequence || 'NNN' || {RC} AS sequence FROM dev")
def concat_rc(spark, sf):
    return au.concat_reverse_complement(read_table(spark, sf, "dev").select("row_id", "sequence"), sep="NNN")


@query("raw_rc_fraction", f"SELECT row_id, split, CASE WHEN place < floor(size * 0.3::double) THEN {RC} ELSE sequence END AS sequence FROM {placed_sql('split', SPLITS_SQL)}")
def raw_rc_fraction(spark, sf):
    return au.reverse_complement_some(splits(spark, sf, "row_id", "sequence"), "row_id", 0.3, ["split"]).select("row_id", "split", "sequence")


@query("append_rows", "SELECT row_id, sequence, gene, NULL AS origin FROM dev UNION ALL SELECT row_id, sequence, NULL, 'test' FROM test")
def append_rows(spark, sf):
    more = read_table(spark, sf, "test").select("row_id", "sequence", F.lit("test").alias("origin"))
    return au.append_rows(read_table(spark, sf, "dev").select("row_id", "sequence", "gene"), more)


@query("sample_exact", f"SELECT row_id, split FROM {placed_sql('split', SPLITS_SQL)} WHERE place < floor(size * 0.25::double)")
def sample_exact(spark, sf):
    return sa.sample(splits(spark, sf, "row_id"), "row_id", 0.25, ["split"])


@query("shuffle_order", f"SELECT row_id, place FROM {placed_sql('', 'train', 3)}")
def shuffle_order(spark, sf):
    return sa.shuffle(read_table(spark, sf, "train").select("row_id"), "row_id", [], 3)


def _part_sql(test: float, val: float, seed: int) -> str:
    held = f"ceil(round(size * {test + val}::double, 9))"
    n_val = f"ceil(round({held} * {val / (test + val)}::double, 9))" if val else "0"
    return f"SELECT row_id, CASE WHEN place >= {held} THEN 'train' WHEN place < {n_val} THEN 'val' ELSE 'test' END AS part FROM {placed_sql('', 'train', seed)}"


@query("split_3way", _part_sql(0.2, 0.1, 1))
def split_3way(spark, sf):
    return sa.split(read_table(spark, sf, "train").select("row_id"), "row_id", 0.2, 0.1, 1)


@query("split_2way", _part_sql(0.25, 0.0, 2))
def split_2way(spark, sf):
    return sa.split(read_table(spark, sf, "train").select("row_id"), "row_id", 0.25, 0.0, 2)


@query("kfold_assign", f"SELECT row_id, (place % 5)::int AS fold FROM {placed_sql('', 'train', 42)}")
def kfold_assign(spark, sf):
    return sa.folds(read_table(spark, sf, "train").select("row_id"), "row_id", 5, [])


@query("kfold_stratified", f"SELECT row_id, label, (place % 5)::int AS fold FROM {placed_sql('label', 'train', 42)}")
def kfold_stratified(spark, sf):
    return sa.folds(read_table(spark, sf, "train").select("row_id", "label"), "row_id", 5, ["label"])


@query("head_n", f"SELECT row_id, split, sequence FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS r FROM {SPLITS_SQL}) WHERE r <= 5")
def head_n(spark, sf):
    return sa.head(splits(spark, sf, "row_id", "sequence"), "row_id", 5, ["split"])


@query("batch_ids", "SELECT (row_id // 64)::bigint AS batch, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM train GROUP BY batch")
def batch_ids(spark, sf):
    return sa.batch_ids(read_table(spark, sf, "train"), "row_id", 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


@query("random_gen_props")
def random_gen_props(spark, sf):
    made = sa.generate(spark, 2000, 60, 240, (0.35, 0.65), 0.02, 6, seed=7)
    n = F.length("sequence")
    return made.select("row_id", n.alias("n"), (n % 6 == 0).alias("whole"), F.round(sq.gc_content(F.col("sequence")), 6).alias("gc"))


@query("label_float", f"SELECT row_id, split, try_cast(trim(label, chr(32) || chr(9) || chr(10) || chr(13)) AS double) AS y FROM {SPLITS_SQL}")
def label_float(spark, sf):
    y = F.regexp_replace("label", r"^[ \t\n\r]+|[ \t\n\r]+$", "").try_cast("double")
    return splits(spark, sf, "row_id", "label").select("row_id", "split", y.alias("y"))


@query("label_multi_split", "SELECT event_id, [try_cast(x AS double) for x in string_split(concat(value, ';', user_id, ';', event_type), ';')] AS labels FROM events")
def label_multi_split(spark, sf):
    from codonlake.sources.files import label_values

    text = F.concat_ws(";", F.col("value").cast("string"), "user_id", "event_type")
    return read_table(spark, sf, "events").select("event_id", label_values(text, ";").alias("labels"))


@query("alias_rename", "SELECT row_id, sequence, label AS labels FROM dev")
def alias_rename(spark, sf):
    from codonlake.sources.files import standard_columns

    return standard_columns(read_table(spark, sf, "dev").select("row_id", F.col("sequence").alias("seq"), F.col("label").alias("target")))


_IV = "(SELECT DISTINCT 'chr' || regexp_replace(regexp_replace(lower(trim(chrom)), '^chr', ''), '^0+(.)', '\\1') AS chrom, start_pos, end_pos, CASE WHEN strand IN ('+', '-') THEN strand END AS strand, gene, lower(trim(feature)) AS feature FROM intervals)"


def _iv(spark, sf) -> DataFrame:
    return iv.plain(read_table(spark, sf, "intervals"))


@query("intervals_plain", f"SELECT * FROM {_IV}")
def intervals_plain(spark, sf):
    return _iv(spark, sf)


_LR = f"WITH iv AS {_IV}, l AS (SELECT chrom, start_pos, end_pos, gene FROM iv WHERE feature <> 'gene' AND start_pos < end_pos), r AS (SELECT chrom, start_pos, end_pos, gene AS other FROM iv WHERE feature = 'gene' AND start_pos < end_pos)"


def _sides(spark, sf):
    i = _iv(spark, sf)
    return i.where("feature <> 'gene'").select("chrom", "start_pos", "end_pos", "gene").distinct(), i.where("feature = 'gene'").select("chrom", "start_pos", "end_pos", F.col("gene").alias("other"))


@query("overlap_join", _LR + " SELECT l.chrom, l.start_pos, l.end_pos, gene, other, r.start_pos AS r_start_pos, r.end_pos AS r_end_pos FROM (SELECT DISTINCT * FROM l) l JOIN r ON l.chrom = r.chrom AND l.start_pos < r.end_pos AND r.start_pos < l.end_pos")
def overlap_join(spark, sf):
    l_, r_ = _sides(spark, sf)
    return iv.overlaps(l_, r_).drop("r_chrom").withColumnRenamed("r_other", "other")


@query("overlap_left_join", _LR + ", h AS (SELECT chrom, start_pos, end_pos FROM r) SELECT l.chrom, l.start_pos, l.end_pos, gene, coalesce(h.start_pos, -1) AS r_start_pos, coalesce(h.end_pos, -1) AS r_end_pos FROM (SELECT DISTINCT * FROM l) l LEFT JOIN h ON l.chrom = h.chrom AND l.start_pos < h.end_pos AND h.start_pos < l.end_pos")
def overlap_left_join(spark, sf):
    l_, r_ = _sides(spark, sf)
    return iv.overlaps(l_, r_.select("chrom", "start_pos", "end_pos"), "left").drop("r_chrom")


@query("islands_from_positions", "WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), g AS (SELECT s, p, p - row_number() OVER (PARTITION BY s ORDER BY p) AS run FROM d) SELECT s, min(p) AS island_start, max(p) + 1 AS island_end FROM g GROUP BY s, run")
def islands_from_positions(spark, sf):
    return iv.islands(read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), ["s"], "p")


@query("introns_from_exons", f"WITH e AS (SELECT gene, chrom, start_pos, end_pos, min(strand) AS strand FROM {_IV} WHERE feature = 'exon' AND gene IS NOT NULL GROUP BY ALL), x AS (SELECT *, lag(end_pos) OVER (PARTITION BY gene, chrom ORDER BY start_pos, end_pos) AS prev FROM e) SELECT gene, chrom, prev AS intron_start, start_pos AS intron_end, row_number() OVER (PARTITION BY gene, chrom ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END)::int AS intron_no FROM x WHERE prev < start_pos")
def introns_from_exons(spark, sf):
    e = _iv(spark, sf).where("feature = 'exon' and gene is not null").groupBy("gene", "chrom", "start_pos", "end_pos").agg(F.min("strand").alias("strand"))
    return iv.introns(e, ["gene", "chrom"])


@query("longest_isoform", f"WITH s AS (SELECT gene, feature, sum(end_pos - start_pos)::bigint AS exon_length FROM {_IV} WHERE feature <> 'gene' AND gene IS NOT NULL GROUP BY gene, feature) SELECT gene, feature, exon_length FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY exon_length DESC, feature DESC) AS r FROM s) WHERE r = 1")
def longest_isoform(spark, sf):
    return iv.longest_isoform(_iv(spark, sf).where("feature <> 'gene' and gene is not null"), "gene", "feature")


@query("strand_positions", f"SELECT gene, start_pos, end_pos, feature, CASE WHEN strand = '-' THEN end_pos - 25 ELSE start_pos + 25 END AS place FROM {_IV} WHERE gene IS NOT NULL")
def strand_positions(spark, sf):
    anchor = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
    return _iv(spark, sf).where("gene is not null").select("gene", "start_pos", "end_pos", "feature", sq.strand_place(anchor, F.lit(25), F.col("strand")).alias("place"))


_TAGS = f"""WITH iv AS {_IV}, g AS (SELECT gene, chrom, min(start_pos) AS a, max(end_pos) AS b FROM iv WHERE feature = 'gene' AND gene IS NOT NULL GROUP BY gene, chrom),
tok AS (SELECT gene, chrom, a + t * 60 AS start_pos, least(b, a + t * 60 + 60) AS end_pos FROM (SELECT *, unnest(range(0, (b - a - 1) // 60 + 1)) AS t FROM g WHERE a < b)),
ann AS (SELECT DISTINCT chrom, start_pos, end_pos, feature FROM iv WHERE feature IN ('utr', 'cds') AND start_pos < end_pos),
one AS (SELECT gene, tok.chrom, tok.start_pos, tok.end_pos, arg_min(feature, (ann.start_pos, ann.end_pos, feature)) AS name FROM tok LEFT JOIN ann ON tok.chrom = ann.chrom AND tok.start_pos < ann.end_pos AND ann.start_pos < tok.end_pos GROUP BY ALL),
tagged AS (SELECT gene, start_pos, end_pos, CASE WHEN name IS NULL THEN 'O' WHEN name = lag(name) OVER (PARTITION BY gene ORDER BY start_pos, end_pos) THEN 'I-' || name ELSE 'B-' || name END AS tag FROM one)"""


def _tagged(spark, sf) -> DataFrame:
    i = _iv(spark, sf)
    genes = i.where("feature = 'gene' and gene is not null").groupBy("gene", "chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return iv.iob_tags(iv.tiles(genes, 60).drop("tile"), i.where("feature in ('utr', 'cds')").select("chrom", "start_pos", "end_pos", "feature").distinct(), "gene")


@query("iob_tags", _TAGS + " SELECT * FROM tagged")
def iob_tags(spark, sf):
    return _tagged(spark, sf)


@query("gene_token_lists", _TAGS + " SELECT gene, list(tag ORDER BY start_pos, end_pos, tag) AS tags, count(*)::int AS n_tokens FROM tagged GROUP BY gene")
def gene_token_lists(spark, sf):
    return iv.token_lists(_tagged(spark, sf), "gene")


@query("gene_token_counts", _TAGS + " SELECT gene, tag, count(*) AS n FROM tagged GROUP BY gene, tag")
def gene_token_counts(spark, sf):
    return _tagged(spark, sf).groupBy("gene", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("bed_window_fetch", "SELECT row_id, a, b, rpad(concat(repeat('.', least(greatest(0, -a), b - a)), substr(sequence, greatest(a, 0) + 1, greatest(0, least(b, length(sequence)) - greatest(a, 0)))), b - a, '.') AS letters FROM (SELECT row_id, sequence, ((row_id * 37) % 700 - 100 - 40)::int AS a, ((row_id * 37) % 700 - 100 + 40 + 40)::int AS b FROM dev WHERE sequence IS NOT NULL)")
def bed_window_fetch(spark, sf):
    dev = read_table(spark, sf, "dev").where("sequence is not null").select(F.col("row_id").alias("chrom"), "sequence", ((F.col("row_id") * 37) % 700 - 100).alias("start_pos"))
    windows = dev.select("chrom", "start_pos", (F.col("start_pos") + 40).alias("end_pos"))
    got = iv.fetch_windows(windows, dev.select("chrom", "sequence"), 120)
    return got.select(F.col("chrom").alias("row_id"), (F.col("start_pos") - 40).cast("int").alias("a"), (F.col("start_pos") + 80).cast("int").alias("b"), "letters")


@query("gff_attributes", f"SELECT DISTINCT chrom, start_pos - 1 AS start_pos, end_pos, gene AS name, 'iso_' || feature AS parent FROM {_IV} WHERE gene IS NOT NULL")
def gff_attributes(spark, sf):
    from codonlake.sources.files import gff_line

    i = _iv(spark, sf).where("gene is not null")
    line = F.concat_ws("\t", "chrom", F.lit("src"), "feature", "start_pos", "end_pos", F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), F.concat(F.lit("ID=x;Name="), "gene", F.lit(";Parent=iso_"), "feature", F.lit(",other")))
    return i.select(gff_line(line).alias("g")).select("g.chrom", "g.start_pos", "g.end_pos", "g.name", "g.parent").distinct()
