"""Queries on text metrics: short answers from part names, long texts from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.functions import text as tx
from codonlake.operators import text_metrics as tm
from codonlake.plans.registry import query
from codonlake.session import cut, read_table, running_totals, spread

#: Two spellings of a part, and the name of another part.
PAIRS = "pairs AS (SELECT p_partkey AS id, concat('The ', p_name, ', a ', p_type, '!') AS pred, concat(p_type, ' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' the ' || p_brand ELSE '' END) AS ref FROM part)"


def pairs(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), "p_name", F.lit(", a "), "p_type", F.lit("!")).alias("pred"), F.concat("p_type", F.lit(" "), "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" the "), "p_brand")).otherwise("")).alias("ref"))


#: Each document against the one before it in its study.
DOCS = "docs AS (SELECT doc_id AS id, text AS pred, lag(text) OVER (PARTITION BY study ORDER BY doc_id) AS ref FROM documents)"


def docs(spark, sf) -> DataFrame:
    """Ranks in order come from running sums over ranges of the identifiers, so no task holds a study, and texts are joined
    only by identifier."""
    d = read_table(spark, sf, "documents")
    ranked = cut(running_totals(d.select("study", "doc_id", F.lit(1).alias("one")), ["study"], "doc_id", {"one": "rank"}))
    before = ranked.select("study", (F.col("rank") + 1).alias("rank"), F.col("doc_id").alias("before"))
    pair = ranked.join(before, [ranked["study"].eqNullSafe(before["study"]), ranked["rank"] == before["rank"]], "left").select("doc_id", "before")
    refs = d.select(F.col("doc_id").alias("before"), F.col("text").alias("ref"))
    return spread(cut(pair.join(d.select("doc_id", F.col("text").alias("pred")), "doc_id").join(refs, "before", "left").select(F.col("doc_id").alias("id"), "pred", "ref")))


_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def words_sql(c: str) -> str:
    white = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{white}'), lambda w: w <> '')"


def rouge_sql(c: str) -> str:
    return words_sql(f"regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')")


def tokens_sql(c: str) -> str:
    """The 13a words."""
    t = f"coalesce({c}, '')"
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "chr(34)"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        t = f"replace({t}, {a}, {b})"
    t = f"concat(' ', {t}, ' ')"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return words_sql(t)


def normal_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({c}), {_PUNCT}, ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def grams_sql(source: str, pred: str, ref: str, most: int, sep: str = " ") -> str:
    """CTEs p, g, c, m: n-gram matches by id and order."""
    one = lambda c: f"flatten([[{{'n': n, 'g': array_to_string({c}[i:i + n - 1], '{sep}')}} for i in range(1, len({c}) - n + 2)] for n in range(1, {most + 1})])"
    return f"""p AS (SELECT id, {pred} AS p, {ref} AS r FROM {source}),
g AS (SELECT id, x.n AS n, x.g AS g, 1 AS s FROM (SELECT id, unnest({one('p')}) AS x FROM p) UNION ALL SELECT id, x.n, x.g, 0 FROM (SELECT id, unnest({one('r')}) AS x FROM p)),
c AS (SELECT id, n, g, sum(s) AS p, sum(1 - s) AS r FROM g GROUP BY id, n, g),
m AS (SELECT id, n, sum(least(p, r))::double AS matches, sum(p)::double AS pt, sum(r)::double AS rt FROM c GROUP BY id, n)"""


@query("m_exact_match", f"WITH {PAIRS} SELECT avg((pred = ref)::int)::double AS plain, avg((translate(translate(lower(pred), {_PUNCT}, ''), '0123456789', '') = translate(translate(lower(ref), {_PUNCT}, ''), '0123456789', ''))::int)::double AS cleaned FROM pairs")
def m_exact_match(spark, sf):
    return pairs(spark, sf).agg(F.avg((F.col("pred") == F.col("ref")).cast("int")).alias("plain"), F.avg((tx.cleaned(F.col("pred")) == tx.cleaned(F.col("ref"))).cast("int")).alias("cleaned"))


@query("answer_normal", f"WITH {PAIRS} SELECT id, {normal_sql('pred')} AS answer FROM pairs")
def answer_normal(spark, sf):
    return pairs(spark, sf).select("id", tx.normal_answer(F.col("pred")).alias("answer"))


@query("m_cer", f"WITH {PAIRS} SELECT round(sum(levenshtein(pred, ref))::double / sum(length(ref)), 9) AS cer FROM pairs")
def m_cer(spark, sf):
    return pairs(spark, sf).agg(F.round(F.sum(F.levenshtein("pred", "ref")) / F.sum(F.length("ref")), 9).alias("cer"))


@query("m_wer", f"WITH {PAIRS}, w AS (SELECT {words_sql('pred')} AS p, {words_sql('ref')} AS r FROM pairs), k AS (SELECT p, r, list_distinct(list_concat(p, r)) AS d FROM w) SELECT round(sum(levenshtein(array_to_string([chr(64 + list_position(d, x)::int) for x in p], ''), array_to_string([chr(64 + list_position(d, x)::int) for x in r], '')))::double / sum(len(r)), 9) AS wer FROM k")
def m_wer(spark, sf):
    p, r = tx.words(F.col("pred")), tx.words(F.col("ref"))
    return pairs(spark, sf).agg(F.round(F.sum(tx.word_distance(p, r)) / F.sum(F.size(r)), 9).alias("wer"))


@query("m_bleu", f"WITH {DOCS}, {grams_sql('docs', tokens_sql('pred'), tokens_sql('ref'), 4)}, o AS (SELECT n, sum(matches) AS m, sum(pt) AS t FROM m GROUP BY n), l AS (SELECT sum(len(p))::double AS c, sum(len(r))::double AS r FROM p) SELECT round(CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp((SELECT sum(ln(m / t)) FROM o) / 4), 6) AS bleu, round(CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END, 6) AS brevity, round(c / r, 6) AS ratio FROM l")
def m_bleu(spark, sf):
    d = cut(docs(spark, sf).select("id", tx.tokens_13a(F.col("pred")).alias("p"), tx.tokens_13a(F.col("ref")).alias("r")))
    out = tm.bleu(tm.ngram_matches(d, "id", F.col("p"), F.col("r"), 4), tm.lengths(d, F.col("p"), F.col("r")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m_gleu", f"WITH {DOCS}, {grams_sql('docs', tokens_sql('pred'), tokens_sql('ref'), 4)} SELECT id, round(sum(matches) / greatest(sum(pt), sum(rt)), 6) AS gleu FROM m GROUP BY id")
def m_gleu(spark, sf):
    out = tm.gleu(tm.ngram_matches(docs(spark, sf), "id", tx.tokens_13a(F.col("pred")), tx.tokens_13a(F.col("ref")), 4), "id")
    return out.select("id", F.round("gleu", 6).alias("gleu"))


@query("m_chrf", f"WITH {PAIRS}, {grams_sql('pairs', chr(10).join(['list_filter(string_split(pred, ' + chr(39) * 2 + '), lambda x: x <> ' + chr(39) + ' ' + chr(39) + ')']), 'list_filter(string_split(ref, ' + chr(39) * 2 + '), lambda x: x <> ' + chr(39) + ' ' + chr(39) + ')', 6, '')}, o AS (SELECT n, sum(matches) / sum(pt) AS p, sum(matches) / sum(rt) AS r FROM m GROUP BY n), a AS (SELECT avg(p) AS p, avg(r) AS r FROM o) SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM a")
def m_chrf(spark, sf):
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != " ")
    out = tm.chrf(tm.ngram_matches(pairs(spark, sf), "id", letters("pred"), letters("ref"), 6))
    return out.select(F.round("chrf", 6).alias("chrf"))


@query("m_rouge_n", f"WITH {DOCS}, {grams_sql('docs', rouge_sql('pred'), rouge_sql('ref'), 2)}, q AS (SELECT id, n, CASE WHEN pt > 0 THEN matches / pt ELSE 0 END AS p, CASE WHEN rt > 0 THEN matches / rt ELSE 0 END AS r FROM m) SELECT id, n::int AS n, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS rouge FROM q")
def m_rouge_n(spark, sf):
    out = tm.rouge_n(tm.ngram_matches(docs(spark, sf), "id", tx.rouge_words(F.col("pred")), tx.rouge_words(F.col("ref")), 2), "id")
    return out.select("id", "n", F.round("rouge", 6).alias("rouge"))


@query("m_rouge_l")
def m_rouge_l(spark, sf):
    return pairs(spark, sf).select("id", F.round(tm.rouge_l(F.col("pred"), F.col("ref")), 6).alias("rouge"))


@query("m_sari")
def m_sari(spark, sf):
    return pairs(spark, sf).select("id", F.round(tm.sari(F.concat("ref", F.lit(" item")), F.col("pred"), F.array("ref")), 6).alias("sari"))


_BAG = grams_sql("pairs", words_sql(normal_sql("pred")), words_sql(normal_sql("ref")), 1)


@query("m_squad", f"WITH {PAIRS}, {_BAG}, q AS (SELECT id, matches / pt AS p, matches / rt AS r FROM m) SELECT pairs.id AS id, ({normal_sql('pred')} = {normal_sql('ref')})::int::double AS exact, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pairs JOIN q ON q.id = pairs.id")
def m_squad(spark, sf):
    out = tm.answer_f1(pairs(spark, sf), "id", "pred", "ref")
    return out.select("id", "exact", F.round("f1", 6).alias("f1"))


@query("m_squad_threshold", "WITH s AS (SELECT value AS s, sum(CASE WHEN event_type = 'error' THEN -1 ELSE (event_id % 5) / 4.0::double END) AS d FROM events GROUP BY value), b AS (SELECT sum((event_type = 'error')::int)::double AS base FROM events), r AS (SELECT s, base, base + round(sum(d) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING), 9) AS v FROM s, b), m AS (SELECT max(v) AS v, arg_max(s, (v, -s)) AS s, any_value(base) AS base FROM r) SELECT round(greatest(v, base), 6) AS best, CASE WHEN v > base THEN s ELSE 0 END AS threshold FROM m")
def m_squad_threshold(spark, sf):
    e = read_table(spark, sf, "events").select("value", ((F.col("event_id") % 5) / F.lit(4.0)).alias("gain"), (F.col("event_type") == "error").alias("none"))
    out = tm.best_threshold(e, "value", "gain", "none")
    return out.select(F.round("best", 6).alias("best"), "threshold")


@query("m_cuad_jaccard", f"WITH {PAIRS}, w AS (SELECT id, list_distinct({words_sql('lower(pred)')}) AS a, list_distinct({words_sql('lower(ref)')}) AS b FROM pairs) SELECT id, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM w")
def m_cuad_jaccard(spark, sf):
    return pairs(spark, sf).select("id", F.round(tx.jaccard(tx.words(F.lower("pred")), tx.words(F.lower("ref"))), 6).alias("jaccard"))


@query("m_bcubed", "WITH c AS (SELECT l_suppkey AS k, l_partkey % 50 AS r, count(*)::double AS n FROM lineitem GROUP BY ALL), s AS (SELECT n, sum(n) OVER (PARTITION BY k) AS nk, sum(n) OVER (PARTITION BY r) AS nr FROM c), t AS (SELECT sum(n * n / nr) / sum(n) AS p, sum(n * n / nk) / sum(n) AS r FROM s) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM t")
def m_bcubed(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("r"))
    out = tm.b_cubed(li, "l_orderkey", "k", "r")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m_perplexity", "SELECT user_id, round(exp(avg(value) / 50), 6) AS perplexity FROM events GROUP BY user_id")
def m_perplexity(spark, sf):
    out = tm.perplexity(read_table(spark, sf, "events").withColumn("lp", -F.col("value") / 50), "user_id", "lp")
    return out.select("user_id", F.round("perplexity", 6).alias("perplexity"))


@query("tokens_13a", f"SELECT doc_id, len(t)::int AS n, len(list_distinct(t))::int AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokens_13a(spark, sf):
    t = read_table(spark, sf, "documents").select("doc_id", tx.tokens_13a(F.col("text")).alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("n"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query("tagged_spans", "WITH t AS (SELECT user_id, list(event_type ORDER BY event_id) AS tok, list(CASE event_type WHEN 'click' THEN 'B-x' WHEN 'view' THEN 'I-x' ELSE 'O' END ORDER BY event_id) AS tag FROM events GROUP BY user_id), p AS (SELECT *, list_position(tag, 'B-x') AS a, len(tag) + 1 - list_position(list_reverse(tag), 'I-x') AS z FROM t) SELECT user_id, array_to_string(tok[a:greatest(a, CASE WHEN list_contains(tag, 'I-x') THEN z ELSE a END)], '') AS span FROM p WHERE a > 0")
def tagged_spans(spark, sf):
    tag = F.when(F.col("event_type") == "click", "B-x").when(F.col("event_type") == "view", "I-x").otherwise("O")
    t = read_table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", tag.alias("tag")))).alias("t"))
    return t.select("user_id", tx.tagged_span(F.col("t.event_type"), F.col("t.tag"), "x").alias("span")).where("span is not null")
