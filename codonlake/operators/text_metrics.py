"""Metrics of generated text against references. N-grams are counted within a row, in Arrow batches, and a few numbers a
row leave it; so do distances and subsequences that no built-in function gives. References are an array of words, or an
array of such arrays where a text has several."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codonlake.functions import text as tx
from codonlake.session import cut, running_totals


def _grams(items: list, n: int) -> Counter:
    return Counter(items) if n == 1 else Counter(zip(*(items[i:] for i in range(n)), strict=False))


def _several(df: DataFrame, ref: Column) -> Column:
    """References as an array of arrays; none for null."""
    nested = isinstance(df.select(ref.alias("r")).schema["r"].dataType.elementType, T.ArrayType)
    return F.coalesce(ref if nested else F.array(ref), F.array().cast("array<array<string>>"))


def ngram_matches(df: DataFrame, id_col: str, pred: Column, ref: Column, most: int) -> DataFrame:
    """(id, n, matches, pred_total, ref_total): common n-grams, n from 1 to ``most``. With several references an n-gram
    counts at most as often as in the one that has it most, and ``ref_total`` is that of the reference with the most
    matches for its length. Orders of which neither side has an n-gram are left out."""
    rows = df.select(id_col, F.coalesce(pred, F.array().cast("array<string>")).alias("__p"), _several(df, ref).alias("__r"))
    one = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "matches", "pred_total", "ref_total")])
    schema = T.StructType([rows.schema[id_col], T.StructField("m", T.ArrayType(one))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, refs in zip(b.column("__p").to_pylist(), b.column("__r").to_pylist(), strict=True):
                refs, mine = [r for r in refs if r is not None] or [[]], []
                for n in range(1, most + 1):
                    have, wanted = _grams(p, n), [_grams(r, n) for r in refs]
                    total, totals = max(0, len(p) - n + 1), [max(0, len(r) - n + 1) for r in refs]
                    hits = [sum(min(c, w[g]) for g, c in have.items() if g in w) for w in wanted]
                    found = hits[0] if len(refs) == 1 else sum(min(c, max(w[g] for w in wanted)) for g, c in have.items())
                    best = max(range(len(refs)), key=lambda k: hits[k] / max(total, totals[k], 1))
                    if total or totals[best]:
                        mine.append({"n": n, "matches": found, "pred_total": total, "ref_total": totals[best]})
                out.append(mine)
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "matches", "pred_total", "ref_total")]))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(out, kind)], [id_col, "m"])

    return rows.mapInArrow(run, schema).select(id_col, F.explode("m").alias("m")).select(id_col, F.col("m.n").cast("int").alias("n"), "m.matches", "m.pred_total", "m.ref_total")


def lengths(df: DataFrame, pred: Column, ref: Column, how: str = "shortest") -> DataFrame:
    """(pred_length, ref_length): words of each text and of its shortest reference, or with ``closest`` of the one whose
    length is nearest (the shorter on ties)."""
    rows = df.select(F.coalesce(F.size(pred), F.lit(0)).alias("c"), F.transform(_several(df, ref), lambda r: F.coalesce(F.size(r), F.lit(0))).alias("r"))
    nearest = F.array_min(F.transform("r", lambda n: F.struct(F.abs(n - F.col("c")).alias("off"), n.alias("n"))))["n"]
    return rows.select(F.col("c").alias("pred_length"), F.coalesce(F.array_min("r") if how == "shortest" else nearest, F.lit(0)).alias("ref_length"))


def bleu(matches: DataFrame, lengths: DataFrame, most: int = 4) -> DataFrame:
    """(bleu, brevity, ratio) of a whole table: ``lengths`` (pred_length, ref_length). 0 if an order has no match."""
    p = matches.groupBy("n").agg(F.sum("matches").alias("m"), F.sum("pred_total").alias("t"))
    logs = p.agg(F.sum(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("t")))).alias("s"), F.count_if(F.col("m") > 0).alias("k"))
    size = lengths.agg(F.sum("pred_length").alias("c"), F.sum("ref_length").alias("r"))
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide("r", "c")))
    score = F.when(F.col("k") < most, 0.0).otherwise(brevity * F.exp(F.col("s") / most))
    return logs.crossJoin(size).select(score.alias("bleu"), brevity.alias("brevity"), F.try_divide("c", "r").alias("ratio"))


def gleu(matches: DataFrame, id_col: str) -> DataFrame:
    """(id, gleu): common n-grams of all orders over those of the longer side."""
    s = matches.groupBy(id_col).agg(F.sum("matches").alias("m"), F.greatest(F.sum("pred_total"), F.sum("ref_total")).alias("t"))
    return s.select(id_col, F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0).alias("gleu"))


def corpus_gleu(matches: DataFrame, id_col: str) -> DataFrame:
    """(gleu) of a whole table: the sums of both sides of ``gleu`` over all texts."""
    s = matches.groupBy(id_col).agg(F.sum("matches").alias("m"), F.greatest(F.sum("pred_total"), F.sum("ref_total")).alias("t"))
    return s.agg(F.coalesce(F.try_divide(F.sum("m"), F.sum("t")), F.lit(0.0)).alias("gleu"))


def f_score(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when((p + r) == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def chrf(matches: DataFrame, beta: float = 2.0) -> DataFrame:
    """(chrf) of a whole table of character n-gram matches: F-beta of the precision and recall averaged over orders."""
    o = matches.groupBy("n").agg(F.sum("matches").alias("m"), F.sum("pred_total").alias("p"), F.sum("ref_total").alias("r")).where("p > 0 and r > 0")
    avg = o.agg(F.avg(F.col("m") / F.col("p")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("r"))
    return avg.select((100 * f_score(F.col("p"), F.col("r"), beta)).alias("chrf"))


def rouge_n(matches: DataFrame, id_col: str) -> DataFrame:
    """(id, n, rouge): F1 of common n-grams by order."""
    p, r = (F.when(F.col(t) > 0, F.col("matches") / F.col(t)).otherwise(0.0) for t in ("pred_total", "ref_total"))
    return matches.select(id_col, "n", f_score(p, r).alias("rouge"))


def answer_f1(df: DataFrame, id_col: str, pred: str, ref: str) -> DataFrame:
    """(id, exact, f1) of normalised answers: equality, and the overlap of their bags of words; both empty is 1."""
    n = df.select(id_col, tx.normal_answer(F.col(pred)).alias("p"), tx.normal_answer(F.col(ref)).alias("r"))
    m = ngram_matches(n, id_col, tx.words(F.col("p")), tx.words(F.col("r")), 1)
    both = n.join(m, id_col, "left").na.fill(0, ["matches", "pred_total", "ref_total"])
    p, r = F.try_divide("matches", "pred_total"), F.try_divide("matches", "ref_total")
    one_empty = (F.col("pred_total") == 0) | (F.col("ref_total") == 0)
    f1 = F.when(one_empty, (F.col("pred_total") == F.col("ref_total")).cast("double")).otherwise(f_score(p, r))
    return both.select(id_col, (F.col("p") == F.col("r")).cast("double").alias("exact"), f1.alias("f1"))


def best_threshold(df: DataFrame, score: str, gain: str, no_answer: str) -> DataFrame:
    """(best, threshold): the best sum of gains if rows up to a no-answer score are answered, and the first score that
    reaches it; rows that have no answer give 1 while they aren't answered."""
    steps = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(no_answer), -1.0).otherwise(F.col(gain))).alias("d"))
    start = df.agg(F.count_if(F.col(no_answer)).cast("double").alias("base"))
    sums = running_totals(steps, [], "s", {"d": "cum"})
    run = sums.crossJoin(F.broadcast(start)).select("s", (F.col("base") + F.round("cum", 9)).alias("v"), "base")
    best = run.agg(F.max("v").alias("v"), F.max_by("s", F.struct("v", -F.col("s"))).alias("s"), F.first("base").alias("base"))
    return best.select(F.greatest("v", "base").alias("best"), F.when(F.col("v") > F.col("base"), F.col("s")).otherwise(0.0).alias("threshold"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. A bit of one long number stands for each word of ``a``, so a word of ``b``
    takes one step over all of them."""
    return len(a) - _unmatched(a, b).bit_count()


def _unmatched(a: list[str], b: list[str]) -> int:
    """The bits of the words of ``a`` at whose end the longest common subsequence with ``b`` doesn't grow."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    state = whole
    for y in b:
        hit = state & at.get(y, 0)
        state = ((state + hit) | (state - hit)) & whole
    return state


def rouge_l(pred: Column, ref: Column) -> Column:
    """F1 of the longest common subsequence of words, as ROUGE takes words."""
    @F.pandas_udf("double")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(p, r, strict=True):
            n = common_subsequence(list(x), list(y))
            out.append(2 * n / (len(x) + len(y)) if n else 0.0)
        return pd.Series(out)

    return run(tx.rouge_words(pred), tx.rouge_words(ref))


def sari_score(source: list[str], pred: list[str], refs: list[list[str]]) -> float:
    """Mean over n = 1 to 4 of the F1 of kept and of added n-grams and the precision of deleted ones, from 0 to 1.

    Counts of the source and the text are multiplied by the number of references, whose counts are added up. Precision of
    kept and of deleted n-grams is the mean of their shares, recall of kept ones a share of all counts; added n-grams are
    compared as sets; a share of nothing is 1.
    """
    share = lambda part, of: part / of if of else 1.0
    f1 = lambda p, r: 2 * p * r / (p + r) if p + r else 0.0
    times = lambda c: Counter({g: k * len(refs) for g, k in c.items()})
    total = 0.0
    for n in range(1, 5):
        s, p, r = times(_grams(source, n)), times(_grams(pred, n)), sum((_grams(x, n) for x in refs), Counter())
        kept, worth_keeping, gone = s & p, s & r, s - p
        good = kept & r
        keep = f1(share(sum(good[g] / kept[g] for g in good), len(kept)), share(good.total(), worth_keeping.total()))
        rightly_gone = gone - r
        delete = share(sum(rightly_gone[g] / gone[g] for g in rightly_gone), len(gone))
        new, wanted = p.keys() - s.keys(), r.keys() - s.keys()
        add = f1(share(len(new & wanted), len(new)), share(len(new & wanted), len(wanted)))
        total += (keep + delete + add) / 3
    return total / 4


def sari(source: Column, pred: Column, refs: Column) -> Column:
    """SARI from 0 to 100 of each row; ``refs`` is an array of texts. Texts are compared in lower case by their 13a words;
    one without words counts as one empty word. Null for a null text or no reference."""
    @F.pandas_udf("double")
    def run(s: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
        some = lambda w: list(w) or [""]
        known = lambda *x: all(y is not None for y in x) and len(x[2])
        return pd.Series([100 * sari_score(some(a), some(b), [some(c) for c in cs]) if known(a, b, cs) else None for a, b, cs in zip(s, p, r, strict=True)], dtype="float64")

    tokens = lambda c: F.when(c.isNotNull(), tx.tokens_13a(F.lower(c)))
    return run(tokens(source), tokens(pred), F.transform(refs, lambda c: tx.tokens_13a(F.lower(c))))


def b_cubed(df: DataFrame, mention: str, key: str, response: str) -> DataFrame:
    """(precision, recall, f1) of two clusterings of the same mentions."""
    cells = df.groupBy(F.col(key).alias("k"), F.col(response).alias("r")).agg(F.count(mention).alias("n"))
    sized = cells.select("n", F.sum("n").over(Window.partitionBy("k")).alias("nk"), F.sum("n").over(Window.partitionBy("r")).alias("nr"))
    n, all_ = F.col("n").cast("double"), F.sum("n")
    s = sized.agg((F.sum(n * n / F.col("nr")) / all_).alias("precision"), (F.sum(n * n / F.col("nk")) / all_).alias("recall"))
    return s.select("precision", "recall", f_score(F.col("precision"), F.col("recall")).alias("f1"))


def perplexity(df: DataFrame, by: str, log_prob: str) -> DataFrame:
    """(by, perplexity) from the log-probability of each token."""
    return df.groupBy(by).agg(F.exp(-F.avg(log_prob)).alias("perplexity"))


def unsupported(name: str) -> None:
    """Metrics that need a neural scorer, an outside program or running untrusted code have no native form."""
    raise NotImplementedError(f"{name} needs a model or program of its own; pass its scores to the aggregates here")


def smoothed_bleu(matches: DataFrame, lengths: DataFrame, most: int = 4, smooth: str = "exp", value: float = 0.0) -> DataFrame:
    """(bleu) from 0 to 100 with smoothing: ``exp`` halves a missing order's precision each time, ``floor`` puts
    ``value`` for no matches, ``add-k`` adds ``value`` to both counts above order 1, ``none`` gives 0."""
    o = matches.groupBy("n").agg(F.sum("matches").alias("m"), F.sum("pred_total").alias("t"))
    missing = F.sum((F.col("m") == 0).cast("int")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m, t = F.col("m").cast("double"), F.col("t").cast("double")
    if smooth == "exp":
        p = F.when(m > 0, m / t).otherwise(1.0 / (F.pow(F.lit(2.0), missing) * t))
    elif smooth == "floor":
        p = F.when(m > 0, m).otherwise(F.lit(value)) / t
    elif smooth == "add-k":
        p = F.when(F.col("n") > 1, (m + value) / (t + value)).otherwise(m / t)
    elif smooth == "none":
        p = m / t
    else:
        raise ValueError(f"unknown smoothing {smooth}")
    logs = o.where("t > 0").select(F.when(p > 0, F.log(p)).alias("l")).agg(F.sum("l").alias("s"), F.count("l").alias("k"))
    size = lengths.agg(F.sum("pred_length").alias("c"), F.sum("ref_length").alias("r"))
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide("r", "c")))
    return logs.crossJoin(size).select(F.when(F.col("k") < most, 0.0).otherwise(100 * brevity * F.exp(F.col("s") / most)).alias("bleu"))


def nist(df: DataFrame, id_col: str, pred: Column, ref: Column, most: int = 5) -> DataFrame:
    """(nist): n-gram matches weighted by their information in all references, summed over orders, with the length
    penalty that is 0.5 at two thirds of the reference length.

    Only n-grams that some row has on both sides take part in the sum, and so does what is before their last word, which
    matches too. They are found within the rows first. Those of the references are then counted in all references, as far
    as a bit table lets them pass; one that passes by a clash has no match and adds nothing.
    """
    rows = df.select(F.coalesce(pred, F.array().cast("array<string>")).alias("__p"), F.coalesce(ref, F.array().cast("array<string>")).alias("__r"))
    sums = rows.mapInArrow(lambda batches: _nist_matches(batches, most), "n int, g string, a bigint, b bigint").groupBy("n", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = cut(sums)
    matched = found.where("g is not null")
    size = min(MATCH_BITS, 1 << max(15, (64 * matched.count()).bit_length()))
    bits = _bit_table(matched, size)
    counts = rows.select("__r").mapInArrow(lambda batches: _nist_counts(batches, most, bits, size), "n int, g string, c bigint").groupBy("n", "g").agg(F.sum("c").alias("c"))
    both = matched.join(counts, ["n", "g"]).select("n", "a", "b", F.log2(F.col("c").cast("double")).alias("l"))
    value = lambda k: F.coalesce(F.sum(F.when(F.col("n") == k, -F.col("a") * F.col("l")).when(F.col("n") == k - 1, F.col("b") * F.col("l"))), F.lit(0.0))
    values = both.agg(*[value(k).alias(f"v{k}") for k in range(1, most + 1)])
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("g").isNull() & (F.col("n") == k), F.col(c))), F.lit(0))
    hits = F.coalesce(F.sum(F.when(F.col("g").isNotNull() & (F.col("n") == 1), F.col("a"))), F.lit(0))
    totals = found.agg(of(0, "a").alias("c"), of(0, "b").alias("r"), hits.alias("hits"), *[of(k, "a").alias(f"t{k}") for k in range(1, most + 1)])
    share = lambda k: (F.col(f"v{k}") + (F.col("hits") * F.log2(F.greatest("r", F.lit(1)).cast("double")) if k == 1 else 0.0)) / F.col(f"t{k}")
    score = reduce(lambda x, y: x + y, [F.when(F.col(f"t{k}") > 0, share(k)).otherwise(0.0) for k in range(1, most + 1)])
    ratio = F.least(F.lit(1.0), F.try_divide("c", "r"))
    beta = F.lit(math.log(0.5) / math.log(1.5) ** 2)
    penalty = F.when(ratio > 0, F.exp(beta * F.pow(F.log(ratio), F.lit(2)))).otherwise(0.0)
    return totals.crossJoin(F.broadcast(values)).select(F.when(F.col("t1") > 0, score * penalty).alias("nist"))


#: Most bits of the table of n-grams that match; 8 MB. A fuller table lets more n-grams pass, no fewer.
MATCH_BITS = 1 << 26
#: Words whose n-grams are added up in memory before they leave a task.
_WORDS_AT_ONCE = 1 << 20


def _bit_table(grams: DataFrame, size: int) -> bytearray:
    """A bit for each n-gram, by its checksum."""
    place = F.crc32(F.col("g").cast("binary")).bitwiseAND(F.lit(size - 1)) + 1  # places of the bitmap functions begin at 1
    words = grams.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("i")).groupBy("k").agg(F.bitmap_construct_agg("i").alias("m"))
    table = bytearray(size // 8)
    for r in words.toLocalIterator():
        at = (r["k"] - 1) * len(r["m"])
        table[at : at + len(r["m"])] = r["m"]
    return table


def _at(places: list[int], words: list[str], n: int) -> list[tuple[int, str]]:
    """The n-grams at ``places`` that aren't cut off by the end."""
    last = len(words) - n
    return [(i, " ".join(words[i : i + n])) for i in places if i <= last]


def _nist_matches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(n, g, a, b): matches of an n-gram and those of n-grams with one word more that begin with it; with a null n-gram
    at n the n-grams of order n in texts, and at 0 the words of texts and of references."""
    schema = pa.schema([("n", pa.int32()), ("g", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    sums: dict[tuple[int, str | None], list[int]] = {}

    def add(n: int, g: str | None, a: int, b: int) -> None:
        have = sums.setdefault((n, g), [0, 0])
        have[0] += a
        have[1] += b

    def flush() -> pa.RecordBatch:
        rows = [(n, g, a, b) for (n, g), (a, b) in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for p, r in zip(batch.column("__p"), batch.column("__r"), strict=True):
            p, r = p.as_py(), r.as_py()
            add(0, None, len(p), len(r))
            for n in range(1, min(most, len(p)) + 1):
                add(n, None, len(p) - n + 1, 0)
            mine, theirs = list(range(len(p))), list(range(len(r)))
            for n in range(1, most + 1):
                own, other = _at(mine, p, n), _at(theirs, r, n)
                have, wanted = Counter(g for _, g in own), Counter(g for _, g in other)
                common = have & wanted
                for g, c in common.items():
                    add(n, g, c, 0)
                    if n > 1:
                        add(n - 1, g.rpartition(" ")[0], 0, c)
                # A longer n-gram matches only where the one it begins with does.
                mine, theirs = [i for i, g in own if g in common], [i for i, g in other if g in common]
                if not mine:
                    break
            if len(sums) > _WORDS_AT_ONCE:
                yield flush()
    if sums:
        yield flush()


def _nist_counts(batches: Iterator[pa.RecordBatch], most: int, bits: bytearray, size: int) -> Iterator[pa.RecordBatch]:
    """(n, g, c): how often the n-grams with a bit in the table are in the references."""
    schema = pa.schema([("n", pa.int32()), ("g", pa.string()), ("c", pa.int64())])
    sums: Counter[tuple[int, str]] = Counter()
    known: dict[str, bool] = {}

    def has(g: str) -> bool:
        place = crc32(g.encode()) & (size - 1)
        return bits[place >> 3] >> (place & 7) & 1 == 1

    def has_word(w: str) -> bool:
        if w not in known:
            if len(known) >= _WORDS_AT_ONCE:
                known.clear()
            known[w] = has(w)
        return known[w]

    def flush() -> pa.RecordBatch:
        rows = [(n, g, c) for (n, g), c in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for r in batch.column("__r"):
            r = r.as_py()
            places = [i for i, w in enumerate(r) if has_word(w)]
            sums.update((1, r[i]) for i in places)
            for n in range(2, most + 1):
                passed = [(i, g) for i, g in _at(places, r, n) if has(g)]
                sums.update((n, g) for _, g in passed)
                places = [i for i, _ in passed]
            if len(sums) > _WORDS_AT_ONCE:
                yield flush()
    if sums:
        yield flush()


def word_alignment_score(pred: Column, ref: Column, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> Column:
    """The exact-match stage of METEOR: weighted harmonic mean of unigram precision and recall, less a share for breaks
    in the order of the matched words. Stems and synonyms need resources of their own and aren't used."""
    @F.pandas_udf("double")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(p, r, strict=True):
            left: dict[str, list[int]] = {}
            for j, w in enumerate(y):
                left.setdefault(w, []).append(j)
            at = [left[w].pop(0) if left.get(w) else None for w in x]
            hits = [j for j in at if j is not None]
            if not hits:
                out.append(0.0)
                continue
            chunks = sum(1 for k, j in enumerate(at) if j is not None and (k == 0 or at[k - 1] is None or at[k - 1] != j - 1))
            pr, rc = len(hits) / len(x), len(hits) / len(y)
            out.append((pr * rc / (alpha * pr + (1 - alpha) * rc)) * (1 - gamma * (chunks / len(hits)) ** beta))
        return pd.Series(out)

    return run(tx.words(F.lower(pred)), tx.words(F.lower(ref)))


def muc(df: DataFrame, mention: str, key: str, response: str) -> DataFrame:
    """(precision, recall, f1) by links: a cluster of m mentions that the other side cuts into k parts keeps m - k of
    its m - 1 links."""
    def side(a: str, b: str) -> DataFrame:
        per = df.groupBy(F.col(a).alias("c")).agg(F.count(mention).alias("m"), F.count_distinct(b).alias("k"))
        return per.agg(F.sum(F.col("m") - F.col("k")).alias("hit"), F.sum(F.col("m") - 1).alias("all"))

    r = side(key, response).select(F.when(F.col("all") > 0, F.col("hit") / F.col("all")).otherwise(0.0).alias("recall"))
    p = side(response, key).select(F.when(F.col("all") > 0, F.col("hit") / F.col("all")).otherwise(0.0).alias("precision"))
    return p.crossJoin(r).select("precision", "recall", f_score(F.col("precision"), F.col("recall")).alias("f1"))


def answer_curve(df: DataFrame, score: str, correct: str, answers: int | None = None) -> DataFrame:
    """(aupr, p_at_80, p_at_90): area under precision and recall of scored answers with precisions raised to the best at
    a higher recall, by the trapezoid rule, and precision at two recalls. Null without a correct answer."""
    steps = df.groupBy(F.col(score).alias("s")).agg(F.count_if(correct).alias("c"), F.count(F.lit(1)).alias("n"))
    run = running_totals(steps, [], "s", {"c": "cc", "n": "cn"}, descending=True)
    total = df.agg(F.count_if(correct).alias("total") if answers is None else F.lit(answers).alias("total"))
    raw = run.crossJoin(F.broadcast(total)).withColumn("raw", F.col("cc") / F.col("cn"))
    best = running_totals(raw, [], "s", {"raw": "p"}, how="max")
    # What stands before a score in order of falling scores comes from the running sums without the score's own rows.
    first = F.col("cn") == F.col("n")
    before = F.when(first, 1.0).otherwise(F.greatest(F.try_divide(F.col("cc") - F.col("c"), F.col("cn") - F.col("n")), F.col("p")))
    cut = best.select(F.try_divide("cc", "total").alias("r"), "p", (F.try_divide("c", "total") * (F.col("p") + before) / 2).alias("a"))
    at = lambda x: F.coalesce(F.max(F.when(F.col("r") >= x, F.col("p"))), F.lit(0.0))
    return cut.agg(F.sum("a").alias("aupr"), at(0.8).alias("p_at_80"), at(0.9).alias("p_at_90"))


def same_expression(a: Column, b: Column) -> Column:
    """Whether two short formulas are the same once spaces, outer dollars and boxes, and leading zeros are set aside."""
    def plain(c: Column) -> Column:
        t = F.regexp_replace(F.lower(c), r"[\s$]|\\left|\\right|\\!|\\,", "")
        t = F.regexp_replace(t, r"^\\boxed\{(.*)\}$", "$1")
        for form in ("\\dfrac", "\\tfrac"):
            t = F.replace(t, F.lit(form), F.lit("\\frac"))
        return F.regexp_replace(t, r"(^|[^0-9])0+(?=\.)", "$1")

    return plain(a) == plain(b)


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def edits_with_shifts(pred: list[str], ref: list[str], longest: int = 10) -> int:
    """Word edits that turn ``pred`` into ``ref``, where moving a run of words costs one: the move that saves most is
    made first, as long as one saves more than it costs. Runs that move are of at most ``longest`` words."""
    words, moves, cost = list(pred), 0, _distance(pred, ref)
    while cost:
        best: tuple[int, list[str]] = (cost - 1, words)
        for i in range(len(words)):
            for n in range(1, min(longest, len(words) - i) + 1):
                run = words[i : i + n]
                places = [j for j in range(len(ref) - n + 1) if ref[j : j + n] == run]
                if not places:
                    break
                rest = words[:i] + words[i + n :]
                for j in places:
                    moved = rest[:j] + run + rest[j:]
                    d = _distance(moved, ref) if moved != words else cost
                    if d < best[0]:
                        best = (d, moved)
        if best[1] is words:
            break
        cost, words, moves = best[0], best[1], moves + 1
    return cost + moves


def ter(df: DataFrame, pred: Column, ref: Column) -> DataFrame:
    """(ter): edits with shifts over the words of all references. For short texts: a row's work grows fast with it."""
    @F.pandas_udf("int")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([edits_with_shifts(list(x), list(y)) for x, y in zip(p, r, strict=True)], dtype="int32")

    p, r = tx.words(F.lower(pred)), tx.words(F.lower(ref))
    return df.select(run(p, r).alias("e"), F.size(r).alias("n")).agg(F.try_divide(F.sum("e"), F.sum("n")).alias("ter"))


def lea(df: DataFrame, mention: str, key: str, response: str) -> DataFrame:
    """(precision, recall, f1) of clusters by their links, weighted by their mentions; a single mention has one link, to
    itself, and keeps it if it is single on the other side."""
    cells = df.groupBy(F.col(key).alias("k"), F.col(response).alias("r")).agg(F.count(mention).alias("n"))
    sized = cells.select("k", "r", "n", F.sum("n").over(Window.partitionBy("k")).alias("nk"), F.sum("n").over(Window.partitionBy("r")).alias("nr"))
    links = lambda n: n * (n - 1) / 2

    def side(own: str, other: str) -> Column:
        kept = F.when(F.col(own) == 1, (F.col(other) == 1).cast("double")).otherwise(links(F.col("n")) / links(F.col(own)))
        return F.sum(kept * F.col(own)) / F.sum("n")

    s = sized.agg(side("nr", "nk").alias("precision"), side("nk", "nr").alias("recall"))
    return s.select("precision", "recall", f_score(F.col("precision"), F.col("recall")).alias("f1"))
