"""Text functions for text metrics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ASCII punctuation marks that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# All white space of Unicode, and what separates words of the public ROUGE definition.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NOT_ROUGE = "[^a-z0-9]+"


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WHITE), lambda w: w != "")


def rouge_words(text: Column) -> Column:
    """Runs of the letters a to z and digits in lower case, as ROUGE compares them."""
    return words(F.regexp_replace(F.lower(text), _NOT_ROUGE, " "))


def normal_answer(text: Column) -> Column:
    """Lower case, without punctuation and the articles a, an, the, with single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def cleaned(text: Column, case: bool = True, punctuation: bool = True, digits: bool = True) -> Column:
    """For exact match: without letter case, punctuation and digits, as asked."""
    out = F.lower(text) if case else text
    out = F.translate(out, PUNCTUATION, "") if punctuation else out
    return F.translate(out, "0123456789", "") if digits else out


def tokens_13a(text: Column) -> Column:
    """Words and marks by the public 13a tokenisation of machine-translation scores."""
    # The entities and patterns of the public definition of 13a.
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<skipped>", ""), "-\n", "")
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("\n", " ")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return words(t)


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """The n-grams of an array of strings, joined."""
    last = F.size(items) - (n - 1)
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(items, i, F.lit(n)), sep))
    return F.when(last > 0, made).otherwise(F.array().cast("array<string>"))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word stands for one character beyond the first plane, of which
    there are 1,048,576; a pair with more distinct words than that is an error."""
    known = F.array_distinct(F.concat(a, b))
    code = lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")
    as_text = lambda x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(code(w)), "UTF-32")), "")
    return F.levenshtein(as_text(a), as_text(b))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tagged_span(tokens: Column, tags: Column, kind: str) -> Column:
    """The tokens from the first B- tag of a kind to the last I- tag of it (or that B- tag), joined."""
    first = F.array_position(tags, f"B-{kind}").cast("int")
    last = F.size(tags) + 1 - F.array_position(F.reverse(tags), f"I-{kind}").cast("int")
    end = F.greatest(first, F.when(F.array_contains(tags, f"I-{kind}"), last).otherwise(first))
    return F.when(first > 0, F.array_join(F.slice(tokens, first, end - first + 1), ""))
