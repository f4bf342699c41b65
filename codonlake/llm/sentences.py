"""Sentence boundaries across languages and scripts.

Every document comes out as its sentences, each with its place in the text in code points. A blank line always ends a
sentence, a single line break is a space. Nothing is cut inside quotation marks or brackets that close in the same
paragraph; closing marks belong to the sentence they end, and a number or mark that opens a list item or heading to it.

Method: document-centred disambiguation. Whether a period ends a sentence depends on what stands before it
(abbreviation, initial, ordinal or plain word) and on whether what follows begins a sentence. Both are taken from the
unambiguous occurrences of the same words elsewhere in the document: a word is an abbreviation if the document has it
with a period before a lower-case word, digit or comma, and a plain word if it has it without; a word begins sentences
if it opens a paragraph, and a capitalised word is no name if the document has it in lower case. Where the document is
silent, counts of the same evidence over all documents decide, then a short list of common abbreviations (``BEFORE``),
which alone knows those with periods inside. Abbreviations that may also end a sentence have a list of their own
(``AFTER``): what follows decides after them. Scripts bring their own terminators: ideographic stops, danda, Arabic and
Greek question marks, and in Thai the spaces between words.

What follows an abbreviation begins a sentence only if it is known to begin sentences and is no name: a capitalised word
that neither the document nor any other has in lower case is taken for a name.

The counts over all documents are combined before they are shuffled. An entry is used from LEAST uses on and by the ratio
of its uses, never by its part of the corpus, so more documents don't weaken what is known. The entries are a table. Up
to MODEL_ROWS of them (counted) go to every task; if there are more, each text asks for the words it may need
(``questions``), and the answers come by a join. Both ways give the same sentences.

An abbreviation has at most SHORT letters by definition. Keys and words beyond LONGEST letters are known by a 128-bit hash.

Defined results: a null, empty or blank text has no sentences; a null identifier is kept. Repeated rows are split each
on its own. A paragraph without a terminator is one sentence. Columns beside those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm.blocking import joined_rows
from codonlake.session import cut, small_enough

#: Entries of the model that go to every task, at most.
MODEL_ROWS = 200_000
#: Evidence an entry needs at least.
LEAST = 2
#: Letters of a word that may be an abbreviation, and of a word that is known by its letters.
SHORT, LONGEST = 6, 64

# Abbreviations that stand before a name, number or example, and those that may end a sentence.
BEFORE = frozenset(
    "ee dr prof mr mrs ms mme mlle m st sr sra srta dra hr fr vs cf fig figs sec eq ref no nr vol pp ed eds art ch chap cap abb tab vgl bzw siehe "
    "approx ca env aprox pos max min núm pág p e.g i.e z.b d.h u.a s.d p.ex p.ej c.-à-d c.à.d gen col lt capt rev hon gov sen rep mt feb jan "
    "проф д-р г-н см рис табл т.е т.к стр гл δρ κ κα π.χ βλ εικ πίν".split()
)
AFTER = frozenset("etc al co inc ltd corp jr usw uu p.m a.m u.s u.k u.s.a κ.λπ κλπ т.д т.п др ฯลฯ".split())
#: The forms in which words of BEFORE stand without a period, alone or with a mark after.
_LISTED = {form + mark: form for w in BEFORE if "." not in w for form in (w, w.capitalize(), w.upper()) for mark in ("", *",;:?!")}
_BREAK = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_TERM = re.compile(r"[.!?…。！？｡．؟۔।॥;;|]+")
_MARK = re.compile(r"""[()\[\]{}"“”„‟‘’«»「」『』（）【】《》〈〉]""")
_OPEN = {"(": ")", "[": ")", "{": ")", "“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_BRACKETS = {")": "([{", "]": "([{", "}": "([{", "）": "（", "】": "【"}
_CLOSERS = "”’»」』）】》〉\")]}“"
_QUOTES_OPEN = "“‘«„\"「『（(["
_LIST = re.compile(r"(?:[(\[]?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)\]]|[-–—•*·▪◦‣#>§]+)\s+")
_MARKER_ONLY = re.compile(r"\s*[(\[]?(?:\d{1,3}|[ivxIVX]{1,5})\s*$")
_BEFORE_DOT = re.compile(r"[^\s()\[\]{}\"“”„«»‘。！？，、：；「」『』（）/…]+$")
_WORD = re.compile(r"[^\W\d_]+(?:[.\-’'][^\W_]+)*", re.UNICODE)
_CJK = re.compile(r"[　-ヿ㐀-鿿豈-﫿＀-￯]")
_THAI = re.compile(r"[ก-ฮ]")
_THAI_GAP = re.compile(r"(?<=[ก-ๅ็-๎])\s+(?=[ก-ฮเ-ไ])(?!\S\.)")
_GREEK = re.compile(r"[Ͱ-ͽͿ-Ͽἀ-῿]")
_DEVANAGARI = re.compile(r"[ऀ-ॣ०-ॿ]")
_KEY_END = re.compile(r"[\s,;:!?…。！？，、：；\"”»」』]")
_INITIAL = re.compile(r"[^\W\d_]\.\s")
_SPACED_INITIAL = re.compile(r"(\w)\.\s?\w$")
_NO_PERIODS = re.compile(r"[฀-๿ऀ-ॿ]$")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,2}\.-?)+[^\W\d_]{1,2}$")
_EDGES = "()[]{}\"“”„‟‘’'«»「」『』，。、,;:!?…¿¡"
#: Characters of a text from which on its abbreviations are found in one pass, which gives the same.
_LONG = 1 << 17
#: Characters within which a space is looked for before a word is walked back over.
_NEAR = 40
_WORD_END, _HYPHENED_END = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+$")
_DOTTED_RUN = re.compile(r"(?:[^\W\d_]{1,2}\.-?)+")
_WORD_EDGE = re.compile(r"[\s()\[\]{}\"“”„«»‘。！？，、：；「」『』（）/…]")
_AFTER_USE = re.compile(r"([,;:])|(?=\s)[^\S\r\n]*(?:\r\n|\n|\r)?[^\S\r\n]*(\S+)")
_PERIOD = re.compile(r"\.(?:(?=([,;:]))|(?=\s)[^\S\r\n]*(?:\r\n|\n|\r)?[^\S\r\n]*(?=(\S+)))")


@dataclass
class Model:
    """What all documents tell: abbreviations, keys that open sentences, words known in lower case, listed words used
    as plain words more often than with a period."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    lower: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()


def entry(word: str) -> str:
    """What a word is known by in the model."""
    return word if len(word) <= LONGEST else "\0" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class _Document:
    """The evidence of one document, found when it is first asked for, with the model of all."""

    def __init__(self, model: Model, text: str):
        self.model, self.text = model, text
        self.places = list(paragraphs(text))
        self.starters = {key_at(text, after_list_mark(text, a, b), b) for a, b in self.places}
        self.thai = bool(_THAI.search(text))
        self._used: dict[str, bool] = {}
        self._all: set[str] | None = None
        self._plain: set[str] | None = None
        self._bare: set[str] | None = None

    def used_as_abbreviation(self, word: str) -> bool:
        """Whether a use of the word with a period here ends no sentence. A word before one that begins sentences is no
        abbreviation for it."""
        if len(self.text) > _LONG:
            if self._all is None:
                self._all = {w for w, f in abbreviation_uses(self.text) if not (f and self.starts(f))}
            return word in self._all
        if word not in self._used:
            text, look, found = self.text, word + ".", False
            at = text.find(look)
            while at >= 0 and not found:
                if at == 0 or text[at - 1].isspace() or text[at - 1] in _EDGES:
                    m = _AFTER_USE.match(text, at + len(look))
                    if m:
                        token = m.group(2)
                        found = _following(m.group(1) or token) and not (token and self.starts(token.rstrip("." + _EDGES)))
                at = text.find(look, at + 1)
            self._used[word] = found
        return self._used[word]

    @property
    def plain(self) -> set[str]:
        """Words that stand here without a period."""
        if self._plain is None:
            self._plain = {t.strip(_EDGES) for t in self.text.split()}
        return self._plain

    def starts(self, key: str) -> bool:
        return bool(key) and (key in self.starters or entry(key) in self.model.starters)

    def begins(self, key: str) -> bool:
        """Whether a sentence begins with the key after an abbreviation: it is known to begin sentences and is no name."""
        return self.starts(key) and not (key[0].isupper() and len(key) > 1 and not self.common(key))

    def abbreviation(self, word: str) -> bool:
        if not (word.isalpha() and len(word) <= SHORT):
            return False
        return self.used_as_abbreviation(word) or (word in self.model.abbreviations and word not in self.plain)

    def listed(self, word: str) -> bool | None:
        """Whether a listed word is an abbreviation by the evidence of this document, else of all; None if both are
        silent."""
        if self.used_as_abbreviation(word):
            return True
        if self._bare is None:
            self._bare = set(plain_uses(self.text.split()))
        if word in self._bare:
            return False
        if word in self.model.abbreviations:
            return True
        return False if word in self.model.plain else None

    def common(self, word: str) -> bool:
        low = word.lower()
        return low != word and (low in self.plain or entry(low) in self.model.lower)


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Places between blank lines, without white space at either end."""
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.strip():
            yield at + len(part) - len(part.lstrip()), at + len(part.rstrip())
        at = m.end() if m else end


def key_at(text: str, at: int, end: int) -> str:
    """What tells whether a sentence begins at ``at``: its first word, or two characters of a script without spaces."""
    if at >= end:
        return ""
    if _CJK.match(text, at) or (text[at] in "“‘" and at + 1 < end and _CJK.match(text, at + 1)):
        return text[at : min(end, at + 2)]
    while at < end and text[at] in _QUOTES_OPEN:
        at += 1
    m = _KEY_END.search(text, at, end)
    stop = m.start() if m else end
    cjk = _CJK.search(text, at, stop)
    if cjk:
        return text[at : cjk.start() + 1]
    return text[at:stop].rstrip(".")


def after_list_mark(text: str, at: int, end: int) -> int:
    m = _LIST.match(text, at, end)
    return m.end() if m else at


def abbreviation_uses(text: str) -> Iterator[tuple[str, str]]:
    """Each use of a short word with a period that ends no sentence, and the word after it ("" if a mark follows)."""
    for m in _PERIOD.finditer(text):
        if m.group(1) is None and not _following(m.group(2)):
            continue
        p = k = m.start()
        while k and p - k <= SHORT and text[k - 1].isalpha():
            k -= 1
        if 0 < p - k <= SHORT and (k == 0 or text[k - 1].isspace() or text[k - 1] in _EDGES):
            yield text[k:p], (m.group(2) or "").rstrip("." + _EDGES)


def plain_uses(tokens: list[str]) -> Iterator[str]:
    """Each use of a listed word as a plain word: without a period, before a mark or a word in lower case. A name or number
    after it would not tell, as some write "Dr Name" and "Fig 3"."""
    if _LISTED.keys().isdisjoint(tokens):
        return
    for i in [i for i, t in enumerate(tokens) if t in _LISTED]:
        word = _LISTED[tokens[i]]
        if tokens[i] != word or (i + 1 < len(tokens) and tokens[i + 1][0].islower()):
            yield word


def _following(use: str) -> bool:
    """Whether what follows a period shows that it ends no sentence."""
    c = use[:1]
    return c in (",", ";", ":") or c.islower() or c.isdigit()


def _enclosed(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotation marks and brackets, as places of the two marks."""
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()
    pairs: list[tuple[int, int]] = []

    def open_(mark: str, place: int) -> None:
        stack.append((mark, place))
        waiting[mark] += 1

    def close(openers: str, place: int) -> bool:
        if not any(waiting[x] for x in openers):
            return False
        while True:  # what is opened within and not closed is no pair
            mark, at_ = stack.pop()
            waiting[mark] -= 1
            if mark in openers:
                pairs.append((at_, place))
                return True

    for m in _MARK.finditer(text, at, end):
        c, p = m.group(), m.start()
        if c == '"':
            if not close('"', p):
                open_(c, p)
        elif c in _BRACKETS:
            close(_BRACKETS[c], p)
        elif c in "“”":
            if close("„" if c == "“" else "“„", p):
                continue
            if c == "“":
                open_(c, p)
        elif c == "„":
            open_(c, p)
        elif c == "’":
            if not (p + 1 < end and text[p + 1].isalnum() and text[p + 1].isascii()):
                close("‘", p)
        elif c in "»」』》〉":
            close({"»": "«", "」": "「", "』": "『", "》": "《", "〉": "〈"}[c], p)
        elif c in _OPEN:
            open_(c, p)
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


_REGULAR, _FOREIGN, _LETTER, _MAY_END, _STANDS_BEFORE, _WITH_PERIODS, _NUMBER = range(7)


@lru_cache(1 << 16)
def _word_class(before: str) -> tuple[int, str]:
    """What kind of word ``before`` ends with, and the word."""
    m = _BEFORE_DOT.search(before)
    word = m.group() if m else ""
    cjk = [x.end() for x in _CJK.finditer(word)]
    bare = (word[cjk[-1] :] if cjk else word).lstrip("'’-–¿¡")
    low = bare.lower()
    if _NO_PERIODS.search(bare):
        return _FOREIGN, bare
    if len(bare) == 1 and bare.isalpha():
        return _LETTER, bare
    last = low if "." in low else low.rsplit("-", 1)[-1]
    if low in AFTER or last in AFTER:
        return _MAY_END, bare
    if low in BEFORE or last in BEFORE:
        return _STANDS_BEFORE, bare
    if _DOTTED.match(low):
        return _WITH_PERIODS, bare
    return _NUMBER if bare.isdigit() else _REGULAR, bare


@lru_cache(1 << 12)
def _run_class(run: str) -> str:
    """The terminator that decides for a run of them."""
    for kind, marks in (("。", "。！？｡"), ("．", "．"), ("。", "।॥"), ("|", "|"), (";", ";;"), ("?", "!?؟")):
        if any(x in marks for x in run):
            return kind
    return "…" if len(run) > 1 or "…" in run else "."


class _Paragraph:
    def __init__(self, text: str, at: int, end: int, doc: _Document):
        self.text, self.at, self.end, self.doc = text, at, end, doc
        self.pairs = _enclosed(text, at, end)
        self.opened = {a for a, _ in self.pairs}
        self.greek = self.devanagari = None
        self._links: tuple[list[int], list[int]] | None = None
        self._word, self._dotted = (at, at), (-1, -1)

    def next_place(self, p: int) -> int:
        text, end = self.text, self.end
        if p + 1 < end and text[p] == " " and text[p + 1] > " ":
            p += 1
        while p < end and text[p].isspace():
            p += 1
        return p

    def opens(self, p: int, spaced: bool) -> bool | None:
        """Whether what stands at ``p`` looks like the beginning of a sentence; None if its script can't tell."""
        text, q = self.text, p
        while q < self.end and text[q] in _QUOTES_OPEN + "¿¡":
            if text[q] in "¿¡":
                return True
            q += 1
        if q >= self.end:
            return True
        c = text[q]
        if c.isupper():
            return True
        if c.islower():
            return spaced and self.doc.starts(key_at(text, p, self.end))
        if c.isdigit():
            return spaced
        if c.isalpha() or _DEVANAGARI.match(c):
            return None
        return spaced

    def in_link(self, start: int, p: int) -> bool:
        if self._links is None:
            runs = [m.span() for m in re.finditer(r"://\S*", self.text[self.at : self.end])]
            self._links = [a + self.at for a, _ in runs], [b + self.at for _, b in runs]
        k = bisect_left(self._links[0], p) - 1
        return k >= 0 and self._links[0][k] >= start and self._links[1][k] >= p

    def word_before(self, start: int, p: int) -> tuple[int, str]:
        """``_word_class`` of the word that ends at ``p``, in steps that don't grow with the word."""
        text, low = self.text, max(start, p - _NEAR)
        space = text.rfind(" ", low, p)
        if space >= 0 or low == start:
            return _word_class(text[space + 1 if space >= 0 else low : p])
        since, known = self._word
        stop, k = known if start <= known <= p else start, p
        while k > stop and not (_WORD_EDGE.match(text, k - 1) or _CJK.match(text, k - 1)):
            k -= 1
        first = max(start, since) if k == stop == known else k
        self._word = first, p
        while first < p and text[first] in "'’-–¿¡":
            first += 1
        if p - first <= LONGEST:
            return _word_class(text[first:p])
        return self.long_word(first, p)

    def long_word(self, first: int, p: int) -> tuple[int, str]:
        """The class of a word longer than any that is listed or an abbreviation."""
        text, tail = self.text, self.text[p - LONGEST : p]
        if _NO_PERIODS.search(tail):
            return _FOREIGN, tail
        if text.find(".", first, p) < 0:
            last = tail.rsplit("-", 1)[-1] if "-" in tail else ""
            if last.lower() in AFTER:
                return _MAY_END, last
            if last.lower() in BEFORE:
                return _STANDS_BEFORE, last
            return _NUMBER if text[first].isdigit() and text[first:p].isdigit() else _REGULAR, tail
        if self._dotted[0] != first:
            m = _DOTTED_RUN.match(text, first, self.end)
            self._dotted = first, m.end() if m else first
        return _WITH_PERIODS if p < self._dotted[1] else _REGULAR, tail

    def after_inner(self, mark: int, p: int) -> bool:
        """Whether a quotation that ends with a terminator, closed before ``p``, ends the sentence."""
        text, n = self.text, self.next_place(p)
        if n >= self.end:
            return True
        spaced = n > p
        wide = bool(_CJK.match(text[mark])) or (mark > 0 and text[mark - 1] in "。！？｡．")
        opens = None if wide else self.opens(n, spaced)
        if opens is None:
            return (wide or spaced) and self.doc.starts(key_at(text, n, self.end))
        return opens

    def inner(self, a: int, b: int, start: int) -> int | None:
        """The end of the sentence that the pair (a, b) ends from within, if it does."""
        text, k = self.text, b - 1
        while k > a and text[k].isspace():
            k -= 1
        if k <= a or text[k] not in ".!?…。！？｡．؟।॥":
            return None
        if text[b] in _BRACKETS and self.next_place(start) != a:
            return None
        return b + 1 if self.after_inner(b, b + 1) else None

    def after_listed(self, abbreviation: bool, n: int, spaced: bool, opens: bool | None) -> bool:
        """Whether a sentence ends with a listed word that evidence shows to be an abbreviation or a plain word."""
        if not abbreviation:
            return spaced if opens is None else opens
        c = self.text[n]
        return spaced and c not in "([（" and not c.isdigit() and opens is True and self.doc.begins(key_at(self.text, n, self.end))

    def period(self, start: int, p: int, q: int, n: int) -> bool:
        """Whether the period at ``p`` ends the sentence that began at ``start``; the next text stands at ``n``."""
        text, doc = self.text, self.doc
        if p - start < 8 and _MARKER_ONLY.match(text, start, p):
            return False
        spaced, c = n > q, text[n]
        if not spaced and (c.islower() or c.isdigit() or not (c.isalpha() or c in _QUOTES_OPEN + "¿¡")):
            return False
        if not spaced and self.in_link(start, p):
            return False
        kind, bare = self.word_before(start, p)
        if kind == _FOREIGN:
            return False
        opens = self.opens(n, spaced)
        if kind == _LETTER:
            twice = _SPACED_INITIAL.search(text, max(start, p - 4), p)
            pair = f"{twice.group(1).lower()}.{bare.lower()}" if twice else ""
            if pair in AFTER:
                return opens is True
            known = doc.listed(bare) if spaced and pair not in BEFORE and bare.lower() in BEFORE else None
            if known is not None and not bare.isupper():
                return self.after_listed(known, n, spaced, opens)
            if not spaced or pair in BEFORE or (bare.lower() in BEFORE and known is None) or not bare.isupper():
                return False
            key = key_at(text, n, self.end)
            return opens is True and c.isupper() and len(key) > 1 and doc.common(key) and doc.starts(key)
        if kind == _MAY_END:
            if c in "([（" or (c.isdigit() and spaced):
                return False
            return opens is True or (opens is None and doc.starts(key_at(text, n, self.end)))
        if kind == _STANDS_BEFORE:
            known = doc.listed(bare if bare.lower() in BEFORE else bare.rsplit("-", 1)[-1]) if "." not in bare else None
            return known is not None and self.after_listed(known, n, spaced, opens)
        if kind == _WITH_PERIODS:
            return spaced and opens is True and doc.begins(key_at(text, n, self.end))
        if kind == _NUMBER and spaced and c.isalpha() and not _INITIAL.match(text, n, self.end):
            return opens is not False and doc.starts(key_at(text, n, self.end))
        if doc.abbreviation(bare):
            return spaced and c not in "([（" and not c.isdigit() and opens is True and doc.begins(key_at(text, n, self.end))
        if not spaced and len(bare) < 2 and not (p > start and text[p - 1] in _CLOSERS):
            return False
        return spaced if opens is None else opens

    def ends(self, start: int, p: int, q: int) -> bool:
        """Whether the terminators from ``p`` to before ``q`` end the sentence that began at ``start``."""
        text = self.text
        n = self.next_place(q)
        if n >= self.end:
            return True
        if q - p == 1 and text[p] == ".":
            return self.period(start, p, q, n)
        kind = _run_class(text[p:q])
        spaced, c = n > q, text[n]
        if kind == "。":
            return True
        if kind == "．":
            return not (c.isdigit() and not spaced)
        if kind == "|":
            if self.devanagari is None:
                self.devanagari = bool(_DEVANAGARI.search(text, self.at, self.end))
            return self.devanagari and q - p == 1 and spaced and bool(_DEVANAGARI.search(text, start, p))
        if kind == ";":
            if self.greek is None:
                self.greek = bool(_GREEK.search(text, self.at, self.end))
            return self.greek and q - p == 1 and bool(_GREEK.search(text, start, p)) and (c.isupper() or spaced)
        if kind == "?":
            if not spaced and (c.islower() or c.isdigit() or not (c.isalpha() or c in _QUOTES_OPEN + "¿¡")):
                return False
            if not spaced and self.in_link(start, p):
                return False
            opens = self.opens(n, spaced)
            return True if opens is None else opens
        if kind == "…":
            if p > start and text[p - 1].isspace():
                return False
            opens = self.opens(n, spaced)
            return self.doc.starts(key_at(text, n, self.end)) if opens is None or not spaced else opens
        return self.period(start, p, q, n)

    def closers(self, q: int) -> int:
        """The place behind closing marks at ``q``."""
        text = self.text
        while q < self.end and text[q] in _CLOSERS and q not in self.opened:
            q += 1
        return q

    def marks(self) -> list[tuple[int, int, int, bool]]:
        """Places where a sentence may end, in order: (place, first, behind, whether it is a closing pair); behind is -1
        for a space between Thai words."""
        text, pairs, k = self.text, self.pairs, 0
        runs = [m.span() for m in _TERM.finditer(text, self.at, self.end)]
        if not pairs and not self.doc.thai:
            return [(p, p, q, False) for p, q in runs]
        out = [(b, a, b, True) for a, b in pairs]
        for p, q in runs:
            while k < len(pairs) and pairs[k][1] < p:
                k += 1
            if not (k < len(pairs) and pairs[k][0] < p):
                out.append((p, p, q, False))
        if self.doc.thai:
            k = 0
            for m in _THAI_GAP.finditer(text, self.at, self.end):
                p = m.start()
                while k < len(pairs) and pairs[k][1] < p:
                    k += 1
                if not (k < len(pairs) and pairs[k][0] < p) and not text.endswith("ฯลฯ", 0, p):
                    out.append((p, p, -1, False))
        out.sort()
        return out

    def sentences(self) -> Iterator[tuple[int, int]]:
        text, start, last = self.text, self.at, self.end
        for _, p, q, pair in self.marks():
            if p < start:
                continue
            if pair:
                end = self.inner(p, q, start)
            elif q < 0:
                end = p
            elif q < last and text[q] in _CLOSERS:
                stop = self.closers(q)
                end = stop if self.ends(start, p, stop) else None
            else:
                end = q if self.ends(start, p, q) else None
            if end is not None and end > start:
                yield start, end
                start = self.next_place(end)
        if start < last:
            yield start, last


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """The places of the sentences of one text."""
    if not text:
        return []
    doc = _Document(model, text)
    return [(a, b) for at, end in doc.places for a, b in _Paragraph(text, at, end, doc).sentences()]


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word, n): the evidence of all documents. Kinds: e, short words with a period; u, those that end no sentence;
    w, words without a period; s, paragraphs that a key opens; b, listed words used as plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, Counter] = {k: Counter() for k in "uewsb"}
            seen: Counter = Counter()
            for t in b.column(0).to_pylist():
                tokens = t.split()
                seen.update(tokens)
                counts["s"].update(entry(key_at(t, after_list_mark(t, a, z), z)) for a, z in paragraphs(t))
                counts["u"].update(w for w, _ in abbreviation_uses(t))
                counts["b"].update(plain_uses(tokens))
            for token, n in seen.items():
                word = token.strip(_EDGES)
                if word.isalpha():
                    counts["w"][entry(word)] += n
                elif word[-1:] == "." and word[:-1].isalpha() and len(word) <= SHORT + 1:
                    counts["e"][word[:-1]] += n
            rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["kind", "word", "n"])

    parts = docs.where(docs[text].isNotNull()).select(docs[text].alias("text")).mapInArrow(run, "kind string, word string, n bigint")
    return parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))


_KINDS = ("abbreviation", "starter", "lower", "plain")


def corpus_entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, flags): what is known of each word from all documents; bit i of ``flags`` stands for the i-th of _KINDS."""
    by_word = corpus_counts(docs, text).groupBy("word").pivot("kind", list("uewsb")).agg(F.first("n")).na.fill(0)
    known = (
        (F.col("u") >= LEAST) & (F.col("u") >= 0.3 * F.col("e")) & (F.col("w") <= F.col("u")),
        (F.col("s") >= LEAST) & (F.col("s") >= 0.02 * F.col("w")),
        (F.col("w") >= LEAST) & (F.col("word") == F.lower("word")),
        (F.col("b") >= LEAST) & (F.col("b") > F.col("e")),
    )
    flags = sum((k.cast("int") * (1 << i) for i, k in enumerate(known)), F.lit(0))
    return by_word.where("word <> ''").select("word", flags.alias("flags")).where("flags > 0")


def model_of(entries: Iterable[tuple[str, int]]) -> Model:
    rows = list(entries)
    return Model(*(frozenset(w for w, f in rows if f >> i & 1) for i in range(len(_KINDS))))


def corpus_model(docs: DataFrame, text: str = "text") -> Model:
    """The model of all documents as a whole; for collections whose model is known to be small."""
    return model_of(corpus_entries(docs, text).collect())


def questions(text: str) -> set[str]:
    """All words about which ``split`` may ask the model, wherever its sentences begin."""
    doc = _Document(Model(), text)
    asked = {entry(f) for _, f in abbreviation_uses(text)}
    for at, end in doc.places:
        part = _Paragraph(text, at, end, doc)
        for _, p, q, pair in part.marks():
            if not pair and q > p:
                for word in (_WORD_END.search(text, max(at, p - LONGEST), p), _HYPHENED_END.search(text, max(at, p - LONGEST), p)):
                    if word:
                        asked.add(word.group())
            for behind in {q, part.closers(q), q + 1} if q >= 0 else ():
                n = part.next_place(behind)
                if n < end and (n > behind or _CJK.match(text, n) or _CJK.match(text, n - 1) or text[n - 1] == "…"):
                    key = key_at(text, n, end)
                    asked.update((entry(key), entry(key.lower())))
    return asked - {""}


def _places(ids: list, texts: list, models: Iterable[Model]) -> pa.RecordBatch:
    out: list = []
    places: list[tuple[int, int]] = []
    for i, t, m in zip(ids, texts, models, strict=False):
        got = split(t, m)
        out.extend([i] * len(got))
        places.extend(got)
    return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([a for a, _ in places], pa.int64()), pa.array([z for _, z in places], pa.int64())], ["id", "sent_start", "sent_end"])


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model_rows: int = MODEL_ROWS) -> DataFrame:
    """(id, sent_start, sent_end) of every sentence."""
    entries = cut(corpus_entries(docs, text))
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text].alias("text")).where("text is not null")
    schema = "id bigint, sent_start bigint, sent_end bigint"
    if not small_enough(entries, model_rows):
        return _with_answers(rows, entries).mapInArrow(_split_with_answers, schema)
    model = docs.sparkSession.sparkContext.broadcast(model_of(entries.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _places(b.column("id").to_pylist(), b.column("text").to_pylist(), repeat(model.value))

    return rows.mapInArrow(run, schema)


def _split_with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        models = (model_of((a["word"], a["flags"]) for a in answers) for answers in b.column("answers").to_pylist())
        yield _places(b.column("id").to_pylist(), b.column("text").to_pylist(), models)


def _with_answers(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, text, answers): each row with what the model knows of the words its text may ask for. A text asks once for all
    its copies; words that many texts ask for, and texts with many copies, are spread over several join groups."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted({"", *questions(t)}) for t in b.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words])
            keys = [pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([w for ws in words for w in ws], pa.string())], ["h1", "h2", "word"])

    keyed = rows.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    asked = cut(keyed.select("h1", "h2", "text").mapInArrow(ask, "h1 bigint, h2 bigint, word string").distinct())
    every = entries.unionByName(entries.sparkSession.createDataFrame([("", 0)], entries.schema))
    found = joined_rows(every, asked, ["word"], "flags", "h1")
    answers = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("word", "flags")).alias("answers"))
    return joined_rows(answers, keyed, ["h1", "h2"], "h1", "id").select("id", "text", "answers")
