"""Encoding token lists for models: special tokens, padding, truncation and label alignment, as array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of places that carry none.
IGNORED = -100


@dataclass(frozen=True)
class Specials:
    """Numbers of special tokens; None where a tokenizer has no such token."""

    pad: int = 0
    cls: int | None = 1
    sep: int | None = 2
    eos: int | None = None

    def frame(self) -> tuple[list[int], list[int]]:
        last = self.sep if self.sep is not None else self.eos
        return ([self.cls] if self.cls is not None else []), ([last] if last is not None else [])


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def encode(ids: Column, length: int, specials: Specials | None = None, side: str = "right") -> Column:
    """Ids between the special tokens, cut and padded to ``length``."""
    s = specials or Specials()
    before, after = s.frame()
    room = length - len(before) - len(after)
    if room < 0:
        raise ValueError("length leaves no room for the special tokens")
    body = F.concat(_numbers(before), F.slice(ids, F.lit(1), F.lit(room)).cast("array<int>"), _numbers(after))
    pad = F.array_repeat(F.lit(s.pad), F.lit(length - len(before) - len(after)) - F.least(F.size(ids), F.lit(room)))
    return F.concat(body, pad) if side == "right" else F.concat(pad, body)


def mask(ids: Column, length: int, specials: Specials | None = None, side: str = "right") -> Column:
    """1 at every place but padding."""
    before, after = (specials or Specials()).frame()
    used = F.least(F.size(ids), F.lit(length - len(before) - len(after))) + len(before) + len(after)
    ones, zeros = F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used)
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def aligned_labels(labels: Column, length: int, specials: Specials | None = None, side: str = "right") -> Column:
    """Token labels at the places of their tokens, IGNORED at special tokens and padding."""
    s = specials or Specials()
    before, after = s.frame()
    same = Specials(IGNORED, IGNORED if before else None, IGNORED if after else None)
    return encode(labels, length, same, side)


def with_separator(seq: Column, mark: str, sep_token: str) -> Column:
    """Several sequences in one field: their mark becomes the tokenizer's separator."""
    return F.replace(seq, F.lit(mark), F.lit(sep_token))
