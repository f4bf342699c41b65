"""Fast similarity sketches of letter strings, in numpy, for whole Arrow batches at a time.

The sketch of a set has ``t`` coordinates. In round i every element is hashed to a bin and a value, and a bin keeps the
least value it gets; values of an earlier round are always smaller. A set takes further rounds until all its bins are
filled. After ``t`` such rounds, round t + j sends every element to bin j, so after 2t rounds every coordinate is filled
whatever the set. Two sets agree in a coordinate with a probability equal to their Jaccard similarity, and the share of
equal coordinates is concentrated around it.
"""

from __future__ import annotations

import numpy as np

#: Letters of a shingle at most: 5 bits each fill a 64-bit word, so shingles are packed exactly, not hashed.
MAX_WIDTH = 12
#: Letters worked on at once.
CHUNK = 1 << 18
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of each word, another one for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pack(text: np.ndarray, width: int = MAX_WIDTH) -> np.ndarray:
    """The packed run of ``width`` letters that begins at each place of ``text`` (ASCII codes of letters)."""
    if not 1 <= width <= MAX_WIDTH:
        raise ValueError(f"width must be 1 to {MAX_WIDTH}")
    if len(text) < width:
        return np.empty(0, np.uint64)
    step = (text & 31).astype(np.uint64)
    out, have, size = None, 0, 1
    while True:
        if width & size:
            out = step[: len(text) - size + 1] if out is None else (out[: len(text) - have - size + 1] << np.uint64(5 * size)) | step[have : have + len(text) - have - size + 1]
            have += size
        size *= 2
        if size > width:
            return out
        half = np.uint64(5 * size // 2)
        step = (step[: len(text) - size + 1] << half) | step[size // 2 :][: len(text) - size + 1]


def shingles(letters: str | bytes, width: int = MAX_WIDTH) -> np.ndarray:
    """The distinct packed runs of one string, in order."""
    raw = letters.encode("ascii") if isinstance(letters, str) else letters
    return np.unique(pack(np.frombuffer(raw, np.uint8), width))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct words; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def text_parts(values, width: int):
    """From an Arrow string array: (rows, row of each shingle, packed shingles) for parts of about CHUNK letters.

    Rows with fewer than ``width`` letters are in no part. A longer text is a part of its own.
    """
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hi = min(hi, len(sizes))
        use = np.flatnonzero(sizes[lo:hi] >= width) + lo
        if len(use):
            codes = pack(data[offsets[lo] : offsets[hi]], width)
            counts = sizes[use] - width + 1
            row = np.repeat(np.arange(len(use)), counts)
            first = np.cumsum(counts) - counts
            place = np.arange(len(row)) - np.repeat(first - (offsets[use] - offsets[lo]), counts)
            yield use, row, codes[place]
        lo = hi


def sketch(row: np.ndarray, codes: np.ndarray, rows: int, t: int) -> np.ndarray:
    """The sketches, ``rows`` by ``t``, of the sets of ``codes`` with the same ``row``. Every row has an element."""
    out = np.full(rows * t, EMPTY, np.uint64)
    for i in range(2 * t):
        h = mix(codes, i + 1)
        bins = (h >> np.uint64(48)).astype(np.int64) % t if i < t else np.full(len(codes), i - t)
        np.minimum.at(out, row * t + bins, (h & _VALUE) | np.uint64(i << 48))
        open_rows = (out.reshape(rows, t) == EMPTY).any(axis=1)
        if not open_rows.any():
            break
        keep = open_rows[row]
        row, codes = row[keep], codes[keep]
    return out.reshape(rows, t)
