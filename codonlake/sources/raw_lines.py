"""Loading raw lines of delimited files, with the lines that can't be loaded set apart and the reason for each.

Rules of a line: fields are separated by one character (by file extension: a tab for .tsv, else a comma). A field may be
enclosed in double quotes, which then stand at its very start and very end; inside, a double quote is written twice and
the separator is plain text. A carriage return at the end of a line is not part of it. Line 1 of a file is its header,
which may begin with a byte-order mark; it names the columns.

Method: minimum-cost error parse. A line is reduced to its quotes, its separators and the runs between them. A dynamic
program over the states of the parser and the number of fields so far finds the least edits (quotes and separators
inserted or deleted) that make the line legal and give it as many fields as its header has. An edit that mends a quote
weighs more than any number of edits that only change the number of fields, so quotes are edited only where no other
reading exists. Lines of cost 0 whose values have the right types load; of the others, the edits state the reason:

* ``quoting``: the cheapest parse edits a quote, or puts a separator beside a misplaced one;
* ``column_count``: it edits separators only;
* ``sequence_value``, ``label_value``: it edits nothing, but the value isn't one the column takes.

Defined results: headers and lines that are null, empty or white space only are neither loaded nor reported. Lines of a
file without a header, or whose header doesn't name both columns, are reported (``column_count``, unless their quoting
is broken). Lines may repeat and stand in any order. Other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.session import broadcast_if_small

SEPARATORS = {".tsv": "\t"}
SEQUENCE = re.compile("[ACGTNacgtn]+")
LABELS = {"0": 0, "1": 1}

_START, _PLAIN, _QUOTED, _CLOSED = range(4)
#: An edit that concerns quotes against one that concerns the number of fields only.
_QUOTE_COST = 1 << 32
#: Reduced lines up to this length are remembered.
_REMEMBER = 64

Parse = tuple[int, tuple[str, ...]]


def reduced(line: str, separator: str) -> str:
    """The line as q (quote), d (separator) and x (a run of anything else). Without quotes, runs don't matter."""
    if '"' not in line:
        return "d" * line.count(separator)
    runs = re.findall(f'"|{re.escape(separator)}|[^"{re.escape(separator)}]+', line)
    return "".join("q" if r == '"' else "d" if r == separator else "x" for r in runs)


def _closure(best: dict, following: str, fields: int, at: int) -> None:
    """Add what insertions before the next symbol reach (``following``: the symbol, or "" at the end)."""
    todo = list(best)
    while todo:
        state, n = key = todo.pop()
        cost, edits = best[key]
        reach = []
        if state in (_START, _CLOSED):
            reach.append(((_QUOTED, n), _QUOTE_COST, "insert quote"))
        if state == _QUOTED:
            reach.append(((_CLOSED, n), _QUOTE_COST, "insert quote"))
        elif n < fields:
            mends = (state == _CLOSED and following == "x") or (state == _PLAIN and following == "q")
            reach.append(((_START, n + 1), _QUOTE_COST if mends else 1, "insert separator"))
        for to, more, what in reach:
            if to not in best or cost + more < best[to][0]:
                best[to] = (cost + more, (edits, f"{what} {at}"))
                todo.append(to)


def _parse(symbols: str, fields: int) -> Parse:
    best: dict = {(_START, 1): (0, ())}
    for at, symbol in enumerate(symbols):
        _closure(best, symbol, fields, at)
        after: dict = {}

        def reach(state: int, n: int, cost: int, edits: tuple, after: dict = after) -> None:
            if n <= fields and ((state, n) not in after or cost < after[state, n][0]):
                after[state, n] = (cost, edits)

        for (state, n), (cost, edits) in best.items():
            if symbol == "x":
                if state != _CLOSED:
                    reach(_PLAIN if state == _START else state, n, cost, edits)
            elif symbol == "q":
                if state != _PLAIN:
                    reach(_CLOSED if state == _QUOTED else _QUOTED, n, cost, edits)
                reach(state, n, cost + _QUOTE_COST, (edits, f"delete quote {at}"))
            elif state == _QUOTED:
                reach(state, n, cost, edits)
            else:
                reach(_START, n + 1, cost, edits)
                reach(_START, n, cost + 1, (edits, f"delete separator {at}"))
        best = after
    _closure(best, "", fields, len(symbols))
    cost, chain = min(v for (state, n), v in best.items() if state != _QUOTED and n == fields)
    edits: list[str] = []
    while chain:
        chain, edit = chain
        edits.append(edit)
    return cost, tuple(reversed(edits))


_parse_short = lru_cache(1 << 14)(_parse)


def legal_fields(symbols: str) -> int:
    """The number of fields of a reduced line that is legal as it stands, in one pass; 0 if its quotes aren't."""
    state, n = _START, 1
    for symbol in symbols:
        if symbol == "x":
            if state == _CLOSED:
                return 0
            state = _PLAIN if state == _START else state
        elif symbol == "q":
            if state == _PLAIN:
                return 0
            state = _CLOSED if state == _QUOTED else _QUOTED
        elif state != _QUOTED:
            state, n = _START, n + 1
    return 0 if state == _QUOTED else n


def error_parse(line: str, separator: str, fields: int) -> Parse:
    """The least cost of a legal parse into ``fields`` fields, and its edits, each with the symbol it stands at. A line that
    is legal as it stands costs nothing, and the program isn't run on it."""
    symbols = reduced(line, separator)
    if legal_fields(symbols) == max(1, fields):
        return 0, ()
    return (_parse_short if len(symbols) <= _REMEMBER else _parse)(symbols, max(1, fields))


def split_fields(line: str, separator: str) -> list[str]:
    """The field values of a legal line."""
    if '"' not in line:
        return line.split(separator)
    out, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end = at + 1
            while True:
                end = line.index('"', end)
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            out.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(separator, at)
            end = len(line) if end < 0 else end
            out.append(line[at:end])
            at = end
        if at >= len(line):
            return out
        at += 1


def read_line(line: str, separator: str, names: list[str] | None, sequence: str, label: str) -> tuple[str | None, int | None, str | None, str | None]:
    """(sequence, label, reason, edits) of one line that isn't blank."""
    line = line[:-1] if line.endswith("\r") else line
    cost, edits = error_parse(line, separator, len(names or []))
    said = "; ".join(edits) or None
    if cost >= _QUOTE_COST:
        return None, None, "quoting", said
    if cost or not names or sequence not in names or label not in names:
        return None, None, "column_count", said
    values = split_fields(line, separator)
    seq, lab = (values[names.index(c)].strip(" \t") for c in (sequence, label))
    if not SEQUENCE.fullmatch(seq):
        return None, None, "sequence_value", None
    if lab not in LABELS:
        return None, None, "label_value", None
    return seq, LABELS[lab], None, None


def header_names(line: str, separator: str) -> list[str]:
    line = line.removeprefix("﻿")
    line = line[:-1] if line.endswith("\r") else line
    if error_parse(line, separator, 1)[0] >= _QUOTE_COST:
        return [x.strip(' \t"') for x in line.split(separator)]
    return [x.strip(" \t") for x in split_fields(line, separator)]


def separator_of(file_name: str | None) -> str:
    return next((s for e, s in SEPARATORS.items() if (file_name or "").lower().endswith(e)), ",")


def parse_lines(lines: DataFrame, sequence: str = "sequence", label: str = "label") -> DataFrame:
    """(line_id, file_name, line_no, sequence, label, reason, edits) of every line that is neither header nor blank;
    ``reason`` is null for the lines that load, ``sequence`` and ``label`` for those that don't."""
    own = lines.select("line_id", "file_name", F.col("line_no").cast("int").alias("line_no"), "line")
    heads = own.where("line_no = 1 and line is not null").groupBy("file_name").agg(F.min("line").alias("__head"))
    body = own.where("line_no is null or line_no <> 1").where("line is not null")
    both = body.join(broadcast_if_small(heads), body.file_name.eqNullSafe(heads.file_name), "left").select(body["*"], "__head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str] | None] = {}
        for b in batches:
            out: list[tuple] = []
            for line_id, file_name, line_no, line, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not line.strip():
                    continue
                sep = separator_of(file_name)
                if (head, sep) not in known:
                    known[head, sep] = None if head is None else header_names(head, sep)
                out.append((line_id, file_name, line_no, *read_line(line, sep, known[head, sep], sequence, label)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], kinds.names)

    kinds = pa.schema([("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("sequence", pa.string()), ("label", pa.int32()), ("reason", pa.string()), ("edits", pa.string())])
    return both.mapInArrow(run, "line_id bigint, file_name string, line_no int, sequence string, label int, reason string, edits string")


def loaded(parsed: DataFrame) -> DataFrame:
    """The rows of the lines that load, typed."""
    return parsed.where("reason is null").select("line_id", "file_name", "line_no", "sequence", "label")


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that don't load, with the reason and the edits that would make them legal."""
    return parsed.where("reason is not null").select("line_id", "file_name", "line_no", "reason", "edits")
