import itertools
import re

import pytest

from codonlake.sources import raw_lines as rl

LEGAL = re.compile('(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')


def brute_reason(line, names):
    if not LEGAL.fullmatch(line):
        return "quoting"
    bare = re.sub('"(?:[^"]|"")*"', "Q", line)
    if bare.count(",") + 1 != len(names):
        return "column_count"
    f = [x.group(1) for x in re.finditer('("(?:[^"]|"")*"|[^",]*)(?:,|$)', line)]
    value = lambda x: (x[1:-1].replace('""', '"') if x[:1] == '"' else x).strip(" \t")
    if not re.fullmatch("[ACGTNacgtn]+", value(f[names.index("sequence")])):
        return "sequence_value"
    return None if value(f[names.index("label")]) in ("0", "1") else "label_value"


@pytest.mark.parametrize("names", [["sequence", "label"], ["label", "sequence", "note"]])
def test_every_short_line_has_the_reason_of_the_rules(names):
    for n in range(1, 8):
        for line in map("".join, itertools.product('A1",', repeat=n)):
            assert rl.read_line(line, ",", names, "sequence", "label")[2] == brute_reason(line, names), line


def test_edits_make_a_line_legal():
    for n in range(1, 7):
        for symbols in itertools.product('A",', repeat=n):
            line = "".join(symbols)
            cost, edits = rl.error_parse(line, ",", 2)
            assert (cost == 0) == (not edits)
            assert (cost < rl._QUOTE_COST) == bool(LEGAL.fullmatch(line))
            assert cost % rl._QUOTE_COST + cost // rl._QUOTE_COST == len(edits)


def test_cases():
    names = ["sequence", "label"]
    read = lambda x, sep=",", n=names: rl.read_line(x, sep, n, "sequence", "label")
    assert read(' acgtN\t, 1 \r') == ("acgtN", 1, None, None)
    assert read('"ACGT","0"')[:2] == ("ACGT", 0)
    assert read('"AC""GT",1')[2] == "sequence_value"
    assert read(' "ACGT",1')[2] == "quoting" and read('"ACGT" ,1')[2] == "quoting" and read('"ACGT,1')[2] == "quoting"
    assert read("ACGT")[2:] == ("column_count", "insert separator 0") and read("ACGT,1,")[2] == "column_count"
    assert read("ACGR,1")[2] == "sequence_value" and read(",1")[2] == "sequence_value" and read("ACGT,01")[2] == "label_value" and read("ACGT,")[2] == "label_value"
    assert read("ACGT\t1", "\t")[1] == 1 and read("ACGT,1", "\t")[2] == "column_count"
    assert read("x,ACGT", ",", None)[2] == "column_count" and read('"x,ACGT', ",", [])[2] == "quoting"
    assert read("A" * 100_000 + "," + "1")[1] == 1
    assert read(",".join(["a"] * 3000))[2] == "column_count" and read('"' * 3001)[2] == "quoting"
    assert rl.header_names('﻿"sequence",label\r', ",") == ["sequence", "label"]


def test_table(spark):
    rows = [(1, "a.csv", 1, "label,sequence"), (2, "a.csv", 2, "1,ACGT"), (3, "a.csv", 3, "  "), (4, "a.csv", 4, None), (5, "a.csv", 5, "ACGT,1"), (6, "b.tsv", 2, "ACGT\t1"), (7, "b.tsv", 1, "﻿sequence\tlabel\r"),
            (8, "b.tsv", 3, 'A"\t1'), (9, "none.csv", 2, "ACGT,1"), (10, None, 2, "ACGT,1"), (2, "a.csv", 2, "1,ACGT"), (11, "b.tsv", 4, "\t")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "line_id bigint, file_name string, line_no int, line string, sequence string, reason string")
    parsed = rl.parse_lines(df)
    assert sorted(tuple(r) for r in rl.loaded(parsed).collect()) == [(2, "a.csv", 2, "ACGT", 1)] * 2 + [(6, "b.tsv", 2, "ACGT", 1)]
    assert sorted((r["line_id"], r["reason"]) for r in rl.rejected(parsed).collect()) == [(5, "sequence_value"), (8, "quoting"), (9, "column_count"), (10, "column_count")]
    assert rl.parse_lines(df.where("false")).collect() == []


def test_legal_lines_are_those_the_program_finds_free():
    import itertools

    from codonlake.sources import raw_lines

    for n in range(7):
        for symbols in itertools.product("qdx", repeat=n):
            line = "".join(symbols)
            if "xx" in line:
                continue
            for fields in (1, 2, 3):
                cost, edits = raw_lines._parse(line, fields)
                assert (cost == 0) == (raw_lines.legal_fields(line) == fields) and (cost > 0 or edits == ()), (line, fields)
