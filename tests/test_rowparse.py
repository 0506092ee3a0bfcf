import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import fsm
from tessera.operators import rowparse

FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
WHOLE = re.compile(rf"{FIELD}(?:\t{FIELD})*")


def brute(line):
    """Fields by a walk over the characters, or None."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        out, j = out + '"', j + 2
                        continue
                    break
                out, j = out + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            out = line[i:j]
        fields.append(out)
        if j >= len(line):
            return fields
        i = j + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('"\tabé1 ', max_size=30), min_size=1, max_size=12), st.integers(1, 9))
def test_against_a_walk(lines, chunk):
    got = rowparse.parse_lines(lines, [None] * len(lines), chunk)
    for line, (reason, offset, _) in zip(lines, got, strict=True):
        assert (reason == "quoting") == (brute(line) is None) == (not WHOLE.fullmatch(line))
        assert reason != "quoting" or 0 <= offset <= len(line.encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(1, 17))
def test_chunks_compose(classes, chunk):
    c = np.array(classes, np.uint8)
    assert (fsm.states(c, chunk) == fsm.states(c, 10_000)).all()


def test_reasons():
    num = lambda value="1", qtrs="0": "\t".join(["a", "T", "v", "20200101", qtrs, "USD", "", "", value])
    sub = lambda fy: "\t".join(["a", "1", "n", "10-K", fy, "FY", "p", "f"])
    cases = [
        (num(), "num", None), (num("-.5e+3"), "num", None), (num(""), "num", None), (num("1,000"), "num", "bad_value"), (num("x", "x"), "num", "bad_value"), (num("1", "004"), "num", "bad_qtrs"), (num("1", "٤"), "num", "bad_qtrs"),
        (num() + "\t", "num", "column_count"), ("", "num", "column_count"), (None, "sub", "column_count"), ('"a', "num", "quoting"), ('"a"b\tc', "sub", "quoting"), (sub("2020"), "sub", None), (sub(""), "sub", None), (sub("1899"), "sub", "bad_fy"), (sub(" 2020"), "sub", "bad_fy"), (num(), None, "unknown_file"),
    ]
    got = rowparse.parse_lines([c[0] for c in cases], [c[1] for c in cases])
    assert [g[0] for g in got] == [c[2] for c in cases]
    quoted = rowparse.parse_lines(['"a\tb"\t"say ""x"""\tc"d' + "\t" * 6], ["num"])[0][2]
    assert quoted[:3] == ["a\tb", 'say "x"', 'c"d']


def test_typed_rows(spark):
    rows = [(1, "x/num.txt", "\t".join(["a", "T", "v", "d", "4", "USD", "", "s", "1.5"]), "n"), (2, "x/sub.txt", "\t".join(["a", "7", "n", "f", "2020", "FY", "p", "d"]), "n"), (3, "x/num.txt", "bad", "n"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line string, reason string")
    fact = rowparse.typed_facts(df).collect()
    assert [(r.line_id, r.qtrs, r.coreg, r.value) for r in fact] == [(1, 4, None, 1.5)]
    assert [(r.cik, r.fy) for r in rowparse.typed_submissions(df).collect()] == [(7, 2020)]
    assert {tuple(r) for r in rowparse.rejected(df).collect()} == {(3, "column_count"), (4, "unknown_file")}
    assert rowparse.parsed(df.limit(0)).count() == 0
