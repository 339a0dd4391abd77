import random

import numpy as np

from tallyspan.operators import rowparse
from tallyspan.session import look_up

LINES = "line_id long, file_no long, line_no int, delim string, raw_line string, fields string"


def parse(line, delim):
    """Fields of a line, or the offset of its first fault, one byte at a time."""
    state, fields, field = 0, [], b""
    for i, c in enumerate(line):
        c = bytes([c])
        if state == 0 and c == b'"':
            state = 2
        elif state < 2:
            if c == delim:
                fields.append(field)
                state, field = 0, b""
            elif c in b'"\r\n':
                return i
            else:
                state, field = 1, field + c
        elif state == 2:
            state, field = (3, field) if c == b'"' else (2, field + c)
        elif c == b'"':
            state, field = 2, field + c
        elif c == delim:
            fields.append(field)
            state, field = 0, b""
        else:
            return i
    return len(line) if state == 2 else [*fields, field]


def test_tokeniser_matches_a_byte_loop():
    rng = random.Random(7)
    lines = [b"", b'"', b'""', b","] + [bytes(rng.choices(b'ab",\n\xc3\xa9;', weights=[9, 9, 4, 4, 1, 0, 0, 2], k=rng.randrange(300))) for _ in range(1500)]
    lines += [b'"' + b'x""y\n' * 2000 + b'",z', b"a," * 3000, b'"' + b"x" * 5000]
    delims = [rng.choice(b",;") for _ in lines]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    fields, fault = rowparse.tokenise_bytes(np.frombuffer(b"".join(lines), np.uint8), starts, [bytes([d]) for d in delims])
    for line, delim, got, at in zip(lines, delims, fields.to_pylist(), fault.tolist(), strict=True):
        want = parse(line, bytes([delim]))
        assert (at, got) == ((want, []) if isinstance(want, int) else (-1, [f.decode() for f in want]))


def test_reasons(spark):
    rows = [
        (1, 1, 0, ",", "DataSeries,2021,_id"),
        (2, 1, 1, ",", " a , 1.5 ,1"),
        (3, 1, 2, ",", '"a\nb",-,"0007"'),
        (4, 1, 3, ",", 'a"b,1'),
        (5, 1, 4, ",", "a,1"),
        (6, 1, 5, ",", "a,1e3,1"),
        (7, 1, 6, ",", " ,1,1"),
        (8, 1, 7, ",", "a,1,0"),
        (9, 1, 8, ",", None),
        (10, 2, 1, ",", "a,1,1"),
        (11, 3, 0, "", "_id,2020,DataSeries"),
        (12, 3, 1, None, "1,NULL,x"),
        (13, 4, 0, "||", "DataSeries||_id"),
        (14, 4, 1, "||", '"a||b"||3'),
        (15, 1, 9, ",", "x,1 ,1"),
        (16, 4, 2, "||", '"a""||\x1f"||4'),
        (17, 4, 3, "||", "a|||5"),
        (18, 1, 10, ",", 'a,"7\n",1'),
        (19, 1, 11, ",", 'a,7,"5\n"'),
        (5, 1, 4, ",", "a,1"),
    ]
    lines = spark.createDataFrame([(*r, "clash") for r in rows], LINES)
    got = sorted((r.line_id, r.reason) for r in rowparse.unsound_lines(lines).collect())
    invalid = [(i, "invalid_value") for i in (6, 7, 8, 15, 17, 18, 19)]
    assert got == sorted([(4, "quoting"), *invalid, *((i, "column_count") for i in (5, 5, 9, 10))])
    typed = {r.line_id: (r.record_id, r.data_series, r.counts) for r in rowparse.typed_rows(lines).collect()}
    assert typed == {2: (1, "a", {2021: 1.5}), 3: (7, "a\nb", {2021: None}), 12: (1, "x", {2020: None}), 14: (3, "a||b", {}), 16: (4, 'a"||\x1f', {})}
    assert rowparse.unsound_lines(lines.limit(0)).count() == 0


def test_long_delimiters_keep_offsets(spark):
    lines = spark.createDataFrame([(1, 1, 0, "::", "DataSeries::_id", ""), (2, 1, 1, "::", 'a::b"c', ""), (3, 1, 2, "::", '"a::b', "")], LINES)
    assert {r.line_id: r.fault_offset for r in rowparse.unsound_lines(lines).collect()} == {2: 4, 3: 5}


def test_large_lookup_tables_are_salted(spark):
    rows = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 999), (None, 998)], "k int, i int")
    small = spark.createDataFrame([(1, "a"), (3, "c")], "k int, name string")
    want = sorted([(i, "a") for i in range(200)] + [(998, ""), (999, "")])
    for limit in (0, 10**9):
        got = look_up(rows, small, ["k"], limit=limit)
        assert got.columns == ["k", "i", "name"] and sorted((r.i, r.name or "") for r in got.collect()) == want
