"""Raw delimited lines to typed rows, or to a reason why a line is unsound.

A quote-aware finite-state tokenizer runs over the bytes of an Arrow batch.
Every line is cut into chunks; the transition function of a chunk (the state it
ends in, for each state it may start in) is found for all chunks at once, the
functions of a line's chunks are composed by a prefix scan, and a second sweep
from the then known start states gives the state after every byte.  Field
bounds, quote removal and the offset of the first fault follow from these.
Header lookup and the checks of values are column expressions.

Defined cases: a null line is an empty one; a null or empty delimiter is a
comma; a line break outside quotes is a quoting fault; lines of a file without
a sound header (line_no 0; of several, the one of lowest line_id) have a wrong
column count; repeated lines are judged one by one; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions.numbers import NUMBER, is_missing
from tallyspan.session import look_up, materialise

# States after a byte.
START, PLAIN, QUOTED, QUOTE, FAULT = range(5)
# Classes of a byte; PAD fills up the last chunk of a line, and stands for the
# bytes of a long delimiter after its first.
OTHER, DELIMITER, MARK, BREAK, PAD = range(5)
#: NEXT[state, class]
NEXT = np.array(
    [
        [PLAIN, START, QUOTED, FAULT, START],
        [PLAIN, START, FAULT, FAULT, PLAIN],
        [QUOTED, QUOTED, QUOTE, QUOTED, QUOTED],
        [FAULT, START, QUOTED, FAULT, QUOTE],
        [FAULT, FAULT, FAULT, FAULT, FAULT],
    ],
    dtype=np.uint8,
)
CHUNK = 64
YEAR = r"^[0-9]{4}\z"
_SLICE = 1 << 20


def _long_delimiters(data: np.ndarray, line_of: np.ndarray, delimiter: bytes, lines: np.ndarray) -> np.ndarray:
    """Where a delimiter of several bytes starts in the ``lines`` that use it.

    Occurrences are taken from the left and do not overlap.
    """
    size = len(delimiter)
    at = np.flatnonzero((data == delimiter[0]) & lines[line_of])
    at = at[at + size <= len(data)]
    for j in range(1, size):
        at = at[(data[at + j] == delimiter[j]) & (line_of[at + j] == line_of[at])]
    if (np.diff(at) >= size).all():
        return at
    chosen, end = [], -1
    for i in at.tolist():
        if i >= end:
            chosen.append(i)
            end = i + size
    return np.array(chosen, dtype=np.int64)


def tokenise_bytes(data: np.ndarray, starts: np.ndarray, delimiters: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:
    """Fields of every line, and the offset of its first fault (-1: none).

    ``data`` holds the lines' bytes, ``starts`` their bounds (one more than
    lines), ``delimiters`` the delimiter of each line, of one or more bytes.  A
    faulty line has no fields; the offset of an unclosed quote is the length of
    the line.
    """
    lines, lengths = len(starts) - 1, np.diff(starts)
    line_of = np.repeat(np.arange(lines), lengths)
    kind = np.full(len(data), OTHER, dtype=np.uint8)
    kind[(data == 10) | (data == 13)] = BREAK
    spellings, used = np.unique(np.array(delimiters, dtype=object).astype(bytes), return_inverse=True) if lines else ([], None)
    kind[data == 34] = MARK
    for n, delimiter in enumerate(map(bytes, spellings)):
        at = _long_delimiters(data, line_of, delimiter, used == n)
        kind[at] = DELIMITER
        for j in range(1, len(delimiter)):
            kind[at + j] = PAD

    chunks = np.maximum(1, -(-lengths // CHUNK))
    first = np.cumsum(chunks) - chunks
    within = np.arange(len(data)) - starts[line_of]
    cell = (first[line_of] + within // CHUNK) * CHUNK + within % CHUNK
    matrix = np.full(int(chunks.sum()) * CHUNK, PAD, dtype=np.uint8)
    matrix[cell] = kind
    matrix = matrix.reshape(-1, CHUNK)

    maps = np.tile(np.arange(5, dtype=np.uint8), (len(matrix), 1))
    for j in range(CHUNK):
        maps = NEXT[maps, matrix[:, j, None]]
    place = np.arange(len(matrix)) - np.repeat(first, chunks)
    step = 1
    while step < chunks.max(initial=1):
        later = np.flatnonzero(place >= step)
        maps[later] = np.take_along_axis(maps[later], maps[later - step].astype(np.int64), axis=1)
        step *= 2
    state = np.full(len(matrix), START, dtype=np.uint8)
    follows = np.flatnonzero(place > 0)
    state[follows] = maps[follows - 1, START]
    after = np.empty(matrix.shape, dtype=np.uint8)
    for j in range(CHUNK):
        state = NEXT[state, matrix[:, j]]
        after[:, j] = state
    after = after.reshape(-1)[cell]
    before = np.concatenate([[START], after[:-1]]).astype(np.uint8) if len(after) else after
    before[within == 0] = START

    fault = np.full(lines, -1, dtype=np.int64)
    faulty = np.flatnonzero((after == FAULT) & (before != FAULT))
    fault[line_of[faulty]] = within[faulty]
    final = np.full(lines, START, dtype=np.uint8)
    some = lengths > 0
    final[some] = after[starts[1:][some] - 1]
    unclosed = final == QUOTED
    fault[unclosed] = lengths[unclosed]

    sound = fault[line_of] < 0
    split = (kind == DELIMITER) & (before != QUOTED) & sound
    keep = sound & ~split & ~((kind == MARK) & ((before == START) | (before == QUOTED))) & ~((kind == PAD) & (before == START))
    fields = np.where(fault < 0, np.bincount(line_of[split], minlength=lines) + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(fields)])
    field_of = (bounds[:-1][line_of] + _count_within(split, starts[:-1][line_of]))[keep]
    sizes = np.bincount(field_of, minlength=bounds[-1]) if bounds[-1] else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.StringArray.from_buffers(int(bounds[-1]), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep])))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values), fault


def _count_within(flags: np.ndarray, line_start: np.ndarray) -> np.ndarray:
    """How many flags stand before each byte within its line."""
    before = np.concatenate([[0], np.cumsum(flags)])
    return before[:-1] - before[line_start] if len(flags) else np.zeros(0, dtype=np.int64)


def tokenise(lines: DataFrame) -> DataFrame:
    """line_id, file_no, line_no, fields, fault_offset (null: none) of each line."""
    source = lines.select(
        F.col("line_id").cast("long"),
        F.col("file_no").cast("long"),
        F.col("line_no").cast("int"),
        F.coalesce("raw_line", F.lit("")).alias("raw"),
        F.when(F.length("delim") > 0, F.col("delim")).otherwise(F.lit(",")).alias("delim"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = max(1, int(len(whole) * _SLICE / max(1, whole.nbytes)))
            for at in range(0, len(whole), size):
                batch = whole.slice(at, size)
                raws = batch.column(3).cast(pa.binary())
                starts = np.concatenate([[0], np.cumsum(pa.compute.binary_length(raws).to_numpy(zero_copy_only=False))]).astype(np.int64)
                data = np.frombuffer(b"".join(raws.to_pylist()), dtype=np.uint8)
                fields, fault = tokenise_bytes(data, starts, batch.column(4).cast(pa.binary()).to_pylist())
                offset = pa.array(fault.astype(np.int32), mask=fault < 0)
                yield pa.record_batch([*batch.columns[:3], fields, offset], names=["line_id", "file_no", "line_no", "fields", "fault_offset"])

    return source.mapInArrow(run, "line_id long, file_no long, line_no int, fields array<string>, fault_offset int")


def _invalid(name: Column, value: Column) -> Column:
    return (
        F.when(name == "DataSeries", F.trim(value) == "")
        .when(name == "_id", ~F.trim(value).rlike(r"^0*[1-9][0-9]*\z"))
        .when(name.rlike(YEAR), ~(is_missing(value) | F.trim(value).rlike(NUMBER)))
        .otherwise(F.lit(False))
    )


def judged(lines: DataFrame) -> DataFrame:
    """Every line but the headers: names, fields, reason (null: sound), labels.

    Adds fault_offset for a quoting fault and bad_column (the first one) for an
    invalid value.
    """
    # The tokenizer hides filters from the scan, so they come before it.
    headers = tokenise(lines.where("line_no = 0")).where("fault_offset is null").groupBy("file_no").agg(F.min_by("fields", "line_id").alias("names"))
    headers = headers.withColumn("names", F.transform("names", lambda n: F.regexp_replace(F.trim(n), "^﻿", "")))
    # One small row a file; the lines of a large file need not meet.
    rows = look_up(tokenise(lines.where("line_no is distinct from 0")), materialise(headers), ["file_no"])
    bad = F.filter(F.arrays_zip("names", "fields"), lambda x: _invalid(x["names"], x["fields"]))
    fits = F.coalesce(F.size("fields") == F.size("names"), F.lit(False)) & F.col("names").isNotNull()
    rows = rows.withColumn("_bad", F.when(fits, F.get(bad, F.lit(0))["names"]))
    reason = F.when(F.col("fault_offset").isNotNull(), "quoting").when(~fits, "column_count").when(F.col("_bad").isNotNull(), "invalid_value")
    return rows.withColumn("reason", reason).withColumn("bad_column", F.when(F.col("reason") == "invalid_value", F.col("_bad"))).drop("_bad")


def unsound_lines(lines: DataFrame) -> DataFrame:
    """line_id, reason, fault_offset, bad_column of the unsound lines."""
    return judged(lines).where("reason is not null").select("line_id", "reason", "fault_offset", "bad_column")


def typed_rows(lines: DataFrame) -> DataFrame:
    """line_id, file_no, line_no, record_id, data_series, counts (year to value,
    null where missing) of the sound lines."""
    rows = judged(lines).where("reason is null")
    named = F.map_from_entries(F.arrays_zip("names", "fields"))
    counts = F.transform_values(F.map_filter("named", lambda k, _: k.rlike(YEAR)), lambda _, v: F.when(~is_missing(v), F.trim(v).try_cast("double")))
    counts = F.map_from_entries(F.transform(F.map_entries(counts), lambda e: F.struct(e["key"].cast("int"), e["value"])))
    return rows.withColumn("named", named).select(
        "line_id", "file_no", "line_no", F.trim(F.col("named")["_id"]).try_cast("decimal(38,0)").try_cast("long").alias("record_id"), F.trim(F.col("named")["DataSeries"]).alias("data_series"), counts.alias("counts")
    )
