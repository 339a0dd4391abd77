"""Nested records to flat tables that keep their parent links.

The JVM parses each body into Arrow list/struct columns (see
``functions.loose_json``); inside the tasks the child tables come from the list
offsets alone: ``list_parent_indices`` gives every child its parent's position,
``take`` carries the keys down, and no row is visited by Python code.  Trees may
be of any depth: levels below the LEVELS that the JVM parses travel as text and
are parsed in the task, one text at a time.

Defined cases: null, empty or malformed bodies give no rows; elements of a
record or claim list that are no objects are left out and not counted; nested
lists written as JSON strings count as lists; repeated rows give repeated
results; further input columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions.loose_json import elements, objects, texts
from tallyspan.session import look_up, materialise

LEVELS = 3


# --- Arrow kernels -----------------------------------------------------------


def tree_levels(roots: pa.ListArray, child: str, below: Callable[[pa.Array], pa.ListArray]) -> list[dict]:
    """The levels of a forest, from the roots down.

    Each level has its ``nodes`` (struct array), the ``row`` of ``roots`` that
    every node stems from, its ``parent`` position in the level above and its
    ``number``: its place among all nodes of its row, a node before the nodes
    under it, in written order.  ``child`` names the member that holds the next
    level; where it is text, ``below`` turns it into lists.
    """
    levels: list[dict] = []
    lists, row = roots, None
    while True:
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        nodes = lists.flatten()
        if len(nodes) == 0:
            break
        row = parent if row is None else row.take(parent)
        levels.append({"nodes": nodes, "parent": parent, "row": row})
        lists = pc.struct_field(nodes, child)
        if pa.types.is_string(lists.type) or pa.types.is_large_string(lists.type):
            if lists.null_count == len(lists):
                break
            lists = below(lists)
    size_below = None
    for level in reversed(levels):
        size = np.ones(len(level["nodes"]), dtype=np.int64)
        if size_below is not None:
            size += np.bincount(size_below[0], weights=size_below[1], minlength=len(size)).astype(np.int64)
        level["size"], size_below = size, (level["parent"], size)
    above = None
    for level in levels:
        before = np.cumsum(level["size"]) - level["size"]
        first = np.searchsorted(level["parent"], level["parent"], side="left")
        level["number"] = before - before[first] + (0 if above is None else above[level["parent"]] + 1)
        above = level["number"]
    return levels


def numbered_items(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(position of the list, number within it, value) of every non-null item."""
    parent = pc.list_parent_indices(lists)
    values = lists.flatten()
    keep = values.is_valid()
    parent = parent.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.arange(len(parent)) - np.searchsorted(parent, parent, side="left")
    return parent, number, values.filter(keep)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _levels_type(node: Callable[[pa.DataType], pa.DataType], depth: int) -> pa.DataType:
    kind: pa.DataType = pa.string()
    for _ in range(depth):
        kind = pa.list_(node(kind))
    return kind


# --- claims and their evidence -----------------------------------------------

_CLAIM = "claim string, supported string, evidence_ids string, parts string"


def _claims(text: Column, depth: int) -> Column:
    def evidence(raw: Column) -> Column:
        return F.transform(texts(raw), lambda e: F.when(F.ltrim(e).startswith("{"), F.get_json_object(e, "$.id")).otherwise(e))

    return F.transform(
        objects(text, _CLAIM),
        lambda c: F.struct(
            c["claim"].alias("claim"),
            c["supported"].alias("supported"),
            evidence(c["evidence_ids"]).alias("evidence_ids"),
            (_claims(c["parts"], depth - 1) if depth > 1 else c["parts"]).alias("parts"),
        ),
    )


def _claim_type(below: pa.DataType) -> pa.DataType:
    return pa.struct([("claim", pa.string()), ("supported", pa.string()), ("evidence_ids", pa.list_(pa.string())), ("parts", below)])


def _loose_list(value: object) -> list:
    """``value`` as a list: a list, one object, or either of them as JSON text."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return []
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _claims_below(rest: pa.Array) -> pa.ListArray:
    def node(x: dict, depth: int) -> dict:
        ids = x.get("evidence_ids")
        if isinstance(ids, str) and ids.lstrip().startswith("["):
            ids = _loose_list(ids) or [ids]
        ids = ids if isinstance(ids, list) else [] if ids is None else [ids]
        parts = x.get("parts")
        return {
            "claim": _text(x.get("claim")),
            "supported": _text(x.get("supported")),
            "evidence_ids": [_text(i.get("id") if isinstance(i, dict) else i) for i in ids],
            "parts": [node(p, depth - 1) for p in _loose_list(parts) if isinstance(p, dict)] if depth > 1 else _text(parts),
        }

    lists = [[node(x, LEVELS) for x in _loose_list(t) if isinstance(x, dict)] for t in rest.to_pylist()]
    return pa.array(lists, type=_levels_type(_claim_type, LEVELS))


def _with_claims(examples: DataFrame, key: str, body: str) -> DataFrame:
    record = F.when(F.ltrim(F.col(body)).startswith("["), F.element_at(elements(F.col(body)), 1)).otherwise(F.col(body))
    members = F.from_json(record, "claims string, example string")
    parsed = examples.select(F.col(key).cast("long").alias("key"), members.alias("m"))
    claims = F.coalesce(F.col("m.claims"), F.from_json(F.col("m.example"), "claims string")["claims"])
    return parsed.select("key", _claims(claims, LEVELS).alias("claims"))


def flatten_claims(examples: DataFrame, key: str = "example_id", body: str = "record_json") -> DataFrame:
    """One row per claim of each example, with its parent claim.

    Result: ``key``, claim_no, parent_claim_no (null for a top claim), depth,
    claim, supported, n_evidence (non-null evidence ids).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, above = _column(batch, "key"), None
            for depth, level in enumerate(tree_levels(_column(batch, "claims"), "parts", _claims_below)):
                nodes, row = level["nodes"], pa.array(level["row"])
                owner, _, _ = numbered_items(pc.struct_field(nodes, "evidence_ids"))
                parent = pa.nulls(len(row), pa.int32()) if above is None else pa.array(above[level["parent"]].astype(np.int32))
                above = level["number"]
                yield pa.record_batch(
                    [
                        keys.take(row),
                        pa.array(level["number"].astype(np.int32)),
                        parent,
                        pa.array(np.full(len(row), depth, dtype=np.int32)),
                        pc.struct_field(nodes, "claim"),
                        pc.struct_field(nodes, "supported"),
                        pa.array(np.bincount(owner, minlength=len(row)).astype(np.int32)),
                    ],
                    names=["key", "claim_no", "parent_claim_no", "depth", "claim", "supported", "n_evidence"],
                )

    schema = "key long, claim_no int, parent_claim_no int, depth int, claim string, supported string, n_evidence int"
    return _with_claims(examples, key, body).mapInArrow(run, schema).withColumnRenamed("key", key)


def flatten_evidence(examples: DataFrame, key: str = "example_id", body: str = "record_json") -> DataFrame:
    """One row per evidence link: ``key``, claim_no, evidence_no, evidence_id.

    evidence_no counts the non-null evidence ids of a claim from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _column(batch, "key")
            for level in tree_levels(_column(batch, "claims"), "parts", _claims_below):
                owner, number, ids = numbered_items(pc.struct_field(level["nodes"], "evidence_ids"))
                yield pa.record_batch(
                    [keys.take(pa.array(level["row"][owner])), pa.array(level["number"][owner].astype(np.int32)), pa.array(number.astype(np.int32)), ids],
                    names=["key", "claim_no", "evidence_no", "evidence_id"],
                )

    schema = "key long, claim_no int, evidence_no int, evidence_id string"
    return _with_claims(examples, key, body).mapInArrow(run, schema).withColumnRenamed("key", key)


# --- payloads and their records ----------------------------------------------


def _holds_records(value: Column) -> Column:
    body = F.ltrim(value)
    as_list = body.startswith("[") & F.from_json(body, "array<string>").isNotNull()
    as_record = body.startswith("{") & F.get_json_object(body, "$._id").isNotNull()
    return F.coalesce(as_list | as_record, F.lit(False))


def _records(items: Column, page: Column, depth: int, only: Sequence[str] | None) -> Column:
    """Record nodes of an array of JSON texts; ``only`` names the members kept.

    Most members are plain values, which a look at their first sign tells; to
    test them twice costs less than to carry what the test found.
    """
    wanted = lambda k: F.lit(True) if only is None else k.isin(list(only))

    def node(members: Column) -> Column:
        inner = F.flatten(F.transform(F.map_values(F.map_filter(members, lambda _, v: _holds_records(v))), lambda v: elements(v)))
        text = F.when(F.size(inner) > 0, F.concat(F.lit("["), F.concat_ws(",", inner), F.lit("]")))
        return F.struct(
            page.alias("page_no"),
            F.map_filter(members, lambda k, v: wanted(k) & ~_holds_records(v)).alias("members"),
            (_records(inner, page, depth - 1, only) if depth > 1 else text).alias("records"),
        )

    found = F.filter(items, lambda x: F.ltrim(x).startswith("{"))
    parsed = F.filter(F.transform(found, lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    return F.transform(parsed, node)


def _record_type(below: pa.DataType) -> pa.DataType:
    return pa.struct([("page_no", pa.int32()), ("members", pa.map_(pa.string(), pa.string())), ("records", below)])


def _records_below(rest: pa.Array) -> pa.ListArray:
    def inner(v: object) -> bool:
        return isinstance(v, list) or isinstance(v, dict) and v.get("_id") is not None

    def unwrapped(v: object) -> object:
        if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def node(x: dict, depth: int) -> dict:
        x = {k: w if inner(w := unwrapped(v)) else v for k, v in x.items()}
        kids = [y for v in x.values() if inner(v) for y in (v if isinstance(v, list) else [v]) if isinstance(y, dict)]
        return {
            "page_no": None,
            "members": [(k, _text(v)) for k, v in x.items() if not inner(v)],
            "records": [node(y, depth - 1) for y in kids] if depth > 1 else _text(kids) if kids else None,
        }

    lists = [[node(x, LEVELS) for x in _loose_list(t) if isinstance(x, dict)] for t in rest.to_pylist()]
    return pa.array(lists, type=_levels_type(_record_type, LEVELS))


def payload_results(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``results``: the result members of each payload, still as text.

    A body is one envelope or a list of envelopes.
    """
    envelopes = objects(F.col(body), "result string")
    result = F.flatten(F.transform(envelopes, lambda e: objects(e["result"], "resource_id string, fields string, records string, pages string")))
    return payloads.withColumn("results", result)


def flatten_records(payloads: DataFrame, key: str = "file_id", body: str = "body", carry: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """One row per record of each payload, with the record it is held in.

    Records stand in ``result.records``, in ``result.pages[].records`` or inside
    other records.  Result: ``key``, record_no (written order within the file,
    a record before those it holds), parent_record_no (null for a top record),
    page_no (null without pages), the columns of ``carry`` (as text), members
    (map of the record's own members as text; members that hold records are left
    out, and others than those of ``only`` where that is given), record_id (from
    ``_id``, null where that is no whole number).
    """
    carry = list(carry)
    pages = lambda r: F.transform(objects(r["pages"], "records string"), lambda p, i: _records(elements(p["records"]), i.cast("int"), LEVELS, only))
    direct = lambda r: F.array(_records(elements(r["records"]), F.lit(None).cast("int"), LEVELS, only))
    trees = F.flatten(F.flatten(F.transform(F.col("results"), lambda r: F.concat(direct(r), pages(r)))))
    source = payloads.select(F.col(key).cast("long").alias("key"), *(F.col(c).cast("string").alias(f"carry_{n}") for n, c in enumerate(carry)), F.col(body).alias("body"))
    parsed = payload_results(source).select("key", *(f"carry_{n}" for n in range(len(carry))), trees.alias("records"))
    names = ["key", "record_no", "parent_record_no", "page_no", *(f"carry_{n}" for n in range(len(carry))), "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, page = None, None
            for level in tree_levels(_column(batch, "records"), "records", _records_below):
                nodes, row = level["nodes"], pa.array(level["row"])
                parent = pa.nulls(len(row), pa.int32()) if above is None else pa.array(above[level["parent"]].astype(np.int32))
                page = pc.struct_field(nodes, "page_no") if page is None else page.take(pa.array(level["parent"]))
                above = level["number"]
                carried = [_column(batch, f"carry_{n}").take(row) for n in range(len(carry))]
                yield pa.record_batch(
                    [_column(batch, "key").take(row), pa.array(above.astype(np.int32)), parent, page, *carried, pc.struct_field(nodes, "members")],
                    names=names,
                )

    carried = "".join(f"carry_{n} string, " for n in range(len(carry)))
    rows = parsed.mapInArrow(run, f"key long, record_no int, parent_record_no int, page_no int, {carried}members map<string,string>")
    digits = F.regexp_extract(F.element_at("members", "_id"), r"^\s*\+?([0-9]+)(?:\.0*)?\s*\z", 1)
    return rows.withColumn("record_id", digits.try_cast("long")).withColumnsRenamed({"key": key, **{f"carry_{n}": c for n, c in enumerate(carry)}})


def link_evidence(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``record_id`` to evidence links: n of ``<source>:r<n>[:...]``.

    ``records`` has source_id and record_id.  A malformed id, or one that names
    no record there, gets -1.  Case and surrounding blanks do not matter.
    """
    text = F.lower(F.col("evidence_id"))
    form = r"(?s)^\s*([^:]*[^:\s])\s*:r([0-9]+)\s*(:.*)?\z"
    # Malformed ids get numbers that no record has, so that they do not meet in one task.
    number = F.coalesce(F.regexp_extract(text, form, 2).try_cast("long"), -1 - F.abs(F.hash("evidence_id").cast("long")))
    links = evidence.withColumns({"_source": F.regexp_extract(text, form, 1), "_n": number})
    known = records.select(F.lower(F.trim("source_id")).alias("_source"), F.col("record_id").alias("_n")).where("_n is not null").distinct().withColumn("_known", F.lit(True))
    joined = look_up(links, materialise(known), ["_source", "_n"])
    return joined.withColumn("record_id", F.when(F.col("_known"), F.col("_n")).otherwise(F.lit(-1).cast("long"))).drop("_source", "_n", "_known")
