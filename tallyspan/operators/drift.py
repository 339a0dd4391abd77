"""Files whose schemas drift: rescue-column ingestion and a change report.

``ingest`` enforces a target schema on flattened records: a member that the
target knows and that can be cast goes into its typed column; every other
member stays as JSON in ``_rescued``, so no value is lost.  ``cells`` replays
typed and rescued values by field id; ``history`` compares each file with its
predecessor on them, and ``changes`` is what it reports; ``promote`` moves
rescued values into typed columns, for renamed fields by the history and for
approved new fields by name.

Defined cases: a file without a field list is described by the keys of its
records; null ids are no fields; of a repeated field id in one list the first
counts, of a repeated ``_id`` in one file the first record; a predecessor that
is not in the table gives no report; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.loose_json import objects
from tallyspan.functions.numbers import canonical
from tallyspan.operators.nested import flatten_records, payload_results
from tallyspan.session import look_up, materialise
from tallyspan.sources.registry import census_ids, sources

COUNT = "decimal(24,6)"
_CASTABLE = r"^[+-]?(?=\.?[0-9])0*[0-9]{0,18}(\.[0-9]{0,6}0*)?\z"
_YEAR = r"^[0-9]{4}\z"

#: Field id to (column name, type) of the consistent table: the label fields,
#: and the years and counts that the registry declares.
TARGET: dict[str, tuple[str, str]] = {
    "Number": ("number_label", "string"),
    "DataSeries": ("data_series", "string"),
    **{i: (f"y{i}", COUNT) for s in sources() for i, _ in s.fields if i.isdigit()},
    **{i: (c, COUNT) for i, c in census_ids().items()},
}


def _castable(kind: str, raw: Column) -> Column:
    return F.lit(True) if kind == "string" else F.trim(raw).rlike(_CASTABLE)


def _typed(kind: str, raw: Column) -> Column:
    return raw if kind == "string" else F.when(_castable(kind, raw), F.trim(raw).try_cast(kind))


def ingest(records: DataFrame, target: Mapping[str, tuple[str, str]] = TARGET) -> DataFrame:
    """Typed target columns and ``_rescued`` (JSON) in place of ``members``.

    Unknown members, members that cannot be cast exactly and members without a
    value are rescued as written, and so is an ``_id`` that is no record_id.
    """
    texts = [i for i, (_, kind) in target.items() if kind == "string"]
    counts = [i for i, (_, kind) in target.items() if kind != "string"]
    kept = lambda k, v: v.isNotNull() & (((k == "_id") & F.col("record_id").isNotNull()) | k.isin(texts) | (k.isin(counts) & F.coalesce(_castable(COUNT, v), F.lit(False))))
    rescued = F.map_filter("members", lambda k, v: ~kept(k, v))
    columns = [_typed(kind, F.col("members")[i]).alias(name) for i, (name, kind) in target.items()]
    others = [c for c in records.columns if c != "members"]
    return records.select(*others, *columns, F.when(F.size(rescued) > 0, F.to_json(rescued)).alias("_rescued"))


def further_years(ingested: DataFrame, target: Mapping[str, tuple[str, str]] = TARGET) -> dict[str, tuple[str, str]]:
    """Field id to column and type of the years of the records that ``target`` lacks.

    Taken from the rescued values, so that years of a first file count too.  Ids
    of four digits bound what is collected.
    """
    ids = ingested.select(F.explode(F.map_keys(F.from_json("_rescued", "map<string,string>"))).alias("id")).where(F.col("id").rlike(_YEAR) & ~F.col("id").isin(list(target)))
    return {i: (f"y{i}", COUNT) for i in sorted((r.id for r in ids.distinct().collect()), reverse=True)}


def cells(ingested: DataFrame, target: Mapping[str, tuple[str, str]] = TARGET) -> Column:
    """Map of field id to text over typed and rescued values of a record.

    Members without a value map to null.
    """
    typed = F.map_filter(F.create_map(*(x for i, (name, _) in target.items() for x in (F.lit(i), F.col(name).cast("string")))), lambda _, v: v.isNotNull())
    rescued = F.coalesce(F.from_json("_rescued", "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = F.when(F.col("record_id").isNotNull(), F.create_map(F.lit("_id"), F.col("record_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(known, typed, rescued)


def ingest_payloads(payloads: DataFrame) -> DataFrame:
    """All records of the payloads through :func:`ingest`, with file and source."""
    return ingest(flatten_records(payloads, carry=("source_id", "resource_id")))


def file_fields(payloads: DataFrame) -> DataFrame:
    """file_id, prev_file_id, has_list, fields (array of id and type) per file."""
    lists = F.filter("results", lambda r: F.ltrim(r["fields"]).startswith("["))
    parsed = payload_results(payloads.select("file_id", "prev_file_id", "body")).withColumn("lists", lists)
    fields = F.flatten(F.transform("lists", lambda r: objects(r["fields"], "id string, type string")))
    return parsed.select("file_id", "prev_file_id", F.coalesce(F.size("lists") > 0, F.lit(False)).alias("has_list"), fields.alias("fields"))


def field_inventory(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """(file_id, field_id, field_type): the fields of every file."""
    listed = files.where("has_list").select("file_id", F.posexplode("fields")).where("col.id is not null")
    first = listed.groupBy("file_id", F.col("col.id").alias("field_id")).agg(F.min_by("col.type", "pos").alias("field_type"))
    bare = ingested.join(files.where("not has_list").select("file_id"), "file_id", "left_semi")
    keyed = bare.select("file_id", F.explode(F.map_keys(cells(bare))).alias("field_id")).distinct()
    return first.unionByName(keyed.withColumn("field_type", F.lit(None).cast("string")))


def history(payloads: DataFrame, ingested: DataFrame) -> DataFrame:
    """Every field of a file against the file in prev_file_id.

    Result: file_id, prev_file_id, field_id, change_kind (added, removed,
    renamed, retyped; kept for a field that stands in both files under one id),
    old_id, old_type, new_type.  A gone and a new id are a rename if they agree
    in at least nine tenths of the ``_id``s of both files in which both hold a
    value, numbers by value, else trimmed text.
    """
    files = materialise(file_fields(payloads))
    fields = field_inventory(files, ingested)
    listed = files.select(F.col("file_id").alias("prev_file_id"), F.col("has_list").alias("prev_has_list"))
    pairs = files.where("prev_file_id is not null").select("file_id", "prev_file_id", "has_list").join(listed, "prev_file_id")

    now = pairs.select("file_id").join(fields, "file_id").select("file_id", "field_id", F.col("field_type").alias("new_type"), F.lit(True).alias("is_now"))
    before = pairs.select("file_id", "prev_file_id").join(fields.withColumnRenamed("file_id", "prev_file_id"), "prev_file_id")
    before = before.select("file_id", "field_id", F.col("field_type").alias("old_type"), F.lit(True).alias("was"))
    both_listed = pairs.select("file_id", "prev_file_id", (F.col("has_list") & F.col("prev_has_list")).alias("both_listed"))
    # Written once: the comparison feeds every part of the report.
    compared = materialise(now.join(before, ["file_id", "field_id"], "full").join(both_listed, "file_id"))
    gone, new = compared.where("is_now is null"), compared.where("was is null")

    # Renames need the values of gone and new ids only, where a file has both.
    new_ids = new.select("file_id", F.col("file_id").alias("holder"), F.col("field_id").alias("new_id")).join(gone.select("file_id"), "file_id", "left_semi")
    old_ids = gone.select("file_id", F.col("prev_file_id").alias("holder"), F.col("field_id").alias("old_id")).join(new.select("file_id"), "file_id", "left_semi")
    watched = new_ids.select("holder", F.col("new_id").alias("id")).union(old_ids.select("holder", "old_id")).groupBy("holder").agg(F.collect_set("id").alias("ids"))
    rows = ingested.where("record_id is not null").join(watched.withColumnRenamed("holder", "file_id"), "file_id")
    wanted = F.map_filter(cells(rows), lambda k, v: F.array_contains("ids", k) & v.isNotNull())
    values = rows.select(F.col("file_id").alias("holder"), "record_id", "record_no", F.explode(wanted).alias("id", "value"))
    values = materialise(values.groupBy("holder", "record_id", "id").agg(canonical(F.min_by("value", "record_no")).alias("value")))

    old_values = values.withColumnsRenamed({"id": "old_id", "value": "old_value"}).join(old_ids, ["holder", "old_id"]).drop("holder")
    new_values = values.withColumnsRenamed({"id": "new_id", "value": "new_value"}).join(new_ids, ["holder", "new_id"]).drop("holder")
    agreed = old_values.join(new_values, ["file_id", "record_id"]).groupBy("file_id", "old_id", "new_id")
    agreed = agreed.agg(F.count("*").alias("n"), F.count_if(F.col("old_value") == F.col("new_value")).alias("same")).where("10 * same >= 9 * n")
    best = Window.partitionBy("file_id", "new_id").orderBy((F.col("same") / F.col("n")).desc(), F.col("n").desc(), "old_id")
    agreed = materialise(agreed)
    renames = agreed.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("file_id", "old_id", F.col("new_id").alias("field_id"))

    differs = F.coalesce(F.lower(F.trim("old_type")), F.lit("")) != F.coalesce(F.lower(F.trim("new_type")), F.lit(""))
    result = ["file_id", "prev_file_id", "field_id", "change_kind", "old_id", "old_type", "new_type"]
    renamed = new.drop("old_type").join(renames, ["file_id", "field_id"]).join(gone.select("file_id", F.col("field_id").alias("old_id"), "old_type"), ["file_id", "old_id"])
    kept = compared.where("was and is_now").withColumn("old_id", F.col("field_id"))
    none = F.lit(None).cast("string")
    parts = [
        new.join(renames, ["file_id", "field_id"], "left_anti").withColumns({"change_kind": F.lit("added"), "old_id": none}),
        gone.join(agreed.select("file_id", F.col("old_id").alias("field_id")), ["file_id", "field_id"], "left_anti").withColumns({"change_kind": F.lit("removed"), "old_id": F.col("field_id")}),
        renamed.withColumn("change_kind", F.lit("renamed")),
        renamed.unionByName(kept, allowMissingColumns=True).where(F.col("both_listed") & differs).withColumn("change_kind", F.lit("retyped")),
        kept.withColumn("change_kind", F.lit("kept")),
    ]
    report = parts[0].select(result)
    for part in parts[1:]:
        report = report.unionByName(part.select(result))
    return report


def changes(payloads: DataFrame, ingested: DataFrame) -> DataFrame:
    """What :func:`history` has to report: every row but the kept fields."""
    return history(payloads, ingested).where("change_kind <> 'kept'").drop("prev_file_id")


def aliases_of(past: DataFrame, known: Sequence[str]) -> DataFrame:
    """(file_id, alias_id, target_id): fields of a file that stand for a known one.

    A field stands for the one that it was renamed from, or kept as, in the
    file before, and so on back to a known field; an id that a later file takes
    up anew starts afresh and stands for itself.  Steps back are doubled in each
    round, so there are as many rounds as the longest way has binary digits;
    what is open after more rounds than that (files that name each other as
    predecessors) stands for itself.
    """
    step = past.where(F.col("change_kind").isin("renamed", "kept") & ~F.col("field_id").isin(list(known)))
    step = materialise(step.select("file_id", F.col("field_id").alias("alias_id"), F.col("prev_file_id").alias("at_file"), F.col("old_id").alias("at_id")))
    found = step.where(F.col("at_id").isin(list(known)))
    for _ in range(step.count().bit_length() + 1):
        open_ends = step.where(~F.col("at_id").isin(list(known)))
        if not open_ends.limit(1).count():
            break
        onward = step.select(F.col("file_id").alias("at_file"), F.col("alias_id").alias("at_id"), F.col("at_file").alias("to_file"), F.col("at_id").alias("to_id"))
        # A way that ends at no known field is dropped.
        step = open_ends.join(onward, ["at_file", "at_id"]).select("file_id", "alias_id", F.col("to_file").alias("at_file"), F.col("to_id").alias("at_id"))
        step = materialise(found.unionByName(step))
        found = step.where(F.col("at_id").isin(list(known)))
    return found.select("file_id", "alias_id", F.col("at_id").alias("target_id"))


def promote(
    ingested: DataFrame,
    past: DataFrame,
    approved: Mapping[str, tuple[str, str]] | None = None,
    target: Mapping[str, tuple[str, str]] = TARGET,
) -> DataFrame:
    """Replays rescued values into typed columns.

    A field that by ``past`` (of :func:`history`) stands for a target field
    fills that field's column where it is empty; see :func:`aliases_of`.
    ``approved`` (field id to column and type) adds columns for further fields,
    whose renames count likewise.  Of several values for one column the field's
    own comes first, then the one of the alias that sorts first; all others,
    values that cannot be cast and all other fields stay in ``_rescued``.
    """
    approved = approved or {}
    kinds = {**target, **approved}
    found = aliases_of(past, list(kinds))
    aliases = materialise(found.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("alias_id", "target_id")))).alias("_aliases")))

    empty = F.create_map().cast("map<string,string>")
    rows = look_up(ingested, aliases, ["file_id"])
    rows = rows.withColumn("_left", F.coalesce(F.from_json("_rescued", "map<string,string>"), empty)).withColumn("_aliases", F.coalesce("_aliases", empty))
    counts = [i for i, (_, kind) in kinds.items() if kind != "string"]
    fits = lambda to, v: v.isNotNull() & (~to.isin(counts) | F.coalesce(_castable(COUNT, v), F.lit(False)))
    own = F.map_filter("_left", lambda k, v: k.isin(list(approved)) & fits(k, v)) if approved else empty
    # What already has a value takes no other one.
    taken = F.concat(F.array_compact(F.array(*(F.when(F.col(name).isNotNull(), F.lit(i)) for i, (name, _) in target.items()))), F.map_keys("_own"))
    entry = lambda e: F.struct(F.col("_aliases")[e["key"]].alias("to"), e["key"].alias("alias"), e["value"].alias("value"))
    offers = F.filter(F.transform(F.map_entries("_left"), entry), lambda e: F.coalesce(e["to"].isNotNull() & fits(e["to"], e["value"]) & ~F.array_contains("_taken", e["to"]), F.lit(False)))
    # Sorted by column and alias: the first offer of each column wins.
    won = F.filter("_offers", lambda e, i: (i == 0) | (F.get(F.col("_offers"), i - 1)["to"] != e["to"]))
    rows = rows.withColumn("_own", own).withColumn("_taken", taken).withColumn("_offers", F.array_sort(offers)).withColumn("_won", won)
    rows = rows.withColumn("_new", F.map_concat("_own", F.map_from_entries(F.transform("_won", lambda e: F.struct(e["to"], e["value"])))))
    columns = {name: F.coalesce(F.col(name), _typed(kind, F.col("_new")[i])) for i, (name, kind) in target.items()}
    columns |= {name: _typed(kind, F.col("_new")[i]) for i, (name, kind) in approved.items()}
    moved = F.concat(F.map_keys("_own"), F.transform("_won", lambda e: e["alias"]))
    rest = F.map_filter("_left", lambda k, _: ~F.array_contains("_moved", k))
    rows = rows.withColumn("_moved", moved).withColumns(columns | {"_rescued": F.when(F.size(rest) > 0, F.to_json(rest))})
    return rows.drop("_left", "_aliases", "_own", "_taken", "_offers", "_won", "_new", "_moved")
