"""Names that stand in texts, found by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyspan.session import look_up, materialise


def named_spans(texts: DataFrame, key: str, words: str, names: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(key, start, name, further ``columns`` of names): the names in each text.

    ``words`` is a column of plain words parted by single blanks, ``names`` has
    one row per plain ``name`` of any number of words.  Longer names come first
    and take their words; of equal length, those further left.  Words that begin
    no name are dropped before anything is built, and candidates meet names in a
    join, so a text meets no name that it does not hold.
    """
    first = F.substring_index("name", " ", 1).alias("_word")
    known = names.where("name <> ''").select("name", *columns)
    lengths = materialise(known.groupBy(first).agg(F.collect_set(F.size(F.split("name", " "))).alias("_lengths")))
    list_ = F.split(F.col(words), " ")
    at = texts.where(F.col(words) != "").select(key, list_.alias("_list"), F.posexplode(list_).alias("start", "_word"))
    at = look_up(at, lengths, ["_word"], "inner").select(key, "_list", "start", F.explode("_lengths").alias("_n"))
    at = at.where(F.col("start") + F.col("_n") <= F.size("_list"))
    spans = at.select(key, "start", "_n", F.array_join(F.slice("_list", F.col("start") + 1, F.col("_n")), " ").alias("name"))
    found = look_up(spans, materialise(known), ["name"], "inner")
    row = F.struct((-F.length("name")).alias("rank"), F.col("start"), (F.col("start") + F.col("_n")).alias("end"), "name", *columns)
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_found"))
    empty = F.filter("_found", lambda x: F.lit(False))

    def take(taken, span):
        clash = F.exists(taken, lambda t: (t["start"] < span["end"]) & (span["start"] < t["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(span)))

    chosen = F.aggregate("_found", empty, take)
    return lists.select(key, F.explode(chosen).alias("s")).select(key, "s.start", "s.name", *(f"s.{c}" for c in columns))
