"""The queries of the LLM training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.llm import leakage, oracles, overlap, packing, reading
from tallyspan.session import table


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    census, regions = table(spark, sf, "census_rows"), table(spark, sf, "region_rows")
    places = overlap.place_names((census, "planning_area"), (census, "number_label"), (regions, "planning_region"))
    return table(spark, sf, "qa_examples"), table(spark, sf, "freeze_manifests"), places


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of an evaluation and a training example, smaller id first."""
    a, b = F.col("evaluation_id"), F.col("training_id")
    return overlap.overlaps(*_questions(spark, sf)).select(F.least(a, b).alias("example_a"), F.greatest(a, b).alias("example_b")).distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap counts per evaluation file, purpose and training file."""
    return overlap.overlap_report(*_questions(spark, sf))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "packing_targets"), tokenizer)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text or piece, for every capacity."""
    return _packed(spark, sf)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and share of their space filled, for every capacity."""
    return packing.fill_report(_packed(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold held-out passages, with the items they hold."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each test item leaked into."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The demanding English documents."""
    documents = table(spark, sf, "documents")
    grades = reading.fit(documents, table(spark, sf, "reading_labels"))
    return reading.demanding(reading.score(documents, grades), grades)


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, sf).select("doc_id", "level", "is_english", "n_words", "n_sentences")


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p6_containers, p6_fill, p7_found, p7_report, p8_found, p8_levels)}
ORACLES = oracles.ORACLES
