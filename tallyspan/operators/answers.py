"""Grounded answers: templates, validation, abstention and policies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyspan.functions.text import number_text, number_tokens

#: A provider maps (question, facts) of a batch to answer texts.
Provider = Callable[[pd.DataFrame], pd.Series]


def template_provider(batch: pd.DataFrame) -> pd.Series:
    """The offline provider: the facts, word for word."""
    return batch["facts"]


def generate(contexts: DataFrame, provider: Provider = template_provider) -> DataFrame:
    """Adds ``answer`` to (example_id, question, facts) by a batch provider."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=provider(batch))

    return contexts.select("example_id", "question", "facts").mapInPandas(run, "example_id long, question string, facts string, answer string")


def validated(answers: DataFrame) -> DataFrame:
    """Adds is_exact (the answer holds the facts) and new_numbers (numbers of
    the answer that stand in neither question nor facts)."""
    known = F.array_union(number_tokens(F.col("question")), number_tokens(F.col("facts")))
    fresh = F.array_except(number_tokens(F.col("answer")), known)
    return answers.withColumns({"is_exact": F.contains(F.col("answer"), F.col("facts")), "new_numbers": F.size(fresh)})


def evidence_facts(evidence: DataFrame) -> DataFrame:
    """(example_id, facts): the observed values of each question in rank order."""
    line = F.struct("rank", F.concat(F.col("evidence_id"), F.lit(" = "), number_text(F.col("value"))).alias("line"))
    lists = evidence.where("value is not null").groupBy("example_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lists.select("example_id", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("facts"))


def supported_claims(claims: DataFrame, links: DataFrame, values: DataFrame) -> DataFrame:
    """Whether the numbers that a claim states follow from its evidence.

    A number follows if it is a value of the evidence, their sum, least or
    largest, or the difference of two.  Result: example_id, claim_no, n_numbers,
    n_values, is_supported (null for a claim without numbers).
    """
    known = links.join(values.select("evidence_id", "value"), "evidence_id").groupBy("example_id", "claim_no").agg(F.collect_list("value").alias("v"))
    rows = claims.select("example_id", "claim_no", F.transform(number_tokens(F.col("claim")), lambda n: n.try_cast("double")).alias("numbers"))
    rows = rows.join(known, ["example_id", "claim_no"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<double>")))
    gaps = F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: a - b)))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    allowed = F.concat(F.col("v"), gaps, F.array(total))
    follows = F.forall("numbers", lambda n: F.exists(allowed, lambda x: F.abs(x - n) <= 1e-9))
    return rows.select("example_id", "claim_no", F.size("numbers").alias("n_numbers"), F.size("v").alias("n_values"), F.when(F.size("numbers") > 0, follows).alias("is_supported"))
