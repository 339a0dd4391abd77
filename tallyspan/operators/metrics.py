"""Classification, ranking and threshold metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.text import safe_divide
from tallyspan.session import materialise

# The labels, and those that mean abstention.
LABELS = ("ANSWERABLE", "PARTIALLY_ANSWERABLE", "INSUFFICIENT_EVIDENCE", "OUT_OF_SCOPE")
ABSTAIN = ("INSUFFICIENT_EVIDENCE", "OUT_OF_SCOPE")
FAILURE = "MODEL_FAILURE"


def label(raw: Column) -> Column:
    """A label in its plain spelling; null for null or any other text."""
    plain = F.trim(F.regexp_replace(F.upper(raw), "[^A-Z]+", "_"), F.lit("_"))
    return F.when(plain.isin(*LABELS), plain)


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Count of every gold and predicted label, zero cells included.

    A null prediction is a MODEL_FAILURE; rows without a gold label are left out.
    """
    cells = [(g, p) for g in LABELS for p in (*LABELS, FAILURE)]
    grid = rows.sparkSession.createDataFrame(cells, "gold string, predicted string")
    counts = rows.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("gold"), F.coalesce(predicted, F.lit(FAILURE)).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["gold", "predicted"], "left").na.fill(0, ["n"])


def _scores(name: str) -> dict[str, Column]:
    hit, said, real = (F.col(f"{c}_{name}") for c in ("hit", "said", "real"))
    precision, recall = safe_divide(hit, said), safe_divide(hit, real)
    return {"precision": precision, "recall": recall, "f1": safe_divide(2 * precision * recall, precision + recall)}


def classification(rows: DataFrame, keys: Sequence[str], gold: str, predicted: str) -> DataFrame:
    """Accuracy, macro-F1 over all labels, abstention and coverage per group.

    An empty denominator gives 0; a null prediction is wrong but no abstention.
    """
    g, p = F.col(gold), F.col(predicted)
    counts = {}
    for name in LABELS:
        counts[f"hit_{name}"] = F.count_if((g == name) & (p == name))
        counts[f"said_{name}"] = F.count_if(p == name)
        counts[f"real_{name}"] = F.count_if(g == name)
    said, real = F.coalesce(p.isin(*ABSTAIN), F.lit(False)), g.isin(*ABSTAIN)
    base = rows.where(g.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(g == p).alias("n_correct"), F.count_if(p.isNull()).alias("n_failed"),
        F.count_if(said).alias("n_abstained"), F.count_if(said & real).alias("n_abstained_rightly"), F.count_if(real).alias("n_to_abstain"),
        *(c.alias(n) for n, c in counts.items()),
    )
    macro = sum((_scores(name)["f1"] for name in LABELS), F.lit(0.0)) / len(LABELS)
    return base.select(
        *keys, "n", "n_failed",
        safe_divide(F.col("n_correct"), F.col("n")).alias("accuracy"),
        macro.alias("macro_f1"),
        safe_divide(F.col("n_abstained_rightly"), F.col("n_abstained")).alias("abstention_precision"),
        safe_divide(F.col("n_abstained_rightly"), F.col("n_to_abstain")).alias("abstention_recall"),
        safe_divide(F.col("n") - F.col("n_abstained"), F.col("n")).alias("coverage"),
    )


def per_label(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every label."""
    cells = confusion(rows, gold, predicted)
    parts = cells.select(F.explode(F.array(*(F.struct(F.lit(n).alias("label"), (F.col("gold") == n).alias("real"), (F.col("predicted") == n).alias("said")) for n in LABELS))).alias("x"), "n").select("x.*", "n")
    sums = parts.groupBy("label").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{a}_x") for a, c in (("hit", F.col("real") & F.col("said")), ("said", F.col("said")), ("real", F.col("real")))))
    return sums.select("label", *(c.alias(n) for n, c in _scores("x").items()), F.col("real_x").alias("support"))


def recall_at(found: DataFrame, wanted: DataFrame, query: str, item: str, ks: Sequence[int]) -> DataFrame:
    """Recall of each query's wanted items among its first k, for each k.

    ``found`` has query, rank and item; ``wanted`` query and item.  A query
    without wanted items has no row, as its recall is undefined.
    """
    wanted = wanted.select(query, item).distinct()
    first = found.groupBy(query, item).agg(F.min("rank").alias("rank"))
    rows = wanted.join(first, [query, item], "left").groupBy(query).agg(
        F.count("*").alias("n_wanted"), *(F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks)
    )
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.col("n_wanted")).alias("recall")) for k in ks)))
    return rows.select(query, "n_wanted", long.alias("r")).select(query, "n_wanted", "r.k", "r.recall")


#: Bins of the score range; what is ordered in one task is one row a bin.
_BINS = 4096


def threshold_sweep(rows: DataFrame, score: str, allowed: str) -> DataFrame:
    """Metrics of the gate ``score >= threshold`` for every score that occurs.

    A null or NaN score is always blocked.  Result: threshold, macro_f1 of allow
    and block, abstention_recall, n_allowed.  One more threshold, infinity,
    blocks all.  Running counts are taken within bins of the score range and over
    the bins, so no task orders all scores.
    """
    value = F.col(score).cast("double")
    counts = rows.groupBy(F.when(~F.isnan(value), value).alias("threshold")).agg(F.count_if(F.col(allowed)).alias("good"), F.count_if(~F.col(allowed)).alias("bad"))
    counts = materialise(counts)
    ends = counts.agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    low, width = ends["low"] or 0.0, ((ends["high"] or 0.0) - (ends["low"] or 0.0)) / _BINS or 1.0
    scores = counts.where("threshold is not null").withColumn("bin", F.floor((F.col("threshold") - low) / width))
    bins = scores.groupBy("bin").agg(F.sum("good").alias("bin_good"), F.sum("bad").alias("bin_bad"))
    # One row a bin.
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("bin_good").over(above), F.lit(0)).alias("good_above"), F.coalesce(F.sum("bin_bad").over(above), F.lit(0)).alias("bad_above"))
    within = Window.partitionBy("bin").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = scores.join(F.broadcast(bins), "bin").select("threshold", (F.col("good_above") + F.sum("good").over(within)).alias("tp"), (F.col("bad_above") + F.sum("bad").over(within)).alias("fp"))
    none = rows.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp long, fp long")
    steps = steps.unionByName(none)
    all_good, all_bad = F.lit(ends["good"] or 0), F.lit(ends["bad"] or 0)
    fn, tn = all_good - F.col("tp"), all_bad - F.col("fp")
    f1 = lambda hit, wrong, lost: safe_divide(2 * hit, 2 * hit + wrong + lost)
    macro = (f1(F.col("tp"), F.col("fp"), fn) + f1(tn, fn, F.col("fp"))) / 2
    return steps.select("threshold", macro.alias("macro_f1"), safe_divide(tn, all_bad).alias("abstention_recall"), (F.col("tp") + F.col("fp")).alias("n_allowed"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of best macro-F1, then abstention recall, then height."""
    best = sweep.agg(F.max(F.struct(F.round("macro_f1", 9).alias("m"), F.round("abstention_recall", 9).alias("a"), "threshold", "n_allowed")).alias("b"))
    return best.select("b.threshold", F.col("b.m").alias("macro_f1"), F.col("b.a").alias("abstention_recall"), "b.n_allowed")
