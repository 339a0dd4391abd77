"""Queries for evaluation analytics, split leakage and integrity, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspan.functions import text
from tallyspan.operators import metrics, profile
from tallyspan.operators.names import named_spans
from tallyspan.plans.retrieval_queries import dense_top
from tallyspan.session import table

# The label that the category of a question foretells.
FORETOLD = {
    "unavailable_value": "INSUFFICIENT_EVIDENCE",
    "temporal_mismatch": "INSUFFICIENT_EVIDENCE",
    "geographic_mismatch": "INSUFFICIENT_EVIDENCE",
    "unsupported_causality": "INSUFFICIENT_EVIDENCE",
    "false_premise": "INSUFFICIENT_EVIDENCE",
    "out_of_scope": "OUT_OF_SCOPE",
    "partially_answerable": "PARTIALLY_ANSWERABLE",
    "direct_lookup": "ANSWERABLE",
    "comparison": "ANSWERABLE",
    "descriptive_trend": "ANSWERABLE",
    "aggregation": "ANSWERABLE",
}


def path(raw: Column) -> Column:
    """A benchmark file's path in its plain spelling."""
    return F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("\\"), F.lit("/")), r"^\./", "")


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Gold label, label by category and label by the question's wording."""
    rows = table(spark, sf, "qa_examples")
    category = F.lower(F.trim("category"))
    by_category = F.create_map(*(F.lit(x) for pair in FORETOLD.items() for x in pair))[category]
    words = text.phrase(F.col("question"))
    causal = text.has_phrase(words, "why") | text.has_phrase(words, "will")
    return rows.select(
        "example_id",
        path(F.col("benchmark_file")).alias("benchmark_file"),
        category.alias("category"),
        metrics.label(F.col("answerability")).alias("gold"),
        by_category.alias("by_category"),
        F.when(causal, "INSUFFICIENT_EVIDENCE").when(F.col("question").isNotNull(), "ANSWERABLE").alias("by_wording"),
    )


def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Gold against predicted labels, zero cells included."""
    return metrics.confusion(_predictions(spark, sf), "gold", "by_category")


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall, F1 and support of every label."""
    return metrics.per_label(_predictions(spark, sf), "gold", "by_category")


def file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, macro-F1, abstention and coverage of every benchmark file."""
    return metrics.classification(_predictions(spark, sf), ["benchmark_file"], "gold", "by_category")


def split_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out minus development metrics, files grouped by their name's kind."""
    rows = _predictions(spark, sf).withColumn("split", F.regexp_extract("benchmark_file", r"/(heldout|dev)_", 1)).where("split <> ''")
    m = metrics.classification(rows, ["split"], "gold", "by_category")
    names = ["accuracy", "macro_f1", "abstention_precision", "abstention_recall", "coverage"]
    long = m.unpivot(["split"], names, "metric", "value")
    return long.groupBy("metric").agg(F.max(F.when(F.col("split") == "dev", F.col("value"))).alias("dev"), F.max(F.when(F.col("split") == "heldout", F.col("value"))).alias("heldout")).withColumn("gap", F.col("heldout") - F.col("dev"))


def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Which of two predictors was right, per category."""
    rows = _predictions(spark, sf).where("gold is not null")
    first, second = (F.coalesce(F.col(c) == F.col("gold"), F.lit(False)) for c in ("by_category", "by_wording"))
    outcome = F.when(first & second, "both").when(first, "category_only").when(second, "wording_only").otherwise("neither")
    return rows.groupBy("category", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of error per file, category and in total (grouping sets)."""
    rows = _predictions(spark, sf).where("gold is not null")
    gold, said = F.col("gold"), F.col("by_category")
    kind = (
        F.when(said.isNull(), "failure").when(said == gold, "correct")
        .when(gold.isin(*metrics.ABSTAIN) & ~said.isin(*metrics.ABSTAIN), "unsafe_answer")
        .when(~gold.isin(*metrics.ABSTAIN) & said.isin(*metrics.ABSTAIN), "needless_abstention")
        .when(gold.isin(*metrics.ABSTAIN), "wrong_abstention").otherwise("partial_confused")
    )
    return spark.sql("SELECT benchmark_file, category, kind, count(*) AS n FROM {errors} GROUP BY GROUPING SETS ((kind), (benchmark_file, kind), (category, kind))", errors=rows.withColumn("kind", kind))


def _recalls(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = dense_top(spark, sf)
    # What is found needs no list of all wanted pairs: only how many there are.
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n_wanted"))
    hits = found.join(queries, "query_id").join(vectors.withColumnRenamed("label", "found_label"), "vec_id")
    per = hits.groupBy("query_id", "label").agg(*(F.count_if((F.col("rank") <= k) & (F.col("label") == F.col("found_label"))).alias(f"k{k}") for k in (1, 3, 5, 10)))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n")) for k in (1, 3, 5, 10))))
    return per.select("query_id", "label", long.alias("r")).join(sizes, "label").select("query_id", "label", "r.k", (F.col("r.n") / F.col("n_wanted")).alias("recall"), (F.col("r.n") / F.col("r.k")).alias("precision"))


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Recall and precision at 1, 3, 5 and 10 of each query vector."""
    return _recalls(spark, sf)


def mean_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Mean recall at k in total and per label (grouping sets)."""
    return spark.sql("SELECT k, label, count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision FROM {found} GROUP BY GROUPING SETS ((k), (k, label))", found=_recalls(spark, sf))


def _gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest other vector of each query: its score, and if it shares the label."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label")
    near = dense_top(spark, sf).where("query_id <> vec_id").groupBy("query_id").agg(F.min_by(F.struct("vec_id", "score"), "rank").alias("b")).select("query_id", "b.*")
    rows = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return rows.select("query_id", "score", (F.col("label") == F.col("own")).alias("is_good"))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Gate metrics for every score threshold."""
    sweep = metrics.threshold_sweep(_gate_scores(spark, sf), "score", "is_good")
    return sweep.where("threshold < 2").select("threshold", F.round("macro_f1", 9).alias("macro_f1"), F.round("abstention_recall", 9).alias("abstention_recall"), "n_allowed")


def threshold_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best threshold."""
    return metrics.best_threshold(metrics.threshold_sweep(_gate_scores(spark, sf), "score", "is_good"))


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Range of the gate's scores over good and bad queries."""
    return _gate_scores(spark, sf).groupBy("is_good").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


def numeric_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each computed result meets the expected value within tolerance."""
    record = F.col("record_json")
    read = lambda p: F.coalesce(F.get_json_object(record, f"$.{p}"), F.get_json_object(record, f"$.example.{p}"))
    gold, made = read("expected_answer.numeric_value").try_cast("double"), read("computation.result").try_cast("double")
    tolerance = F.coalesce(read("expected_answer.numeric_tolerance").try_cast("double"), F.lit(0.0))
    verdict = F.when(gold.isNull(), "no_gold").when(made.isNull(), "no_number").when(F.abs(made - gold) <= tolerance, "equal").otherwise("different")
    return table(spark, sf, "qa_examples").select("example_id", verdict.alias("verdict"), F.round(made - gold, 6).alias("error"))


def event_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Count, total, mean and exact median of the events' values by type."""
    events = table(spark, sf, "events")
    middle = profile.exact_medians(events, ["event_type"], "value", 1.0)
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean")).join(middle, "event_type")


# --- leakage and integrity ---------------------------------------------------------


def _split_questions(spark: SparkSession, sf: str) -> DataFrame:
    manifests = table(spark, sf, "freeze_manifests")
    frozen = manifests.where("lower(trim(freeze_status)) = 'frozen' and benchmark_file is not null").select(path(F.col("benchmark_file")).alias("file"), F.lit("evaluation").alias("split"))
    training = manifests.where("development_benchmark is not null").select(path(F.col("development_benchmark")).alias("file"), F.lit("training").alias("split"))
    # A bounded number of files stand in the manifests.
    roles = F.broadcast(frozen.unionByName(training).distinct())
    rows = table(spark, sf, "qa_examples").withColumn("file", path(F.col("benchmark_file")))
    return rows.join(roles, "file")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Keys that both splits have, with their counts: no pair is formed."""
    sides = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(F.col("split") == "evaluation").alias("n_evaluation"), F.count_if(F.col("split") == "training").alias("n_training"))
    return sides.where("n_evaluation > 0 and n_training > 0")


def leak_ids(spark: SparkSession, sf: str) -> DataFrame:
    """External ids that occur in both splits."""
    return _shared(_split_questions(spark, sf), "ext_id")


def leak_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of equal words that occur in both splits."""
    return _shared(_split_questions(spark, sf).withColumn("words", text.phrase(F.col("question"))), "words")


def leak_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that are equal but for years and other numbers."""
    template = F.regexp_replace(F.regexp_replace(text.phrase(F.col("question")), "(?:19|20)[0-9]{2}", "<year>"), "[0-9]+", "<number>")
    return _shared(_split_questions(spark, sf).withColumn("template", template), "template")


def leak_place_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that are equal but for places, years and other numbers."""
    census, regions = table(spark, sf, "census_rows"), table(spark, sf, "region_rows")
    label = F.regexp_replace(F.trim("number_label"), r" - Total\z", "")
    names = census.select(label.alias("n")).unionByName(census.select(F.col("planning_area").alias("n"))).unionByName(regions.select(F.col("planning_region").alias("n")))
    names = names.select(text.phrase(F.col("n")).alias("name")).where("name not in ('', 'total')").distinct()
    rows = _split_questions(spark, sf).select("example_id", "split", text.phrase(F.col("question")).alias("words"))
    spans = named_spans(rows.select("example_id", "words").where("words is not null").distinct(), "example_id", "words", names)
    places = spans.groupBy("example_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), "name"))).alias("places"))
    rows = rows.join(places, "example_id", "left")
    # Blanks are doubled, so that neighbouring names do not share one.
    spread = F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))
    spread_name = lambda p: F.concat(F.lit(" "), F.replace(p["name"], F.lit(" "), F.lit("  ")), F.lit(" "))
    bare = F.when(F.col("places").isNull(), spread).otherwise(F.aggregate("places", spread, lambda t, p: F.replace(t, spread_name(p), F.lit(" <place> "))))
    template = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(bare, " +", " ")), "(?:19|20)[0-9]{2}", "<year>"), "[0-9]+", "<number>")
    return _shared(rows.withColumn("template", template), "template")


def leak_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Equal non-empty sets of required evidence in both splits, by checksum."""
    record = F.col("record_json")
    listed = F.coalesce(F.get_json_object(record, "$.required_evidence"), F.get_json_object(record, "$.example.required_evidence"))
    ids = F.array_sort(F.array_distinct(F.from_json(listed, "array<string>")))
    rows = _split_questions(spark, sf).withColumn("evidence", F.when(F.size(ids) > 0, F.sha2(F.array_join(ids, "|"), 256)))
    return _shared(rows, "evidence")


def internal_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that a file holds more than once."""
    rows = table(spark, sf, "qa_examples").where("question is not null").select(path(F.col("benchmark_file")).alias("file"), text.phrase(F.col("question")).alias("words"))
    return rows.groupBy("file", "words").agg(F.count("*").alias("n")).where("n > 1")


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and categories by file (grouping sets)."""
    return spark.sql("SELECT benchmark_file, category, gold, count(*) AS n FROM {labels} GROUP BY GROUPING SETS ((benchmark_file, gold), (benchmark_file, category), (category, gold))", labels=_predictions(spark, sf))


def file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """An order-free checksum of each benchmark file, merged from its rows'."""
    digest = F.conv(F.substring(F.sha2("record_json", 256), 1, 15), 16, 10).cast("long")
    return table(spark, sf, "qa_examples").groupBy(path(F.col("benchmark_file")).alias("file")).agg(F.count("*").alias("n"), F.bit_xor(digest).alias("checksum"))


def missing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Required census evidence that no census row provides."""
    from tallyspan.operators import observations as obs

    record = F.col("record_json")
    listed = F.coalesce(F.get_json_object(record, "$.required_evidence"), F.get_json_object(record, "$.example.required_evidence"))
    wanted = table(spark, sf, "qa_examples").select("example_id", F.explode(F.from_json(listed, "array<string>")).alias("evidence_id")).where("evidence_id is not null")
    wanted = wanted.withColumn("evidence_id", F.lower(F.trim("evidence_id"))).where(F.col("evidence_id").startswith(obs.CENSUS_SOURCE)).distinct()
    known = obs.census_observations(table(spark, sf, "census_rows")).select("evidence_id").distinct()
    return wanted.join(known, "evidence_id", "left_anti")


def order_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by year, region, nation and segment at every published level."""
    orders, customers, nations, regions = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.year("o_orderdate").alias("y"), "r_name", "n_name", "c_mktsegment", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return spark.sql(
        """SELECT y AS year, r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n_orders, sum(cents) AS total_cents, sum(cents) / count(*) AS mean_cents
           FROM {rows} GROUP BY GROUPING SETS ((y), (y, r_name), (y, r_name, n_name), (y, r_name, c_mktsegment), (y, r_name, n_name, c_mktsegment))""",
        rows=rows,
    )


QUERIES = {
    f.__name__: f
    for f in (
        label_confusion, label_scores, file_metrics, split_gap, paired_outcomes, error_kinds, recall_at_k, mean_recall, threshold_sweep, threshold_best, score_distribution, numeric_agreement, event_costs,
        leak_ids, leak_questions, leak_templates, leak_place_templates, leak_evidence, internal_duplicates, label_distribution, file_checksums, missing_evidence, order_cube,
    )
}

# --- SQL -----------------------------------------------------------------------------

_PATH = r"regexp_replace(replace(lower(trim({0}, ' ')), '\', '/'), '^\./', '')"
_PHRASE = r"trim(regexp_replace(lower({0}), '[^\p{{L}}0-9]+', ' ', 'g'), ' ')"
_LABEL = "CASE WHEN {0} IN ('ANSWERABLE', 'PARTIALLY_ANSWERABLE', 'INSUFFICIENT_EVIDENCE', 'OUT_OF_SCOPE') THEN {0} END".format("trim(regexp_replace(upper(answerability), '[^A-Z]+', '_', 'g'), '_')")
_ABSTAIN = "('INSUFFICIENT_EVIDENCE', 'OUT_OF_SCOPE')"
_P = f"""p AS (SELECT example_id, {_PATH.format("benchmark_file")} AS benchmark_file, lower(trim(category, ' ')) AS category, {_LABEL} AS gold,
    CASE lower(trim(category, ' ')) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORETOLD.items())} END AS by_category,
    CASE WHEN contains(' ' || {_PHRASE.format("question")} || ' ', ' why ') OR contains(' ' || {_PHRASE.format("question")} || ' ', ' will ') THEN 'INSUFFICIENT_EVIDENCE' WHEN question IS NOT NULL THEN 'ANSWERABLE' END AS by_wording FROM qa_examples),
  labels AS (SELECT unnest(['ANSWERABLE', 'PARTIALLY_ANSWERABLE', 'INSUFFICIENT_EVIDENCE', 'OUT_OF_SCOPE']) AS label)"""
_DIV = "coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0.0)"


def _metrics_sql(key: str, source: str) -> str:
    f1 = []
    for n in metrics.LABELS:
        hit, said, real = f"count(*) FILTER (WHERE gold = '{n}' AND by_category = '{n}')", f"count(*) FILTER (WHERE by_category = '{n}')", f"count(*) FILTER (WHERE gold = '{n}')"
        f1.append(_DIV.format(f"(2 * {hit})", f"({said} + {real})"))
    abst, right, real = (f"count(*) FILTER (WHERE {c})" for c in (f"by_category IN {_ABSTAIN}", f"by_category IN {_ABSTAIN} AND gold IN {_ABSTAIN}", f"gold IN {_ABSTAIN}"))
    return f"""SELECT {key}, count(*) AS n, count(*) - count(by_category) AS n_failed, {_DIV.format("count(*) FILTER (WHERE gold = by_category)", "count(*)")} AS accuracy, ({" + ".join(f1)}) / 4 AS macro_f1,
      {_DIV.format(right, abst)} AS abstention_precision, {_DIV.format(right, real)} AS abstention_recall, {_DIV.format(f"(count(*) - {abst})", "count(*)")} AS coverage FROM {source} WHERE gold IS NOT NULL GROUP BY {key}"""


_DENSE = """d AS (SELECT q.vec_id AS query_id, q.label AS own, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank, v.vec_id, v.label,
    round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)"""
_RECALL = f"""{_DENSE}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), sizes AS (SELECT label, count(*) AS n_wanted FROM embeddings GROUP BY label),
    rec AS (SELECT query_id, own AS label, k, count(*) FILTER (WHERE rank <= k AND d.label = own) / any_value(n_wanted) AS recall, count(*) FILTER (WHERE rank <= k AND d.label = own) / k AS precision
      FROM d CROSS JOIN ks JOIN sizes s ON s.label = own GROUP BY query_id, own, k)"""
_GATE = f"""{_DENSE}, g AS (SELECT query_id, score, label = own AS is_good FROM d WHERE query_id <> vec_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
    t AS (SELECT score AS threshold, count(*) FILTER (WHERE is_good) AS good, count(*) FILTER (WHERE NOT is_good) AS bad FROM g GROUP BY 1 UNION ALL SELECT 'infinity'::DOUBLE, 0, 0),
    c AS (SELECT threshold, sum(good) OVER w AS tp, sum(bad) OVER w AS fp, sum(good) OVER () AS ag, sum(bad) OVER () AS ab FROM t WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
    sweep AS (SELECT threshold, round(({_DIV.format("(2 * tp)", "(2 * tp + fp + ag - tp)")} + {_DIV.format("(2 * (ab - fp))", "(2 * (ab - fp) + ag - tp + fp)")}) / 2, 9) AS macro_f1, round({_DIV.format("(ab - fp)", "ab")}, 9) AS abstention_recall, CAST(tp + fp AS BIGINT) AS n_allowed FROM c)"""
_SPLITS = f"""roles AS (SELECT DISTINCT {_PATH.format("benchmark_file")} AS file, 'evaluation' AS split FROM freeze_manifests WHERE lower(trim(freeze_status, ' ')) = 'frozen' AND benchmark_file IS NOT NULL
    UNION SELECT DISTINCT {_PATH.format("development_benchmark")}, 'training' FROM freeze_manifests WHERE development_benchmark IS NOT NULL),
  s AS (SELECT q.*, r.* FROM qa_examples q JOIN roles r ON r.file = {_PATH.format("q.benchmark_file")})"""


def _shared_sql(name: str, key: str) -> str:
    return f"""WITH {_SPLITS} SELECT {key} AS {name}, count(*) FILTER (WHERE split = 'evaluation') AS n_evaluation, count(*) FILTER (WHERE split = 'training') AS n_training
      FROM s WHERE {key} IS NOT NULL GROUP BY 1 HAVING n_evaluation > 0 AND n_training > 0"""


_READ = lambda p: f"coalesce(record_json->>'$.{p}', record_json->>'$.example.{p}')"
_REQUIRED = "CAST(coalesce(record_json->'$.required_evidence', record_json->'$.example.required_evidence') AS VARCHAR[])"
_EVIDENCE_SET = f"CASE WHEN len({_REQUIRED}) > 0 THEN sha256(array_to_string(list_sort(list_distinct({_REQUIRED})), '|')) END"

ORACLES = {
    "label_confusion": f"""WITH {_P} SELECT g.label AS gold, q.label AS predicted, count(p.example_id) AS n FROM labels g CROSS JOIN (SELECT label FROM labels UNION ALL SELECT 'MODEL_FAILURE') q
        LEFT JOIN p ON p.gold = g.label AND coalesce(by_category, 'MODEL_FAILURE') = q.label GROUP BY ALL""",
    "label_scores": f"""WITH {_P}, c AS (SELECT label, count(*) FILTER (WHERE gold = label AND by_category = label) AS hit, count(*) FILTER (WHERE by_category = label) AS said, count(*) FILTER (WHERE gold = label) AS support
          FROM labels CROSS JOIN p WHERE gold IS NOT NULL GROUP BY label)
        SELECT label, {_DIV.format("hit", "said")} AS precision, {_DIV.format("hit", "support")} AS recall, {_DIV.format("(2 * hit)", "(said + support)")} AS f1, support FROM c""",
    "file_metrics": f"WITH {_P} {_metrics_sql('benchmark_file', 'p')}",
    "split_gap": f"""WITH {_P}, k AS (SELECT *, regexp_extract(benchmark_file, '/(heldout|dev)_', 1) AS split FROM p WHERE regexp_matches(benchmark_file, '/(heldout|dev)_')), m AS ({_metrics_sql("split", "k")}),
        l AS (SELECT split, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, macro_f1, abstention_precision, abstention_recall, coverage)))
        SELECT metric, max(value) FILTER (WHERE split = 'dev') AS dev, max(value) FILTER (WHERE split = 'heldout') AS heldout, heldout - dev AS gap FROM l GROUP BY metric""",
    "paired_outcomes": f"""WITH {_P} SELECT category, CASE WHEN by_category IS NOT DISTINCT FROM gold AND by_wording IS NOT DISTINCT FROM gold THEN 'both' WHEN by_category IS NOT DISTINCT FROM gold THEN 'category_only'
          WHEN by_wording IS NOT DISTINCT FROM gold THEN 'wording_only' ELSE 'neither' END AS outcome, count(*) AS n FROM p WHERE gold IS NOT NULL GROUP BY ALL""",
    "error_kinds": f"""WITH {_P}, e AS (SELECT *, CASE WHEN by_category IS NULL THEN 'failure' WHEN by_category = gold THEN 'correct' WHEN gold IN {_ABSTAIN} AND by_category NOT IN {_ABSTAIN} THEN 'unsafe_answer'
          WHEN gold NOT IN {_ABSTAIN} AND by_category IN {_ABSTAIN} THEN 'needless_abstention' WHEN gold IN {_ABSTAIN} THEN 'wrong_abstention' ELSE 'partial_confused' END AS kind FROM p WHERE gold IS NOT NULL)
        SELECT benchmark_file, category, kind, count(*) AS n FROM e GROUP BY GROUPING SETS ((kind), (benchmark_file, kind), (category, kind))""",
    "recall_at_k": f"WITH {_RECALL} SELECT query_id, label, k, recall, precision FROM rec",
    "mean_recall": f"WITH {_RECALL} SELECT k, label, count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision FROM rec GROUP BY GROUPING SETS ((k), (k, label))",
    "threshold_sweep": f"WITH {_GATE} SELECT * FROM sweep WHERE threshold < 2",
    "threshold_best": f"WITH {_GATE} SELECT threshold, macro_f1, abstention_recall, n_allowed FROM sweep ORDER BY macro_f1 DESC, abstention_recall DESC, threshold DESC LIMIT 1",
    "score_distribution": f"WITH {_GATE} SELECT is_good, count(*) AS n, min(score) AS least, max(score) AS most FROM g GROUP BY is_good",
    "numeric_agreement": f"""WITH v AS (SELECT example_id, TRY_CAST({_READ("expected_answer.numeric_value")} AS DOUBLE) AS gold, TRY_CAST({_READ("computation.result")} AS DOUBLE) AS made, coalesce(TRY_CAST({_READ("expected_answer.numeric_tolerance")} AS DOUBLE), 0) AS tol FROM qa_examples)
        SELECT example_id, CASE WHEN gold IS NULL THEN 'no_gold' WHEN made IS NULL THEN 'no_number' WHEN abs(made - gold) <= tol THEN 'equal' ELSE 'different' END AS verdict, round(made - gold, 6) AS error FROM v""",
    "event_costs": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, median(value) AS median FROM events GROUP BY event_type",
    "leak_ids": _shared_sql("ext_id", "ext_id"),
    "leak_questions": _shared_sql("words", _PHRASE.format("question")),
    "leak_templates": _shared_sql("template", f"regexp_replace(regexp_replace({_PHRASE.format('question')}, '(?:19|20)[0-9]{{2}}', '<year>', 'g'), '[0-9]+', '<number>', 'g')"),
    "leak_place_templates": f"""WITH {_SPLITS}, names AS (SELECT DISTINCT {_PHRASE.format("n")} AS name FROM (SELECT regexp_replace(trim(number_label, ' '), ' - Total$', '') AS n FROM census_rows UNION SELECT planning_area FROM census_rows UNION SELECT planning_region FROM region_rows) WHERE n IS NOT NULL),
        w AS (SELECT example_id, split, {_PHRASE.format("question")} AS words FROM s),
        l AS (SELECT example_id, list(DISTINCT name) AS names FROM w JOIN names ON contains(' ' || words || ' ', ' ' || name || ' ') AND name NOT IN ('', 'total') GROUP BY example_id),
        b AS (SELECT w.*, list_reduce(list_concat([' ' || replace(words, ' ', '  ') || ' '], [' ' || replace(x, ' ', '  ') || ' ' FOR x IN list_transform(list_sort([lpad(CAST(length(y) AS VARCHAR), 6, '0') || y FOR y IN coalesce(names, [])], 'DESC'), lambda z: z[7:])]), lambda t, p: replace(t, p, ' <place> ')) AS bare FROM w LEFT JOIN l USING (example_id)),
        t AS (SELECT split, regexp_replace(regexp_replace(trim(regexp_replace(bare, ' +', ' ', 'g'), ' '), '(?:19|20)[0-9]{{2}}', '<year>', 'g'), '[0-9]+', '<number>', 'g') AS template FROM b)
        SELECT template, count(*) FILTER (WHERE split = 'evaluation') AS n_evaluation, count(*) FILTER (WHERE split = 'training') AS n_training FROM t WHERE template IS NOT NULL GROUP BY 1 HAVING n_evaluation > 0 AND n_training > 0""",
    "leak_evidence": _shared_sql("evidence", _EVIDENCE_SET),
    "internal_duplicates": f"SELECT {_PATH.format('benchmark_file')} AS file, {_PHRASE.format('question')} AS words, count(*) AS n FROM qa_examples WHERE question IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "label_distribution": f"WITH {_P} SELECT benchmark_file, category, gold, count(*) AS n FROM p GROUP BY GROUPING SETS ((benchmark_file, gold), (benchmark_file, category), (category, gold))",
    "file_checksums": f"SELECT {_PATH.format('benchmark_file')} AS file, count(*) AS n, bit_xor(CAST('0x' || substr(sha256(record_json), 1, 15) AS BIGINT)) AS checksum FROM qa_examples GROUP BY 1",
    "missing_evidence": None,
    "order_cube": """SELECT year(o_orderdate) AS year, r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS mean_cents
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((year(o_orderdate)), (year(o_orderdate), r_name), (year(o_orderdate), r_name, n_name), (year(o_orderdate), r_name, c_mktsegment), (year(o_orderdate), r_name, n_name, c_mktsegment))""",
}
from tallyspan.plans.observation_queries import CENSUS_SQL  # noqa: E402

ORACLES["missing_evidence"] = f"""WITH {CENSUS_SQL}, w AS (SELECT DISTINCT example_id, lower(trim(e, ' ')) AS evidence_id FROM (SELECT example_id, unnest({_REQUIRED}) AS e FROM qa_examples) WHERE e IS NOT NULL)
    SELECT example_id, evidence_id FROM w WHERE starts_with(evidence_id, 'resident_population_census_2020') AND evidence_id NOT IN (SELECT evidence_id FROM census_obs WHERE evidence_id IS NOT NULL)"""
