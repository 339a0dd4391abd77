"""JSON lines, immutable outputs, checksums and vector artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyspan.operators.dense import vector_faults


class CorpusError(ValueError):
    """A corpus file that breaks the contract of its reader."""


def canonical(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as JSON with members in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, immutable: bool = False) -> None:
    """Writes canonical JSON lines; an immutable output must not exist yet.

    Spark's commit protocol makes the files visible when all are complete.
    """
    canonical(df).write.mode("errorifexists" if immutable else "overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """JSON lines with exactly this schema: malformed lines fail the read.

    With ``key``, a repeated key raises :class:`CorpusError`.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        repeated = rows.groupBy(key).count().where("count > 1").limit(1).collect()
        if repeated:
            raise CorpusError(f"repeated {key}: {repeated[0][0]}")
    return rows


def schema_faults(df: DataFrame, expected: list[tuple[str, str]]) -> list[str]:
    """Differences of names, types and order from the expected columns."""
    return [f"column {i}: {got} instead of {want}" for i, (got, want) in enumerate(zip([*df.dtypes, *[None] * len(expected)], [*expected, *[None] * len(df.dtypes)], strict=False)) if got != want]


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest of checksums."""
    both = current.alias("c").join(manifest.alias("m"), "path", "full")
    state = F.when(F.col("c.sha256").isNull(), "missing").when(F.col("m.sha256").isNull(), "new").when(F.col("c.sha256") != F.col("m.sha256"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(evidence_id, embedding) as parquet, clustered by id."""
    vectors.select("evidence_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str, size: int, units: DataFrame) -> DataFrame:
    """Vectors that fit the units: raises unless ids agree and lengths are 1."""
    vectors = spark.read.parquet(path)
    lost = units.select("evidence_id").join(vectors, "evidence_id", "left_anti").limit(1).count()
    foreign = vectors.join(units, "evidence_id", "left_anti").limit(1).count()
    faulty = vector_faults(vectors, "evidence_id", "embedding", size).limit(1).count()
    if lost or foreign or faulty:
        raise CorpusError(f"vectors do not fit: missing {lost}, foreign {foreign}, faulty {faulty}")
    return vectors
