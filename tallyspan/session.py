"""Session factory, input tables and shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings this library expects; ``conf`` adds to them."""
    builder = SparkSession.builder.master(master).appName("tallyspan")
    return builder.config(map=SETTINGS | conf).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: A scan of more bytes than this is spread if it has fewer partitions than cores.
SPREAD_BYTES = 2_000_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory.

    A table in a few unsplittable files would keep most cores idle, so its rows
    are spread; a table of many splits, as any large one, is read as it is.
    """
    ship(spark)
    rows = spark.read.parquet(f"{directory}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if stored_bytes(rows) > SPREAD_BYTES and rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where that setting is absent, a local session, as in tests, takes a
    temporary folder and sets it; on a cluster that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read, and a
    result that is used several times is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A lookup table is sent to all tasks if it takes at most so many bytes.
BROADCAST_BYTES = 8_000_000
#: Else both sides are shuffled, each key spread over so many tasks.
SALTS = 16


def stored_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``; for a table of files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def look_up(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins rows to a table with one row a key, whatever the share of a key.

    ``small`` should be materialised, so that its size is known.  Up to
    ``limit`` bytes it is broadcast; a larger one is copied for each of SALTS
    salts, so that the rows of a hot key meet in that many tasks.
    """
    if stored_bytes(small) <= limit:
        return rows.join(F.broadcast(small), keys, how)
    salts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.hint("merge").join(salts, [*keys, "_salt"], how).drop("_salt")
