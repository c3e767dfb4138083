"""Session defaults, the shared work folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The settings every job relies on. Time arithmetic is written for a UTC session; a handful of
# large messages must not blow up one Arrow batch; a hot key is split by the adaptive planner
# even when the split costs the next operator a shuffle.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app: str = "mailframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    extra = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for local masters."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="mailframe-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _location(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table or folder is there."""
    system, where = _location(spark, path)
    return system.exists(where)


# With this on, the shuffle files of a query go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write ``df``, drop the shuffles that it took, and read it back."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    return _write(df, work_dir(df.sparkSession, name))


def drop_staged(*tables: DataFrame) -> None:
    """Remove what ``stage`` wrote for these tables; nothing may read them any more."""
    for table in tables:
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            system, where = _location(table.sparkSession, folder)
            system.delete(where, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like ``stage`` whose tables are removed at the end of the block.

    What the block returns must not read them any more: stage it with ``stage``.
    """
    root = work_dir(spark, name)
    numbers = iter(range(1_000_000))
    try:
        yield lambda df, label: _write(df, f"{root}/{next(numbers)}-{label}")
    finally:
        system, where = _location(spark, root)
        system.delete(where, True)
