"""Session settings and tables staged in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "foliant", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC times, adaptive execution and skew handling; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="foliant-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that are sent to all tasks at most, so that the rows they meet stay where they are.
SENT_KEYS = 1_000_000


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, is pruned by column and survives lost executors. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foliant/{uuid.uuid4().hex}/{name}"
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_end_here(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a table from :func:`staged` that nothing reads any more."""
    remove_folder(table.sparkSession, table.staged_at)


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right in a folder."""
    folder, files = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory())


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of the data files right in a folder."""
    folder, files = _file_system(spark, path)
    found = [(f.getPath(), f.getLen()) for f in files.listStatus(folder) if f.isFile()]
    return sorted((p.toString(), size) for p, size in found if not p.getName().startswith(("_", ".")))


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Keys of a written table, which go to all tasks where they are few enough; counting reads no column. Else Spark chooses."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def spread(df: DataFrame) -> DataFrame:
    """Deal a table over all cores where few tasks would read most of it: a small file, or files of few row groups, which Spark cannot cut. Other tables pass
    without a shuffle. Rows are counted by task, which reads no column of a plain scan; a plan with shuffles would run to be counted."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < cores:
        return df.repartition(cores)
    largest, rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return df.repartition(parts) if rows and largest * cores > 2 * rows else df
