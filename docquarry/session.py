"""Session helpers: reading the given tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written: its shuffle files are deleted after it, and batches for Python hold few enough rows for long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
#: Settings while a table is read whose rows take long: parts so small that every core gets several.
READING = {"spark.sql.files.maxPartitionBytes": str(16 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        context = spark.sparkContext
        held = context.getCheckpointDir()
        if not held:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
            held = context.getCheckpointDir()
        base = held
    return base.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def spread(rows: DataFrame, each: int = 3, least: int = 100) -> DataFrame:
    """``rows``, dealt out anew where one part (a row group can't be split) holds more than one in ``each`` of a core's share; parts of ``least`` rows at least. Rows are counted first."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    most, all_ = held[0] or 0, held[1] or 0
    parts = min(cores * each, all_ // least)
    return rows.repartition(parts) if parts > 1 and most * parts > all_ * 1.5 else rows


class Scratch:
    """Intermediate tables of one run of an operator, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks that read it. ``save`` asks Spark
    to delete the shuffle files behind a table once it is written, and ``drop`` deletes a table that nothing
    lazy still reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, name: str, build: DataFrame | Callable[[], DataFrame], batch: int | None = None) -> DataFrame:
        """Write a table and read it back; ``batch``: rows at a time for Python, where they are large."""
        frame = build() if callable(build) else build
        with settings(self.spark, WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)} if batch else {})):
            frame.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def _at(self, name: str) -> tuple:
        """A table's file system and path, in any store that Spark writes."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def holds(self, *names: str) -> bool:
        """Whether all of these tables are still there."""
        return all(files.exists(path) for files, path in map(self._at, names))

    def drop(self, *names: str) -> None:
        for files, path in map(self._at, names):
            files.delete(path, True)
