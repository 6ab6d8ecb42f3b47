"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows that goes to a Python worker, however long texts are; a batch has one row at least.
BATCH_BYTES = 4 << 20
#: Partitions that ``dealt`` makes at most, as a multiple of the session's; estimates from which on a size counts as unknown.
MOST_TIMES, UNKNOWN_BYTES = 32, 1 << 60
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own where it is unset, in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerlens"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that sets no bound itself: what a worker holds then doesn't grow with the length of texts."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it are dropped once the table is written. ``discard`` removes the table.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    for made in _recorded:
        made.append(out)
    return out


_recorded: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that materialize writes inside, as they come."""
    made: list[DataFrame] = []
    _recorded.append(made)
    try:
        yield made
    finally:
        _recorded[:] = [x for x in _recorded if x is not made]


def discard_unread(tables: list[DataFrame], result: DataFrame) -> None:
    """Delete those of tables, made by materialize, from which result doesn't read any more."""
    read = [f.split("://")[-1].lstrip("/") for f in result.inputFiles()]
    for t in tables:
        path = t._written_to.split("://")[-1].lstrip("/").removeprefix("file:").lstrip("/")
        if not any(path in f for f in read):
            discard(t)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize that no later result reads."""
    for t in tables:
        remove_path(t.sparkSession, t._written_to)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too small for Spark to cut them into as many splits; else as it is.

    The bound is what opening a file counts for (spark.sql.files.openCostInBytes, 4 MB) for every core.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * (4 << 20) else df


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, key: str, task_bytes: int) -> DataFrame:
    """df shuffled by key; where the session's partitions or its cores would hold more than task_bytes by Spark's estimate, over as many as keep to it.

    Their number is then fixed: Spark would merge the session's own by their bytes, which are few against the memory that rows take.
    At most MOST_TIMES as many, since estimates behind joins are products; tables whose size Spark doesn't know take the session's.
    """
    own, size = shuffle_partitions(df.sparkSession), estimated_bytes(df)
    n = min(-(-size // task_bytes), MOST_TIMES * own) if size < UNKNOWN_BYTES else 0
    return df.repartition(n, key) if n > min(own, df.sparkSession.sparkContext.defaultParallelism) else df.repartition(key)
