"""Session helpers: the shared folder, checkpoints, and the package on the workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session without the setting gets a private folder only when master and
    workers are one process (``local[...]``, as in tests). Anywhere else the
    setting is required, because executors can't see each other's disks.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tapewise-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the reliable checkpoint folder.

    Used where a wide result feeds several consumers, so that it is computed
    once and a lost executor re-reads files instead of recomputing the lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_in_place(df: DataFrame) -> DataFrame:
    """As :func:`staged`, and Spark still knows how the rows are partitioned and sorted.

    Windows, aggregates and joins by the key of the last shuffle then need no other. Adaptive
    execution would forget it, as it may merge partitions, so it is off for this plan alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return staged(df)
    finally:
        conf.set(key, was)


def tabled(df: DataFrame) -> DataFrame:
    """Write a wide intermediate result as Parquet to the checkpoint folder and read it back.

    As :func:`staged`, for tables whose consumers need different columns: each reads its own.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds that are done.

    Spark does so when the driver collects the plans that made them, which a loop of many
    rounds on few driver objects may not bring about for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a staged table of narrow rows for broadcast when it has at most ``max_rows``.

    ``df`` must already be staged, so that counting it reads a written table. A
    larger table is returned unmarked and its join shuffles.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tapewise-ship-"), "tapewise_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)  # Spark's own file server hands it to each executor
    _SHIPPED.add(sc.applicationId)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Give Python workers whole texts in batches of ``BATCH_ROWS`` rows at most.

    An executor holds a batch outside its heap, in arrays that double as they grow, and the
    worker holds it again. With Spark's 10,000 rows that is dozens of megabytes a task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tune(spark: SparkSession) -> None:
    """Let small inputs keep their cores.

    Per-asset windows do much work per byte, and merging small shuffle partitions
    down to one would leave it to one core. Large inputs are not affected.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
