"""Append-only intake of observations and decisions as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicated(stream: DataFrame) -> DataFrame:
    """First delivery of each payload, however late it comes.

    The hashes seen are kept as state: the store is append-only, and a late row counts.

    Revisions carry their own hash and stay separate rows. An observation that
    would be known before it happened fails the stream.
    """
    checked = stream.where(F.assert_true(F.col("available_ts") >= F.col("event_ts"),
                                         F.lit("observation available before its event")).isNull())
    return checked.dropDuplicates(["payload_hash"])


def append_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str, state: str,
                  transform=lambda df: df, files_per_batch: int | None = None) -> DataFrame:
    """Drain the files of ``source`` into the parquet table ``sink``, exactly once.

    The checkpoint in ``state`` remembers what has been taken, so a later run only
    adds new files; batches are the flush unit.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (transform(reader.parquet(source)).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def intake(spark: SparkSession, source: str, schema: T.StructType, sink: str, state: str, files_per_batch: int | None = None) -> DataFrame:
    return append_stream(spark, source, schema, sink, state, deduplicated, files_per_batch)
