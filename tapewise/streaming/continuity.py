"""Bar continuity carried from batch to batch, one small state per asset."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "asset_id string, ts timestamp, bars_since_gap int, stale_run int"
STATE = "session_index long, bars_since_gap int, stale_run int, close_raw double, volume double"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, since, run, close, volume = state.get if state.exists else (None, -1, 0, None, None)
    rows = pd.concat(list(batches)).sort_values("ts")  # this batch's bars of one asset
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and r.session_index <= last:  # older than what has been counted
            out.append((key[0], r.ts, None, None))
            continue
        step = None if last is None else r.session_index - last
        since = 0 if step is not None and step > 1 else since + 1
        same = step == 1 and r.volume > 0 and volume > 0 and r.close_raw == close
        run = run + 1 if same else 1
        last, close, volume = int(r.session_index), float(r.close_raw), float(r.volume)
        out.append((key[0], r.ts, since, run))
    state.update((last, since, run, close, volume))
    yield pd.DataFrame(out, columns=["asset_id", "ts", "bars_since_gap", "stale_run"]).astype({"bars_since_gap": "Int32", "stale_run": "Int32"})


def with_continuity(stream: DataFrame) -> DataFrame:
    """Bars since the last hole and length so far of the unchanged-close run.

    Needs asset_id, ts, session_index, close_raw, volume. A bar that comes after a
    later one of its asset has been counted keeps its row, with nulls, and doesn't
    change the state; bars of one batch are ordered here.
    """
    return stream.groupBy("asset_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_continuity(spark: SparkSession, source: str, schema: T.StructType, sink: str, state: str) -> DataFrame:
    """Take the bar files delivered since the last call as one batch, however many."""
    reader = spark.readStream.schema(schema)
    q = (with_continuity(reader.parquet(source)).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
