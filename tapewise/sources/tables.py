"""Reads and writes of the library's tables as partitioned parquet, CSV and text."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.operators.panel import schema_gap

# Column contracts of the raw tables.
OHLCV_COLUMNS = ("asset_id", "symbol", "session", "open", "high", "low", "close", "volume", "dividend", "split_ratio")
ACTION_COLUMNS = ("asset_id", "ex_date", "action_type", "split_ratio", "cash_amount", "new_symbol")
TICKER_COLUMNS = ("asset_id", "symbol", "exchange", "category", "sector", "is_etf", "listed_date", "delisted_date", "delist_reason")
EARNINGS_COLUMNS = ("asset_id", "earnings_date", "is_confirmed", "available_ts", "timing")


def require_columns(df: DataFrame, expected: tuple[str, ...], name: str) -> DataFrame:
    missing, _ = schema_gap(df, expected)
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    return df.select(*expected)


def write_by_year(df: DataFrame, path: str, day: str, sort: list[str]) -> None:
    """One folder per year; only the years present in ``df`` are replaced.

    Spark's committer publishes the files of a job together and marks the folder
    with ``_SUCCESS`` last. Rows are ordered inside their files only.
    """
    (df.withColumn("year", F.year(day)).repartition("year", F.col(sort[-1])).sortWithinPartitions(*sort)
     .write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def scan_panel(spark: SparkSession, path: str, ids: DataFrame | list[str], start, end) -> DataFrame:
    """Panel rows of some assets between two instants, both inclusive.

    The year bounds prune folders; the timestamp bounds reach the parquet reader.
    """
    if isinstance(ids, list):
        ids = spark.createDataFrame([(i,) for i in set(ids)], "asset_id string")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = spark.read.parquet(path).where(F.col("year").between(F.year(lo), F.year(hi)) & F.col("ts").between(lo, hi))
    return rows.join(ids.select("asset_id").distinct(), "asset_id", "left_semi").drop("year")


def available_range(panel: DataFrame, asset_id: str) -> DataFrame:
    """First and last timestamp of an asset; no row when it has none."""
    return panel.where(F.col("asset_id") == asset_id).groupBy("asset_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def read_raw_bars(spark: SparkSession, path: str, expected: tuple[str, ...]) -> DataFrame:
    return require_columns(spark.read.parquet(path), expected, "raw bars")


def snapshot_manifest(bars: DataFrame, actions: DataFrame, earnings: DataFrame, vendor: str) -> DataFrame:
    """One row: names, rows and span of the bars, and row counts of the others."""
    b = bars.agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("ohlcv_rows"),
                 F.min("session").alias("first_session"), F.max("session").alias("last_session")).withColumn("_k", F.lit(1))
    a = actions.agg(F.count(F.lit(1)).alias("actions_rows")).withColumn("_k", F.lit(1))
    e = earnings.agg(F.count(F.lit(1)).alias("earnings_rows")).withColumn("_k", F.lit(1))
    out = b.join(F.broadcast(a), "_k").join(F.broadcast(e), "_k").drop("_k")  # one row each
    return out.withColumn("snapshot_id", F.concat(F.date_format("last_session", "yyyyMMdd"), F.lit(f"-{vendor}")))


def read_candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """``asset_id,symbol`` lines; blanks and # comments are skipped, others must parse."""
    line = F.trim("value")
    rows = spark.read.text(path).where((F.length(line) > 0) & ~line.startswith("#")).withColumn(
        "_p", F.transform(F.split(line, ","), lambda p: F.trim(p)))
    checked = rows.where(F.assert_true(F.size("_p") == 2, F.concat(F.lit("expected asset_id,symbol, got "), line)).isNull())
    return checked.select(F.element_at("_p", 1).alias("asset_id"), F.element_at("_p", 2).alias("symbol"))


def write_candidate_lines(candidates: DataFrame, path: str, mode: str = "append") -> None:
    candidates.select(F.concat_ws(",", "asset_id", "symbol").alias("value")).write.mode(mode).text(path)


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headered bulk table with lower-cased column names, all text."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.lower() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def normalise_ohlcv(bars: DataFrame, tickers: DataFrame) -> DataFrame:
    """Typed bars: incomplete rows dropped, neutral defaults, blank symbols filled."""
    b = require_columns(bars, OHLCV_COLUMNS, "ohlcv").dropna(subset=["open", "high", "low", "close", "volume"])
    names = tickers.groupBy("asset_id").agg(F.min("symbol").alias("_sym"))
    b = b.join(names, "asset_id", "left")
    blank = F.coalesce(F.length("symbol") == 0, F.lit(True))
    out = b.select(
        F.col("asset_id").cast("string").alias("asset_id"), F.when(blank, F.col("_sym")).otherwise(F.col("symbol")).alias("symbol"),
        F.to_date("session").alias("session"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.coalesce("dividend", F.lit(0.0)).cast("double").alias("dividend"),
        F.coalesce("split_ratio", F.lit(1.0)).cast("double").alias("split_ratio"))
    return out.where(F.assert_true(F.col("session").isNotNull(), F.lit("ohlcv.session: null date")).isNull())


def normalise_actions(actions: DataFrame) -> DataFrame:
    a = require_columns(actions, ACTION_COLUMNS, "actions").select(
        F.col("asset_id").cast("string").alias("asset_id"), F.to_date("ex_date").alias("ex_date"), "action_type",
        F.col("split_ratio").cast("double").alias("split_ratio"), F.col("cash_amount").cast("double").alias("cash_amount"),
        F.coalesce("new_symbol", F.lit("")).alias("new_symbol"))
    return a.where(F.assert_true(F.col("ex_date").isNotNull(), F.lit("actions.ex_date: null date")).isNull())


def normalise_tickers(tickers: DataFrame) -> DataFrame:
    t = require_columns(tickers, TICKER_COLUMNS, "tickers")
    return t.select(*[F.col(c).cast("string").alias(c) for c in ("asset_id", "symbol", "exchange", "category", "sector")],
                    F.col("is_etf").cast("boolean").alias("is_etf"), F.to_date("listed_date").alias("listed_date"),
                    F.to_date("delisted_date").alias("delisted_date"), F.coalesce("delist_reason", F.lit("")).alias("delist_reason"))


def normalise_earnings(earnings: DataFrame) -> DataFrame:
    e = require_columns(earnings, EARNINGS_COLUMNS, "earnings").select(
        F.col("asset_id").cast("string").alias("asset_id"), F.to_date("earnings_date").alias("earnings_date"),
        F.col("is_confirmed").cast("boolean").alias("is_confirmed"), F.col("available_ts").cast("timestamp").alias("available_ts"),
        F.col("timing").cast("string").alias("timing"))
    return e.where(F.assert_true(F.col("earnings_date").isNotNull(), F.lit("earnings_date: null date")).isNull())


def build_benchmark(index_bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Index grid with the newest VIX close of the same timestamp; nothing is filled."""
    v = vix.groupBy("ts").agg(F.max_by("close", "ord").alias("vix_close"))
    empty = F.lit(None).cast("double")
    return index_bars.join(F.broadcast(v), "ts", "left").select(  # one row per session
        "ts", "session_index", "open", "high", "low", "close", "vix_close", empty.alias("vix9d_close"), empty.alias("vix3m_close"))


def ingest(tickers: DataFrame, bars: DataFrame, actions: DataFrame, earnings: DataFrame, path: str, vendor: str,
           start: str, end: str) -> DataFrame:
    """Normalise and store the four raw tables; the manifest is written last."""
    if end < start:
        raise ValueError("end must not be before start")
    if tickers.isEmpty() or bars.isEmpty():
        raise ValueError("refusing to ingest without tickers or bars")
    spark, window = bars.sparkSession, F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    t, b = normalise_tickers(tickers), normalise_ohlcv(bars, tickers).where(window)
    a, e = normalise_actions(actions), normalise_earnings(earnings)
    t.write.mode("overwrite").parquet(f"{path}/tickers")
    a.sortWithinPartitions("ex_date", "asset_id", "action_type").write.mode("overwrite").parquet(f"{path}/actions")
    e.sortWithinPartitions("earnings_date", "asset_id").write.mode("overwrite").parquet(f"{path}/earnings")
    write_by_year(b, f"{path}/ohlcv", "session", ["session", "asset_id"])
    read = spark.read.parquet
    manifest = snapshot_manifest(read(f"{path}/ohlcv"), read(f"{path}/actions"), read(f"{path}/earnings"), vendor)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return read(f"{path}/manifest")


# -- run outputs ------------------------------------------------------------------

def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.partitionBy("strategy_id").mode("overwrite").parquet(path)


def read_labels(spark: SparkSession, path: str, strategy_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if strategy_id is None else df.where(F.col("strategy_id") == strategy_id)


def _is_missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def label_progress(spark: SparkSession, path: str) -> DataFrame:
    """Finished assets of a resumable run, empty if nothing has been written."""
    try:
        return spark.read.parquet(f"{path}/progress")
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return spark.createDataFrame([], "asset_id string, config_hash string, strategies string, attempt string")


def write_labels_resumable(spark: SparkSession, path: str, config_hash: str, strategy_ids: list[str], compute) -> None:
    """Append labels of the assets an interrupted run has not finished.

    ``compute(done)`` gets the finished assets. The progress table also holds the
    configuration; a mismatch is refused. Labels carry the attempt that wrote them,
    and count only once the progress table names that attempt for their asset: what a
    crash leaves behind between the two writes is never read.
    """
    want = ",".join(sorted(strategy_ids))
    progress = label_progress(spark, path)
    other = progress.where((F.col("config_hash") != config_hash) | (F.col("strategies") != want))
    if not other.isEmpty():
        raise ValueError("the stored labels belong to another configuration")
    attempt = uuid.uuid4().hex
    labels, assets = compute(progress.select("asset_id"))
    labels.withColumn("attempt", F.lit(attempt)).write.partitionBy("attempt", "strategy_id").mode("append").parquet(f"{path}/labels")
    assets.join(progress.select("asset_id"), "asset_id", "left_anti").select(
        "asset_id", F.lit(config_hash).alias("config_hash"), F.lit(want).alias("strategies"), F.lit(attempt).alias("attempt")
    ).write.mode("append").parquet(f"{path}/progress")


def read_resumable_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of finished assets, each from the attempt that finished it."""
    done = label_progress(spark, path).select("asset_id", "attempt").distinct()
    return spark.read.parquet(f"{path}/labels").join(done, ["asset_id", "attempt"], "left_semi").drop("attempt")


def append_decisions(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


# -- trial registry ---------------------------------------------------------------

TRIAL_COLUMNS = ("trial_id", "run_id", "split", "config_hash", "data_snapshot_id", "metric", "value")


def append_trial(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """The entry with the next trial number; a value that is not finite becomes NULL."""
    last = registry.agg(F.coalesce(F.max("trial_id"), F.lit(0)).alias("_last")).withColumn("_k", F.lit(1))
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    out = entry.withColumn("_k", F.lit(1)).join(F.broadcast(last), "_k")  # one row
    return out.withColumn("trial_id", F.col("_last") + 1).withColumn("value", F.when(finite, F.col("value"))).select(*TRIAL_COLUMNS)


def development_trials(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("split") == "DEVELOPMENT").agg(F.count(F.lit(1)).alias("n_trials"))
