"""Seeded random-walk equities for tests, with the holes, splits and dividends a caller plants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _noise(seed: int, *cols: str):
    """Roughly normal number from a row's own keys, the same on every run."""
    u = [F.pmod(F.xxhash64(*cols, F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0 for k in range(6)]
    total = u[0]
    for x in u[1:]:
        total = total + x
    return (total - 3.0) * 1.4142135623730951


def asset_id(k: int) -> str:
    """Id of the k-th generated name, from 0: the only place where ids are made."""
    return f"asset-{k:05d}"


def tickers(spark: SparkSession, listed: int = 50, delisted: int = 8, gone: str = "2005-06-30") -> DataFrame:
    """``listed`` names that go on, then ``delisted`` ones that end on the day ``gone``."""
    rows = [(asset_id(k), f"N{k}", k >= listed) for k in range(listed + delisted)]
    return spark.createDataFrame(rows, "asset_id string, symbol string, _gone boolean").select(
        "asset_id", "symbol", F.lit("NYSE").alias("exchange"),
        F.lit("Domestic Common Stock").alias("category"), F.lit("TECH").alias("sector"), F.lit(False).alias("is_etf"),
        F.lit("1998-01-01").cast("date").alias("listed_date"), F.when(F.col("_gone"), F.lit(gone).cast("date")).alias("delisted_date"),
        F.when(F.col("_gone"), "OTHER").otherwise("").alias("delist_reason"))


def bars(names: DataFrame, calendar: DataFrame, holes: Sequence[tuple[str, int, int]] = (), splits: Sequence[tuple[str, int, float]] = (),
         seed: int = 7, drift: float = 0.0, vol: float = 0.02) -> DataFrame:
    """One bar per name and session.

    Each hole (asset, first, end) leaves the sessions first <= index < end out. Each
    split (asset, session, ratio) divides the prices from that session on.
    """
    one = calendar.agg(F.collect_list(F.struct("session", "session_index")).alias("_c")).withColumn("_k", F.lit(1))
    grid = names.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").select(
        "asset_id", "symbol", "delisted_date", F.explode("_c").alias("_s")).select("asset_id", "symbol", "delisted_date", "_s.*")
    grid = grid.where(F.col("delisted_date").isNull() | (F.col("session") <= F.col("delisted_date")))
    for asset, first, end in holes:
        grid = grid.where((F.col("asset_id") != asset) | (F.col("session_index") < first) | (F.col("session_index") >= end))
    w = Window.partitionBy("asset_id").orderBy("session_index").rowsBetween(Window.unboundedPreceding, 0)
    walk = F.lit(50.0) * F.exp(F.sum(F.lit(drift) + vol * _noise(seed, "asset_id", "session_index")).over(w))
    df = grid.withColumn("_c", walk)
    df = df.withColumn("_o", F.col("_c") * F.exp(vol / 3 * _noise(seed + 10, "asset_id", "session_index")))
    up = F.exp(F.abs(vol / 2 * _noise(seed + 20, "asset_id", "session_index")))
    dn = F.exp(-F.abs(vol / 2 * _noise(seed + 30, "asset_id", "session_index")))
    scale = F.lit(1.0)
    for asset, at, ratio in splits:
        scale = scale * F.when((F.col("asset_id") == asset) & (F.col("session_index") >= at), 1.0 / ratio).otherwise(1.0)
    return df.select(
        "asset_id", "symbol", "session", (F.col("_o") * scale).alias("open"), (F.greatest("_o", "_c") * up * scale).alias("high"),
        (F.least("_o", "_c") * dn * scale).alias("low"), (F.col("_c") * scale).alias("close"),
        (F.lit(1_000_000.0) / scale).alias("volume"), F.lit(0.0).alias("dividend"), F.lit(1.0).alias("split_ratio"))


def actions(calendar: DataFrame, splits: Sequence[tuple[str, int, float]] = (), dividends: Sequence[tuple[str, int, float]] = ()) -> DataFrame:
    """The corporate actions of planted splits (asset, session, ratio) and dividends (asset, session, cash)."""
    rows = [(a, i, "SPLIT", r, 0.0) for a, i, r in splits] + [(a, i, "DIVIDEND", 1.0, c) for a, i, c in dividends]
    planted = calendar.sparkSession.createDataFrame(rows, "asset_id string, session_index int, action_type string, split_ratio double, cash_amount double")
    return calendar.join(F.broadcast(planted), "session_index").select(
        "asset_id", F.col("session").alias("ex_date"), "action_type", "split_ratio", "cash_amount", F.lit("").alias("new_symbol"))


def earnings(names: DataFrame, calendar: DataFrame, every: int = 63) -> DataFrame:
    days = calendar.where(F.col("session_index") % every == every - 1).agg(F.collect_list("session").alias("_d")).withColumn("_k", F.lit(1))
    return names.withColumn("_k", F.lit(1)).join(F.broadcast(days), "_k").select(
        "asset_id", F.explode("_d").alias("earnings_date"), F.lit(True).alias("is_confirmed"),
        F.lit(None).cast("timestamp").alias("available_ts"), F.lit("UNKNOWN").alias("timing"))
