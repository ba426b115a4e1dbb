"""Inputs of the operators derived from the driver's tables.

Suppliers act as assets and shipping weeks as sessions. Every input is a
DataFrame over whole tables; nothing is sampled or made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.functions.exprs import session_close_utc
from tapewise.operators.panel import processed_panel
from tapewise.params import (EdgeParams, FeatureParams, GateParams, MarketParams, RegimeParams,
                             UniverseParams)

# The derived panel has one bar per week and about 357 of them, so windows are
# shortened and trend thresholds fit a mean-reverting series.
WEEKLY = FeatureParams(
    atr_n=14, ema_fast=10, ema_slow=26, slope_n=10, donchian_short=10, donchian_long=20,
    er_n=10, er_long_n=26, vol_short=10, vol_long=26, vol_window=104, vol_min_periods=26,
    gap_mean_n=10, overnight_n=26, beta_window=52, mom_long=52, mom_mid=26, mom_skip=4,
    mom_short=4, bars_per_year=52)
WEEKLY_REGIME = RegimeParams(er_trend_min=0.05, er_long_trend_min=0.01, slope_min=0.05, er_range_max=0.04)
WEEKLY_MARKET = MarketParams(sma_n=40, dd_n=52, vol_n=10, vol_window=104, vol_min_periods=52,
                             dd_warn=0.35, dd_stress=0.55, vol_stress=0.95, bars_per_year=52)
WEEKLY_UNIVERSE = UniverseParams(
    size=60, min_history_bars=40, min_bars_since_gap=2, min_price_usd=60.0, min_adv_usd=8_500.0,
    max_spread_bps=900.0, suspect_lookback=5, delisting_grace=3, spread_window=10, adv_bars=12,
    spread_floors=((16_000.0, 0.5), (12_000.0, 1.0), (9_000.0, 3.0)),
    min_lifetime_dollar_volume=35_000.0)
WEEKLY_GATES = GateParams(min_xs_population=5)
WEEKLY_EDGE = EdgeParams(min_samples=20)

ASSET = "S000000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_key(c):
    return F.concat(F.lit("S"), F.lpad(c.cast("string"), 9, "0"))


def symbol_key(c):
    return F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))


def trades_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as prints: supplier, session (week), price, quantity, order.

    ``tape_order`` packs (day, order, line, price) into one decimal. A fixed-width
    key keeps ``min_by``/``max_by`` in hash aggregation, where a struct would force
    a sort of the whole input.
    """
    whole = T.DecimalType(38, 0)
    px = F.sqrt("l_extendedprice")
    day = F.dayofweek(F.date_add(F.to_date("l_shipdate"), -1)).cast("long")
    place = day * F.lit(10**15) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"), px.alias("px"),
        F.col("l_quantity").alias("qty"), "l_returnflag", "l_discount", "l_tax",
        (place.cast(T.DecimalType(20, 0)) * F.lit(10**12).cast(T.DecimalType(13, 0))
         + F.round(px * 1e6).cast(T.DecimalType(12, 0))).cast(whole).alias("tape_order"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unadjusted weekly bars, fully combined on the map side, so a hot asset costs
    nothing extra."""
    bars = trades_tape(spark, sf_dir).groupBy("l_suppkey", "session").agg(
        F.min_by("px", "tape_order").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "tape_order").alias("close"), F.sum("qty").alias("volume"))
    return bars.select(asset_key(F.col("l_suppkey")).alias("asset_id"), symbol_key(F.col("l_suppkey")).alias("symbol"),
                       "session", "open", "high", "low", "close", "volume")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct shipping weeks, closing 16:00 New York."""
    weeks = table(spark, sf_dir, "lineitem").select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("session")).distinct()
    return weeks.select("session", session_close_utc(F.col("session")).alias("close_utc"),
                        (F.row_number().over(Window.orderBy("session")) - 1).cast("int").alias("session_index"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits, dividends and spin-offs by rule from line-item flags."""
    t = trades_tape(spark, sf_dir)
    split = (F.col("qty") == 50) & (F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.0)
    div = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)
    spin = (F.col("l_returnflag") == "N") & (F.col("qty") == 49) & (F.col("l_tax") == 0.01)
    kind = F.when(split, "SPLIT").when(div, "DIVIDEND").when(spin, "SPINOFF")
    rows = t.withColumn("action_type", kind).where(F.col("action_type").isNotNull())
    days = rows.groupBy("l_suppkey", F.col("session").alias("ex_date"), "action_type").agg(
        F.max(F.when(F.col("action_type") == "SPLIT",
                     F.when(F.col("l_returnflag") == "A", 0.5).otherwise(2.0)).otherwise(1.0)).alias("split_ratio"),
        F.max(F.when(F.col("action_type") == "SPLIT", 0.0)
              .when(F.col("action_type") == "DIVIDEND", F.col("px") * 0.02).otherwise(F.lit(5.0))).alias("cash_amount"),
    )
    return days.select(asset_key(F.col("l_suppkey")).alias("asset_id"), "ex_date", "action_type", "split_ratio",
                       "cash_amount", F.lit("").alias("new_symbol"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_panel(raw_bars(spark, sf_dir), actions(spark, sf_dir), calendar(spark, sf_dir), keep=("session",))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers together as the index, one bar per week; the mean discount
    stands in for the volatility index."""
    bars = trades_tape(spark, sf_dir).groupBy("session").agg(
        F.min_by("px", "tape_order").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "tape_order").alias("close"), F.max("l_discount").alias("vix_close"))
    return bars.join(F.broadcast(calendar(spark, sf_dir)), "session").select(
        F.col("close_utc").alias("ts"), "session", "session_index", "open", "high", "low", "close", "vix_close")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier dimension with sector, listing venue and delisting by rule."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    venue = F.when(F.col("s_nationkey") < 8, "NYSE").when(F.col("s_nationkey") < 16, "NASDAQ") \
        .when(F.col("s_nationkey") < 22, "BATS").otherwise("OTC")
    bal = F.col("s_acctbal")
    return s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey, "left").select(
        asset_key(F.col("s_suppkey")).alias("asset_id"), F.col("s_name").alias("symbol"), venue.alias("exchange"),
        F.when(bal > 9000, "ETF").when(bal < -900, "ADR Common Stock").otherwise("Domestic Common Stock").alias("category"),
        F.coalesce("r_name", F.lit("")).alias("sector"), (bal > 9000).alias("is_etf"),
        F.lit("1992-01-01").cast("date").alias("listed_date"),
        F.when((bal > 0) & (bal < 2000), F.lit("2001-03-05").cast("date")).alias("delisted_date"),
        F.when((bal > 0) & (bal < 2000), "OTHER").otherwise("").alias("delist_reason"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as earnings dates of the suppliers on any of their lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.to_date("o_orderdate").alias("earnings_date"), "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    known = F.when(F.col("o_orderstatus") == "F", session_close_utc(F.date_sub("earnings_date", 21)))
    return j.select(asset_key(F.col("l_suppkey")).alias("asset_id"), "earnings_date", F.lit(True).alias("is_confirmed"),
                    known.alias("available_ts"), F.lit("UNKNOWN").alias("timing")).distinct()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sentiment observations, known one hour after they happened."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    ts = F.col("ts").cast("timestamp")
    weight = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 0.5).otherwise(0.3)
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("event_type").alias("source"),
        ts.alias("event_ts"), (ts + F.expr("INTERVAL 1 HOUR")).alias("available_ts"), F.col("value").alias("raw_score"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 10.0 - 1.0)).alias("score"),
        weight.alias("source_weight"), k.cast("int").alias("sample_size"),
        F.col("event_id").cast("string").alias("payload_hash"))
