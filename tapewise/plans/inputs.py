"""Stage tables of one data folder, each computed once per session.

They mirror the files that pass between the steps of a research run: panel,
snapshots, features, labels, edge. Each is written to the checkpoint folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.functions.exprs import session_of
from tapewise.operators import edge as E
from tapewise.operators import features as FT
from tapewise.operators import labels as L
from tapewise.operators import universe as U
from tapewise.operators.panel import first_session_of_period, processed_panel
from tapewise.operators.setups import make_strategy, may_set_up
from tapewise.plans import derived as D
from tapewise.session import release, staged, staged_in_place

WARMUPS = {"xsec_momentum_v1": 60, "donchian_breakout_v1": 58}
EQUITY = 100_000.0


def strategies() -> list:
    return [
        make_strategy("xsec_momentum_v1", {"xs_threshold": 0.8, "stop_atr": 1.5, "max_hold_bars": 8}),
        make_strategy("donchian_breakout_v1", {"entry_buffer_atr": 0.0, "stop_atr": 1.0, "target_rr": 1.5,
                                               "max_hold_bars": 12, "min_ema_spread_atr": 0.0}),
    ]


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.sf_dir, name)

    def freed(self, df: DataFrame) -> DataFrame:
        """``df``, a written stage, without the shuffle files that made it."""
        release(self.spark)
        return df

    @cached_property
    def bars(self):
        return staged(D.raw_bars(self.spark, self.sf_dir))

    @cached_property
    def actions(self):
        return staged(D.actions(self.spark, self.sf_dir))

    @cached_property
    def calendar(self):
        return staged(D.calendar(self.spark, self.sf_dir))

    @cached_property
    def panel(self):
        # bars are read once, so are written only if something else has asked for them; assets keep their place
        bars = self.bars if "bars" in self.__dict__ else D.raw_bars(self.spark, self.sf_dir)
        return self.freed(staged_in_place(processed_panel(bars, self.actions, self.calendar, keep=("session",))))

    @cached_property
    def benchmark(self):
        return staged(D.benchmark(self.spark, self.sf_dir))

    @cached_property
    def tickers(self):
        return D.tickers(self.spark, self.sf_dir)

    @cached_property
    def earnings(self):
        return staged(D.earnings(self.spark, self.sf_dir))

    @cached_property
    def candidates(self):
        bars = self.panel if "panel" in self.__dict__ else self.bars
        return staged(U.seed_candidates(self.tickers, bars, D.WEEKLY_UNIVERSE))

    @cached_property
    def snapshots(self):
        return self.freed(staged(U.build_snapshots(self.panel, self.candidates, self.tickers, self.calendar, D.WEEKLY_UNIVERSE)))

    @cached_property
    def features(self):
        # written inside, without ranks, market and plain columns, which are joined and computed as it is read
        return FT.compute_features(self.panel, self.benchmark, self.snapshots, D.WEEKLY, D.WEEKLY_REGIME, D.WEEKLY_MARKET)

    @cached_property
    def setup_features(self):
        """The feature rows that can have a setup, and those ranked with them; all rows if these are there."""
        if "features" in self.__dict__:
            return self.features
        return FT.compute_features(self.panel, self.benchmark, self.snapshots, D.WEEKLY, D.WEEKLY_REGIME, D.WEEKLY_MARKET,
                                   only=may_set_up(strategies()))

    @cached_property
    def labels(self):
        return self.freed(staged(L.label_setups(self.setup_features, self.panel, strategies(), self.snapshots, self.earnings,
                                                self.tickers.select("asset_id", "is_etf"), self.calendar)))

    @cached_property
    def grid(self):
        return first_session_of_period(self.calendar).select(F.col("ts").alias("as_of"))

    @cached_property
    def edge(self):
        return staged(E.build_edge(self.labels, self.grid, D.WEEKLY_EDGE, "weekly", "derived"))

    @cached_property
    def assets(self):
        return U.asset_dimension(self.candidates, self.tickers)

    @cached_property
    def trades(self):
        """Resolved labels booked as trades at a fixed money risk."""
        lab = self.labels.where("outcome <> 'OPEN'")
        sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
        qty = F.floor(F.lit(100.0) / F.col("risk_per_unit") * 100.0) / 100.0
        t = lab.join(self.tickers.select("asset_id", F.col("sector").alias("cluster")), "asset_id").withColumn("qty", qty)
        return t.select(
            "asset_id", "symbol", "cluster", "strategy_id", "direction", sign.alias("sign"), "regime", "vol_bucket", "setup_ts",
            "entry_ts", F.col("resolution_ts").alias("exit_ts"), "entry_price", "exit_price", "stop_price", "qty", "outcome",
            "bars_held", (sign * (F.col("exit_price") - F.col("entry_price")) * F.col("qty")).alias("gross_pnl_usd"),
            (F.col("qty") * 0.007).alias("fees_usd"), F.lit(0.0).alias("funding_usd"),
            F.when(sign < 0, F.col("bars_held") * 0.01).otherwise(0.0).alias("borrow_usd"),
            F.col("realised_r_gross").alias("realised_r"), "mae_r", "mfe_r", "beta_bench_90",
            (F.col("mom_252_xs_pct") * 0.2 - 0.1).alias("ev_net_r_at_entry"),
            F.struct("entry_ts", "asset_id", "strategy_id", "setup_ts").alias("_order"))

    @property
    def row_key(self):
        """Integer key of a trade from its asset number, session and strategy."""
        week = F.floor(F.datediff(session_of(F.col("setup_ts")), F.lit("1990-01-01").cast("date")) / 7)
        return (F.substring("asset_id", 2, 9).cast("long") * 2000 + week * 2
                + F.when(F.col("strategy_id") == "xsec_momentum_v1", 0).otherwise(1))

    @cached_property
    def equity(self):
        """Start capital plus the money result of the trades closed so far."""
        from pyspark.sql import Window
        day = self.trades.groupBy(F.col("exit_ts").alias("ts")).agg(
            F.sum(F.col("gross_pnl_usd") - F.col("fees_usd") - F.col("borrow_usd")).alias("_p"))
        line = self.calendar.select(F.col("close_utc").alias("ts"), "session").join(F.broadcast(day), "ts", "left")
        w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
        return staged(line.select("ts", "session", (F.lit(EQUITY) + F.coalesce(F.sum("_p").over(w), F.lit(0.0))).alias("equity")))


_MEMO: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    return _MEMO.setdefault(key, Inputs(spark, sf_dir))


def forget() -> None:
    """Drop the staged tables, so that the next use computes them again."""
    _MEMO.clear()
