"""Outputs of a run with fixed columns: edge table, trades, equity and funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.operators.edge import check_provenance
from tapewise.operators.research import with_drawdown
from tapewise.sources.tables import require_columns, write_csv

# Column contracts of the output files.
TRADE_COLUMNS = (
    "symbol", "strategy_id", "direction", "entry_ts", "exit_ts", "entry_price", "exit_price", "qty", "bars_held", "outcome",
    "gross_pnl_usd", "fees_usd", "dividends_usd", "borrow_usd", "funding_usd", "net_pnl_usd", "realised_r", "mae_r", "mfe_r",
    "regime", "vol_bucket", "cluster", "ev_net_r_at_entry",
)
MONEY_COLUMNS = ("entry_price", "exit_price", "qty", "gross_pnl_usd", "fees_usd", "dividends_usd", "borrow_usd", "funding_usd", "net_pnl_usd")
EQUITY_COLUMNS = ("ts", "equity", "benchmark", "drawdown_pct")
FUNNEL_COLUMNS = ("stage", "rejection_reason", "n")
ACTION_TYPES = ("SPLIT", "DIVIDEND", "SPINOFF", "MERGER", "TICKER_CHANGE")


def write_edge(edge: DataFrame, path: str) -> None:
    """Save an edge table; its configuration and snapshot travel in its columns."""
    require_columns(edge, ("as_of", "config_hash", "data_snapshot_id"), "edge table")
    edge.write.mode("overwrite").parquet(path)


def read_edge(spark: SparkSession, path: str, config_hash: str, snapshot_id: str) -> DataFrame:
    """A saved edge table; reading fails if it belongs to another run."""
    return check_provenance(spark.read.parquet(path), config_hash, snapshot_id)


def write_trades(trades: DataFrame, path: str) -> None:
    """Closed trades as CSV; money is written as decimal text."""
    t = require_columns(trades, TRADE_COLUMNS, "trades")
    write_csv(t.select(*[F.col(c).cast("string") if c in MONEY_COLUMNS else F.col(c) for c in TRADE_COLUMNS]), path)


def equity_output(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The equity curve with the benchmark's value at its stamps and its drawdown."""
    joined = with_drawdown(equity.select("ts", "equity")).join(benchmark.select("ts", "benchmark"), "ts", "left")
    return joined.select(*EQUITY_COLUMNS)


def write_equity(equity: DataFrame, benchmark: DataFrame, path: str) -> None:
    write_csv(equity_output(equity, benchmark), path)


def write_funnel(funnel: DataFrame, path: str) -> None:
    """Counts by reason; the accepted remainder is there even when it is 0."""
    none = funnel.sparkSession.range(1).select(F.lit("ACCEPTED").alias("stage"), F.lit("").alias("rejection_reason"), F.lit(0).cast("long").alias("n"))
    both = funnel.select(*FUNNEL_COLUMNS).unionByName(none)
    write_csv(both.groupBy("stage", "rejection_reason").agg(F.sum("n").alias("n")), path)


def typed_actions(actions: DataFrame) -> DataFrame:
    """Corporate actions of known types; rows of other types are dropped."""
    return actions.where(F.col("action_type").isin(*ACTION_TYPES))
