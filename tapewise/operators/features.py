"""The feature panel: per-asset indicators, eligible-only ranks, market columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import is_true
from tapewise.operators.indicators import asset_series, market_columns, with_plain_columns
from tapewise.operators.ranking import average_pct_ranks
from tapewise.params import FeatureParams, MarketParams, RegimeParams
from tapewise.session import staged, tabled

# The feature contract, in order.
FEATURE_COLUMNS = (
    "symbol", "ts", "close", "atr_14", "atr_pct", "vol_20", "vol_60", "ema_fast", "ema_slow", "ema_spread_atr",
    "slope_atr_20", "efficiency_ratio_20", "efficiency_ratio_60", "atr_percentile_1y", "regime", "vol_bucket",
    "donchian_high_20", "donchian_low_20", "donchian_high_55", "donchian_low_55", "keltner_upper", "keltner_lower",
    "dist_to_high_atr", "dist_to_low_atr", "mom_252_skip21", "mom_126_skip21", "mom_21", "mom_252_xs_pct",
    "vol_xs_pct", "xs_population", "gap_atr", "gap_abs_mean_20", "overnight_var_share_60", "market_regime",
    "spy_dd_252", "spy_above_ma", "vix_close", "beta_bench_90", "corr_bench_90", "bars_available",
    "bars_since_gap", "is_warm",
)
RANKED = (("mom_252_skip21", "mom_252_xs_pct"), ("vol_60", "vol_xs_pct"))


def with_eligibility(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Eligibility of each row on its newest snapshot; none counts as ineligible. The rows come back in series.

    An asset's snapshots travel as one array (bounded by the months of the calendar, and shortened to
    the changes), so that the rows meet them in the partitioning by asset that the indicators need.
    """
    before = F.lag("_on").over(Window.partitionBy("asset_id").orderBy("_at"))
    changes = snapshots.select("asset_id", F.col("ts").alias("_at"), is_true(F.col("eligible")).alias("_on")).withColumn("_was", before)
    per = changes.where("_on <> coalesce(_was, false)").groupBy("asset_id").agg(F.sort_array(F.collect_list("_at"), asc=False).alias("_at"))
    out = df.repartition("asset_id").join(per, "asset_id", "left")
    # the changes alternate, beginning with one to eligible
    return out.withColumn("eligible", F.coalesce(F.size(F.filter("_at", lambda t: t <= F.col("ts"))) % 2 == 1, F.lit(False))).drop("_at")


#: Ranked rows up to which they are sent to the others instead of being shuffled with the eligible ones.
RANKS_SENT = 500_000


def with_cross_section(df: DataFrame) -> DataFrame:
    """Percentile ranks among the eligible rows of each timestamp, and their count.

    Only the eligible rows have ranks; the others, which are most, stay where they are.
    """
    key = ["asset_id", "ts"]
    masked = {f"_masked_{src}": dest for src, dest in RANKED}
    df, on = df.drop(*masked.values()), is_true(F.col("eligible"))
    own = df.where(on).select(*key, *[F.col(src).alias(f"_masked_{src}") for src, _ in RANKED])
    ranks = staged(average_pct_ranks(own, ["ts"], masked).select(*key, *masked.values()))
    if ranks.count() <= RANKS_SENT:
        out = df.join(F.broadcast(ranks), key, "left")
    else:
        rest = df.where(~on).withColumns({c: F.lit(None).cast("double") for c in masked.values()})
        out = df.where(on).join(ranks, key).unionByName(rest)
    population = df.groupBy("ts").agg(F.sum(F.col("eligible").cast("long")).alias("xs_population"))
    return out.join(F.broadcast(staged(population)), "ts")  # one row per session


def with_market(df: DataFrame, benchmark: DataFrame, m: MarketParams) -> DataFrame:
    """Attach the market columns; a row without its session in the benchmark is an error."""
    market = market_columns(benchmark, m).select(
        "ts", "market_regime", "spy_dd_252", "spy_above_ma", "vix_close", F.lit(True).alias("_known"))
    out = df.join(F.broadcast(market), "ts", "left")  # one row per session
    return out.where(F.assert_true(F.col("_known").isNotNull(), F.lit("no benchmark row for a feature timestamp"))
                     .isNull()).drop("_known")


def compute_features(panel: DataFrame, benchmark: DataFrame, snapshots: DataFrame, p: FeatureParams = FeatureParams(),
                     r: RegimeParams = RegimeParams(), m: MarketParams = MarketParams(), emit_from=None,
                     stage: bool = True, only: Column | None = None) -> DataFrame:
    """One feature row per panel row. ``emit_from`` drops earlier rows after the
    windows and before the ranks. ``only``, a condition on an asset's own columns, keeps its rows
    and the eligible ones, which are all that ranks and counts look at: those have the same values as without it."""
    df = asset_series(with_eligibility(panel, snapshots), benchmark, p).drop("volume", "dollar_volume", "is_suspect")
    if emit_from is not None:
        df = df.where(F.col("ts") >= F.lit(emit_from).cast("timestamp"))
    if only is not None:
        # what plain columns are made of is written, not they
        plain = with_plain_columns(df.withColumn("_kept_back", F.col("_back")), p, r)
        df = plain.where(is_true(F.col("eligible")) | is_true(only)).withColumnRenamed("_kept_back", "_back").select(df.columns)
    if stage:  # ranks, and every use of the rows; plain columns of others are not written
        df = tabled(df)
    df = with_market(with_cross_section(with_plain_columns(df, p, r)), benchmark, m)
    extra = [c for c in ("asset_id", "session", "session_index", "eligible", "open", "high", "low", "close_raw")
             if c in df.columns]
    return df.select(*extra, *FEATURE_COLUMNS)
