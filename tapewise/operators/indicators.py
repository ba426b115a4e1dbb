"""Per-asset indicators as window columns.

Input is a panel unique on (asset_id, ts), so a window group is as long as the
trading calendar and no longer, however rows are distributed over assets. All
indicators use the same partitioning and ordering: one shuffle, one sort. Lags, extremes
and means are window functions; averages, moments, ranks and medians are computed in one pass
over each task's series (:mod:`tapewise.operators.series`), in array operations. Frames
count the asset's own rows; gaps are absent rows. Every function takes a frame and
returns it with columns added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions import sliding as SL
from tapewise.functions.exprs import call_over, column, first_reason, rolling, rolling_mean, rolling_std, rolling_sum, strict_greatest, windowed
from tapewise.functions.sliding import Matrices, Step
from tapewise.operators.series import add_series, in_series
from tapewise.params import FeatureParams, MarketParams, RegimeParams, UniverseParams

BY_ASSET = "PARTITION BY asset_id ORDER BY ts"


def over_asset():
    return Window.partitionBy("asset_id").orderBy("ts")


def lag_sql(c: str, n: int = 1) -> str:
    return call_over(f"lag({c}, {n})", BY_ASSET)


def lagged(c: str, n: int = 1) -> Column:
    return column(lag_sql(c, n))


def with_bar_number(df: DataFrame, name: str = "bars_available") -> DataFrame:
    return df.withColumn(name, F.row_number().over(over_asset()))


def true_range() -> str:
    p = lag_sql("close")
    return f"greatest(high - low, abs(high - {p}), abs(low - {p}))"


def ema_step(value: str, name: str, alpha: float, min_periods: int) -> Step:
    return lambda m: {name: SL.ema(m[value], alpha, min_periods)}


def atr_step(n: int) -> Step:
    def step(m: Matrices) -> Matrices:
        atr = SL.ema(m["_tr"], 1.0 / n, n)
        return {"atr_14": atr, "atr_pct": atr / m["close"]}
    return step


def averages_step(fast: int, slow: int) -> Step:
    return lambda m: {"ema_fast": SL.ema(m["close"], 2.0 / (fast + 1), fast), "ema_slow": SL.ema(m["close"], 2.0 / (slow + 1), slow)}


def with_ema(df: DataFrame, value: str, name: str, alpha: float, min_periods: int) -> DataFrame:
    """Recursive exponential average ``y = alpha * x + (1 - alpha) * y_prev``. Values must not be null."""
    return add_series(in_series(df), [ema_step(value, name, alpha, min_periods)], [value], [name])


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    out = windowed(in_series(df), {"_tr": true_range()})
    return add_series(out, [atr_step(n)], ["_tr", "close"], ["atr_14", "atr_pct"], drop=("_tr",))


def with_moving_averages(df: DataFrame, fast: int, slow: int) -> DataFrame:
    return add_series(in_series(df), [averages_step(fast, slow)], ["close"], ["ema_fast", "ema_slow"])


def ema_spread() -> Column:
    return F.expr("(ema_fast - ema_slow) / nullif(atr_14, 0)")


def slope(n: int) -> str:
    return f"(close - {lag_sql('close', n)}) / nullif(atr_14 * {math.sqrt(n)!r}D, 0)"


def channel(c: str, agg: str, n: int) -> str:
    """Extreme of the ``n`` rows before the current one."""
    frame = call_over(f"{agg}({c})", BY_ASSET, f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
    return f"CASE WHEN {lag_sql(c, n)} IS NOT NULL THEN {frame} END"


def vol_step(windows: dict[str, int], bars_per_year: int) -> Step:
    return lambda m: {name: np.sqrt(SL.covariance(m["_lr"], n)) * math.sqrt(bars_per_year) for name, n in windows.items()}


def with_realised_vol(df: DataFrame, windows: dict[str, int], bars_per_year: int) -> DataFrame:
    """Annualised deviation of the log returns ``_lr`` over each window."""
    return add_series(in_series(df), [vol_step(windows, bars_per_year)], ["_lr"], list(windows))


def with_steps(df: DataFrame) -> DataFrame:
    """Add ``_lr``, the log return, and ``_step``, the absolute price change."""
    p = lag_sql("close")
    return windowed(df, {"_lr": f"ln(close / nullif({p}, 0))", "_step": f"abs(close - {p})"})


def efficiency(n: int) -> str:
    path = rolling_sum("_step", BY_ASSET, n)
    return f"abs(close - {lag_sql('close', n)}) / nullif({path}, 0)"


def momentum(far: int, near: int = 0) -> str:
    recent = "close" if near == 0 else lag_sql("close", near)
    return f"{recent} / nullif({lag_sql('close', far)}, 0) - 1D"


def gap_step(mean_n: int) -> Step:
    def step(m: Matrices) -> Matrices:
        gap = (m["open"] - SL.lag(m["close"])) / SL.lag(m["atr_14"])
        gap[~np.isfinite(gap)] = np.nan
        return {"gap_atr": gap, "gap_abs_mean_20": SL.mean(np.abs(gap), mean_n)}
    return step


def with_gap(df: DataFrame, mean_n: int = 20) -> DataFrame:
    return add_series(in_series(df), [gap_step(mean_n)], ["open", "close", "atr_14"], ["gap_atr", "gap_abs_mean_20"])


def _log_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.log(a / b)
    out[~np.isfinite(out)] = np.nan
    return out


def overnight_step(n: int) -> Step:
    def step(m: Matrices) -> Matrices:
        night = SL.covariance(_log_ratio(m["open"], SL.lag(m["close"])), n)
        day = SL.covariance(_log_ratio(m["close"], m["open"]), n)
        return {"overnight_var_share_60": np.where(night + day > 0, night / (night + day), np.nan)}
    return step


def with_overnight_share(df: DataFrame, n: int = 60) -> DataFrame:
    return add_series(in_series(df), [overnight_step(n)], ["open", "close"], ["overnight_var_share_60"])


def rank_step(value: str, name: str, n: int, min_periods: int) -> Step:
    return lambda m: {name: SL.pct_rank(m[value], n, min_periods)}


def with_rolling_rank(df: DataFrame, value: str, name: str, n: int, min_periods: int, key: str | None = "asset_id") -> DataFrame:
    """Average-tie percentile rank of the current value among the last ``n`` rows."""
    return add_series(in_series(df, key), [rank_step(value, name, n, min_periods)], [value], [name], key)


def bench_step(window: int) -> Step:
    """Beta and correlation on the rows that the benchmark has too, which form their own sequence."""
    def step(m: Matrices) -> Matrices:
        both = ~np.isnan(m["_b"])
        place = np.cumsum(both, axis=1) - 1
        rows, cols = np.nonzero(both)
        at = (rows, place[rows, cols])
        own, bench = np.full(both.shape, np.nan), np.full(both.shape, np.nan)
        own[at], bench[at] = m["close"][rows, cols], m["_b"][rows, cols]
        rs, rb = _log_ratio(own, SL.lag(own)), _log_ratio(bench, SL.lag(bench))
        need = window // 2
        cov = SL.covariance(rs, window, rb, need)
        beta = cov / SL.covariance(rb, window, need=need)
        pairs = np.isnan(rs) | np.isnan(rb)
        vs, vb = (SL.covariance(np.where(pairs, np.nan, r), window, need=need) for r in (rs, rb))
        out = {"beta_bench_90": np.full(both.shape, np.nan), "corr_bench_90": np.full(both.shape, np.nan)}
        out["beta_bench_90"][rows, cols] = beta[at]
        out["corr_bench_90"][rows, cols] = (cov / (np.sqrt(vs) * np.sqrt(vb)))[at]
        return out
    return step


BENCH = ["beta_bench_90", "corr_bench_90"]


def with_bench_close(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    return df.join(F.broadcast(benchmark.select("ts", F.col("close").alias("_b"))), "ts", "left")  # one row per session


def of_reference(reference: str) -> dict[str, Column]:
    return {c: F.when(F.col("symbol") == reference, 1.0).otherwise(F.col(c)) for c in BENCH}


def with_bench_moments(df: DataFrame, benchmark: DataFrame, window: int, reference: str) -> DataFrame:
    """Rolling beta and correlation against the benchmark close.

    Returns are taken between rows present on both sides, so a hole widens both
    returns. The variance counts benchmark returns on their own rows.
    """
    out = add_series(in_series(with_bench_close(df, benchmark)), [bench_step(window)], ["close", "_b"], BENCH, drop=("_b",))
    return out.withColumns(of_reference(reference))


def with_bars_since_gap(df: DataFrame, name: str = "bars_since_gap") -> DataFrame:
    """Position inside the current run of consecutive sessions, from 0."""
    n = call_over("row_number()", BY_ASSET)
    out = windowed(df, {"_row": n, "_first": f"if(coalesce(session_index - {lag_sql('session_index')} > 1, true), {n}, NULL)"})
    return windowed(out, {name: "_row - " + call_over("max(_first)", BY_ASSET, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")}).drop("_row", "_first")


# -- spread and liquidity ------------------------------------------------------

def with_corwin_schultz(df: DataFrame, n: int, name: str = "cs_bps") -> DataFrame:
    """High-low spread estimate in bps from two-bar ranges, averaged over ``n`` bars."""
    k = 3.0 - 2.0 * math.sqrt(2.0)
    out = df.selectExpr("*", "CASE WHEN high > 0 AND low > 0 AND high >= low THEN ln(high / low) END AS _hl")
    hl1, ph, pl = (lag_sql(c) for c in ("_hl", "high", "low"))
    pair = f"_hl IS NOT NULL AND {hl1} IS NOT NULL"
    two = f"ln(greatest(high, {ph}) / nullif(least(low, {pl}), 0))"
    out = windowed(out, {"_b": f"CASE WHEN {pair} THEN _hl * _hl + {hl1} * {hl1} END",
                         "_g": f"CASE WHEN {pair} THEN {two} * {two} END"})
    out = windowed(out, {"_beta": rolling_mean("_b", BY_ASSET, n), "_gamma": rolling_mean("_g", BY_ASSET, n)})
    out = out.selectExpr("*", f"(sqrt(2D * _beta) - sqrt(_beta)) / {k!r}D - sqrt(_gamma / {k!r}D) AS _alpha")
    bps = "2D * (exp(_alpha) - 1D) / (1D + exp(_alpha)) * 1e4"
    return out.withColumn(name, F.expr(f"CASE WHEN _alpha IS NOT NULL THEN greatest({bps}, 0D) END")).drop(
        "_hl", "_b", "_g", "_beta", "_gamma", "_alpha")


def spread_floor(adv: Column, p: UniverseParams) -> Column:
    out = F.when(adv.isNull(), F.lit(None).cast("double"))
    for above, bps in p.spread_floors:
        out = out.when(adv > above, bps)
    return out.otherwise(p.spread_floor_rest)


def final_spread(cs: Column, adv: Column, p: UniverseParams) -> Column:
    return strict_greatest(cs, spread_floor(adv, p))


def with_rolling_median(df: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """Median of the last ``n`` rows where all have a value."""
    return add_series(in_series(df), [lambda m: {name: SL.median(m[value], n)}], [value], [name])


# -- labels --------------------------------------------------------------------

def vol_bucket(pct: Column, p: RegimeParams) -> Column:
    return F.when(pct.isNull(), "UNKNOWN").when(pct < p.vol_low, "LOW").when(
        pct >= p.vol_high, "HIGH").otherwise("MID")


def regime(er: Column, er_long: Column, slope_: Column, vol_pct: Column, p: RegimeParams) -> Column:
    missing = er.isNull() | er_long.isNull() | slope_.isNull() | vol_pct.isNull()
    trend = (er >= p.er_trend_min) & (er_long >= p.er_long_trend_min)
    return first_reason([
        (missing, "UNKNOWN"),
        (trend & (slope_ >= p.slope_min), "TREND_UP"),
        (trend & (slope_ <= -p.slope_min), "TREND_DOWN"),
        ((er <= p.er_range_max) & (vol_pct <= p.vol_range_max), "RANGE"),
    ], F.lit("CHOP"))


def market_columns(benchmark: DataFrame, p: MarketParams) -> DataFrame:
    """Market regime per session from the one-row-per-session benchmark."""
    over = "ORDER BY ts"  # bounded: one row per trading session
    out = windowed(benchmark, {"_lr": f"ln(close / nullif({call_over('lag(close)', over)}, 0))"})
    out = windowed(out, {
        "_sma": rolling_mean("close", over, p.sma_n), "_peak": rolling("max(close)", "close", over, p.dd_n),
        "_vol": rolling_std("_lr", over, p.vol_n, math.sqrt(p.bars_per_year)),
    })
    out = with_rolling_rank(out, "_vol", "vol_pct", p.vol_window, p.vol_min_periods, key=None)
    above = F.coalesce(F.col("close") > F.col("_sma"), F.lit(False))
    dd = F.expr("1D - close / nullif(_peak, 0)")
    stressed = (F.col("spy_dd_252") >= p.dd_stress) | (F.col("vol_pct") >= p.vol_stress)
    return out.withColumn("spy_above_ma", above).withColumn("spy_dd_252", dd).withColumn(
        "market_regime",
        first_reason([
            (F.col("spy_dd_252").isNull() | F.col("vol_pct").isNull(), "UNKNOWN"),
            (F.col("spy_above_ma") & (F.col("spy_dd_252") <= p.dd_warn) & ~stressed, "RISK_ON"),
            (~F.col("spy_above_ma") & stressed, "RISK_OFF"),
        ], F.lit("NEUTRAL")),
    ).drop("_lr", "_peak", "_vol").withColumnRenamed("_sma", "sma")


def asset_features(panel: DataFrame, benchmark: DataFrame, p: FeatureParams, r: RegimeParams) -> DataFrame:
    """All per-asset feature columns (everything but ranks, regime and market)."""
    return with_plain_columns(asset_series(in_series(panel), benchmark, p), p, r)


def asset_series(panel: DataFrame, benchmark: DataFrame, p: FeatureParams) -> DataFrame:
    """The columns that look along a series, of a panel partitioned by asset.

    One sort: window functions first, then one pass of the series steps.
    """
    df = with_bench_close(panel, benchmark)
    df = windowed(with_steps(with_bars_since_gap(with_bar_number(df))), {
        "_tr": true_range(),
        "_back": f"close - {lag_sql('close', p.slope_n)}",
        "efficiency_ratio_20": efficiency(p.er_n),
        "efficiency_ratio_60": efficiency(p.er_long_n),
        "donchian_high_20": channel("high", "max", p.donchian_short),
        "donchian_low_20": channel("low", "min", p.donchian_short),
        "donchian_high_55": channel("high", "max", p.donchian_long),
        "donchian_low_55": channel("low", "min", p.donchian_long),
        "mom_252_skip21": momentum(p.mom_long, p.mom_skip),
        "mom_126_skip21": momentum(p.mom_mid, p.mom_skip),
        "mom_21": momentum(p.mom_short),
    })
    steps = [atr_step(p.atr_n), averages_step(p.ema_fast, p.ema_slow), vol_step({"vol_20": p.vol_short, "vol_60": p.vol_long}, p.bars_per_year),
             rank_step("atr_pct", "atr_percentile_1y", p.vol_window, p.vol_min_periods), gap_step(p.gap_mean_n), overnight_step(p.overnight_n),
             bench_step(p.beta_window)]
    df = add_series(df, steps, ["_tr", "close", "open", "_lr", "_b"],
                    ["atr_14", "atr_pct", "ema_fast", "ema_slow", "vol_20", "vol_60", "atr_percentile_1y", "gap_atr", "gap_abs_mean_20",
                     "overnight_var_share_60", *BENCH], drop=("_tr", "_lr", "_step", "_b"))
    return df.withColumns(of_reference(p.reference_symbol))


def with_plain_columns(df: DataFrame, p: FeatureParams, r: RegimeParams) -> DataFrame:
    """The columns that follow from others of their row."""
    df = df.withColumn(
        "slope_atr_20", F.expr(f"_back / nullif(atr_14 * {math.sqrt(p.slope_n)!r}D, 0)")).drop("_back")
    return df.withColumns({
        "keltner_upper": F.col("ema_slow") + p.keltner_k * F.col("atr_14"),
        "keltner_lower": F.col("ema_slow") - p.keltner_k * F.col("atr_14"),
        "ema_spread_atr": ema_spread(),
        "dist_to_high_atr": F.expr("(donchian_high_55 - close) / nullif(atr_14, 0)"),
        "dist_to_low_atr": F.expr("(close - donchian_low_55) / nullif(atr_14, 0)"),
        "vol_bucket": vol_bucket(F.col("atr_percentile_1y"), r),
        "regime": regime(F.col("efficiency_ratio_20"), F.col("efficiency_ratio_60"),
                         F.col("slope_atr_20"), F.col("atr_percentile_1y"), r),
        "is_warm": F.col("bars_available") >= p.warmup,
    })
