"""Queries on indicators, features, market state, setups and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewise.functions.exprs import column, windowed
from tapewise.operators import features as FT
from tapewise.operators import indicators as I
from tapewise.operators import labels as L
from tapewise.operators import ranking as R
from tapewise.operators import setups as SU
from tapewise.plans import derived as D
from tapewise.plans.catalog import query, tidy
from tapewise.plans.inputs import strategies
from tapewise.plans.oracles import READY, blocked, d, i, s

W = D.WEEKLY
KEY = f"asset_id, {s('session')}"


def numbered(x):
    return I.with_bar_number(x.panel)


def view(df, *cols, **kw):
    return tidy(df.select("asset_id", "session", *cols), **kw)


def computed(df, **sql):
    """The frame with windowed columns added, and only those shown."""
    return view(windowed(df, sql), *sql)


@query("true_range_atr", f"SELECT {KEY}, {d('true_range atr_14 atr_pct')} FROM f3")
def true_range_atr(x):
    return view(windowed(I.with_atr(numbered(x), W.atr_n), {"true_range": I.true_range()}), "true_range", "atr_14", "atr_pct")


@query("moving_averages", f"SELECT {KEY}, {d('ema_fast ema_slow ema_spread_atr slope_atr_20 keltner_upper keltner_lower')} FROM f4")
def moving_averages(x):
    df = I.with_moving_averages(I.with_atr(numbered(x), W.atr_n), W.ema_fast, W.ema_slow)
    return view(df, "ema_fast", "ema_slow", I.ema_spread().alias("ema_spread_atr"), column(I.slope(W.slope_n)).alias("slope_atr_20"),
                (F.col("ema_slow") + W.keltner_k * F.col("atr_14")).alias("keltner_upper"),
                (F.col("ema_slow") - W.keltner_k * F.col("atr_14")).alias("keltner_lower"))


@query("price_channels", f"SELECT {KEY}, {d('donchian_high_20 donchian_low_20 donchian_high_55 donchian_low_55')} FROM f4")
def price_channels(x):
    return computed(x.panel, **{f"donchian_{c}_{t}": I.channel(c, a, n) for n, t in ((W.donchian_short, 20), (W.donchian_long, 55))
                                for c, a in (("high", "max"), ("low", "min"))})


@query("realised_volatility", f"SELECT {KEY}, {d('vol_20 vol_60')} FROM f4")
def realised_volatility(x):
    return view(I.with_realised_vol(I.with_steps(I.in_series(x.panel)), {"vol_20": W.vol_short, "vol_60": W.vol_long}, W.bars_per_year), "vol_20", "vol_60")


@query("opening_gaps", f"SELECT {KEY}, {d('gap_atr gap_abs_mean_20')} FROM f4")
def opening_gaps(x):
    return view(I.with_gap(I.with_atr(numbered(x), W.atr_n), W.gap_mean_n), "gap_atr", "gap_abs_mean_20")


@query("overnight_share", f"SELECT {KEY}, {d('overnight_var_share_60')} FROM feat")
def overnight_share(x):
    return view(I.with_overnight_share(x.panel, W.overnight_n), "overnight_var_share_60")


@query("momentum", f"SELECT {KEY}, {d('mom_252_skip21 mom_126_skip21 mom_21')} FROM f4")
def momentum(x):
    return computed(x.panel, mom_252_skip21=I.momentum(W.mom_long, W.mom_skip), mom_126_skip21=I.momentum(W.mom_mid, W.mom_skip),
                    mom_21=I.momentum(W.mom_short))


@query("efficiency_ratio", f"SELECT {KEY}, {d('efficiency_ratio_20 efficiency_ratio_60')} FROM f4")
def efficiency_ratio(x):
    return computed(I.with_steps(x.panel), efficiency_ratio_20=I.efficiency(W.er_n), efficiency_ratio_60=I.efficiency(W.er_long_n))


@query("volatility_percentile", f"SELECT {KEY}, {d('atr_percentile_1y')}, vol_bucket FROM feat")
def volatility_percentile(x):
    df = I.with_rolling_rank(I.with_atr(x.panel, W.atr_n), "atr_pct", "atr_percentile_1y", W.vol_window, W.vol_min_periods)
    return view(df, "atr_percentile_1y", I.vol_bucket(F.col("atr_percentile_1y"), D.WEEKLY_REGIME).alias("vol_bucket"))


@query("benchmark_beta", f"SELECT {KEY}, {d('beta_bench_90 corr_bench_90')} FROM betas")
def benchmark_beta(x):
    return view(I.with_bench_moments(x.panel, x.benchmark, W.beta_window, "SPY"), "beta_bench_90", "corr_bench_90")


@query("bar_continuity", f"SELECT {KEY}, {i('bars_available bars_since_gap')}, is_warm FROM f4")
def bar_continuity(x):
    df = I.with_bars_since_gap(numbered(x))
    return view(df, "bars_available", "bars_since_gap", (F.col("bars_available") >= W.warmup).alias("is_warm"))


@query("asset_regime", f"SELECT {KEY}, regime FROM feat")
def asset_regime(x):
    df = I.asset_features(x.panel, x.benchmark, W, D.WEEKLY_REGIME)
    return view(df, "regime")


@query("market_state", f"SELECT {s('session')}, {d('sma vol_pct spy_dd_252 vix_close')}, spy_above_ma, market_regime FROM market")
def market_state(x):
    df = I.market_columns(x.benchmark, D.WEEKLY_MARKET)
    return tidy(df.select("session", "sma", "vol_pct", "spy_dd_252", "vix_close", "spy_above_ma", "market_regime"))


@query("row_eligibility", f"SELECT {KEY}, eligible FROM f0")
def row_eligibility(x):
    return view(FT.with_eligibility(x.panel, x.snapshots), "eligible")


@query("cross_section_ranks", f"SELECT {KEY}, {d('mom_252_xs_pct vol_xs_pct')}, {i('xs_population')} FROM feat")
def cross_section_ranks(x):
    base = x.features.drop("mom_252_xs_pct", "vol_xs_pct", "xs_population")
    return view(FT.with_cross_section(base), "mom_252_xs_pct", "vol_xs_pct", "xs_population")


@query("price_rank_all_lines", """SELECT round(l_extendedprice, 2) AS l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity, count(*) AS copies,
  round(any_value(p), 9) AS pct FROM (SELECT l_extendedprice, l_quantity, (rank() OVER w + (count(*) OVER (PARTITION BY l_quantity, l_extendedprice) - 1) / 2e0)
  / count(*) OVER (PARTITION BY l_quantity) AS p FROM lineitem WINDOW w AS (PARTITION BY l_quantity ORDER BY l_extendedprice)) GROUP BY l_extendedprice, l_quantity""")
def price_rank_all_lines(x):
    li = x.table("lineitem").select("l_extendedprice", "l_quantity")
    ranked = R.average_pct_rank(li, ["l_quantity"], "l_extendedprice", "pct")
    return tidy(ranked.groupBy("l_extendedprice", "l_quantity").agg(F.count(F.lit(1)).alias("copies"), F.max("pct").alias("pct")), 9)


@query("quantiles_of_large_groups", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(median(l_extendedprice), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def quantiles_of_large_groups(x):
    return tidy(R.exact_quantiles(x.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


FEATURE_SQL = ", ".join([
    "asset_id", "symbol", s("session"), d("close atr_14 atr_pct vol_20 vol_60 ema_fast ema_slow ema_spread_atr slope_atr_20 efficiency_ratio_20 efficiency_ratio_60 "
    "atr_percentile_1y donchian_high_20 donchian_low_20 donchian_high_55 donchian_low_55 keltner_upper keltner_lower dist_to_high_atr dist_to_low_atr "
    "mom_252_skip21 mom_126_skip21 mom_21 mom_252_xs_pct vol_xs_pct gap_atr gap_abs_mean_20 overnight_var_share_60 spy_dd_252 vix_close beta_bench_90 corr_bench_90"),
    "regime, vol_bucket, market_regime, spy_above_ma, is_warm, eligible", i("xs_population bars_available bars_since_gap session_index")])


@query("feature_panel", f"SELECT {FEATURE_SQL} FROM feat")
def feature_panel(x):
    return tidy(x.features.drop("ts", "open", "high", "low", "close_raw"))


@query("feature_panel_emit_from", f"SELECT {KEY}, {d('ema_slow mom_252_xs_pct')}, {i('xs_population bars_available')} FROM feat WHERE session >= DATE '1999-01-01'")
def feature_panel_emit_from(x):
    f = FT.compute_features(x.panel, x.benchmark, x.snapshots, W, D.WEEKLY_REGIME, D.WEEKLY_MARKET, emit_from="1999-01-01 00:00:00")
    return view(f, "ema_slow", "mom_252_xs_pct", "xs_population", "bars_available")


SETUP_SQL = f"{KEY}, strategy_id, direction, {d('reference_price stop_price target_price risk_per_unit')}, CAST(hold AS BIGINT) AS max_hold_bars"
SETUP_COLS = ("strategy_id", "direction", "reference_price", "stop_price", "target_price", "risk_per_unit", "max_hold_bars")


@query("momentum_setups", f"SELECT {SETUP_SQL} FROM setups WHERE strategy_id = 'xsec_momentum_v1'")
def momentum_setups(x):
    return view(SU.detect_setups(x.features, strategies()[:1]), *SETUP_COLS)


@query("breakout_setups", f"SELECT {SETUP_SQL} FROM setups WHERE strategy_id = 'donchian_breakout_v1'")
def breakout_setups(x):
    return view(SU.detect_setups(x.features, strategies()[1:]), *SETUP_COLS)


@query("setups_any_market", f"""SELECT {KEY}, CASE WHEN mom_252_xs_pct >= 0.8 THEN 'LONG' ELSE 'SHORT' END AS direction, {d('close')} FROM feat
  WHERE {READY} AND (mom_252_xs_pct >= 0.8 OR mom_252_xs_pct <= 1e0 - 0.8e0)""")
def setups_any_market(x):
    return view(SU.detect_setups(x.features, strategies()[:1], gate_regime=False), "direction", "close")


@query("regime_gate", f"""SELECT {KEY}, coalesce(market_regime IN ('RISK_ON', 'NEUTRAL'), false) AS market_ok, coalesce(regime IN ('TREND_UP', 'TREND_DOWN'), false) AS breakout_ok, true AS momentum_ok FROM feat""")
def regime_gate(x):
    mo, br = strategies()
    return view(x.features, SU.market_allows(mo).alias("market_ok"), SU.regime_allows(br).alias("breakout_ok"), SU.regime_allows(mo).alias("momentum_ok"))


@query("momentum_top", f"""SELECT {KEY}, direction, {d('mom_252_xs_pct reference_price stop_price')}, CAST(k AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY abs(mom_252_xs_pct - 0.5e0) DESC, asset_id) AS k FROM setups WHERE strategy_id = 'xsec_momentum_v1') WHERE k <= 3""")
def momentum_top(x):
    rows = SU.detect_setups(x.features, strategies()[:1])
    order = F.struct((-F.abs(F.col("mom_252_xs_pct") - 0.5)).alias("neg"), F.col("asset_id").alias("tie"))
    out = R.with_position(rows.withColumn("_ord", order), ["ts"], "_ord", name="rank").where("rank <= 3")
    return view(out, "direction", "mom_252_xs_pct", "reference_price", "stop_price", "rank")


OUTCOME_SQL = f"""asset_id, CAST(setup_session AS VARCHAR) AS setup_ts, strategy_id, direction, CAST(entry_session AS VARCHAR) AS entry_ts, CAST(exit_session AS VARCHAR) AS resolution_ts,
  outcome, {i('bars_held')}, {d('entry_price exit_price stop_price target_price realised_r_gross mae_r mfe_r entry_gap_atr')}"""


@query("triple_barrier", f"SELECT {OUTCOME_SQL} FROM labels_")
def triple_barrier(x):
    ss = strategies()
    res = L.resolve(SU.detect_setups(x.features, ss), x.panel, max(z.max_hold_bars for z in ss))
    return tidy(res.select("asset_id", "setup_ts", "strategy_id", "direction", "entry_ts", "resolution_ts", "outcome", "bars_held", "entry_price",
                           "exit_price", "stop_price", "target_price", "realised_r_gross", "mae_r", "mfe_r", "entry_gap_atr"))


@query("triple_barrier_target_tie", f"""SELECT s.asset_id, CAST(s.session AS VARCHAR) AS setup_ts, s.strategy_id, s.direction, coalesce(e.code, 'OPEN') AS outcome, round(e.px, 6) AS exit_price
  FROM setups s LEFT JOIN (SELECT asset_id, session, strategy_id, direction, arg_min(code2, k) FILTER (code2 IS NOT NULL) AS code, arg_min(px2, k) FILTER (code2 IS NOT NULL) AS px FROM (
    SELECT *, CASE WHEN sgn * open <= sgn * stp THEN 'STOP' WHEN greatest(sgn * high, sgn * low) >= sgn * tgt THEN 'TARGET' WHEN least(sgn * high, sgn * low) <= sgn * stp THEN 'STOP' WHEN k >= hold THEN 'TIME' END AS code2,
    CASE WHEN sgn * open <= sgn * stp THEN open WHEN greatest(sgn * high, sgn * low) >= sgn * tgt THEN CASE WHEN sgn * open >= sgn * tgt THEN open ELSE tgt END
      WHEN least(sgn * high, sgn * low) <= sgn * stp THEN stp WHEN k >= hold THEN close END AS px2 FROM fwd1) GROUP BY ALL) e USING (asset_id, session, strategy_id, direction)""")
def triple_barrier_target_tie(x):
    ss = strategies()
    res = L.resolve(SU.detect_setups(x.features, ss), x.panel, max(z.max_hold_bars for z in ss), "TARGET")
    return tidy(res.select("asset_id", "setup_ts", "strategy_id", "direction", "outcome", "exit_price"))


@query("earnings_window", f"SELECT asset_id, CAST(session AS VARCHAR) AS session, {blocked('p', '8')} AS had_earnings_in_window FROM panel p")
def earnings_window(x):
    rows = x.panel.select("asset_id", "ts", "session", "session_index", F.lit(8).alias("max_hold_bars"))
    out = L.with_earnings_flag(rows, x.earnings, x.calendar, x.tickers.select("asset_id", "is_etf"), [8])
    return view(out, "had_earnings_in_window")


LABEL_SQL = f"""{OUTCOME_SQL}, symbol, regime, market_regime, vol_bucket, {d('reference_price risk_per_unit reward_risk_ratio atr_pct efficiency_ratio_20 beta_bench_90 mom_252_xs_pct overnight_var_share_60')},
  {d('adv_usd_60', 3)}, {i('xs_population')}, had_earnings_in_window"""


@query("label_table", f"SELECT {LABEL_SQL} FROM labels_")
def label_table(x):
    return tidy(x.labels, adv_usd_60=3)


@query("label_partitions", f"SELECT {OUTCOME_SQL} FROM labels_ WHERE strategy_id = 'donchian_breakout_v1'")
def label_partitions(x):
    from tapewise.plans.queries_panel import scratch
    from tapewise.sources.tables import read_labels, write_labels
    path = scratch(x, "labels")
    write_labels(x.labels, path)
    return tidy(read_labels(x.spark, path, "donchian_breakout_v1").select(
        "asset_id", "setup_ts", "strategy_id", "direction", "entry_ts", "resolution_ts", "outcome", "bars_held", "entry_price",
        "exit_price", "stop_price", "target_price", "realised_r_gross", "mae_r", "mfe_r", "entry_gap_atr"))


@query("labels_resumed", f"SELECT {OUTCOME_SQL} FROM labels_ WHERE asset_id NOT IN (SELECT asset_id FROM tick WHERE exchange = 'NYSE')")
def labels_resumed(x):
    done = x.tickers.where("exchange = 'NYSE'")
    return tidy(L.label_setups(x.features, x.panel, strategies(), x.snapshots, x.earnings, x.tickers.select("asset_id", "is_etf"),
                               x.calendar, done=done).select(
        "asset_id", "setup_ts", "strategy_id", "direction", "entry_ts", "resolution_ts", "outcome", "bars_held", "entry_price",
        "exit_price", "stop_price", "target_price", "realised_r_gross", "mae_r", "mfe_r", "entry_gap_atr"))


@query("label_summary", """SELECT strategy_id, count(*) AS rows, CAST(sum(CASE WHEN outcome = 'OPEN' THEN 1 ELSE 0 END) AS BIGINT) AS open,
  CAST(sum(CASE WHEN outcome <> 'OPEN' THEN 1 ELSE 0 END) AS BIGINT) AS resolved FROM labels_ GROUP BY 1""")
def label_summary(x):
    return tidy(L.label_summary(x.labels))
