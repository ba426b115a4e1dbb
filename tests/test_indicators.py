"""Golden values, pandas cross-checks, causality and partitioning of features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.functions import sliding as SL
from tapewise.functions.exprs import windowed
from tapewise.operators import features as FT
from tapewise.operators import indicators as I
from tapewise.params import FeatureParams, MarketParams, RegimeParams
from tapewise.sources.synthetic import asset_id

SMALL = FeatureParams(atr_n=5, ema_fast=4, ema_slow=9, slope_n=5, donchian_short=5, donchian_long=10, er_n=5, er_long_n=10,
                      vol_short=5, vol_long=10, vol_window=60, vol_min_periods=12, gap_mean_n=5, overnight_n=10, beta_window=20,
                      mom_long=40, mom_mid=20, mom_skip=3, mom_short=3)
SMALL_MARKET = MarketParams(sma_n=20, dd_n=30, vol_n=5, vol_window=50, vol_min_periods=20)


def tiny(spark, high, low, close, open_=None):
    n = len(close)
    pdf = pd.DataFrame({"asset_id": "a", "symbol": "a", "ts": pd.date_range("2020-01-01", periods=n), "session_index": range(n),
                        "open": open_ or close, "high": high, "low": low, "close": close})
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))


def column(df, c):
    return df.orderBy("ts").select(c).toPandas()[c].to_numpy(dtype=float)


def test_true_range_first_bar_has_no_previous_close(spark):
    df = tiny(spark, [12.0, 13, 10, 15, 16], [9.0, 10, 7, 9, 13], [11.0, 12, 9, 14, 15])
    assert column(windowed(df, {"tr": I.true_range()}), "tr").tolist() == [3, 3, 5, 6, 3]


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 51, 0.5, 0.995, 1.0])
def test_blocked_ema_equals_the_recursion(spark, alpha):
    rng = np.random.default_rng(5)
    x = np.exp(np.cumsum(rng.normal(0, 0.02, 700))) * 50
    df = I.with_ema(tiny(spark, x.tolist(), x.tolist(), x.tolist()), "close", "e", alpha, 3)
    want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=3).mean()
    np.testing.assert_allclose(column(df, "e"), want, rtol=1e-12)


def test_moments_and_ranks_match_pandas(spark):
    rng = np.random.default_rng(8)
    x = np.exp(np.cumsum(rng.normal(0, 0.03, 300))) * 20
    x[100:140] = x[100]  # a constant stretch has exactly zero variance
    df = I.with_steps(tiny(spark, x.tolist(), x.tolist(), x.tolist()))
    df = I.with_rolling_median(I.with_rolling_rank(I.with_realised_vol(df, {"v": 20}, 252), "close", "r", 50, 10), "close", "m", 6)
    np.testing.assert_allclose(column(df, "m"), pd.Series(x).rolling(6).median(), rtol=1e-12)
    lr = np.log(pd.Series(x) / pd.Series(x).shift(1))
    np.testing.assert_allclose(column(df, "v"), lr.rolling(20).std() * np.sqrt(252), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(column(df, "r"), pd.Series(x).rolling(50, min_periods=10).rank(pct=True), rtol=1e-12)
    assert column(df, "v")[125] == 0.0


def test_channel_excludes_the_current_bar(spark):
    df = tiny(spark, [1.0, 2, 9, 3, 4], [1.0] * 5, [1.0] * 5)
    assert pd.isna(column(windowed(df, {"c": I.channel("high", "max", 2)}), "c")[:2]).all()
    assert column(windowed(df, {"c": I.channel("high", "max", 2)}), "c")[2:].tolist() == [2, 9, 9]


def test_bars_since_gap_restarts_at_zero(spark):
    df = tiny(spark, [1.0] * 5, [1.0] * 5, [1.0] * 5).withColumn("session_index", F.element_at(F.array(*map(F.lit, [0, 1, 5, 6, 7])), F.col("session_index").cast("int") + 1))
    assert column(I.with_bars_since_gap(df), "bars_since_gap").tolist() == [0, 1, 0, 1, 2]


def test_beta_of_a_hole_in_the_benchmark_widens_returns(spark):
    rng = np.random.default_rng(2)
    x = np.exp(np.cumsum(rng.normal(0, 0.02, 60))) * 30
    b = np.exp(np.cumsum(rng.normal(0, 0.01, 60))) * 100
    df = tiny(spark, x.tolist(), x.tolist(), x.tolist())
    bench = tiny(spark, b.tolist(), b.tolist(), b.tolist()).where("session_index not in (20, 21)")
    got = column(I.with_bench_moments(df, bench, 15, "SPY"), "beta_bench_90")
    j = pd.DataFrame({"s": x, "b": b}).drop([20, 21])
    rs, rb = np.log(j.s / j.s.shift()), np.log(j.b / j.b.shift())
    want = (rs.rolling(15, min_periods=7).cov(rb) / rb.rolling(15, min_periods=7).var()).reindex(range(60))
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-8)


@pytest.mark.parametrize("er,erl,slope,vol,want", [
    (None, .3, .3, .5, "UNKNOWN"), (.3, .2, .25, .5, "TREND_UP"), (.3, .2, -.25, .5, "TREND_DOWN"),
    (.15, .1, 0.0, .67, "RANGE"), (.2, .1, 0.0, .5, "CHOP"), (.15, .1, 0.0, .68, "CHOP")])
def test_regime_thresholds_are_inclusive(spark, er, erl, slope, vol, want):
    df = spark.createDataFrame([(er, erl, slope, vol)], "a double, b double, c double, d double")
    assert df.select(I.regime(*[F.col(c) for c in "abcd"], RegimeParams()).alias("r")).first()["r"] == want


def _features(market, panel, stage=False):
    snaps = market["names"].select("asset_id", "symbol").withColumn("ts", F.to_timestamp(F.lit("2004-02-02 21:00:00"))).withColumn(
        "eligible", F.col("asset_id") != asset_id(8)).withColumn("adv_usd_60", F.lit(1e7))
    return FT.compute_features(panel, market["bench"], snaps, SMALL, RegimeParams(), SMALL_MARKET, stage=stage)


def test_feature_contract_and_rank_population(market):
    f = _features(market, market["panel"])
    assert set(FT.FEATURE_COLUMNS) <= set(f.columns)
    p = f.where("ts > '2004-06-01'").toPandas()
    assert len(p) == market["panel"].where("ts > '2004-06-01'").count()
    assert p[p.asset_id == asset_id(8)].mom_252_xs_pct.isna().all()
    one = p[p.ts == p.ts.max()]
    assert (one.xs_population == one.eligible.sum()).all()
    assert one.mom_252_xs_pct.max() == 1.0


def test_future_bars_do_not_change_the_past(market):
    cut = "2005-02-15 23:00:00"
    full = _features(market, market["panel"]).where(F.col("ts") <= cut)
    altered = market["panel"].where(F.col("ts") <= cut)
    cols = ["asset_id", "ts", "atr_14", "ema_slow", "vol_60", "atr_percentile_1y", "mom_252_skip21", "mom_252_xs_pct", "beta_bench_90"]
    a, b = (d.select(*cols).toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True) for d in (full, _features(market, altered)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_partitioning_does_not_matter(market, spark):
    cols = ["asset_id", "ts", "ema_fast", "vol_20", "mom_252_xs_pct"]
    a, b = (_features(market, market["panel"].repartition(n)).select(*cols).toPandas().sort_values(["asset_id", "ts"]).reset_index(drop=True) for n in (1, 16))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


# -- series in one pass ---------------------------------------------------------


def padded(series):
    out = np.full((len(series), max(map(len, series))), np.nan)
    for i, x in enumerate(series):
        out[i, :len(x)] = x
    return out


@pytest.fixture(scope="module")
def ragged():
    rng = np.random.default_rng(12)
    out = []
    for n in (1, 2, 7, 64, 130, 700):
        x = rng.normal(0, 1, n).round(1)
        x[rng.random(n) < 0.1] = np.nan
        out.append(x)
    return out


@pytest.mark.parametrize("n,need", [(2, 2), (5, 5), (20, 8), (64, 64), (504, 126)])
def test_sliding_windows_match_pandas(ragged, n, need):
    m = padded(ragged)
    other = np.roll(np.nan_to_num(m, nan=0.3), 1, axis=1)
    cov, var, avg, rank, med = SL.covariance(m, n, other, need), SL.covariance(m, n, need=need), SL.mean(m, n, need), SL.pct_rank(m, n, need), SL.median(m, n)
    for i, x in enumerate(ragged):
        s, o = pd.Series(x), pd.Series(other[i, :len(x)])
        np.testing.assert_allclose(var[i, :len(x)], s.rolling(n, min_periods=need).var(), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(avg[i, :len(x)], s.rolling(n, min_periods=need).mean(), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(cov[i, :len(x)], s.rolling(n, min_periods=need).cov(o.where(s.notna())), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(rank[i, :len(x)], s.rolling(n, min_periods=need).rank(pct=True), rtol=1e-12)
        np.testing.assert_allclose(med[i, :len(x)], s.rolling(n).median(), rtol=1e-12)


def test_windows_do_not_depend_on_bars_outside():
    rng = np.random.default_rng(6)
    calm = rng.normal(0, 1e-9, 40)
    calm[20:] = calm[20]
    wild = np.concatenate([rng.normal(0, 1e12, 500), calm])
    for n in (5, 16):
        a, b = SL.covariance(calm[None, :], n)[0, n - 1:], SL.covariance(wild[None, :], n)[0, 500 + n - 1:]
        np.testing.assert_allclose(a, b, rtol=1e-12)
        assert (a[-3:] == 0).all() and (b[-3:] == 0).all() and (a[:3] > 0).all()


def test_volatility_after_a_large_early_history(spark):
    close = np.concatenate([50.0 * 10.0 ** np.tile([0, 9], 30), 40 + 1e-7 * np.arange(60) % 3e-7])
    df = tiny(spark, close.tolist(), close.tolist(), close.tolist())
    v = column(I.with_realised_vol(I.with_steps(df), {"v": 20}, 252), "v")
    lr = np.log(close[1:] / close[:-1])
    assert v[-1] == pytest.approx(np.std(lr[-20:], ddof=1) * np.sqrt(252), rel=1e-9) and v[-1] > 0


def test_series_are_cut_anywhere(spark, monkeypatch):
    """Series over many Arrow batches, of very different lengths, with few cells at a time."""
    rng = np.random.default_rng(3)
    rows = [(f"k{a}" if a else None, int(t), float(x)) for a, n in enumerate((5, 1, 2000, 40, 3)) for t, x in enumerate(rng.normal(0, 1, n))]
    pdf = pd.DataFrame(rows, columns=["asset_id", "ts", "close"])
    df = spark.createDataFrame(rows, "asset_id string, ts int, close double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = I.with_rolling_rank(df.repartition(3), "close", "r", 30, 4).toPandas().sort_values(["asset_id", "ts"], na_position="first")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pdf = pdf.sort_values(["asset_id", "ts"], na_position="first")
    want = pdf.groupby("asset_id", dropna=False).close.transform(lambda s: s.rolling(30, min_periods=4).rank(pct=True))
    np.testing.assert_allclose(got.r.to_numpy(float), want.to_numpy(float), rtol=1e-12)
    assert I.with_rolling_rank(df.where("false"), "close", "r", 30, 4).collect() == []


def test_features_take_one_sort_by_asset(market):
    plan = I.asset_features(market["panel"], market["bench"], SMALL, RegimeParams())._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Sort [asset_id") == 1 and final.count("Exchange hashpartitioning(asset_id") == 1 and "collect_list" not in final
