"""Triple barriers against a plain loop, earnings rules, walk-forward statistics."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.operators import edge as E
from tapewise.operators import labels as L
from tapewise.operators import setups as SU
from tapewise.operators.bootstrap import bootstrap_means, bootstrap_statistic, interval, weights, with_weight
from tapewise.params import EdgeParams


def loop(bars, i, sign, risk, reward, hold, tie):
    """The barrier rules, one bar after the other."""
    fwd = bars.iloc[i + 1:i + 1 + hold]
    if fwd.empty:
        return "OPEN", 0, None, 0.0, 0.0
    entry = fwd.open.iloc[0]
    stop, target = entry - sign * risk, None if reward is None else entry + sign * reward
    mae = mfe = 0.0
    for k, b in enumerate(fwd.itertuples(), 1):
        a, c = sign * (b.high - entry) / risk, sign * (b.low - entry) / risk
        mae, mfe = min(mae, a, c), max(mfe, a, c)
        if sign * b.open <= sign * stop:
            return "STOP", k, b.open, mae, mfe
        s = min(sign * b.low, sign * b.high) <= sign * stop
        t = target is not None and max(sign * b.low, sign * b.high) >= sign * target
        if s and not (t and tie == "TARGET"):
            return "STOP", k, stop, mae, mfe
        if t:
            return "TARGET", k, b.open if sign * b.open >= sign * target else target, mae, mfe
        if k >= hold:
            return "TIME", k, b.close, mae, mfe
    return "OPEN", len(fwd), None, mae, mfe


@pytest.mark.parametrize("tie,size,hold", [("STOP", 16, 14), ("TARGET", 16, 14), ("STOP", 4, 60), ("TARGET", 1, 25), ("STOP", 16, 200)])
def test_random_setups_match_the_loop(spark, tie, size, hold):
    rng = np.random.default_rng(21)
    parts = []
    for a in ("a", "b"):
        c = np.exp(np.cumsum(rng.normal(0, 0.03, 120))) * 50
        o = np.r_[c[0], c[:-1]] * np.exp(rng.normal(0, 0.015, 120))
        parts.append(pd.DataFrame({"asset_id": a, "ts": pd.date_range("2020-01-01", periods=120), "open": o,
                                   "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * .99, "close": c}))
    bars = pd.concat(parts, ignore_index=True)
    rows = []
    for n, r in enumerate(bars.sample(150, random_state=1).itertuples()):
        sign, risk = (1, -1)[n % 2], r.close * rng.uniform(.01, .08 if hold < 20 else .4)
        reward = None if n % 3 == 0 else risk * rng.uniform(.5, 2)
        rows.append((r.asset_id, r.ts.to_pydatetime(), f"s{n}", "LONG" if sign > 0 else "SHORT", sign, r.close, r.close - sign * risk,
                     None if reward is None else r.close + sign * reward, risk, reward, int(rng.integers(1, hold + 1)), 1.0))
    schema = ("asset_id string, ts timestamp, strategy_id string, direction string, sign int, reference_price double, stop_price double, "
              "target_price double, risk_per_unit double, reward_per_unit double, max_hold_bars int, atr_14 double")
    setups = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(bars).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.strategy_id: r for r in L.resolve(setups, b, hold, tie, size).collect()}
    assert len(got) == len(rows)
    for row in rows:
        one = bars[bars.asset_id == row[0]].reset_index(drop=True)
        i = int(one.index[one.ts == row[1]][0])
        out, held, px, mae, mfe = loop(one, i, row[4], row[8], row[9], row[10], tie)
        g = got[row[2]]
        assert (g.outcome, g.bars_held) == (out, held), row
        assert (g.exit_price, g.mae_r, g.mfe_r) == (None if px is None else pytest.approx(px), pytest.approx(mae), pytest.approx(mfe))
        if held == 0:
            assert g.entry_ts == row[1] and g.entry_price is None and g.stop_price == row[6]


def test_stop_at_the_level(spark):
    ts = pd.date_range("2020-01-01", periods=3)
    bars = spark.createDataFrame(pd.DataFrame({"asset_id": "a", "ts": ts, "open": [1.0, 100, 100.5], "high": [1.0, 101, 101], "low": [1.0, 99, 95], "close": [1.0, 100.5, 96]})).withColumn("ts", F.col("ts").cast("timestamp"))
    s = spark.createDataFrame([("a", ts[0].to_pydatetime(), "s", "LONG", 1, 100.0, 95.0, 110.0, 5.0, 10.0, 21, 1.0)],
                              "asset_id string, ts timestamp, strategy_id string, direction string, sign int, reference_price double, stop_price double, target_price double, risk_per_unit double, reward_per_unit double, max_hold_bars int, atr_14 double")
    r = L.resolve(s, bars, 21).first()
    assert (r.outcome, r.exit_price, r.realised_r_gross) == ("STOP", 95.0, -1.0)


def test_earnings_rules_block_on_missing_knowledge(spark, market):
    cal = market["calendar"]
    days = [r.session for r in cal.orderBy("session_index").limit(60).collect()]
    ev = spark.createDataFrame([
        ("exact", days[30], dt.datetime(2004, 1, 5)), ("band", days[30], None), ("late", days[30], dt.datetime(2010, 1, 1)),
        ("beyond", dt.date(2011, 1, 1), None), ("etf", days[21], None)], "asset_id string, earnings_date date, available_ts timestamp")
    etf = spark.createDataFrame([("etf", True), ("exact", False)], "asset_id string, is_etf boolean")
    at = cal.where("session_index in (15, 19, 20, 24, 29, 30, 33, 34)").select(F.col("close_utc").alias("ts"), "session_index")
    rows = spark.createDataFrame([(a,) for a in ("exact", "band", "late", "beyond", "etf", "none")], "asset_id string").crossJoin(at).withColumn("max_hold_bars", F.lit(10))
    out = L.with_earnings_flag(rows, ev, cal, etf, [10, 3], "f").collect()
    got = {(r.asset_id, r.session_index): r.f for r in out}
    assert len(got) == len(out) == 48
    assert {t for (a, t), f in got.items() if a == "exact" and f} == {20, 24, 29}
    assert {t for (a, t), f in got.items() if a == "band" and f} == {19, 20, 24, 29, 30, 33}
    assert all(f for (a, _), f in got.items() if a in ("late", "beyond", "none")) and not any(f for (a, _), f in got.items() if a == "etf")


def test_strategies_validate_and_fire_on_strict_breakouts(spark):
    with pytest.raises(ValueError, match="unknown parameter"):
        SU.make_strategy("xsec_momentum_v1", {"nope": 1})
    with pytest.raises(ValueError, match="max_hold_bars"):
        SU.make_strategy("donchian_breakout_v1", {"max_hold_bars": 0})
    with pytest.raises(ValueError, match="unknown strategy"):
        SU.make_strategy("x")
    s = SU.make_strategy("donchian_breakout_v1")
    rows = [("up", 10.3, 10.0, 1.0, "TREND_UP"), ("edge", 10.1, 10.0, 1.0, "TREND_UP"), ("down", 7.0, 9.0, -1.0, "TREND_DOWN"), ("chop", 99.0, 10.0, 1.0, "CHOP"),
            ("flat", 10.3, 10.0, 0.1, "TREND_UP")]
    df = spark.createDataFrame([(a, True, c, 1.0, r, "RISK_ON", h, h, e, 0.5) for a, c, h, e, r in rows],
                               "asset_id string, is_warm boolean, close double, atr_14 double, regime string, market_regime string, donchian_high_55 double, donchian_low_55 double, ema_spread_atr double, mom_252_xs_pct double")
    out = {r.asset_id: r for r in SU.detect_setups(df, [s]).collect()}
    assert set(out) == {"up", "down"}
    assert (out["up"].stop_price, out["up"].target_price) == (pytest.approx(7.3), pytest.approx(16.3))
    assert (out["down"].stop_price, out["down"].target_price) == (pytest.approx(10.0), pytest.approx(1.0))
    assert SU.detect_setups(df.withColumn("market_regime", F.lit("RISK_OFF")), [s]).count() == 0


@pytest.fixture(scope="module")
def labels(spark):
    rng = np.random.default_rng(9)
    n = 1500
    day = pd.Timestamp("2020-01-06") + pd.to_timedelta(rng.integers(0, 300, n), unit="D")
    r = np.where(rng.random(n) < .4, -1.0, rng.normal(.2, 1, n))
    pdf = pd.DataFrame({"asset_id": [f"a{i}" for i in range(n)], "strategy_id": "s", "direction": np.where(rng.random(n) < .8, "LONG", "SHORT"), "vol_bucket": "MID",
                        "setup_ts": day, "resolution_ts": day + pd.Timedelta(days=5), "realised_r_gross": r, "outcome": np.where(r == -1, "STOP", "TIME"),
                        "bars_held": rng.integers(1, 20, n)})
    df = spark.createDataFrame(pdf).withColumn("setup_ts", F.col("setup_ts").cast("timestamp")).withColumn(
        "resolution_ts", F.when(F.col("asset_id") != "a7", F.col("resolution_ts").cast("timestamp")))
    return pdf.assign(resolution_ts=pdf.resolution_ts.mask(pdf.asset_id == "a7")), df


def test_edge_table_uses_only_earlier_resolutions(spark, labels):
    pdf, df = labels
    stamps = list(pd.date_range("2020-01-01", "2020-11-01", freq="MS"))
    grid = spark.createDataFrame([(t.to_pydatetime(),) for t in stamps], "as_of timestamp")
    got = E.build_edge(df, grid, EdgeParams()).toPandas().set_index(["direction", "as_of"])
    assert len(got) == 2 * len(stamps)
    for (dirn, t), g in got.iterrows():
        s = pdf[(pdf.direction == dirn) & (pdf.resolution_ts < t)].realised_r_gross
        assert g.n == len(s)
        if len(s) > 1:
            want = [s.mean(), s.std(), s.mean() - 1.28 * s.std() / np.sqrt(len(s)), s.median(), s.quantile(.05), s.quantile(.95)]
            np.testing.assert_allclose(g[["mean_r", "std_r", "ev_r_lcb", "median_r", "p05_r", "p95_r"]].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-12)
        if len(s) == 0:
            assert pd.isna(g.mean_r) and pd.isna(g.win_rate)


def test_golden_bin(spark):
    df = spark.createDataFrame([("s", "LONG", "MID", dt.datetime(2020, 1, 1), r, "TIME", 5) for r in (1.0, -1.0, .5, -.5)],
                               "strategy_id string, direction string, vol_bucket string, resolution_ts timestamp, realised_r_gross double, outcome string, bars_held int")
    b = E.bin_statistics(df).first()
    std = np.sqrt(2.5 / 3)
    assert (b.mean_r, b.std_r, b.ev_r_lcb) == (pytest.approx(0), pytest.approx(std), pytest.approx(-1.28 * std / 2))
    assert (b.win_rate, b.avg_win_r, b.avg_loss_r, b.time_rate) == (.5, .75, -.75, 1.0)


def test_edge_parameters_are_checked(labels):
    for bad in (EdgeParams(grid="weekly"), EdgeParams(dimensions=("strategy_id",)), EdgeParams(lcb_method="x")):
        with pytest.raises(ValueError):
            E.check_edge_params(bad)


def test_bootstrap_weights_and_interval(spark, labels):
    pdf, df = labels
    w = with_weight(spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("r")), "id", "r", 5, "w")
    m = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert m.m == pytest.approx(1, abs=.02) and m.v == pytest.approx(1, abs=.03)
    key = F.substring("asset_id", 2, 9).cast("long")
    one, many = (bootstrap_means(df.repartition(k), ["direction"], F.col("realised_r_gross"), key, 400, 1).toPandas().sort_values(["direction", "replicate"])["mean"].to_numpy() for k in (1, 16))
    np.testing.assert_allclose(one, many, rtol=1e-9)
    got = {r.direction: r for r in interval(bootstrap_means(df, ["direction"], F.col("realised_r_gross"), key, 400, 1), ["direction"], "mean", .9, "lo", "hi").collect()}
    for dirn, s in pdf.groupby("direction").realised_r_gross:
        half = 1.645 * s.std() / np.sqrt(len(s))
        assert got[dirn].lo == pytest.approx(s.mean() - half, abs=half * .35) and got[dirn].hi == pytest.approx(s.mean() + half, abs=half * .35)


def test_statistic_over_weighted_sums(spark, labels):
    _, df = labels
    key = F.substring("asset_id", 2, 9).cast("long")
    a = bootstrap_statistic(df, ["direction"], {"s": F.col("realised_r_gross")}, key, 20, 1, "s / weight").toPandas().sort_values(["direction", "replicate"]).stat.to_numpy()
    b = bootstrap_means(df, ["direction"], F.col("realised_r_gross"), key, 20, 1).toPandas().sort_values(["direction", "replicate"])["mean"].to_numpy()
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_array_weights_equal_column_weights(spark):
    rows = spark.range(300).select(F.expr("id * 977").alias("k"), F.expr("id % 37").alias("r"))
    got = with_weight(rows, "k", "r", 5).toPandas()
    assert (weights(got.k.to_numpy(), 37, 5)[np.arange(300), got.r.to_numpy()] == got._w.to_numpy()).all()


def test_resume_skips_finished_assets_and_refuses_other_settings(spark, labels, tmp_path):
    from tapewise.sources.tables import read_resumable_labels, write_labels_resumable
    _, df = labels
    path, seen = str(tmp_path / "run"), []

    def part(limit):
        def compute(done):
            todo = df.where(F.substring("asset_id", 2, 9).cast("int") < limit).join(done, "asset_id", "left_anti")
            seen.append(todo.count())
            return todo, todo.select("asset_id").distinct()
        return compute

    write_labels_resumable(spark, path, "h", ["s"], part(100))
    write_labels_resumable(spark, path, "h", ["s"], part(250))
    assert seen == [100, 150] and read_resumable_labels(spark, path).count() == 250
    df.limit(7).withColumn("attempt", F.lit("crashed")).write.partitionBy("attempt", "strategy_id").mode("append").parquet(f"{path}/labels")
    assert read_resumable_labels(spark, path).count() == 250
    with pytest.raises(ValueError, match="another configuration"):
        write_labels_resumable(spark, path, "other", ["s"], part(300))
