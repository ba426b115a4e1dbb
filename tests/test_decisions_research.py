"""Costs, allocation, sentiment, research metrics and streams."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.functions import stats as ST
from tapewise.operators import decisions as DE
from tapewise.operators import portfolio as PF
from tapewise.operators import research as RE
from tapewise.operators import sentiment as SE
from tapewise.params import CostParams, PortfolioParams, RiskParams, SentimentParams
from tapewise.streaming import continuity as SC
from tapewise.streaming import observations as SO


def test_golden_cost(spark):
    n = 400 / .054
    cols = DE.round_trip_cost(F.lit(n), F.lit(400.0), F.lit(10.0), F.lit(230.0), F.lit(.018), F.lit(1.0), F.lit(1.5e9), F.lit("LONG"))
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (r.entry_fee_bps + r.exit_fee_bps, r.spread_bps, r.slippage_bps) == (pytest.approx(.945, abs=1e-9), 2.0, pytest.approx(9.2))
    assert r.impact_bps == pytest.approx(.4, abs=1e-3) and r.funding_bps == 0
    assert r.cost_r == pytest.approx(12.545e-4 / .054, rel=1e-3)
    with pytest.raises(ValueError):
        DE.round_trip_cost(*[F.lit(1.0)] * 8, CostParams(multiplier=.5))


def _book(spark, n_ranked=8, **book):
    base = {"equity": 100_000.0, "peak_equity": 100_000.0, "day_start_equity": 100_000.0, "trades_today": 0, "bars_since_breaker": 10_000}
    books = spark.createDataFrame([(1, *[{**base, **book}[k] for k in base])], "ts int, " + "equity double, peak_equity double, day_start_equity double, trades_today int, bars_since_breaker int")
    ranked = spark.createDataFrame(
        [(1, i, f"S{i}", "x", "LONG", f"C{i % 2}", 100.0, 95.0, 100.0, 3e8, .02, 1.0, 1.0, 1.0, 10.0, 1.0, 1.0, 0.0) for i in range(1, n_ranked + 1)],
        "ts int, rank int, symbol string, strategy_id string, direction string, cluster string, reference_price double, stop_price double, price_raw double, adv_usd_60 double, "
        "atr_pct double, spread_bps_est double, beta_bench_90 double, ev_r_lcb double, expected_bars_held double, sentiment_multiplier double, step_size double, min_notional_usd double")
    return ranked, books


def _positions(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows] or [(0, "-", "-", 1.0, 0.0, 1.0, 1.0, 0.0)],
                                 "ts int, symbol string, cluster string, sign double, qty double, entry_price double, stop_price double, beta_bench_90 double")


def _reasons(spark, rows=(), p=PortfolioParams(), r=RiskParams(), ranked=None, **book):
    base, books = _book(spark, **book)
    out = PF.allocate(base if ranked is None else ranked(base), books, _positions(spark, list(rows)), ["ts"], p, r).orderBy("rank").collect()
    return [o.reason for o in out], out


def test_allocation_walks_in_rank_order(spark):
    reasons, out = _reasons(spark)
    # risk 400 each: heat .4% apiece, top_n is 3; net beta .4% each fits 1.5%
    assert reasons[:3] == [None] * 3 and set(reasons[3:]) == {"BELOW_TOP_N"} and len(out) == 8
    assert out[0].qty == 80.0 and out[0].risk_usd == 400.0 and out[0].notional_usd == 8000.0


def test_allocation_limits(spark):
    six = [(f"P{i}", "Z", 1.0, 0.0, 10.0, 9.0, 0.0) for i in range(6)]
    assert set(_reasons(spark, six)[0]) == {"MAX_POSITIONS"}
    assert set(_reasons(spark, r=RiskParams(trading_enabled=False))[0]) == {"KILL_SWITCH"}
    assert set(_reasons(spark, day_start_equity=104_000.0)[0]) == {"CIRCUIT_BREAKER"}
    assert set(_reasons(spark, peak_equity=120_000.0)[0]) == {"CIRCUIT_BREAKER"}
    assert _reasons(spark, [("S1", "Z", 1.0, 0.0, 10.0, 9.0, 0.0)])[0][:2] == ["ALREADY_IN_POSITION", None]
    assert _reasons(spark, [("P", "C1", 1.0, 700.0, 10.0, 9.0, 0.0)])[0][0] == "CLUSTER_CAP"
    assert _reasons(spark, [("P", "Z", 1.0, 1400.0, 10.0, 9.0, 1.0)])[0][0] == "BETA_CAP"
    assert _reasons(spark, [("P", "Z", 1.0, 149_000.0, 1.0, 1.0, 0.0)])[0][0] == "GROSS_EXPOSURE_CAP"
    assert _reasons(spark, [("P", "Z", 1.0, 1900.0, 10.0, 9.0, 0.0)])[0][0] == "PORTFOLIO_HEAT_CAP"
    assert _reasons(spark, trades_today=6)[0][:4] == [None, None, "CIRCUIT_BREAKER", "CIRCUIT_BREAKER"]
    veto = lambda d: d.withColumn("sentiment_multiplier", F.when(F.col("rank") == 1, 0.0).otherwise(1.0))
    assert _reasons(spark, ranked=veto)[0][:2] == ["SENTIMENT_VETO", None]
    poor = lambda d: d.withColumn("ev_r_lcb", F.lit(0.05))
    assert _reasons(spark, ranked=poor)[0][0] == "BELOW_EV_THRESHOLD"
    tiny = lambda d: d.withColumn("step_size", F.lit(500.0))
    assert _reasons(spark, ranked=tiny)[0][0] == "SIZE_BELOW_MIN_NOTIONAL"


def test_position_size_native_and_greedy_agree(spark):
    df = spark.createDataFrame([(100_000.0, 1.0, 100.0, 95.0, 100.0, 3e8), (100_000.0, .5, 100.0, 99.9, 50.0, 3e8), (100_000.0, 1.0, 100.0, 95.0, 100.0, 1e5)],
                               "equity double, multiplier double, reference_price double, stop_price double, price_raw double, adv_usd_60 double")
    got = [r.qty for r in PF.with_position_size(df).orderBy(F.col("adv_usd_60").desc(), F.col("multiplier").desc()).collect()]
    assert got == [Decimal(80), Decimal(500), Decimal(5)]  # risk, notional cap, ADV cap


def test_sentiment_is_point_in_time(spark):
    t = dt.datetime(2024, 1, 10, 12)
    obs = spark.createDataFrame([("A", "x", t, t + dt.timedelta(hours=6), .5, 1.0, 40, "h1"), ("A", "y", t, t + dt.timedelta(hours=6), .9, 1.0, 40, "h2")],
                                "symbol string, source string, event_ts timestamp, available_ts timestamp, score double, source_weight double, sample_size int, payload_hash string")
    ask = spark.createDataFrame([("A", t + dt.timedelta(hours=h)) for h in (1, 6, 126, 127)], "symbol string, ts timestamp")
    v = {int((r.ts - t).total_seconds() // 3600): r for r in SE.sentiment_views(ask, obs).collect()}
    assert [v[h].source_count for h in (1, 6, 126, 127)] == [0, 2, 2, 0]
    assert v[6].score == pytest.approx(.7) and v[6].disagreement == pytest.approx(.2) and v[6].freshness_bars == 0
    assert v[6].confidence == pytest.approx(2 / 20 * .8) and v[6].is_stale and not v[1].is_stale


def test_sentiment_totals_match_the_pairs_for_a_hot_symbol(spark):
    """Against all pairs of decision and observation; one symbol holds most rows, ends and instants fall together."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(17)
    t0 = pd.Timestamp("2024-01-01")
    n = 500
    obs = pd.DataFrame({"symbol": np.where(rng.random(n) < .8, "hot", "b"), "source": rng.choice(["x", "y", "z"], n), "available_ts": t0 + pd.to_timedelta(rng.integers(0, 900, n), "h"),
                        "score": rng.uniform(-1, 1, n), "source_weight": rng.choice([0.0, .3, 1.0], n), "sample_size": rng.integers(0, 30, n)})
    ask = pd.DataFrame({"symbol": np.where(rng.random(200) < .8, "hot", rng.choice(["b", "none"], 200)), "ts": t0 + pd.to_timedelta(rng.integers(-50, 1100, 200), "h")}).drop_duplicates()
    p = SentimentParams()
    m = ask.merge(obs, on="symbol")
    age = (m.ts - m.available_ts) / pd.Timedelta("1h")
    m["w"] = .5 ** (age / p.half_life_hours) * m.source_weight * np.log1p(m.sample_size)
    m = m[(age >= 0) & (age <= p.max_age_hours) & (m.w > 0)]
    m["ws"], m["w2"] = m.w * m.score, m.w ** 2
    want = m.groupby(["symbol", "ts", "source"]).agg(sw=("w", "sum"), sw2=("w2", "sum"), sws=("ws", "sum"), newest=("available_ts", "max"), samples=("sample_size", "sum")).reset_index()
    totals = SE.decayed_totals(spark.createDataFrame(ask), spark.createDataFrame(obs), p)
    got = totals.toPandas().sort_values(["symbol", "ts", "source"]).reset_index(drop=True)
    assert len(got) == len(want) > 200
    for c in ("sw", "sw2", "sws"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12)
    assert (got.newest.to_numpy() == want.newest.to_numpy()).all() and (got.samples.to_numpy() == want.samples.to_numpy()).all()
    assert "NestedLoop" not in totals._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="half lives"):
        SE.decayed_totals(spark.createDataFrame(ask), spark.createDataFrame(obs), SentimentParams(half_life_hours=.1))


def test_calibration_of_equal_predictions(spark):
    import pandas as pd
    for value in (0.05, -2.0, 0.0):
        df = spark.createDataFrame([(value, float(i), i) for i in range(8)], "ev_net_r_at_entry double, realised_r double, k int")
        got = RE.calibration(df, F.col("k"), 10).collect()
        cut = pd.cut(pd.Series([value] * 8), bins=1)[0]
        assert [(r["bucket"], r["n"], r["mean_realised_r"]) for r in got] == [(1, 8, 3.5)]
        assert got[0]["predicted_mid"] == pytest.approx((cut.left + cut.right) / 2, abs=1e-9)


@pytest.mark.parametrize("score,conf,sign,want", [(.9, .9, 1, 1.0), (.9, .9, -1, 0.0), (.5, .5, -1, 1 - .85 * .25), (.8, .85, -1, .422), (0.0, .9, -1, 1.0)])
def test_sentiment_penalty(spark, score, conf, sign, want):
    df = spark.createDataFrame([(score, conf, 10, 2, False)], "score double, confidence double, sample_size int, source_count int, is_stale boolean")
    assert df.select(SE.sentiment_multiplier(F.lit(sign)).alias("m")).first().m == pytest.approx(want)
    assert df.select(SE.sentiment_multiplier(F.lit(sign), SentimentParams(enabled=False)).alias("m")).first().m == 1.0


@pytest.fixture(scope="module")
def run(spark):
    r = [1.0] * 10 + [-1.0] * 8 + [.5, -.5]
    eq = [100_000.0]
    for i in range(19):
        eq.append(eq[-1] * (1.02 if i % 2 == 0 else .99))
    ts = pd.date_range("2020-01-01", periods=20)
    equity = spark.createDataFrame(pd.DataFrame({"ts": ts, "equity": eq})).withColumn("ts", F.col("ts").cast("timestamp"))
    trades = spark.createDataFrame(pd.DataFrame({
        "realised_r": r, "bars_held": 5, "mae_r": -.5, "mfe_r": .5, "entry_ts": ts, "exit_ts": ts + pd.Timedelta(days=1), "qty": 10.0, "entry_price": 100.0, "exit_price": 101.0,
        "fees_usd": 1.0, "funding_usd": 0.0, "borrow_usd": .5, "gross_pnl_usd": 10.0, "ev_net_r_at_entry": np.linspace(0, 1, 20), "outcome": "STOP", "i": range(20)}))
    return trades.withColumn("entry_ts", F.col("entry_ts").cast("timestamp")).withColumn("exit_ts", F.col("exit_ts").cast("timestamp")).withColumn("_order", F.col("i")), equity, eq


def test_trade_and_return_metrics(run):
    trades, equity, eq = run
    m = RE.run_metrics(trades, equity, F.col("i"), n_trials=1).first()
    rets = pd.Series(eq).pct_change().dropna()
    assert (m.n_trades, m.win_rate, m.profit_factor, m.payoff_ratio, m.max_consecutive_losses) == (20, .55, pytest.approx(10.5 / 8.5), pytest.approx((10.5 / 11) / (8.5 / 9)), 8)
    assert m.sharpe == pytest.approx(rets.mean() / rets.std() * math.sqrt(252))
    assert m.sortino == pytest.approx(rets.mean() / math.sqrt((np.minimum(rets, 0) ** 2).mean()) * math.sqrt(252))
    assert m.max_drawdown_pct == pytest.approx(.01) and m.exposure_pct == 1.0 and m.cost_drag_pct == pytest.approx(.15)
    assert m.max_drawdown_duration_days == 0 and m.mean_r_ci_low < m.mean_r < m.mean_r_ci_high


def test_calibration_matches_qcut(run):
    trades, _, _ = run
    got = RE.calibration(trades, F.col("i"), 10).orderBy("bucket").toPandas()
    pdf = trades.toPandas()
    cut = pd.qcut(pdf.ev_net_r_at_entry, 10, duplicates="drop")
    want = pdf.groupby(cut, observed=True).realised_r.agg(["mean", "size"])
    assert got.n.tolist() == want["size"].tolist()
    np.testing.assert_allclose(got.mean_realised_r, want["mean"])
    np.testing.assert_allclose(got.predicted_mid, [.5 * (i.left + i.right) for i in want.index], rtol=1e-12)


def test_published_statistics(spark):
    kw = dict(n_obs=1250, skew=-3, kurtosis=10, var_sr=1 / 500)
    kw = {k: F.lit(v) for k, v in kw.items()}
    got = spark.range(1).select(*[ST.deflated_sharpe(F.lit(2.5 / math.sqrt(250)), n, **kw).alias(f"n{n}") for n in (100, 46)]).first()
    assert got.n100 == pytest.approx(.9004, abs=1e-4)
    assert got.n46 == pytest.approx(.9505, abs=1e-4)
    one = spark.range(1)
    lo, hi = ST.wilson_interval(F.lit(8), F.lit(10), .95)
    assert tuple(one.select(lo, hi).first()) == (pytest.approx(.490162, abs=1e-6), pytest.approx(.943318, abs=1e-6))
    t, df = ST.welch(*[F.lit(x) for x in (2.0, 1.0, 3, 3.0, 1.0, 3)])
    assert tuple(one.select(t, df).first()) == (pytest.approx(-math.sqrt(1.5)), pytest.approx(4.0))
    assert ST.student_two_sided(2.776445105, 4) == pytest.approx(.05, abs=1e-8)
    assert ST.student_two_sided(0.0, 4) == 1.0


def test_exposure_sweep_counts_inclusive_ends(spark, run):
    trades, equity, _ = run
    one = trades.where("i = 5")
    got = RE.exposed_sessions(one, equity).orderBy("ts").toPandas().open_trades.tolist()
    assert got == [0] * 5 + [1, 1] + [0] * 13


def test_split_and_dividend_reach_trade_pnl(spark):
    ts = pd.date_range("2020-01-01", periods=5)
    bars = spark.createDataFrame(pd.DataFrame({"asset_id": "a", "ts": ts, "session": ts.date, "entry_rn": range(1, 6), "high": 51.0, "low": 49.0, "close": 50.0,
                                               "close_raw": [100.0, 100, 50, 50, 50]})).withColumn("ts", F.col("ts").cast("timestamp"))
    t = spark.createDataFrame([("t1", "a", 1, 10.0, 100.0, 90.0, 55.0, 1, 3), ("t2", "a", -1, 10.0, 100.0, 110.0, 55.0, 1, 3)],
                              "trade_id string, asset_id string, sign int, qty double, entry_price double, stop_price double, exit_price double, entry_rn int, bars_held int")
    acts = spark.createDataFrame([("a", ts[2].date(), "SPLIT", 2.0, 0.0), ("a", ts[3].date(), "DIVIDEND", 1.0, .5)],
                                 "asset_id string, ex_date date, action_type string, split_ratio double, cash_amount double")
    r = {x.trade_id: x for x in PF.trade_pnl(t, bars, acts, 5).collect()}
    assert (r["t1"].gross_pnl_usd, r["t1"].dividends_usd, r["t1"].borrow_usd) == (100.0, 10.0, 0.0)
    assert (r["t2"].gross_pnl_usd, r["t2"].dividends_usd) == (-100.0, -10.0)
    assert r["t2"].borrow_usd == pytest.approx((10 * 100 + 20 * 50 * 2) * 30 / 1e4 / 252)
    assert r["t1"].mae_r == pytest.approx(-.2) and r["t1"].mfe_r == pytest.approx(.2)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "symbol string, event_ts timestamp, available_ts timestamp, payload_hash string"
    rows = [("A", t, t + dt.timedelta(hours=h), f"h{h // 2}") for h in range(6)]
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(src)
    assert SO.intake(spark, src, df.schema, out, state).count() == 3
    df.withColumn("payload_hash", F.concat("payload_hash", F.lit("new"))).coalesce(1).write.mode("append").parquet(src)
    assert SO.intake(spark, src, df.schema, out, state).count() == 6  # resumes, takes only what is new
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("A", t, t - dt.timedelta(hours=1), "x")], schema).write.parquet(bad)
    with pytest.raises(Exception, match="available before"):
        SO.intake(spark, bad, df.schema, str(tmp_path / "o2"), str(tmp_path / "s2"))


def test_continuity_stream_carries_state(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t + dt.timedelta(days=i), s, c, 1.0) for i, (s, c) in enumerate([(0, 5.0), (1, 5.0), (2, 5.0), (5, 5.0), (6, 6.0), (7, 6.0)])]
    src = str(tmp_path / "src")
    df = spark.createDataFrame(rows, "asset_id string, ts timestamp, session_index int, close_raw double, volume double")
    df.where("session_index < 2").repartition(2).write.parquet(src)
    SC.run_continuity(spark, src, df.schema, str(tmp_path / "o"), str(tmp_path / "s"))
    df.where("session_index >= 2").repartition(3).write.mode("append").parquet(src)
    SC.run_continuity(spark, src, df.schema, str(tmp_path / "o"), str(tmp_path / "s"))
    late = df.where("session_index = 1").withColumn("ts", F.col("ts") + F.expr("interval 1 second")).withColumn("session_index", F.lit(4))
    late.write.mode("append").parquet(src)
    out = SC.run_continuity(spark, src, df.schema, str(tmp_path / "o"), str(tmp_path / "s"))
    assert out.where("bars_since_gap is null").count() == 1  # a bar older than what was counted
    got = out.where("bars_since_gap is not null").orderBy("ts").collect()
    assert [r.bars_since_gap for r in got] == [0, 1, 2, 0, 1, 2]
    assert [r.stale_run for r in got] == [1, 2, 3, 1, 1, 2]


def test_outputs_keep_their_columns(spark, tmp_path):
    from tapewise.sources import outputs as O

    t = dt.datetime(2024, 1, 1)
    eq = spark.createDataFrame([(t, 100.0), (t + dt.timedelta(days=1), 90.0)], "ts timestamp, equity double")
    got = O.equity_output(eq, spark.createDataFrame([(t, 5.0)], "ts timestamp, benchmark double")).orderBy("ts").collect()
    assert [(r.benchmark, r.drawdown_pct) for r in got] == [(5.0, 0.0), (None, pytest.approx(.1))]
    O.write_funnel(spark.createDataFrame([("REJECT", "x", 3)], "stage string, rejection_reason string, n long"), str(tmp_path / "f"))
    rows = spark.read.csv(str(tmp_path / "f"), header=True).collect()
    assert {(r.stage, r.n) for r in rows} == {("REJECT", "3"), ("ACCEPTED", "0")}
    acts = spark.createDataFrame([("SPLIT",), ("OTHER",), (None,)], "action_type string")
    assert [r[0] for r in O.typed_actions(acts).collect()] == ["SPLIT"]
    edge = spark.createDataFrame([(t, "h", "s")], "as_of timestamp, config_hash string, data_snapshot_id string")
    O.write_edge(edge, str(tmp_path / "e"))
    assert O.read_edge(spark, str(tmp_path / "e"), "h", "s").count() == 1
    with pytest.raises(Exception, match="another run"):
        O.read_edge(spark, str(tmp_path / "e"), "h", "other").collect()


def test_comparison_has_a_p_value(spark):
    df = spark.createDataFrame([(True, v) for v in (1.0, 2.0, 3.0)] + [(False, v) for v in (2.0, 3.0, 4.0)], "f boolean, v double")
    r = RE.compare_samples(df, F.col("f"), "v").first()
    assert r.t_stat == pytest.approx(-math.sqrt(1.5)) and r.dof == pytest.approx(4) and r.p_value == pytest.approx(.287864, abs=1e-6)
    few = RE.compare_samples(df.where("f or v = 2"), F.col("f"), "v").first()
    assert few.t_stat is None and few.p_value is None
