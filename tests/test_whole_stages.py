"""Stages that were mended for larger tables: their SQL's guards, and the rows that no longer travel."""

import datetime as dt

import duckdb

from pyspark.sql import functions as F

from tapewise.operators import bootstrap as BS
from tapewise.operators import decisions as DE
from tapewise.operators import features as FT
from tapewise.operators import labels as L
from tapewise.operators import panel as P
from tapewise.operators import research as RE
from tapewise.operators import universe as U
from tapewise.operators.asof import asof_backward
from tapewise.operators.setups import make_strategy
from tapewise.params import GateParams, PortfolioParams, UniverseParams
from tapewise.plans import catalog
from tapewise.plans.oracles import CTE, ORDERED_FACTORS


def test_turnover_of_a_lost_account_is_missing_in_the_sql_too(spark):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=400 * i) for i in range(3)]
    money = [(days[0], days[1], 10.0, 5.0, 4.0, 0.1, 0.0, 0.2, -10.0)]
    curve = list(zip(days, [100.0, -50.0, -90.0]))
    trades = spark.createDataFrame(money, "e date, x date, qty double, entry_price double, exit_price double, fees_usd double, funding_usd double, borrow_usd double, gross_pnl_usd double")
    trades = trades.withColumns({"entry_ts": F.col("e").cast("timestamp"), "exit_ts": F.col("x").cast("timestamp")})
    equity = spark.createDataFrame(curve, "d date, equity double").withColumn("ts", F.col("d").cast("timestamp"))
    got = RE.activity_and_cost(trades, equity).first()
    catalog.load()
    con = duckdb.connect()
    con.execute("CREATE TABLE money AS SELECT 10e0 AS qty, 5e0 AS entry_price, 4e0 AS exit_price, 0.1e0 AS fees_usd, 0e0 AS funding_usd, 0.2e0 AS borrow_usd, -10e0 AS gross_pnl_usd")
    con.execute("CREATE TABLE curve (session DATE, equity DOUBLE)")
    con.executemany("INSERT INTO curve VALUES (?, ?)", curve)
    con.execute("CREATE TABLE openx AS SELECT session, 1 AS open_trades FROM curve")
    want = con.execute(f"SELECT turnover_annual FROM ({CTE['act_']})").fetchone()[0]
    assert got["turnover_annual"] is None and want is None


def test_factors_are_multiplied_in_a_stated_order(spark):
    assert "ORDER BY" in ORDERED_FACTORS["evf"] and "ORDER BY e.ex_date DESC" in ORDERED_FACTORS["adj"]
    day = dt.date(2004, 2, 2)
    acts = [(f"A{i}", day, k, 2.0, cash) for i in range(40) for k, cash in
            (("SPLIT", 0.0), ("DIVIDEND", 0.1 + 0.2), ("SPINOFF", 0.7))[:: 1 if i % 2 else -1]]
    actions = spark.createDataFrame(acts, "asset_id string, ex_date date, action_type string, split_ratio double, cash_amount double").repartition(7)
    bars = spark.createDataFrame([(f"A{i}", day - dt.timedelta(days=7), 10.1) for i in range(40)], "asset_id string, session date, close double")
    got = {r["event_factor"] for r in P.event_factors(actions, bars).collect()}
    assert len(got) == 1


def test_entries_outside_the_universe_need_no_features(spark):
    entries = spark.createDataFrame([("A", 1, "LOW_PRICE"), ("B", 1, ""), ("C", 2, None)], "asset_id string, ts int, universe_reason string")
    assets = spark.createDataFrame([("A", "X", False), ("B", "Y", False)], "asset_id string, cluster string, is_etf boolean")
    inside, outside = DE.universe_split(entries, assets, F.lit(100.0), GateParams(), PortfolioParams())
    assert [r["asset_id"] for r in inside.collect()] == ["B"]
    strategies = [make_strategy("xsec_momentum_v1"), make_strategy("donchian_breakout_v1")]
    rows = DE.stopped_at_universe(outside, strategies)
    assert sorted((r["asset_id"], r["strategy_id"], r["reason"], r["stage"]) for r in rows.collect()) == [
        (a, s.strategy_id, why, "GATE") for a, why in (("A", "LOW_PRICE"), ("C", "NOT_IN_UNIVERSE")) for s in reversed(strategies)]
    features = spark.createDataFrame([("A", 1, "CHOP", "a")], "asset_id string, ts int, regime string, symbol string").withColumns(
        {"session_index": F.lit(1), "eligible": F.lit(True)})
    shown = DE.stopped_at_universe(outside, strategies, features).select("asset_id", "regime").distinct().collect()
    assert sorted((r["asset_id"], r["regime"]) for r in shown) == [("A", "CHOP"), ("C", None)]
    # what asks for an expected value reads none of them
    judged = spark.createDataFrame([("B", 0.5)], "asset_id string, ev_net_r double")
    both = judged.unionByName(rows, allowMissingColumns=True).where("ev_net_r >= 0")
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
    everyone, none = DE.universe_split(entries, assets, F.lit(100.0), GateParams(require_universe=False), PortfolioParams())
    assert everyone.count() == 3 and none.count() == 0


def _snapshots(spark, market):
    panel = market["panel"].select("asset_id").distinct()
    stamps = market["calendar"].where("session_index % 21 = 3").select(F.col("close_utc").alias("ts"), "session_index")
    return panel.crossJoin(stamps).withColumn("eligible", F.when(F.col("session_index") % 63 != 3, F.crc32("asset_id") % 3 > 0))


def test_eligibility_is_that_of_the_newest_snapshot(spark, market):
    snaps = _snapshots(spark, market)
    got = {(r["asset_id"], r["ts"]): r["eligible"] for r in FT.with_eligibility(market["panel"], snaps).collect()}
    rows = market["panel"].select("asset_id", "ts").collect()
    per = {}
    for s in snaps.collect():
        per.setdefault(s["asset_id"], []).append((s["ts"], bool(s["eligible"])))
    want = {(r["asset_id"], r["ts"]): max([(t, e) for t, e in per[r["asset_id"]] if t <= r["ts"]], default=(None, False))[1] for r in rows}
    assert got == want and len(set(got.values())) == 2


def test_only_eligible_rows_travel_to_their_ranks(spark, market, monkeypatch):
    rows = FT.with_eligibility(market["panel"], _snapshots(spark, market)).withColumns(
        {"mom_252_skip21": F.col("close"), "vol_60": F.when(F.col("volume") > 1e6, F.col("volume"))})
    rows = rows.withColumn("eligible", F.when(F.crc32("asset_id") % 5 != 0, F.col("eligible")))  # unknown counts as not
    show = lambda df: sorted(map(tuple, df.select("asset_id", "ts", "mom_252_xs_pct", "vol_xs_pct", "xs_population").collect()), key=str)
    sent = show(FT.with_cross_section(rows))
    monkeypatch.setattr(FT, "RANKS_SENT", 0)
    assert show(FT.with_cross_section(rows)) == sent and len(sent) == market["panel"].count()


def test_panel_is_shuffled_by_asset_once_for_its_windows(spark, market):
    flagged = P.quality_flags(P.join_calendar(P.adjust_bars(market["bars"], market["actions"]), market["calendar"]), market["actions"], market["calendar"])
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session" not in plan.split("BroadcastExchange")[0]
    # bars and events; their as-of line and its two aggregates; splits; actions; factors and days
    before = flagged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert before <= 12, plan


def test_metrics_at_stamps_are_those_a_lookup_finds(spark, market):
    stamps = market["calendar"].where("session_index % 21 = 3").select(F.col("close_utc").alias("ts"))
    p = UniverseParams()
    every, few = U.panel_metrics(market["panel"], p), U.panel_metrics(market["panel"], p, stamps)
    left = market["panel"].select("asset_id").distinct().crossJoin(stamps)
    look = lambda m: sorted(map(tuple, asof_backward(left, m, ["asset_id"], "ts", "ts", U.METRICS, right_ts_as="at").collect()), key=str)
    assert look(few) == look(every) and few.count() < every.count() / 10


def test_replicates_shuffled_grow_with_groups_and_not_with_tasks(spark):
    rows = spark.range(4000).repartition(16).select(F.col("id"), (F.col("id") % 40).alias("g"), F.lit(1.0).alias("v"))
    sums = BS.weighted_sums(rows, ["g"], {"x": F.col("v")}, F.col("id"), 50, 7)
    assert sums.groupBy("g").count().where("count > 50").count() == 0
    narrow = rows.repartitionByRange("g", "id")
    pairs = narrow.select(F.spark_partition_id().alias("p"), "g").distinct().count()
    assert pairs <= 40 + narrow.rdd.getNumPartitions()
    assert "rangepartitioning" in sums._jdf.queryExecution().executedPlan().toString()


def test_events_are_one_row_an_asset_and_ids_go_to_the_rows(spark, market):
    twice = market["earnings"].unionByName(market["earnings"])
    per = L.earnings_of_assets(twice, market["calendar"])
    assert per.count() == market["earnings"].select("asset_id").distinct().count()
    assert per.where(F.size("_events") > 2 * market["calendar"].count()).count() == 0
    ids = market["panel"].where(F.crc32("asset_id") % 2 == 0).select("asset_id")
    some = U.restrict_to(market["panel"], ids)
    assert "Exchange hashpartitioning" not in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == ids.count()
