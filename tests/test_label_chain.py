"""What the label chain writes and shuffles: panel in place, features of possible setups, bars within reach."""

import pytest
from pyspark.sql import functions as F

from tapewise.operators import features as FT
from tapewise.operators import labels as L
from tapewise.operators import panel as P
from tapewise.operators import setups as SU
from tapewise.operators import universe as U
from tapewise.operators.indicators import with_bar_number
from tapewise.operators.series import in_series
from tapewise.params import FeatureParams, MarketParams, RegimeParams
from tapewise.plans import derived as D
from tapewise.plans import inputs as I
from tapewise.session import staged, staged_in_place
from tapewise.sources.synthetic import asset_id

TABLES = "/root/testdata/sf0.001"
SHORT = FeatureParams(er_n=5, er_long_n=10, vol_short=5, vol_long=10, vol_window=40, vol_min_periods=10, gap_mean_n=5, overnight_n=10,
                      beta_window=20, mom_long=40, mom_mid=20, mom_skip=3, mom_short=3)
LOOSE = RegimeParams(er_trend_min=0.0, er_long_trend_min=0.0, slope_min=0.0)
CALM = MarketParams(sma_n=20, dd_n=20, vol_n=5, vol_window=40, vol_min_periods=10)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def in_place(market):
    return staged_in_place(P.processed_panel(market["bars"], market["actions"], market["calendar"], keep=("session",)))


def test_a_panel_staged_in_place_needs_no_shuffle_by_asset(spark, market, in_place):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    assert _shuffles(with_bar_number(in_place)) == 0 and _shuffles(in_series(in_place)) == 0
    assert _shuffles(with_bar_number(market["panel"])) == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
    columns = ("asset_id", "ts", "close", "volume", "is_suspect", "bars_available")
    assert _rows(with_bar_number(in_place), *columns) == _rows(with_bar_number(market["panel"]), *columns)


def test_bars_are_read_once_and_scaled_by_the_later_event_factors(spark, market):
    a = asset_id(3)
    days = [r["session"] for r in market["bars"].where(F.col("asset_id") == a).orderBy("session").limit(90).collect()]
    more = [(a, days[20], "DIVIDEND", 1.0, 0.3, ""), (a, days[20], "SPLIT", 2.0, 0.0, ""), (a, days[20], "SPINOFF", 1.0, 0.2, ""),
            (a, days[50], "DIVIDEND", 1.0, 1e6, ""), (a, days[0], "DIVIDEND", 1.0, 0.1, ""), (a, days[60], "MERGER", 0.5, 1.0, "")]
    acts = market["actions"].unionByName(spark.createDataFrame(more, market["actions"].schema))
    out = P.adjust_bars(market["bars"], acts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == market["bars"].crossJoin(acts)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    per = {}
    for r in P.event_factors(acts, market["bars"]).collect():
        per.setdefault(r["asset_id"], []).append((r["ex_date"], r["event_factor"]))
    got = out.select("asset_id", "session", "factor").collect()
    assert len(got) == market["bars"].count() and len({r["factor"] for r in got}) > 3
    for r in got:
        want = 1.0
        for day, f in sorted(per.get(r["asset_id"], []), reverse=True):
            want *= f if day > r["session"] else 1.0
        assert r["factor"] == want


def test_lifetime_volume_of_a_panel_is_that_of_its_raw_bars(market, in_place):
    raw, panel = (_rows(U.lifetime_dollar_volume(b), "asset_id", "max_dollar_volume_usd") for b in (market["bars"], in_place))
    assert raw == panel


def _strategies():
    return [SU.make_strategy("xsec_momentum_v1", {"xs_threshold": 0.8, "stop_atr": 1.5, "max_hold_bars": 8}),
            SU.make_strategy("donchian_breakout_v1", {"entry_buffer_atr": 0.0, "stop_atr": 1.0, "target_rr": 1.5, "max_hold_bars": 12, "min_ema_spread_atr": 0.0})]


def test_features_of_possible_setups_give_the_same_setups(market):
    snaps = market["names"].select("asset_id", "symbol").withColumn("ts", F.to_timestamp(F.lit("2004-02-02 21:00:00"))).withColumn(
        "eligible", F.crc32("asset_id") % 3 == 0)
    make = lambda **k: FT.compute_features(market["panel"], market["bench"], snaps, SHORT, LOOSE, CALM, **k)
    every, few = make(), make(only=SU.may_set_up(_strategies()))
    assert 0 < few.count() < every.count() / 2
    columns = [c for c in every.columns if c != "symbol"]
    own = _rows(few, *columns)
    assert own == _rows(every.join(few.select("asset_id", "ts"), ["asset_id", "ts"], "left_semi"), *columns)
    setups = [_rows(SU.detect_setups(f, _strategies()), "asset_id", "ts", "strategy_id", "direction", "mom_252_xs_pct", "xs_population", "risk_per_unit")
              for f in (every, few)]
    assert setups[0] == setups[1] and {s[2] for s in setups[0]} == {"xsec_momentum_v1", "donchian_breakout_v1"}


def test_setups_look_at_their_own_bar_and_the_bars_that_follow(spark, market):
    line = staged(with_bar_number(market["panel"].select("asset_id", "ts"), "_rn"))
    setups = line.where((F.col("asset_id") == asset_id(2)) & F.col("_rn").isin(5, 7, 40, 10_000)).unionByName(
        line.where((F.col("asset_id") == asset_id(5)) & (F.col("_rn") == 1)))
    got = _rows(L.within_reach(line, setups.unionByName(setups), 3), "asset_id", "_rn", "_own")
    want = [(asset_id(2), n, n in (5, 7, 40)) for n in (5, 6, 7, 8, 9, 10, 40, 41, 42, 43)] + [(asset_id(5), n, n == 1) for n in (1, 2, 3, 4)]
    assert got == sorted(want, key=str)


@pytest.fixture(scope="module")
def labelled(spark):
    """The stages of a query on trades, with how often shuffle files were let go."""
    freed = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "release", lambda s: freed.append(s))
        x = I.Inputs(spark, TABLES)
        x.labels  # noqa: B018
    return x, set(x.__dict__), freed


def test_trades_need_neither_written_bars_nor_all_features(spark, labelled):
    x, written, _ = labelled
    assert {"panel", "snapshots", "setup_features"} <= written and not {"bars", "features"} & written
    every = FT.compute_features(x.panel, x.benchmark, x.snapshots, D.WEEKLY, D.WEEKLY_REGIME, D.WEEKLY_MARKET)
    assert x.setup_features.count() < every.count() / 2
    want = L.label_setups(every, x.panel, I.strategies(), x.snapshots, x.earnings, x.tickers.select("asset_id", "is_etf"), x.calendar)
    assert _rows(x.labels, *L.LABEL_COLUMNS) == _rows(want, *L.LABEL_COLUMNS) and x.labels.count() > 50


def test_shuffle_files_go_when_a_stage_is_written(labelled):
    x, _, freed = labelled
    assert len(freed) == 3 and all(s is x.spark for s in freed)  # panel, snapshots, labels


def test_all_features_serve_the_labels_once_they_are_there(spark):
    x = I.Inputs(spark, TABLES)
    x.__dict__["features"] = every = spark.range(1)
    assert x.setup_features is every
