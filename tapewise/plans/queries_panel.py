"""Queries on sources, panel, quality and universe."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewise.functions import exprs as X
from tapewise.operators import asof as A
from tapewise.operators import indicators as I
from tapewise.operators import panel as P
from tapewise.operators import universe as U
from tapewise.plans import derived as D
from tapewise.plans.catalog import query, tidy
from tapewise.plans.oracles import d, i, s
from tapewise.session import checkpoint_dir
from tapewise.sources import tables as S
from tapewise.sources import vendors as V

OHLC = "open high low close"
PANEL_SQL = f"asset_id, symbol, {s('session')}, {i('session_index')}, {d('open high low close close_raw volume')}, {d('dollar_volume', 2)}, is_suspect"


def scratch(x, name: str) -> str:
    """A new folder under the shared checkpoint folder: no call meets what another has left."""
    return f"{checkpoint_dir(x.spark)}/{name}-{uuid.uuid4().hex}"


def panel_view(df):
    return tidy(df.select("asset_id", "symbol", "session", "session_index", *OHLC.split(), "close_raw", "volume",
                          "dollar_volume", "is_suspect"), dollar_volume=2)


# -- bars and store -----------------------------------------------------------------

@query("weekly_bars", f"SELECT asset_id, symbol, {s('session')}, {d('open high low close volume')} FROM bars")
def weekly_bars(x):
    return tidy(x.bars)


@query("raw_bars_by_year", f"SELECT asset_id, symbol, {s('session')}, {d('open high low close volume')}, CAST(year(session) AS BIGINT) AS year FROM bars")
def raw_bars_by_year(x):
    path = scratch(x, "raw_bars")
    S.write_by_year(x.bars, path, "session", ["session", "asset_id"])
    return tidy(S.read_raw_bars(x.spark, path, tuple([*x.bars.columns, "year"])))


@query("panel_scan", f"""SELECT {PANEL_SQL} FROM panel WHERE session BETWEEN DATE '1997-03-03' AND DATE '1999-06-28'
  AND asset_id IN (SELECT asset_id FROM tick WHERE exchange = 'NYSE')""")
def panel_scan(x):
    path = scratch(x, "panel")
    S.write_by_year(x.panel, path, "ts", ["ts", "asset_id"])
    ids = x.tickers.where("exchange = 'NYSE'")
    return panel_view(S.scan_panel(x.spark, path, ids, "1997-03-03 00:00:00", "1999-06-28 23:59:59"))


@query("available_range", f"SELECT asset_id, CAST(min(session) AS VARCHAR) AS first_ts, CAST(max(session) AS VARCHAR) AS last_ts FROM panel WHERE asset_id = '{D.ASSET}' GROUP BY 1")
def available_range(x):
    return tidy(S.available_range(x.panel, D.ASSET))


@query("snapshot_manifest", """SELECT count(DISTINCT symbol) AS symbols, count(*) AS ohlcv_rows, CAST(min(session) AS VARCHAR) AS first_session,
  CAST(max(session) AS VARCHAR) AS last_session, (SELECT count(*) FROM acts) AS actions_rows, (SELECT count(*) FROM earn) AS earnings_rows,
  strftime(max(session), '%Y%m%d') || '-derived' AS snapshot_id FROM bars""")
def snapshot_manifest(x):
    return tidy(S.snapshot_manifest(x.bars, x.actions, x.earnings, "derived"))


def _raw(x):
    return (x.tickers, x.bars.withColumn("dividend", F.lit(None).cast("double")).withColumn("split_ratio", F.lit(None).cast("double"))
            .withColumn("symbol", F.when(F.col("volume") > 100, F.lit("")).otherwise(F.col("symbol"))), x.actions, x.earnings)


@query("ingest_manifest", """SELECT count(DISTINCT symbol) AS symbols, count(*) AS ohlcv_rows, CAST(min(session) AS VARCHAR) AS first_session,
  CAST(max(session) AS VARCHAR) AS last_session, (SELECT count(*) FROM acts) AS actions_rows, (SELECT count(*) FROM earn) AS earnings_rows,
  strftime(max(session), '%Y%m%d') || '-derived' AS snapshot_id FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def ingest_manifest(x):
    t, b, a, e = _raw(x)
    return tidy(S.ingest(t, b, a, e, scratch(x, "ingest"), "derived", "1996-01-01", "2000-12-31"))


@query("normalised_bars", f"SELECT asset_id, symbol, {s('session')}, {d('open high low close volume')}, 0e0 AS dividend, 1e0 AS split_ratio FROM bars")
def normalised_bars(x):
    t, b, _, _ = _raw(x)
    return tidy(S.normalise_ohlcv(b, t))


@query("candidate_lines", "SELECT asset_id, symbol FROM cand")
def candidate_lines(x):
    path = scratch(x, "candidates")
    note = x.candidates.limit(1).select(F.explode(F.array(F.lit("# seeded names"), F.lit(""))).alias("value"))
    note.write.mode("overwrite").text(path)
    S.write_candidate_lines(x.candidates, path)
    return S.read_candidate_lines(x.spark, path)


@query("new_candidates", "SELECT asset_id, symbol FROM cand WHERE asset_id NOT IN (SELECT asset_id FROM tick WHERE exchange = 'NASDAQ')")
def new_candidates(x):
    return U.append_new(x.tickers.where("exchange = 'NASDAQ'"), x.candidates)


@query("vendor_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def vendor_csv(x):
    path = scratch(x, "vendor_csv")
    sup = x.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    S.write_csv(sup.toDF(*[c.upper() for c in sup.columns]), path)
    return S.read_vendor_csv(x.spark, path)


@query("distinct_sessions", f"SELECT {s('session')}, {i('session_index')} FROM cal")
def distinct_sessions(x):
    return tidy(x.calendar.select("session", "session_index"))


@query("benchmark_build", f"SELECT {s('session')}, {i('session_index')}, {d('open high low close vix_close')} FROM bench")
def benchmark_build(x):
    vix = x.benchmark.select("ts", F.col("vix_close").alias("close"), F.col("session_index").alias("ord"))
    out = S.build_benchmark(x.benchmark.drop("vix_close"), vix)
    return tidy(out.select(F.col("ts").alias("session"), "session_index", *OHLC.split(), "vix_close"))


# -- vendors ---------------------------------------------------------------------------

def _a_raw_tickers(x):
    s_ = x.table("supplier")
    return s_.select(
        F.when(F.col("s_nationkey") % 2 == 0, "SEP").otherwise("sfp").alias("table"), F.col("s_suppkey").alias("permaticker"),
        F.col("s_name").alias("ticker"), F.when(F.col("s_nationkey") < 12, "NYSEMKT").otherwise("NASDAQ").alias("exchange"),
        F.when(F.col("s_acctbal") > 8000, "Leveraged Exchange Traded Fund").otherwise("Domestic Common Stock").alias("category"),
        F.lit(None).cast("string").alias("sector"), F.when(F.col("s_acctbal") < 0, "y").otherwise("N").alias("isdelisted"),
        F.lit("1995-01-02").alias("firstpricedate"), F.lit("2001-06-01").alias("lastpricedate"), F.col("s_suppkey").alias("ord")
    ).unionByName(s_.select(  # later duplicate of the same id, and a table that is not priced
        F.lit("SF1").alias("table"), F.col("s_suppkey").alias("permaticker"), F.lit("ZZZ").alias("ticker"), F.lit("X").alias("exchange"),
        F.lit("").alias("category"), F.lit("").alias("sector"), F.lit("N").alias("isdelisted"), F.lit("1990-01-01").alias("firstpricedate"),
        F.lit("1990-01-01").alias("lastpricedate"), F.col("s_suppkey").alias("ord")))


@query("vendor_a_tickers", """SELECT CAST(s_suppkey AS VARCHAR) AS asset_id, s_name AS symbol, CASE WHEN s_nationkey < 12 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
  CASE WHEN s_acctbal > 8000 THEN 'Leveraged Exchange Traded Fund' ELSE 'Domestic Common Stock' END AS category, '' AS sector, s_acctbal > 8000 AS is_etf,
  '1995-01-02' AS listed_date, CASE WHEN s_acctbal < 0 THEN '2001-06-01' END AS delisted_date, '' AS delist_reason FROM supplier""")
def vendor_a_tickers(x):
    return tidy(V.a_tickers(_a_raw_tickers(x)))


def _a_raw_bars(x, stock: bool):
    b = x.bars.where((F.col("volume") >= 60) if stock else (F.col("volume") < 60))
    f = F.when(F.col("volume") > 120, 2.0).otherwise(1.0)
    return b.select(F.col("symbol").alias("ticker"), F.col("session").cast("string").alias("date"), *[(F.col(c) / f).alias(c) for c in OHLC.split()],
                    (F.col("volume") * f).alias("volume"), F.col("close").alias("closeunadj"))


@query("vendor_a_bars", f"""SELECT CAST(CAST(substr(asset_id, 2) AS BIGINT) AS VARCHAR) AS asset_id, symbol, {s('session')}, {d('open high low close volume')},
  0e0 AS dividend, 1e0 AS split_ratio FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_a_bars(x):
    return tidy(V.a_bars(_a_raw_bars(x, True), _a_raw_bars(x, False), V.a_tickers(_a_raw_tickers(x)), "1996-01-01", "2000-12-31"))


@query("unadjusted_bars", f"""SELECT asset_id, {s('session')}, {d('open high low close')}, {d('volume')} FROM
  (SELECT asset_id, session, open / f * (close / (close / f)) AS open, high / f * (close / (close / f)) AS high, low / f * (close / (close / f)) AS low, close,
   volume * f / (close / (close / f)) AS volume FROM (SELECT *, CASE WHEN volume > 120 THEN 2e0 ELSE 1e0 END AS f FROM bars))""")
def unadjusted_bars(x):
    raw = _a_raw_bars(x, True).unionByName(_a_raw_bars(x, False))
    out = V.unadjust(raw).join(x.tickers.select("asset_id", F.col("symbol").alias("ticker")), "ticker")
    return tidy(out.select("asset_id", F.to_date("date").alias("session"), *OHLC.split(), "volume"))


ACTION_WORD = """CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'Split' WHEN l_returnflag = 'A' THEN 'delisted' WHEN l_returnflag = 'N' AND l_tax > 0.05e0 THEN 'spinoff'
  WHEN l_returnflag = 'N' THEN 'dividend' WHEN l_tax > 0.05e0 THEN 'acquisition' ELSE 'tickerchangeto' END"""


def _a_raw_actions(x):
    li = x.table("lineitem")
    flag, tax, line = F.col("l_returnflag"), F.col("l_tax"), F.col("l_linenumber")
    word = (F.when((flag == "A") & (line == 1), "Split").when(flag == "A", "delisted").when((flag == "N") & (tax > 0.05), "spinoff")
            .when(flag == "N", "dividend").when(tax > 0.05, "acquisition").otherwise("tickerchangeto"))
    return li.select(D.symbol_key(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").cast("string").alias("date"), word.alias("action"),
                     F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("value"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("contraticker"))


@query("vendor_a_actions", f"""SELECT asset_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ex_date, k AS action_type, round(CASE WHEN k IN ('SPLIT', 'SPINOFF') AND v <> 0 THEN v ELSE 1 END, 6) AS split_ratio,
  round(CASE WHEN k = 'DIVIDEND' THEN v ELSE 0 END, 6) AS cash_amount, CASE WHEN k IN ('SPLIT', 'DIVIDEND') THEN '' ELSE 'C' || l_partkey END AS new_symbol
  FROM (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS asset_id, l_shipdate, l_partkey, CASE WHEN l_discount > 0 THEN l_discount * 10e0 ELSE 0e0 END AS v,
    CASE {ACTION_WORD} WHEN 'Split' THEN 'SPLIT' WHEN 'spinoff' THEN 'SPINOFF' WHEN 'dividend' THEN 'DIVIDEND' WHEN 'acquisition' THEN 'MERGER' WHEN 'tickerchangeto' THEN 'TICKER_CHANGE' END AS k
    FROM lineitem) WHERE k IS NOT NULL AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_a_actions(x):
    return tidy(V.a_actions(_a_raw_actions(x), x.tickers, "1996-01-01", "2000-12-31"))


@query("vendor_a_earnings", """SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS asset_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS earnings_date, true AS is_confirmed,
  'UNKNOWN' AS timing FROM lineitem WHERE l_quantity = 22 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_a_earnings(x):
    li = x.table("lineitem")
    codes = F.concat(F.lit("122| "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ,7"))
    raw = li.select(D.symbol_key(F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").cast("string").alias("date"), codes.alias("eventcodes"))
    return tidy(V.a_earnings(raw, x.tickers, "1996-01-01", "2000-12-31").drop("available_ts"))


def _b_lists(x):
    t = x.tickers.select("asset_id", "symbol", F.col("exchange"), F.lit("Equity").alias("subtype1"),
                         F.when(F.col("is_etf"), "US Exchange Traded Fund").when(F.col("exchange") == "OTC", "").otherwise("Operating/Holding Company").alias("subtype2"),
                         "sector", F.lit("1992-01-01").alias("first_quoted"), F.lit("2001-03-05").alias("last_quoted"), "delisted_date")
    return t.where("delisted_date is null or exchange = 'NYSE'").drop("delisted_date"), t.where("delisted_date is not null").drop("delisted_date")


@query("vendor_b_tickers", """SELECT asset_id, symbol, exchange, CASE WHEN is_etf THEN 'ETF' WHEN exchange = 'OTC' THEN 'Equity' ELSE 'Domestic Common Stock' END AS category,
  sector, is_etf, '1992-01-01' AS listed_date, CASE WHEN gone THEN '2001-03-05' END AS delisted_date, CASE WHEN gone THEN 'OTHER' ELSE '' END AS delist_reason
  FROM (SELECT *, delisted_date IS NOT NULL AND exchange <> 'NYSE' AS gone FROM tick)""")
def vendor_b_tickers(x):
    return tidy(V.b_tickers(*_b_lists(x)))


def _b_raw(x):
    paid = F.when(F.col("volume") > 150, F.col("volume") / 1000).otherwise(0.0)
    return x.bars.select("asset_id", "symbol", F.col("session").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                         F.col("low").alias("Low"), F.when(F.col("volume") > 20, F.col("close")).alias("Unadjusted Close"), F.col("volume").alias("Volume"), paid.alias("Dividend"))


B_BARS = "SELECT *, CASE WHEN volume > 150 THEN volume / 1000e0 ELSE 0e0 END AS dividend FROM bars WHERE volume > 20"


@query("vendor_b_bars", f"SELECT asset_id, symbol, {s('session')}, {d('open high low close volume dividend')}, 1e0 AS split_ratio FROM ({B_BARS})")
def vendor_b_bars(x):
    return tidy(V.b_bars(_b_raw(x)))


@query("vendor_b_dividends", f"""SELECT asset_id, CAST(ex AS VARCHAR) AS ex_date, 'DIVIDEND' AS action_type, 1e0 AS split_ratio, round(dividend, 6) AS cash_amount, '' AS new_symbol
  FROM (SELECT *, (SELECT min(c.session) FROM cal c WHERE c.session > b.session) AS ex FROM ({B_BARS}) b) WHERE dividend <> 0 AND ex BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_b_dividends(x):
    return tidy(V.b_dividends(V.b_bars(_b_raw(x)), x.calendar, "1996-01-01", "2000-12-31"))


@query("entitlement_ex_dates", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS entitlement,
  CAST((SELECT min(session) FROM cal WHERE session > CAST(o_orderdate AS DATE)) AS VARCHAR) AS ex_date FROM orders""")
def entitlement_ex_dates(x):
    o = x.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("entitlement"))
    return tidy(V.ex_date_of(o, x.calendar, "entitlement"))


@query("vendor_b_splits", """SELECT asset_id, CAST(ex AS VARCHAR) AS ex_date, 'SPLIT' AS action_type, round(CASE WHEN nc <> 0 AND close <> 0 AND k <> 0 THEN (nk / k) * (close / nc) ELSE 1 END, 6) AS split_ratio,
  0e0 AS cash_amount, '' AS new_symbol FROM (SELECT *, lead(close) OVER w AS nc, lead(k) OVER w AS nk, lead(session) OVER w AS nx, (SELECT min(c.session) FROM cal c WHERE c.session > b.session) AS ex
  FROM (SELECT *, close * (1 + volume / 100) AS k FROM bars) b WINDOW w AS (PARTITION BY asset_id ORDER BY session)) WHERE volume > 150 AND nx IS NOT NULL AND ex BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def vendor_b_splits(x):
    flags = x.bars.select("asset_id", "session", F.when(F.col("volume") > 150, 1.0).otherwise(0.0).alias("flag"))
    cap = x.bars.withColumn("close", F.col("close") * (1 + F.col("volume") / 100))
    return tidy(V.b_splits(flags, x.bars, cap, x.calendar, "1996-01-01", "2000-12-31"))


# -- calendar and adjustment ----------------------------------------------------------

US_DST = """CASE WHEN day >= CASE WHEN year(day) >= 2007 THEN m2 ELSE a1 END AND day < CASE WHEN year(day) >= 2007 THEN n1 ELSE ol END THEN 4 ELSE 5 END"""


@query("session_calendar", f"""SELECT CAST(day AS VARCHAR) AS session, strftime(CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE + to_hours({US_DST}), '%Y-%m-%d %H:%M:%S') AS open_utc,
  strftime(CAST(day AS TIMESTAMP) + to_hours(CASE WHEN half THEN 13 ELSE 16 END + {US_DST}), '%Y-%m-%d %H:%M:%S') AS close_utc, half AS is_half_day, row_number() OVER (ORDER BY day) - 1 AS session_index
  FROM (SELECT *, CAST(day AS DATE) IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '5-LOW' AND day(o_orderdate) = 24) AS half,
    make_date(year(day), 4, 1) + CAST((7 - dayofweek(make_date(year(day), 4, 1))) % 7 AS INT) AS a1,
    make_date(year(day), 3, 8) + CAST((7 - dayofweek(make_date(year(day), 3, 8))) % 7 AS INT) AS m2,
    make_date(year(day), 11, 1) + CAST((7 - dayofweek(make_date(year(day), 11, 1))) % 7 AS INT) AS n1,
    make_date(year(day), 10, 25) + CAST((7 - dayofweek(make_date(year(day), 10, 25))) % 7 AS INT) AS ol
    FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    WHERE dayofweek(day) BETWEEN 1 AND 5 AND CAST(day AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE day(o_orderdate) = 4 AND month(o_orderdate) = 7)
  )""")
def session_calendar(x):
    day = x.table("orders").select(F.to_date("o_orderdate").alias("session"), "o_orderpriority")
    hol = day.where((F.dayofmonth("session") == 4) & (F.month("session") == 7))
    early = day.where((F.dayofmonth("session") == 24) & (F.col("o_orderpriority") == "5-LOW"))
    cal = P.build_calendar(x.spark, "1995-01-01", "2001-12-31", hol, early)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tidy(cal.select("session", stamp("open_utc"), stamp("close_utc"), "is_half_day", "session_index"))


@query("corporate_actions", f"SELECT asset_id, {s('ex_date')}, action_type, {d('split_ratio cash_amount')} FROM acts")
def corporate_actions(x):
    return tidy(x.actions.drop("new_symbol"))


@query("contemporaneous_dividends", f"SELECT asset_id, {s('ex_date')}, action_type, {d('split_ratio cash_amount')} FROM divs")
def contemporaneous_dividends(x):
    return tidy(P.contemporaneous_dividends(x.actions).drop("new_symbol"))


@query("action_factors", f"SELECT asset_id, {s('ex_date')}, {d('event_factor', 9)} FROM evf")
def action_factors(x):
    return tidy(P.event_factors(x.actions, x.bars), 9)


@query("back_adjusted_bars", f"SELECT asset_id, {s('session')}, {d('open high low close close_raw volume volume_raw factor')} FROM adj")
def back_adjusted_bars(x):
    return tidy(P.adjust_bars(x.bars, x.actions).select("asset_id", "session", *OHLC.split(), "close_raw", "volume", "volume_raw", "factor"))


@query("quality_flags", f"SELECT asset_id, {s('session')}, ohlc_invalid, large_return, zero_volume, stale_close, not_in_calendar FROM qual")
def quality_flags(x):
    bars = P.join_calendar(P.adjust_bars(x.bars, x.actions), x.calendar)
    return tidy(P.quality_flags(bars, x.actions, x.calendar).select(
        "asset_id", "session", "ohlc_invalid", "large_return", "zero_volume", "stale_close", "not_in_calendar"))


@query("stale_runs", """SELECT asset_id, CAST(min(session) AS VARCHAR) AS first_session, count(*) AS n FROM (SELECT *, sum(CASE WHEN coalesce(session_index = pi + 1 AND b = pb, false) THEN 0 ELSE 1 END)
  OVER (PARTITION BY asset_id ORDER BY session) AS run FROM (SELECT *, lag(b) OVER w AS pb, lag(session_index) OVER w AS pi FROM (SELECT *, floor(close_raw / 150) AS b FROM panel) WINDOW w AS (PARTITION BY asset_id ORDER BY session))) GROUP BY asset_id, run HAVING count(*) >= 5""")
def stale_runs(x):
    from pyspark.sql import Window
    # coarse price steps, so that long runs of an unchanged close occur
    rows = x.panel.withColumn("close_raw", F.floor(F.col("close_raw") / 150).cast("double")).withColumn("volume", F.lit(1.0))
    cont, _ = P.stale_close()
    w = Window.partitionBy("asset_id").orderBy("session_index", "session")
    runs = rows.withColumn("_c", cont).withColumn("_run", F.sum(F.when(F.col("_c"), 0).otherwise(1)).over(w))
    out = runs.groupBy("asset_id", "_run").agg(F.min("session").alias("first_session"), F.count(F.lit(1)).alias("n"))
    return tidy(out.where(F.col("n") >= P.STALE_SESSIONS).drop("_run"))


@query("processed_panel", f"SELECT {PANEL_SQL} FROM panel")
def processed_panel(x):
    return panel_view(D.panel(x.spark, x.sf_dir))


@query("suspect_rate", "SELECT count(*) AS rows, sum(CAST(is_suspect AS BIGINT))::BIGINT AS suspect_rows, round(avg(CAST(is_suspect AS DOUBLE)), 6) AS suspect_rate FROM panel")
def suspect_rate(x):
    return tidy(P.suspect_rate(x.panel))


# -- reads in time -----------------------------------------------------------------------

@query("panel_as_of", f"SELECT {PANEL_SQL} FROM panel WHERE session <= DATE '1997-06-30'")
def panel_as_of(x):
    return panel_view(P.as_of(x.panel, "1997-06-30 23:00:00"))


@query("panel_rows_at", f"SELECT {PANEL_SQL} FROM panel WHERE session = DATE '1997-06-30'")
def panel_rows_at(x):
    return panel_view(P.rows_at(x.panel, "1997-06-30 20:00:00"))


@query("panel_slice", f"SELECT {PANEL_SQL} FROM panel WHERE asset_id = '{D.ASSET}'")
def panel_slice(x):
    return panel_view(P.slice_asset(x.panel, D.ASSET))


@query("panel_latest", f"SELECT {PANEL_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY session DESC) AS k FROM panel WHERE session <= DATE '1997-06-30') WHERE k = 1")
def panel_latest(x):
    return panel_view(P.latest(x.panel, "1997-06-30 23:00:00"))


@query("first_of_month", f"SELECT {s('session')}, {i('session_index')} FROM months")
def first_of_month(x):
    return tidy(P.first_session_of_period(x.calendar).select("session", "session_index"))


@query("first_of_week", f"SELECT {s('session')}, {i('session_index')} FROM cal WHERE session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def first_of_week(x):
    return tidy(P.first_session_of_period(x.calendar, "weekly", "1996-01-01 00:00:00", "1999-12-31 23:59:59").select("session", "session_index"))


@query("next_session", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST((SELECT min(session_index) FROM cal WHERE session >= CAST(o_orderdate AS DATE)) AS BIGINT) AS session_index FROM orders""")
def next_session(x):
    o = x.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return tidy(A.next_on_or_after(o, x.calendar, "day", [("session_index", "session_index")]))


@query("many_to_one_lookup", f"SELECT b.asset_id, {s('session')}, round(close, 6) AS close, t.sector, t.exchange FROM bars b LEFT JOIN tick t ON t.asset_id = b.asset_id")
def many_to_one_lookup(x):
    return tidy(A.many_to_one(x.bars.select("asset_id", "session", "close"), x.tickers.select("asset_id", "sector", "exchange"), ["asset_id"]))


@query("duplicate_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(x):
    return tidy(A.duplicate_keys(x.table("lineitem"), ["l_orderkey", "l_linenumber"]))


@query("keep_first_row", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, {d('l_extendedprice')} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def keep_first_row(x):
    li = x.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return tidy(A.keep_one(li, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_suppkey"), F.col("l_extendedprice")]).drop("l_shipdate"))


@query("asof_last_bar", """SELECT o.asset_id, CAST(o.day AS VARCHAR) AS day, CAST(b.session AS VARCHAR) AS bar_session, round(b.close, 6) AS close FROM (SELECT DISTINCT asset_id, earnings_date AS day FROM earn) o
  ASOF LEFT JOIN bars b ON o.asset_id = b.asset_id AND o.day >= b.session""")
def asof_last_bar(x):
    left = x.earnings.select("asset_id", F.col("earnings_date").alias("day")).distinct()
    return tidy(A.asof_backward(left, x.bars.select("asset_id", "session", "close"), ["asset_id"], "day", "session", ["close"], right_ts_as="bar_session"))


@query("asof_snapshot_version", """SELECT p.asset_id, CAST(p.session AS VARCHAR) AS session, CAST(n.session AS VARCHAR) AS stamp, n.reason FROM panel p ASOF LEFT JOIN snap n ON p.asset_id = n.asset_id AND p.session >= n.session""")
def asof_snapshot_version(x):
    right = x.snapshots.select("asset_id", F.col("ts").alias("snap_ts"), F.col("ts").alias("stamp"), "reason")
    return tidy(A.asof_interval(x.panel.select("asset_id", "ts", "session"), right, ["asset_id"], "ts", "snap_ts", ["stamp", "reason"]).drop("ts"))


# -- universe ---------------------------------------------------------------------------------

@query("lifetime_dollar_volume", "SELECT asset_id, round(max(close * volume), 4) AS max_dollar_volume_usd FROM bars GROUP BY 1")
def lifetime_dollar_volume(x):
    return tidy(U.lifetime_dollar_volume(x.bars), 4)


@query("seed_candidates", "SELECT asset_id, symbol FROM cand")
def seed_candidates(x):
    return x.candidates


@query("delisted_guard", "SELECT count(*) AS candidates, round(coalesce(avg(CASE WHEN delisted_date IS NULL THEN 0e0 ELSE 1e0 END), 0), 6) AS delisted_share FROM cand JOIN tick USING (asset_id)")
def delisted_guard(x):
    return tidy(U.require_delisted(U.delisted_share(x.candidates, x.tickers), 0.05))


@query("delisted_share", "SELECT count(*) AS candidates, round(coalesce(avg(CASE WHEN delisted_date IS NULL THEN 0e0 ELSE 1e0 END), 0), 6) AS delisted_share FROM cand JOIN tick USING (asset_id)")
def delisted_share(x):
    return tidy(U.delisted_share(x.candidates, x.tickers))


@query("rolling_adv", f"SELECT asset_id, {s('session')}, {d('adv_usd_60', 3)}, suspect_in_lookback, CAST(bars_available AS BIGINT) AS bars_available FROM met1")
def rolling_adv(x):
    return tidy(U.panel_metrics(x.panel, D.WEEKLY_UNIVERSE).select("asset_id", "session", "adv_usd_60", "suspect_in_lookback", "bars_available"), 3)


@query("spread_estimate", f"SELECT asset_id, {s('session')}, {d('cs_bps floor_bps spread_bps_est', 4)} FROM metrics")
def spread_estimate(x):
    m = U.panel_metrics(x.panel, D.WEEKLY_UNIVERSE)
    floor = I.spread_floor(F.col("adv_usd_60"), D.WEEKLY_UNIVERSE).alias("floor_bps")
    return tidy(m.select("asset_id", "session", "cs_bps", floor, "spread_bps_est"), 4)


@query("snapshot_grid", "SELECT asset_id, symbol, CAST(session AS VARCHAR) AS session, CAST(session_index AS BIGINT) AS snapshot_index FROM cand, months")
def snapshot_grid(x):
    return tidy(U.snapshot_grid(x.candidates, P.first_session_of_period(x.calendar)).drop("ts"))


@query("liquidity_rank", """SELECT asset_id, CAST(session AS VARCHAR) AS session, CAST(adv_rank AS BIGINT) AS adv_rank FROM (SELECT *, CASE WHEN adv_usd_60 IS NOT NULL
  THEN row_number() OVER (PARTITION BY session ORDER BY adv_usd_60 DESC NULLS LAST, asset_id) END AS adv_rank FROM metrics)""")
def liquidity_rank(x):
    m = U.panel_metrics(x.panel, D.WEEKLY_UNIVERSE).select("ts", "asset_id", "session", "adv_usd_60")
    return tidy(U.liquidity_rank(m).select("asset_id", "session", "adv_rank"))


SNAP_SQL = f"asset_id, symbol, CAST(session AS VARCHAR) AS ts, eligible, reason, {d('adv_usd_60', 3)}, {i('adv_rank')}, {d('spread_bps_est', 4)}, {d('close_raw')}, {i('bars_available')}, sector, is_etf"


@query("universe_snapshots", f"SELECT {SNAP_SQL} FROM snap")
def universe_snapshots(x):
    return tidy(U.build_snapshots(x.panel, x.candidates, x.tickers, x.calendar, D.WEEKLY_UNIVERSE), adv_usd_60=3, spread_bps_est=4)


@query("snapshot_at", f"SELECT {SNAP_SQL} FROM snap WHERE session = (SELECT max(session) FROM months WHERE session <= DATE '1998-05-20')")
def snapshot_at(x):
    return tidy(U.snapshot_at(x.snapshots, "1998-05-20 00:00:00"), adv_usd_60=3, spread_bps_est=4)


@query("eligible_by_year", "SELECT CAST(year(session) AS BIGINT) AS year, CAST(sum(CAST(eligible AS INT)) AS BIGINT) AS eligible FROM snap GROUP BY 1")
def eligible_by_year(x):
    return tidy(U.eligible_by_year(x.snapshots))


@query("universe_rejections", "SELECT reason, count(*) AS n FROM snap WHERE NOT eligible GROUP BY 1")
def universe_rejections(x):
    return U.rejection_reasons(x.snapshots)


@query("ever_eligible_panel", f"SELECT {PANEL_SQL} FROM panel SEMI JOIN (SELECT DISTINCT asset_id FROM snap WHERE eligible) USING (asset_id)")
def ever_eligible_panel(x):
    return panel_view(U.restrict_to(x.panel, U.ever_eligible(x.snapshots)))


@query("asset_dimension", "SELECT asset_id, symbol, exchange, cluster, is_etf, 'USD' AS currency, 0.01e0 AS tick_size, 1e0 AS step_size, 0e0 AS min_notional_usd FROM assets_")
def asset_dimension(x):
    return x.assets


@query("assets_without_cluster", "SELECT asset_id, cluster FROM assets_ WHERE cluster NOT IN (SELECT r_name FROM region WHERE r_regionkey < 3)")
def assets_without_cluster(x):
    known = x.table("region").where("r_regionkey < 3").select(F.col("r_name").alias("cluster"))
    return U.without_cluster(x.assets, known).select("asset_id", "cluster")


@query("decimal_rounding", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, CAST(p AS DOUBLE) AS price, CAST(floor(p / 0.25) * 0.25 AS DOUBLE) AS stop_long, CAST(ceil(p / 0.25) * 0.25 AS DOUBLE) AS stop_short,
  CAST(ceil(p / 0.25) * 0.25 AS DOUBLE) AS entry_long, CAST(floor(p / 0.25) * 0.25 AS DOUBLE) AS target_long, CAST(floor(p * 100) / 100 AS DOUBLE) AS usd, CAST(floor(l_quantity / 3) * 3 AS DOUBLE) AS qty
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18, 4)) AS p FROM lineitem)""")
def decimal_rounding(x):
    li = x.table("lineitem")
    p = X.to_decimal("l_extendedprice")
    quarter, three = F.lit(0.25).cast("decimal(4,2)"), F.lit(3).cast("decimal(4,0)")
    yes, no = F.lit(True), F.lit(False)
    return tidy(li.select("l_orderkey", "l_linenumber", "l_suppkey", p.alias("price"), X.round_stop(p, quarter, yes).alias("stop_long"),
                          X.round_stop(p, quarter, no).alias("stop_short"), X.round_entry(p, quarter, yes).alias("entry_long"),
                          X.round_target(p, quarter, yes).alias("target_long"), X.round_cents(p).alias("usd"),
                          X.round_qty(X.to_decimal("l_quantity"), three).alias("qty")))


