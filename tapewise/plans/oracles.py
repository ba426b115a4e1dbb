"""SQL statements of the same computations, for checking results elsewhere.

Statements are put together from named subqueries; a session date stands for its
closing timestamp.
"""

from __future__ import annotations

import re

from tapewise.plans import derived as D
from tapewise.plans.inputs import EQUITY, strategies

CTE: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTE[name] = sql


def statement(select: str, instead: dict[str, str] | None = None) -> str:
    """``select`` preceded by the subqueries it needs, in order of definition; ``instead`` has other texts for some."""
    need: set[str] = set()
    texts = {**CTE, **(instead or {})}

    def visit(sql: str) -> None:
        for name in texts:
            if name not in need and re.search(rf"\b{name}\b", sql):
                need.add(name)
                visit(texts[name])

    visit(select)
    parts = [f"{n} AS ({texts[n]})" for n in texts if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def d(cols: str, digits: int = 6) -> str:
    """Rounded double columns."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols.split())


def i(cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols.split())


def s(cols: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols.split())


F, R, M, U, X = D.WEEKLY, D.WEEKLY_REGIME, D.WEEKLY_MARKET, D.WEEKLY_UNIVERSE, D.WEEKLY_EDGE
ASSET = "'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')"
TAPE_ORDER = "l_shipdate, l_orderkey, l_linenumber, px"

cte("tape", f"""SELECT {ASSET} AS asset_id, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS symbol,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS session, sqrt(l_extendedprice) AS px, l_quantity AS qty, l_shipdate,
  l_orderkey, l_linenumber, l_returnflag, l_discount, l_tax FROM lineitem""")
cte("bars", f"""SELECT asset_id, symbol, session, first(px ORDER BY {TAPE_ORDER}) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY {TAPE_ORDER}) AS close, sum(qty) AS volume FROM tape GROUP BY ALL""")
cte("cal", "SELECT session, row_number() OVER (ORDER BY session) - 1 AS session_index FROM (SELECT DISTINCT session FROM tape)")
cte("acts", """SELECT asset_id, session AS ex_date, action_type,
  max(CASE WHEN action_type = 'SPLIT' THEN CASE WHEN l_returnflag = 'A' THEN 0.5e0 ELSE 2.0e0 END ELSE 1.0e0 END) AS split_ratio,
  max(CASE action_type WHEN 'SPLIT' THEN 0e0 WHEN 'DIVIDEND' THEN px * 0.02e0 ELSE 5e0 END) AS cash_amount
  FROM (SELECT *, CASE WHEN qty = 50 AND l_discount = 0 AND l_tax = 0 THEN 'SPLIT'
    WHEN l_returnflag = 'R' AND l_tax = 0.08e0 AND l_discount = 0.1e0 THEN 'DIVIDEND'
    WHEN l_returnflag = 'N' AND qty = 49 AND l_tax = 0.01e0 THEN 'SPINOFF' END AS action_type FROM tape)
  WHERE action_type IS NOT NULL GROUP BY ALL""")
cte("divs", """SELECT a.asset_id, a.ex_date, a.action_type, a.split_ratio,
  CASE WHEN action_type = 'DIVIDEND' THEN cash_amount * coalesce((SELECT product(b.split_ratio) FROM acts b
    WHERE b.asset_id = a.asset_id AND b.action_type = 'SPLIT' AND b.split_ratio > 0 AND b.ex_date > a.ex_date), 1e0)
  ELSE cash_amount END AS cash_amount FROM acts a""")
cte("evf", """SELECT asset_id, ex_date, product(f) AS event_factor FROM (
  SELECT v.asset_id, v.ex_date, CASE WHEN action_type = 'SPLIT' THEN CASE WHEN split_ratio > 0 THEN 1e0 / split_ratio ELSE 1e0 END
    WHEN b.close > 0 AND 1e0 - cash_amount / b.close > 0 THEN 1e0 - cash_amount / b.close ELSE 1e0 END AS f
  FROM divs v ASOF LEFT JOIN bars b ON v.asset_id = b.asset_id AND v.ex_date > b.session) GROUP BY ALL""")
cte("adj", """SELECT b.asset_id, b.symbol, b.session, b.open * f AS open, b.high * f AS high, b.low * f AS low, b.close * f AS close,
  b.close AS close_raw, b.volume / f AS volume, b.volume AS volume_raw, f AS factor
  FROM (SELECT b.*, coalesce((SELECT product(e.event_factor) FROM evf e WHERE e.asset_id = b.asset_id AND e.ex_date > b.session), 1e0) AS f
    FROM bars b) b""")
# The same factors, multiplied in a stated order: a product of doubles depends on it in the last place, which
# decides between assets that are equal in everything.
ORDERED_FACTORS = {"evf": CTE["evf"].replace("product(f)", "product(f ORDER BY action_type)").replace("v.ex_date, CASE", "v.ex_date, v.action_type, CASE"),
                   "adj": CTE["adj"].replace("product(e.event_factor)", "product(e.event_factor ORDER BY e.ex_date DESC)")}
cte("qual0", """SELECT a.*, c.session_index, x.asset_id IS NOT NULL AS has_action,
  lag(session_index) OVER w AS pi, lag(close_raw) OVER w AS pc, lag(a.volume) OVER w AS pv
  FROM adj a JOIN cal c USING (session) LEFT JOIN (SELECT DISTINCT asset_id, ex_date FROM acts) x
    ON x.asset_id = a.asset_id AND x.ex_date = a.session
  WINDOW w AS (PARTITION BY a.asset_id ORDER BY session_index)""")
cte("qual", """SELECT *, (high < low OR close < low OR close > high) AS ohlc_invalid,
  coalesce(session_index = pi + 1 AND close_raw > 0 AND pc > 0 AND abs(ln(close_raw / pc)) > 1, false) AND NOT has_action AS large_return,
  volume = 0 AS zero_volume, (count(*) OVER (PARTITION BY asset_id, run) >= 5 AND volume > 0) AS stale_close, false AS not_in_calendar
  FROM (SELECT *, sum(CASE WHEN coalesce(session_index = pi + 1 AND volume > 0 AND pv > 0 AND close_raw = pc, false) THEN 0 ELSE 1 END)
    OVER (PARTITION BY asset_id ORDER BY session_index) AS run FROM qual0)""")
cte("panel", """SELECT asset_id, symbol, session, CAST(session_index AS BIGINT) AS session_index, open, high, low, close, close_raw,
  volume, close_raw * volume_raw AS dollar_volume,
  (ohlc_invalid OR large_return OR zero_volume OR stale_close OR not_in_calendar) AS is_suspect FROM qual""")
cte("bench", f"""SELECT session, session_index, first(px ORDER BY {TAPE_ORDER}) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY {TAPE_ORDER}) AS close, max(l_discount) AS vix_close FROM tape JOIN cal USING (session) GROUP BY ALL""")
cte("tick", """SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS asset_id, s_name AS symbol,
  CASE WHEN s_nationkey < 8 THEN 'NYSE' WHEN s_nationkey < 16 THEN 'NASDAQ' WHEN s_nationkey < 22 THEN 'BATS' ELSE 'OTC' END AS exchange,
  CASE WHEN s_acctbal > 9000 THEN 'ETF' WHEN s_acctbal < -900 THEN 'ADR Common Stock' ELSE 'Domestic Common Stock' END AS category,
  coalesce(r_name, '') AS sector, s_acctbal > 9000 AS is_etf, DATE '1992-01-01' AS listed_date,
  CASE WHEN s_acctbal > 0 AND s_acctbal < 2000 THEN DATE '2001-03-05' END AS delisted_date,
  CASE WHEN s_acctbal > 0 AND s_acctbal < 2000 THEN 'OTHER' ELSE '' END AS delist_reason
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("earn", f"""SELECT DISTINCT {ASSET} AS asset_id, CAST(o_orderdate AS DATE) AS earnings_date,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) - 21 END AS available
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
cte("cand", f"""SELECT t.asset_id, t.symbol FROM tick t JOIN (SELECT asset_id, max(close * volume) AS dv FROM bars GROUP BY 1) b
  USING (asset_id) WHERE exchange IN ('NYSE', 'NASDAQ', 'NYSEARCA', 'BATS')
  AND category IN ('Domestic Common Stock', 'ETF') AND dv >= {U.min_lifetime_dollar_volume}""")
cte("months", """SELECT session, session_index FROM (SELECT *, row_number() OVER (PARTITION BY year(session), month(session) ORDER BY session) AS k
  FROM cal) WHERE k = 1""")


def roll(agg: str, x: str, n: int, need: int | None = None, w: str = "PARTITION BY asset_id ORDER BY session") -> str:
    f = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} >= {n if need is None else need} THEN {agg}({x}) OVER {f} END"


K = "(3e0 - 2e0 * sqrt(2e0))"
GAPS = """sum(CASE WHEN session_index - pi > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY session)"""
cte("met0", """SELECT *, ln(high / low) AS hl, row_number() OVER w AS bars_available, lag(session_index) OVER w AS pi,
  lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM panel WINDOW w AS (PARTITION BY asset_id ORDER BY session)""")
cte("met1", f"""SELECT *, {GAPS} AS run, hl * hl + pow(lag(hl) OVER (PARTITION BY asset_id ORDER BY session), 2) AS b,
  CASE WHEN ph IS NOT NULL THEN pow(ln(greatest(high, ph) / least(low, pl)), 2) END AS g,
  {roll('median', 'dollar_volume', U.adv_bars)} AS adv_usd_60,
  max(CAST(is_suspect AS INT)) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN {U.suspect_lookback - 1} PRECEDING AND CURRENT ROW) = 1
    AS suspect_in_lookback FROM met0""")
cte("met2", f"""SELECT *, row_number() OVER (PARTITION BY asset_id, run ORDER BY session) - 1 AS bars_since_gap,
  {roll('avg', 'b', U.spread_window)} AS beta, {roll('avg', 'g', U.spread_window)} AS gamma FROM met1""")
FLOOR = "CASE WHEN adv_usd_60 IS NULL THEN NULL " + " ".join(
    f"WHEN adv_usd_60 > {a} THEN {b}" for a, b in U.spread_floors) + f" ELSE {U.spread_floor_rest} END"
cte("metrics", f"""SELECT *, {FLOOR} AS floor_bps, CASE WHEN cs_bps IS NOT NULL AND adv_usd_60 IS NOT NULL
  THEN greatest(cs_bps, {FLOOR}) END AS spread_bps_est FROM (SELECT *, CASE WHEN alpha IS NOT NULL THEN
    greatest(0e0, 2e0 * (exp(alpha) - 1e0) / (1e0 + exp(alpha)) * 1e4) END AS cs_bps
  FROM (SELECT *, (sqrt(2e0 * beta) - sqrt(beta)) / {K} - sqrt(gamma / {K}) AS alpha FROM met2))""")
cte("snap0", """SELECT g.asset_id, g.symbol, g.session, g.session_index AS snapshot_index, m.session AS psession, m.session_index AS last_index,
  m.close_raw, m.adv_usd_60, m.spread_bps_est, coalesce(m.bars_available, 0) AS bars_available, coalesce(m.bars_since_gap, 0) AS bars_since_gap,
  coalesce(m.suspect_in_lookback, false) AS suspect, coalesce(t.sector, '') AS sector, coalesce(t.is_etf, false) AS is_etf,
  coalesce(t.delisted_date <= g.session, false) AS gone
  FROM (SELECT * FROM cand, months) g ASOF LEFT JOIN metrics m ON g.asset_id = m.asset_id AND g.session >= m.session
  LEFT JOIN tick t ON t.asset_id = g.asset_id""")
cte("snap", f"""SELECT *, reason = '' AS eligible FROM (SELECT *, CASE WHEN bars_available < {U.min_history_bars} THEN 'INSUFFICIENT_HISTORY'
  WHEN coalesce(psession <> session, true) OR gone OR coalesce(last_index < snapshot_index - {U.delisting_grace}, false) THEN 'STALE_DATA'
  WHEN suspect THEN 'DATA_SUSPECT' WHEN bars_since_gap < {U.min_bars_since_gap} THEN 'DATA_GAP'
  WHEN NOT coalesce(close_raw >= {U.min_price_usd}, false) THEN 'LOW_PRICE'
  WHEN NOT coalesce(adv_usd_60 >= {U.min_adv_usd}, false) THEN 'LOW_LIQUIDITY'
  WHEN NOT coalesce(adv_rank <= {U.size}, false) THEN 'NOT_IN_UNIVERSE'
  WHEN NOT coalesce(spread_bps_est <= {U.max_spread_bps}, false) THEN 'WIDE_SPREAD' ELSE '' END AS reason
  FROM (SELECT *, CASE WHEN adv_usd_60 IS NOT NULL THEN row_number() OVER (PARTITION BY session ORDER BY adv_usd_60 DESC NULLS LAST, asset_id)
    END AS adv_rank FROM snap0))""")


def ema(x: str, alpha: float, n: int) -> str:
    q = 1.0 - alpha
    return (f"CASE WHEN bars_available >= {n} THEN list_reduce(list({x}) OVER (PARTITION BY asset_id ORDER BY session "
            f"ROWS UNBOUNDED PRECEDING), lambda a, v: {q!r} * a + {alpha!r} * v) END")


def pct_rank(x: str, n: int, need: int, w: str = "PARTITION BY asset_id ORDER BY session") -> tuple[str, str]:
    lst = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    calc = (f"CASE WHEN {x} IS NOT NULL AND len(seen) >= {need} THEN (len(list_filter(seen, lambda v: v < {x})) "
            f"+ (len(list_filter(seen, lambda v: v = {x})) + 1) / 2e0) / len(seen) END")
    return lst, calc


P = "PARTITION BY asset_id ORDER BY session"
cte("f0", f"""SELECT *, row_number() OVER w AS bars_available, lag(session_index) OVER w AS pi, lag(close) OVER w AS pc
  FROM (SELECT p.*, coalesce(sn.eligible, false) AS eligible FROM panel p ASOF LEFT JOIN snap sn
    ON p.asset_id = sn.asset_id AND p.session >= sn.session) WINDOW w AS ({P})""")
cte("f1", f"""SELECT *, {GAPS} AS run, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS true_range,
  ln(close / pc) AS lr, abs(close - pc) AS step, ln(open / pc) AS r_on, ln(close / open) AS r_in FROM f0""")
cte("f2", f"""SELECT *, row_number() OVER (PARTITION BY asset_id, run ORDER BY session) - 1 AS bars_since_gap,
  {ema('true_range', 1.0 / F.atr_n, F.atr_n)} AS atr_14, {ema('close', 2.0 / (F.ema_fast + 1), F.ema_fast)} AS ema_fast,
  {ema('close', 2.0 / (F.ema_slow + 1), F.ema_slow)} AS ema_slow FROM f1""")
PR_LIST, PR_CALC = pct_rank("atr_pct", F.vol_window, F.vol_min_periods)
cte("f3", f"SELECT *, {PR_LIST} AS seen, (open - pc) / lag(atr_14) OVER ({P}) AS gap_atr FROM (SELECT *, atr_14 / close AS atr_pct FROM f2)")


def donchian(agg: str, x: str, n: int) -> str:
    f = f"({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} >= {n} THEN {agg}({x}) OVER {f} END"


def er(n: int) -> str:
    return f"abs(close - lag(close, {n}) OVER ({P})) / nullif({roll('sum', 'step', n)}, 0)"


cte("f4", f"""SELECT * EXCLUDE (seen), {PR_CALC} AS atr_percentile_1y,
  {roll('stddev_samp', 'lr', F.vol_short)} * sqrt({F.bars_per_year}e0) AS vol_20, {roll('stddev_samp', 'lr', F.vol_long)} * sqrt({F.bars_per_year}e0) AS vol_60,
  (ema_fast - ema_slow) / atr_14 AS ema_spread_atr, (close - lag(close, {F.slope_n}) OVER ({P})) / (atr_14 * sqrt({F.slope_n}e0)) AS slope_atr_20,
  {er(F.er_n)} AS efficiency_ratio_20, {er(F.er_long_n)} AS efficiency_ratio_60,
  {donchian('max', 'high', F.donchian_short)} AS donchian_high_20, {donchian('min', 'low', F.donchian_short)} AS donchian_low_20,
  {donchian('max', 'high', F.donchian_long)} AS donchian_high_55, {donchian('min', 'low', F.donchian_long)} AS donchian_low_55,
  lag(close, {F.mom_skip}) OVER ({P}) / lag(close, {F.mom_long}) OVER ({P}) - 1 AS mom_252_skip21,
  lag(close, {F.mom_skip}) OVER ({P}) / lag(close, {F.mom_mid}) OVER ({P}) - 1 AS mom_126_skip21,
  close / lag(close, {F.mom_short}) OVER ({P}) - 1 AS mom_21, {roll('avg', 'abs(gap_atr)', F.gap_mean_n)} AS gap_abs_mean_20,
  {roll('var_samp', 'r_on', F.overnight_n)} AS v_on, {roll('var_samp', 'r_in', F.overnight_n)} AS v_in,
  ema_slow + {F.keltner_k} * atr_14 AS keltner_upper, ema_slow - {F.keltner_k} * atr_14 AS keltner_lower,
  bars_available >= {F.warmup} AS is_warm FROM f3""")
cte("bb", f"SELECT f.asset_id, f.session, ln(f.close / lag(f.close) OVER w) AS rs, ln(b.close / lag(b.close) OVER w) AS rb "
          f"FROM f0 f JOIN bench b USING (session) WINDOW w AS (PARTITION BY f.asset_id ORDER BY f.session)")
FB = f"({P} ROWS BETWEEN {F.beta_window - 1} PRECEDING AND CURRENT ROW)"
cte("betas", f"""SELECT asset_id, session, CASE WHEN count(rs) OVER {FB} >= {F.beta_window // 2} THEN covar_samp(rs, rb) OVER {FB} / var_samp(rb) OVER {FB} END AS beta_bench_90,
  CASE WHEN count(rs) OVER {FB} >= {F.beta_window // 2} THEN corr(rs, rb) OVER {FB} END AS corr_bench_90 FROM bb""")
MR_LIST, MR_CALC = pct_rank("vol", M.vol_window, M.vol_min_periods, "ORDER BY session")
cte("mk0", f"""SELECT *, {roll('avg', 'close', M.sma_n, w='ORDER BY session')} AS sma, {roll('max', 'close', M.dd_n, w='ORDER BY session')} AS peak,
  {roll('stddev_samp', 'lr', M.vol_n, w='ORDER BY session')} * sqrt({M.bars_per_year}e0) AS vol
  FROM (SELECT *, ln(close / lag(close) OVER (ORDER BY session)) AS lr FROM bench)""")
cte("mk1", f"SELECT *, {MR_CALC} AS vol_pct, 1e0 - close / peak AS spy_dd_252, coalesce(close > sma, false) AS spy_above_ma FROM (SELECT *, {MR_LIST} AS seen FROM mk0)")
STRESS = f"(spy_dd_252 >= {M.dd_stress} OR vol_pct >= {M.vol_stress})"
cte("market", f"""SELECT session, session_index, close, sma, vol_pct, spy_dd_252, spy_above_ma, vix_close, CASE WHEN spy_dd_252 IS NULL OR vol_pct IS NULL THEN 'UNKNOWN'
  WHEN spy_above_ma AND spy_dd_252 <= {M.dd_warn} AND NOT {STRESS} THEN 'RISK_ON'
  WHEN NOT spy_above_ma AND {STRESS} THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS market_regime FROM mk1""")


def xs(col: str) -> str:
    m = f"CASE WHEN eligible THEN {col} END"
    return (f"CASE WHEN eligible AND {col} IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY {m} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY session, {m}) - 1) / 2e0) / count({m}) OVER (PARTITION BY session) END")


TREND = f"efficiency_ratio_20 >= {R.er_trend_min} AND efficiency_ratio_60 >= {R.er_long_trend_min}"
cte("feat", f"""SELECT f.*, k.market_regime, k.spy_dd_252, k.spy_above_ma, k.vix_close, b.beta_bench_90, b.corr_bench_90,
  CASE WHEN v_on + v_in > 0 THEN v_on / (v_on + v_in) END AS overnight_var_share_60,
  (donchian_high_55 - f.close) / atr_14 AS dist_to_high_atr, (f.close - donchian_low_55) / atr_14 AS dist_to_low_atr,
  {xs('mom_252_skip21')} AS mom_252_xs_pct, {xs('vol_60')} AS vol_xs_pct,
  count(*) FILTER (eligible) OVER (PARTITION BY session) AS xs_population,
  CASE WHEN atr_percentile_1y IS NULL THEN 'UNKNOWN' WHEN atr_percentile_1y < {R.vol_low} THEN 'LOW' WHEN atr_percentile_1y >= {R.vol_high} THEN 'HIGH' ELSE 'MID' END AS vol_bucket,
  CASE WHEN efficiency_ratio_20 IS NULL OR efficiency_ratio_60 IS NULL OR slope_atr_20 IS NULL OR atr_percentile_1y IS NULL THEN 'UNKNOWN'
    WHEN {TREND} AND slope_atr_20 >= {R.slope_min} THEN 'TREND_UP' WHEN {TREND} AND slope_atr_20 <= -{R.slope_min} THEN 'TREND_DOWN'
    WHEN efficiency_ratio_20 <= {R.er_range_max} AND atr_percentile_1y <= {R.vol_range_max} THEN 'RANGE' ELSE 'CHOP' END AS regime
  FROM f4 f JOIN market k USING (session) JOIN betas b ON b.asset_id = f.asset_id AND b.session = f.session""")
XS, DC = strategies()
READY = "is_warm AND atr_14 > 0"
cte("setups", f"""SELECT *, abs(reference_price - stop_price) AS risk_per_unit, abs(target_price - reference_price) AS reward_per_unit FROM (
  SELECT *, '{XS.strategy_id}' AS strategy_id, CASE WHEN sgn = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, close AS reference_price,
    close - sgn * {XS.stop_atr} * atr_14 AS stop_price, CAST(NULL AS DOUBLE) AS target_price, {XS.max_hold_bars} AS hold
  FROM (SELECT *, CASE WHEN mom_252_xs_pct >= {XS.xs_threshold} THEN 1 WHEN mom_252_xs_pct <= 1e0 - {XS.xs_threshold} THEN -1 END AS sgn
    FROM feat WHERE {READY} AND market_regime IN ('RISK_ON', 'NEUTRAL')) WHERE sgn IS NOT NULL
  UNION ALL
  SELECT *, '{DC.strategy_id}', CASE WHEN sgn = 1 THEN 'LONG' ELSE 'SHORT' END, close, close - sgn * {DC.stop_atr} * atr_14,
    close + sgn * {DC.target_rr} * {DC.stop_atr} * atr_14, {DC.max_hold_bars}
  FROM (SELECT *, CASE WHEN regime = 'TREND_UP' AND ema_spread_atr >= {DC.min_ema_spread_atr} AND close > donchian_high_55 + {DC.entry_buffer_atr} * atr_14 THEN 1
    WHEN regime = 'TREND_DOWN' AND ema_spread_atr <= -{DC.min_ema_spread_atr} AND close < donchian_low_55 - {DC.entry_buffer_atr} * atr_14 THEN -1 END AS sgn
    FROM feat WHERE {READY} AND market_regime IN ('RISK_ON', 'NEUTRAL')) WHERE sgn IS NOT NULL)""")
cte("fwd0", """SELECT s.asset_id, s.session, s.strategy_id, s.direction, s.sgn, s.hold, s.risk_per_unit, s.reward_per_unit,
  b.bars_available - s.bars_available AS k, b.open, b.high, b.low, b.close, b.session AS fsession,
  first(b.open) OVER w AS entry, first(b.session) OVER w AS entry_session
  FROM setups s JOIN f0 b ON b.asset_id = s.asset_id AND b.bars_available > s.bars_available AND b.bars_available <= s.bars_available + s.hold
  WINDOW w AS (PARTITION BY s.asset_id, s.session, s.strategy_id, s.direction ORDER BY b.bars_available)""")
cte("fwd1", """SELECT *, CASE WHEN sgn * open <= sgn * stp THEN 'STOP' WHEN least(sgn * high, sgn * low) <= sgn * stp THEN 'STOP'
  WHEN greatest(sgn * high, sgn * low) >= sgn * tgt THEN 'TARGET' WHEN k >= hold THEN 'TIME' END AS code,
  CASE WHEN sgn * open <= sgn * stp THEN open WHEN least(sgn * high, sgn * low) <= sgn * stp THEN stp
  WHEN greatest(sgn * high, sgn * low) >= sgn * tgt THEN CASE WHEN sgn * open >= sgn * tgt THEN open ELSE tgt END WHEN k >= hold THEN close END AS px
  FROM (SELECT *, entry - sgn * risk_per_unit AS stp, entry + sgn * reward_per_unit AS tgt FROM fwd0)""")
cte("exits", """SELECT asset_id, session, strategy_id, direction, min(k) FILTER (code IS NOT NULL) AS ek, max(k) AS seen,
  arg_min(code, k) FILTER (code IS NOT NULL) AS code, arg_min(px, k) FILTER (code IS NOT NULL) AS px,
  arg_min(fsession, k) FILTER (code IS NOT NULL) AS xsession, any_value(entry) AS entry, any_value(entry_session) AS entry_session
  FROM fwd1 GROUP BY ALL""")
cte("excur", """SELECT f.asset_id, f.session, f.strategy_id, f.direction,
  least(0, min(least(sgn * (high - f.entry), sgn * (low - f.entry)) / risk_per_unit)) AS mae_r,
  greatest(0, max(greatest(sgn * (high - f.entry), sgn * (low - f.entry)) / risk_per_unit)) AS mfe_r
  FROM fwd1 f JOIN exits e USING (asset_id, session, strategy_id, direction) WHERE e.ek IS NULL OR f.k <= e.ek GROUP BY ALL""")
cte("earnx", """SELECT asset_id, available, (SELECT min(session_index) FROM cal WHERE session >= earnings_date) AS idx FROM earn""")


def blocked(t: str, hold: str) -> str:
    known = f"e.asset_id = {t}.asset_id AND (e.available IS NULL OR e.available <= {t}.session)"
    return (f"CASE WHEN coalesce((SELECT any_value(is_etf) FROM tick z WHERE z.asset_id = {t}.asset_id), false) THEN false "
            f"WHEN NOT EXISTS (SELECT 1 FROM earnx e WHERE {known}) THEN true "
            f"ELSE EXISTS (SELECT 1 FROM earnx e WHERE {known} AND (e.idx IS NULL OR "
            f"(e.idx - CASE WHEN e.available IS NULL THEN 4 ELSE 0 END <= {t}.session_index + {hold} AND "
            f"e.idx + CASE WHEN e.available IS NULL THEN 4 ELSE 0 END >= {t}.session_index + 1))) END")


cte("labels_", f"""SELECT s.asset_id, s.symbol, s.session AS setup_session, coalesce(e.entry_session, s.session) AS entry_session, e.xsession AS exit_session,
  s.strategy_id, s.direction, s.sgn, s.regime, s.market_regime, s.vol_bucket, s.reference_price, e.entry AS entry_price,
  coalesce(e.entry - s.sgn * s.risk_per_unit, s.stop_price) AS stop_price, e.px AS exit_price,
  CASE WHEN e.entry IS NULL THEN s.target_price ELSE e.entry + s.sgn * s.reward_per_unit END AS target_price, s.risk_per_unit,
  s.reward_per_unit / s.risk_per_unit AS reward_risk_ratio, s.sgn * (e.entry - s.reference_price) / s.atr_14 AS entry_gap_atr,
  coalesce(e.code, 'OPEN') AS outcome, coalesce(e.ek, e.seen, 0) AS bars_held, s.sgn * (e.px - e.entry) / s.risk_per_unit AS realised_r_gross,
  coalesce(x.mae_r, 0) AS mae_r, coalesce(x.mfe_r, 0) AS mfe_r, s.atr_pct, s.efficiency_ratio_20, s.beta_bench_90, n.adv_usd_60, s.mom_252_xs_pct,
  s.overnight_var_share_60, s.xs_population, {blocked('s', 's.hold')} AS had_earnings_in_window
  FROM setups s LEFT JOIN exits e USING (asset_id, session, strategy_id, direction) LEFT JOIN excur x USING (asset_id, session, strategy_id, direction)
  ASOF LEFT JOIN snap n ON n.asset_id = s.asset_id AND s.session >= n.session""")
BIN = "strategy_id, direction, vol_bucket"
AGG = f"""count(r) AS n, avg(r) AS mean_r, stddev_samp(r) AS std_r, CASE WHEN count(r) > 1 THEN avg(r) - {X.z} * stddev_samp(r) / sqrt(count(r)) END AS ev_r_lcb,
  avg(bars_held) FILTER (r IS NOT NULL) AS mean_bars_held, avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS win_rate,
  CASE WHEN count(r) > 0 THEN coalesce(avg(r) FILTER (r > 0), 0) END AS avg_win_r, CASE WHEN count(r) > 0 THEN coalesce(avg(r) FILTER (r < 0), 0) END AS avg_loss_r,
  avg(CASE WHEN r IS NULL THEN NULL WHEN outcome = 'TARGET' THEN 1e0 ELSE 0e0 END) AS target_rate, avg(CASE WHEN r IS NULL THEN NULL WHEN outcome = 'STOP' THEN 1e0 ELSE 0e0 END) AS stop_rate,
  avg(CASE WHEN r IS NULL THEN NULL WHEN outcome = 'TIME' THEN 1e0 ELSE 0e0 END) AS time_rate, median(r) AS median_r, quantile_cont(r, 0.05) AS p05_r, quantile_cont(r, 0.95) AS p95_r"""
cte("resolved", "SELECT *, realised_r_gross AS r FROM labels_ WHERE exit_session IS NOT NULL")
cte("edge_", f"""SELECT g.strategy_id, g.direction, g.vol_bucket, g.session AS as_of, {AGG}
  FROM (SELECT * FROM (SELECT DISTINCT {BIN} FROM resolved), (SELECT session FROM months)) g LEFT JOIN resolved l
  ON l.strategy_id = g.strategy_id AND l.direction = g.direction AND l.vol_bucket = g.vol_bucket AND l.exit_session < g.session GROUP BY 1, 2, 3, 4""")
cte("assets_", """SELECT c.asset_id, c.symbol, coalesce(t.exchange, 'NYSE') AS exchange, CASE WHEN trim(coalesce(t.sector, '')) = '' THEN 'OTHER' ELSE t.sector END AS cluster,
  coalesce(t.is_etf, false) AS is_etf FROM cand c LEFT JOIN tick t USING (asset_id)""")
cte("trades_", f"""SELECT l.*, t.sector AS cluster, entry_session AS ets, exit_session AS xts, floor(100e0 / risk_per_unit * 100) / 100 AS qty,
  CAST(sgn AS DOUBLE) AS sign, r AS realised_r, mom_252_xs_pct * 0.2e0 - 0.1e0 AS ev_net_r_at_entry,
  CAST(substr(l.asset_id, 2) AS BIGINT) * 2000 + CAST(floor((setup_session - DATE '1990-01-01') / 7) AS BIGINT) * 2 + CASE WHEN strategy_id = '{XS.strategy_id}' THEN 0 ELSE 1 END AS row_key
  FROM resolved l JOIN tick t ON t.asset_id = l.asset_id""")
cte("money", """SELECT *, sign * (exit_price - entry_price) * qty AS gross_pnl_usd, qty * 0.007e0 AS fees_usd, 0e0 AS funding_usd,
  CASE WHEN sign < 0 THEN bars_held * 0.01e0 ELSE 0e0 END AS borrow_usd FROM trades_""")
cte("curve", f"""SELECT session, session_index, {EQUITY} + sum(coalesce(p, 0)) OVER (ORDER BY session) AS equity
  FROM cal LEFT JOIN (SELECT xts, sum(gross_pnl_usd - fees_usd - borrow_usd) AS p FROM money GROUP BY 1) ON xts = session""")
cte("curve2", """SELECT *, equity / lag(equity) OVER (ORDER BY session) - 1 AS ret, max(equity) OVER (ORDER BY session) AS peak,
  greatest(0e0, 1e0 - equity / max(equity) OVER (ORDER BY session)) AS dd FROM curve""")

