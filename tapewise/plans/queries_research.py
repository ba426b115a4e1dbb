"""Queries on performance, stability, calibration, registry and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewise.functions.stats import ERF_SCALE, ERF_TERMS, expected_best
from tapewise.operators import bootstrap as BS
from tapewise.operators import research as RE
from tapewise.params import ResearchParams
from tapewise.plans import derived as D
from tapewise.plans.catalog import query, tidy
from tapewise.plans.oracles import ORDERED_FACTORS, cte, d
from tapewise.plans.queries_decide import REPS, SEED, UNIFORM, WEIGHT
from tapewise.sources import outputs as O
from tapewise.sources import tables as S
from tapewise.streaming import continuity as SC
from tapewise.streaming import observations as SO

P = ResearchParams(bootstrap_iterations=REPS, bootstrap_seed=SEED)
YEARS = "floor(date_diff('day', min(session), max(session))) / 365.25e0"


@query("equity_curve", f"SELECT CAST(session AS VARCHAR) AS session, {d('equity ret dd', 6)} FROM curve2")
def equity_curve(x):
    e = RE.with_drawdown(RE.with_returns(x.equity))
    return tidy(e.select("session", "equity", "ret", F.col("drawdown_pct").alias("dd")))


cte("under", """SELECT max(date_diff('day', a, b)) AS days FROM (SELECT min(session) AS a, max(session) AS b FROM (SELECT *, sum(CASE WHEN dd > 0 THEN 0 ELSE 1 END) OVER (ORDER BY session) AS run FROM curve2)
  WHERE dd > 0 GROUP BY run)""")
cte("rr", f"""SELECT arg_min(equity, session) AS e0, arg_max(equity, session) AS e1, {YEARS} AS y, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(pow(least(ret, 0), 2)) FILTER (ret IS NOT NULL)) AS dn,
  max(dd) AS max_drawdown_pct, sqrt(avg(dd * dd)) AS ulcer_index FROM curve2""")
RR = """e1 / e0 - 1 AS total_return_pct, pow(e1 / e0, 1 / y) - 1 AS cagr_pct, m / s * sqrt(252e0) AS sharpe, m / dn * sqrt(252e0) AS sortino, max_drawdown_pct,
  (pow(e1 / e0, 1 / y) - 1) / nullif(max_drawdown_pct, 0) AS calmar, ulcer_index"""
RR_COLS = "total_return_pct cagr_pct sharpe sortino max_drawdown_pct calmar ulcer_index max_drawdown_duration_days"


@query("return_and_risk", f"SELECT {d(RR_COLS)} FROM (SELECT {RR}, (SELECT coalesce(days, 0) FROM under) AS max_drawdown_duration_days FROM rr)")
def return_and_risk(x):
    return tidy(RE.return_risk(x.equity, P))


cte("ordered", "SELECT *, row_number() OVER (ORDER BY ets, asset_id, strategy_id, setup_session) AS pos FROM money")
cte("streak", """SELECT coalesce(max(c), 0) AS best FROM (SELECT count(*) AS c FROM (SELECT *, pos - row_number() OVER (ORDER BY pos) AS grp FROM ordered WHERE realised_r < 0) GROUP BY grp)""")
cte("ts_", """SELECT count(realised_r)::DOUBLE AS n_trades, avg(CAST(realised_r > 0 AS DOUBLE)) AS win_rate, avg(realised_r) FILTER (realised_r > 0) AS avg_win_r, avg(realised_r) FILTER (realised_r < 0) AS avg_loss_r,
  avg(realised_r) AS mean_r, median(realised_r) AS median_r, stddev_samp(realised_r) AS std_r, sum(realised_r) FILTER (realised_r > 0) / abs(sum(realised_r) FILTER (realised_r < 0)) AS profit_factor,
  avg(realised_r) AS expectancy_r, avg(realised_r) FILTER (realised_r > 0) / abs(avg(realised_r) FILTER (realised_r < 0)) AS payoff_ratio, (SELECT best FROM streak)::DOUBLE AS max_consecutive_losses,
  avg(bars_held) AS avg_bars_held, avg(mae_r) AS mae_r_mean, avg(mfe_r) AS mfe_r_mean FROM money""")
TS_COLS = "n_trades win_rate avg_win_r avg_loss_r mean_r median_r std_r profit_factor expectancy_r payoff_ratio max_consecutive_losses avg_bars_held mae_r_mean mfe_r_mean"


@query("trade_statistics", f"SELECT {d(TS_COLS)} FROM ts_")
def trade_statistics(x):
    return tidy(RE.trade_statistics(x.trades))


cte("openx", "SELECT c.session, (SELECT count(*) FROM money m WHERE m.ets <= c.session AND m.xts >= c.session) AS open_trades FROM cal c")


@query("exposed_sessions", "SELECT CAST(session AS VARCHAR) AS ts, open_trades FROM openx")
def exposed_sessions(x):
    return tidy(RE.exposed_sessions(x.trades, x.equity))


cte("act_", f"""SELECT n / (y * 12) AS trades_per_month, (SELECT avg(CAST(open_trades > 0 AS DOUBLE)) FROM openx) AS exposure_pct, CASE WHEN me > 0 THEN nv / me / y END AS turnover_annual, total_fees_usd, total_funding_usd,
  CASE WHEN gp > 0 THEN (total_fees_usd + total_funding_usd + bw) / gp END AS cost_drag_pct FROM (SELECT count(*) AS n, sum(0.5e0 * (abs(qty * entry_price) + abs(qty * exit_price))) AS nv, sum(fees_usd) AS total_fees_usd,
  sum(funding_usd) AS total_funding_usd, sum(borrow_usd) AS bw, sum(gross_pnl_usd) AS gp FROM money), (SELECT {YEARS} AS y, avg(equity) AS me FROM curve)""")
ACT_COLS = "trades_per_month exposure_pct turnover_annual total_fees_usd total_funding_usd cost_drag_pct"


@query("activity_and_cost", f"SELECT {d(ACT_COLS, 5)} FROM act_", ORDERED_FACTORS)
def activity_and_cost(x):
    return tidy(RE.activity_and_cost(x.trades, x.equity), 5)


@query("mean_r_interval", """SELECT round(quantile_cont(m, 0.05), 6) AS mean_r_ci_low, round(quantile_cont(m, 0.95), 6) AS mean_r_ci_high, round(avg(CAST(m <= 0 AS DOUBLE)), 6) AS p_value_mean_r
  FROM (SELECT rep, sum(w * realised_r) / sum(w) AS m FROM wts GROUP BY 1)""")
def mean_r_interval(x):
    return tidy(RE.mean_r_interval(x.trades, x.row_key, P))


cte("wts_ret", f"SELECT *, {WEIGHT} AS w FROM (SELECT *, {UNIFORM} FROM (SELECT ret, CAST(session - DATE '1990-01-01' AS BIGINT) AS row_key FROM curve2 WHERE ret IS NOT NULL), "
    f"(SELECT unnest(generate_series(0, {REPS - 1}))::BIGINT AS rep))))))")


@query("sharpe_interval", """SELECT round(quantile_cont(z, 0.05), 5) AS sharpe_ci_low, round(quantile_cont(z, 0.95), 5) AS sharpe_ci_high FROM (SELECT rep,
  sum(w * ret) / sum(w) / sqrt((sum(w * ret * ret) - sum(w * ret) * sum(w * ret) / sum(w)) / (sum(w) - 1)) * sqrt(252e0) AS z FROM wts_ret GROUP BY 1)""")
def sharpe_interval(x):
    return tidy(RE.sharpe_interval(x.equity, P, F.datediff("session", F.lit("1990-01-01").cast("date"))), 5)


MOMENTS = """count(ret) AS n_obs, avg(ret) / stddev_samp(ret) AS sharpe_per_bar, sum(pow(ret - mu, 3)) / count(ret) / pow(sum(pow(ret - mu, 2)) / count(ret), 1.5e0) AS skew,
  sum(pow(ret - mu, 4)) / count(ret) / pow(sum(pow(ret - mu, 2)) / count(ret), 2) AS kurtosis FROM curve2, (SELECT avg(ret) AS mu FROM curve2)"""


@query("return_moments", f"SELECT n_obs, {d('sharpe_per_bar skew kurtosis')} FROM (SELECT {MOMENTS})")
def return_moments(x):
    return tidy(RE.return_moments(x.equity))


@query("bootstrap_statistic", """SELECT direction, round(avg(z), 6) AS mean_stat, round(quantile_cont(z, 0.05), 6) AS low, round(quantile_cont(z, 0.95), 6) AS high
  FROM (SELECT direction, rep, sum(w * greatest(realised_r, 0)) / sum(w * abs(realised_r)) AS z FROM wts WHERE realised_r IS NOT NULL GROUP BY ALL HAVING sum(w) > 0) GROUP BY 1""")
def bootstrap_statistic(x):
    """Share of the gains in all absolute results, over replicates."""
    r = F.col("realised_r")
    reps = BS.bootstrap_statistic(x.trades, ["direction"], {"gain": F.greatest(r, r * 0), "size": F.abs(r)}, x.row_key, REPS, SEED, "gain / size")
    return tidy(reps.groupBy("direction").agg(F.avg("stat").alias("mean_stat"), F.percentile("stat", F.lit(0.05)).alias("low"),
                                              F.percentile("stat", F.lit(0.95)).alias("high")))


DEVIATION = "sqrt(greatest(0e0, 1 - skew * sharpe_per_bar + sharpe_per_bar * sharpe_per_bar * (kurtosis - 1) / 4e0) / (n_obs - 1))"
ERF = "0e0"
for _c in reversed(ERF_TERMS):
    ERF = f"(({ERF} + {_c!r}e0) * t)"


@query("deflated_sharpe", f"""SELECT round(CASE WHEN z < 0 THEN up ELSE 1 - up END, 6) AS deflated_sharpe, 20e0 AS n_trials, round(sharpe_per_bar, 6) AS sharpe_per_bar
  FROM (SELECT *, {ERF} * exp(-z * z / 2) / 2 AS up FROM (SELECT *, 1 / (1 + {ERF_SCALE}e0 * abs(z) / sqrt(2e0)) AS t
  FROM (SELECT *, (sharpe_per_bar - {expected_best(20)!r}e0 * {DEVIATION}) / {DEVIATION} AS z FROM (SELECT {MOMENTS}))))""")
def deflated_sharpe(x):
    return tidy(RE.deflated_sharpe_row(RE.return_moments(x.equity), 20))


@query("run_metrics", f"SELECT {d(RR_COLS)}, {d(TS_COLS)}, {d(ACT_COLS, 6)} FROM (SELECT {RR}, (SELECT coalesce(days, 0) FROM under) AS max_drawdown_duration_days FROM rr), ts_, act_", ORDERED_FACTORS)
def run_metrics(x):
    m = RE.run_metrics(x.trades, x.equity, x.row_key, n_trials=20, p=P)
    return tidy(m.select(*RR_COLS.split(), *TS_COLS.split(), *ACT_COLS.split()))


@query("headline_metrics", """SELECT round((SELECT arg_max(equity, session) / arg_min(equity, session) - 1 FROM curve), 6) AS total_return_pct, round((SELECT max(dd) FROM curve2), 6) AS max_drawdown_pct,
  round((SELECT arg_max(equity, session) FROM curve), 4) AS final_equity, count(*) AS n_trades, round(avg(CAST(realised_r > 0 AS DOUBLE)), 6) AS win_rate, round(avg(realised_r), 6) AS mean_r,
  count(*) FILTER (outcome = 'TARGET') AS n_target, count(*) FILTER (outcome = 'STOP') AS n_stop, count(*) FILTER (outcome = 'TIME') AS n_time FROM money""")
def headline_metrics(x):
    return tidy(RE.headline_metrics(x.trades, x.equity), final_equity=4)


cte("dims", " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS grp, realised_r FROM money" for k, v in {
    "year": "CAST(year(ets) AS VARCHAR)", "quarter": "year(ets) || 'Q' || quarter(ets)", "regime": "regime", "vol_bucket": "vol_bucket", "direction": "direction",
    "symbol": "symbol", "cluster": "cluster", "strategy_id": "strategy_id"}.items()))


@query("group_mean_r", """SELECT dimension, grp AS "group", count(*) AS n, round(avg(realised_r), 6) AS mean_r, round(sum(realised_r), 6) AS sum_r FROM dims WHERE grp IS NOT NULL GROUP BY ALL""")
def group_mean_r(x):
    return tidy(RE.group_mean_r(x.trades))


cte("bysym", "SELECT symbol, count(*) AS n, avg(realised_r) AS mean_r, sum(realised_r) AS sum_r FROM money GROUP BY 1")


@query("pnl_share", """SELECT symbol AS "group", n, round(mean_r, 6) AS mean_r, round(sum_r, 6) AS sum_r, round(sum_r / (SELECT sum(abs(sum_r)) FROM bysym), 6) AS pnl_share FROM bysym""")
def pnl_share(x):
    return tidy(RE.pnl_share(x.trades))


@query("top_share", "SELECT round((SELECT sum(sum_r) FROM (SELECT sum_r FROM bysym ORDER BY sum_r DESC, symbol LIMIT 3)) / sum(sum_r), 6) AS top_share FROM bysym")
def top_share(x):
    return tidy(RE.top_share(x.trades, 3))


@query("benchmark_regression", """SELECT round(b, 6) AS beta, round(a * 252, 6) AS alpha_annualised_pct, round(a / sqrt(greatest(yy - xy * xy / xx, 0) / (n - 2) * (1e0 / n + mx * mx / xx)), 6) AS t_alpha, n
  FROM (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_count(y, x)::BIGINT AS n, regr_sxx(y, x) AS xx, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, avg(x) FILTER (y IS NOT NULL) AS mx
  FROM (SELECT c.ret AS y, b.close / lag(b.close) OVER (ORDER BY session) - 1 AS x FROM curve2 c JOIN bench b USING (session)))""")
def benchmark_regression(x):
    return tidy(RE.benchmark_regression(x.equity, x.benchmark))


WINDOWS = (("w1996", "1996-02-01", "1996-05-01"), ("w1998", "1998-07-01", "1998-11-01"), ("w2000", "2000-01-01", "2001-01-01"), ("w2030", "2030-01-01", "2031-01-01"))


@query("window_returns", f"""SELECT w AS "window", s AS "start", e AS "end", round(CASE WHEN count(session) >= 2 THEN arg_max(equity, session) / arg_min(equity, session) - 1 END, 6) AS return_pct,
  coalesce(CASE WHEN count(session) >= 2 THEN arg_max(equity, session) / arg_min(equity, session) - 1 END < -0.15, false) AS fails_15pct
  FROM (VALUES {', '.join(str(w) for w in WINDOWS)}) v(w, s, e) LEFT JOIN curve ON session >= CAST(s AS DATE) AND session < CAST(e AS DATE) GROUP BY ALL""")
def window_returns(x):
    return tidy(RE.window_returns(x.equity, P, WINDOWS))


@query("monthly_returns", "SELECT CAST(y AS BIGINT) AS year, " + ", ".join(f"round(max(r) FILTER (m = {k}), 6) AS m{k:02d}" for k in range(1, 13)) + """ FROM (SELECT y, m, e / lag(e) OVER (ORDER BY y, m) - 1 AS r
  FROM (SELECT year(session) AS y, month(session) AS m, arg_max(equity, session) AS e FROM curve GROUP BY ALL)) GROUP BY y""")
def monthly_returns(x):
    return tidy(RE.monthly_grid(x.equity))


@query("equity_with_benchmark", "SELECT CAST(session AS VARCHAR) AS session, round(c.equity, 6) AS equity, round(b.close / first(b.close) OVER (ORDER BY session), 6) AS benchmark, round(dd, 6) AS drawdown_pct FROM curve2 c JOIN bench b USING (session)")
def equity_with_benchmark(x):
    return tidy(RE.equity_with_benchmark(x.equity, x.benchmark).select("session", "equity", "benchmark", "drawdown_pct"))


@query("trades_per_month", "SELECT strftime(ets, '%Y-%m') AS month, count(*) AS n_trades FROM money GROUP BY 1")
def trades_per_month(x):
    return RE.trades_per_month(x.trades)


@query("gap_decomposition", """SELECT count(*) AS n_stop, round(avg(realised_r), 6) AS mean_r, round(quantile_cont(realised_r, 0.05), 6) AS p05_r, round(avg(CAST(realised_r < -1.5 AS DOUBLE)), 6) AS frac_below_minus_1_5
  FROM money WHERE outcome = 'STOP'""")
def gap_decomposition(x):
    return tidy(RE.gap_decomposition(x.trades))


@query("bin_realised", """SELECT b.*, coalesce(n, 0) AS realised_n, round(m, 6) AS realised_mean_r FROM (SELECT DISTINCT strategy_id, direction, vol_bucket FROM edge_) b
  LEFT JOIN (SELECT strategy_id, direction, vol_bucket, count(*) AS n, avg(realised_r) AS m FROM money GROUP BY ALL) t USING (strategy_id, direction, vol_bucket)""")
def bin_realised(x):
    bins = x.edge.select("strategy_id", "direction", "vol_bucket").distinct()
    return tidy(RE.bin_realised(bins, x.trades))


cte("cuts", "SELECT list_distinct(list_value(" + ", ".join(f"quantile_cont(ev_net_r_at_entry, {k / 10})" for k in range(11)) + ")) AS raw FROM money")


@query("calibration_buckets", """SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n, round(avg(realised_r), 6) AS mean_realised_r FROM (SELECT realised_r,
  greatest(1, len(list_filter(list_sort(raw), lambda e: e < ev_net_r_at_entry))) AS bucket FROM money, cuts WHERE ev_net_r_at_entry IS NOT NULL) GROUP BY 1""")
def calibration_buckets(x):
    return tidy(RE.calibration(x.trades, x.row_key, 10, P).select("bucket", "n", "mean_realised_r"))


@query("calibration_flat", """SELECT CAST(1 AS BIGINT) AS bucket, count(*) AS n, round(avg(realised_r), 6) AS mean_realised_r, 0.05e0 AS predicted_mid FROM money WHERE ev_net_r_at_entry IS NOT NULL AND realised_r IS NOT NULL""")
def calibration_flat(x):
    flat = x.trades.withColumn("ev_net_r_at_entry", F.when(F.col("ev_net_r_at_entry").isNotNull(), F.lit(0.05)))
    return tidy(RE.calibration(flat, x.row_key, 10, P).select("bucket", "n", "mean_realised_r", "predicted_mid"), 6, predicted_mid=3)


@query("funnel_written", """SELECT stage, rejection_reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN reason IS NULL THEN 'ACCEPTED' ELSE 'REJECT' END AS stage, coalesce(reason, '') AS rejection_reason, 1 AS n FROM dec
  UNION ALL SELECT 'ACCEPTED', '', 0) GROUP BY ALL""")
def funnel_written(x):
    from tapewise.operators.decisions import funnel
    from tapewise.plans.queries_decide import evaluated
    from tapewise.plans.queries_panel import scratch
    path = scratch(x, "funnel")
    O.write_funnel(funnel(evaluated(x)), path)
    got = x.spark.read.csv(path, header=True, schema="stage string, rejection_reason string, n long")
    return tidy(got.withColumn("rejection_reason", F.coalesce("rejection_reason", F.lit(""))))


@query("typed_actions", """SELECT action_type, count(*) AS n FROM acts WHERE month(ex_date) <> 1 GROUP BY 1""")
def typed_actions(x):
    other = x.actions.withColumn("action_type", F.when(F.month("ex_date") == 1, "RIGHTS").otherwise(F.col("action_type")))
    return tidy(O.typed_actions(other).groupBy("action_type").agg(F.count(F.lit(1)).alias("n")))


@query("calibration_table")
def calibration_table(x):
    return tidy(RE.calibration(x.trades, x.row_key, 10, P))


#: Two-sided p-value of t_stat: one minus the density between -t and t, by Simpson's rule.
P_VALUE = """round(1 - 2 * abs(t_stat) / 6000 * list_sum(list_transform(range(2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + pow(t_stat * k / 2000, 2) / dof, -(dof + 1) / 2))), 6) AS p_value"""


@query("compare_samples", f"""SELECT n1, n2, {d('m1 v1 m2 v2 t_stat dof')}, {P_VALUE} FROM (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t_stat, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof
  FROM (SELECT avg(realised_r) FILTER (direction = 'LONG') AS m1, var_samp(realised_r) FILTER (direction = 'LONG') AS v1, count(*) FILTER (direction = 'LONG') AS n1,
  avg(realised_r) FILTER (direction <> 'LONG') AS m2, var_samp(realised_r) FILTER (direction <> 'LONG') AS v2, count(*) FILTER (direction <> 'LONG') AS n2 FROM money))""")
def compare_samples(x):
    return tidy(RE.compare_samples(x.trades, F.col("direction") == "LONG", "realised_r"))


Z = 1.6448536269514715


@query("win_rate_interval", f"""SELECT strategy_id, direction, n, wins, round(mid - half, 6) AS ci_low, round(mid + half, 6) AS ci_high FROM (SELECT *, (p + {Z * Z} / (2e0 * n)) / (1 + {Z * Z} / n) AS mid,
  {Z} * sqrt(p * (1 - p) / n + {Z * Z} / (4e0 * n * n)) / (1 + {Z * Z} / n) AS half FROM (SELECT strategy_id, direction, count(*) AS n, count(*) FILTER (realised_r > 0) AS wins, avg(CAST(realised_r > 0 AS DOUBLE)) AS p FROM money GROUP BY ALL))""")
def win_rate_interval(x):
    return tidy(RE.win_rate_interval(x.trades, ["strategy_id", "direction"]))


# -- registry and splits ----------------------------------------------------------------------

@query("trial_registry", """SELECT k AS trial_id, 'run' || k AS run_id, CASE WHEN k % 3 = 0 THEN 'HOLDOUT' ELSE 'DEVELOPMENT' END AS split, round(CASE WHEN n < 5000 THEN NULL ELSE v END, 6) AS value FROM (
  SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS k, count(*) AS n, avg(l_discount) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus)
  UNION ALL SELECT (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) + 1, 'next', 'DEVELOPMENT', NULL""")
def trial_registry(x):
    from pyspark.sql import Window
    g = x.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("v"))
    k = F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus")).cast("long")  # six rows
    reg = g.withColumn("trial_id", k).select(
        "trial_id", F.concat(F.lit("run"), F.col("trial_id").cast("string")).alias("run_id"),
        F.when(F.col("trial_id") % 3 == 0, "HOLDOUT").otherwise("DEVELOPMENT").alias("split"), F.lit("h").alias("config_hash"), F.lit("s").alias("data_snapshot_id"),
        F.lit("mean_r").alias("metric"), F.when(F.col("n") < 5000, F.lit(None)).otherwise(F.col("v")).alias("value"))
    new = reg.limit(1).withColumn("value", F.lit(float("inf"))).withColumn("run_id", F.lit("next")).withColumn("split", F.lit("DEVELOPMENT"))
    return tidy(reg.unionByName(S.append_trial(reg, new)).select("trial_id", "run_id", "split", "value"))


@query("development_trials", "SELECT count(*) AS n_trials FROM money WHERE direction = 'LONG'")
def development_trials(x):
    return S.development_trials(x.trades.withColumn("split", F.when(F.col("direction") == "LONG", "DEVELOPMENT").otherwise("HOLDOUT")))


@query("period_split", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + 7300 >= DATE '2018-01-01' THEN 'HOLDOUT' ELSE 'DEVELOPMENT' END AS split FROM orders")
def period_split(x):
    day = F.to_date("o_orderdate")
    return x.table("orders").select("o_orderkey", RE.split_of(day, F.date_add(day, 7300)).alias("split"))


@query("equity_output", """SELECT CAST(session AS VARCHAR) AS ts, round(equity, 6) AS equity, round(b.close, 6) AS benchmark, round((peak - equity) / peak, 6) AS drawdown_pct
  FROM curve2 LEFT JOIN (SELECT session, close FROM bench) b USING (session)""")
def equity_output(x):
    from tapewise.plans.queries_panel import scratch
    path = scratch(x, "equity")
    O.write_equity(x.equity, x.benchmark.select("ts", F.col("close").alias("benchmark")), path)
    return tidy(x.spark.read.csv(path, header=True, schema="ts timestamp, equity double, benchmark double, drawdown_pct double"))


# -- streams ----------------------------------------------------------------------------------------

@query("stream_observations", "SELECT 'U' || user_id AS symbol, event_type AS source, CAST(event_id AS VARCHAR) AS payload_hash, round(value, 6) AS raw_score FROM events")
def stream_observations(x):
    from tapewise.plans.queries_panel import scratch
    obs = D.observations(x.spark, x.sf_dir)
    src = scratch(x, "obs_feed")
    # every observation is delivered twice, in files ordered by availability
    obs.unionByName(obs).repartitionByRange(4, "available_ts").write.mode("overwrite").parquet(src)
    out = SO.intake(x.spark, src, obs.schema, scratch(x, "obs_out"), scratch(x, "obs_state"), files_per_batch=2)
    return tidy(out.select("symbol", "source", "payload_hash", "raw_score"))


@query("stream_bar_continuity", "SELECT asset_id, CAST(session AS VARCHAR) AS session, CAST(bars_since_gap AS BIGINT) AS bars_since_gap FROM f2")
def stream_bar_continuity(x):
    from tapewise.plans.queries_panel import scratch
    src = scratch(x, "bar_feed")
    bars = x.panel.select("asset_id", "ts", "session_index", "close_raw", "volume")
    # three deliveries of any number of files
    sink, state = scratch(x, "bar_out"), scratch(x, "bar_state")
    for lo, hi in ((-1, 119), (120, 239), (240, 1 << 30)):
        bars.where(F.col("session_index").between(lo, hi)).write.mode("append").parquet(src)
        out = SC.run_continuity(x.spark, src, bars.schema, sink, state)
    return tidy(out.select("asset_id", F.col("ts").alias("session"), "bars_since_gap"))


@query("stream_decision_sink", "SELECT symbol, CAST(session AS VARCHAR) AS decision_ts, strategy_id, stage FROM dec")
def stream_decision_sink(x):
    from tapewise.operators.decisions import decision_log
    from tapewise.plans.queries_decide import evaluated
    from tapewise.plans.queries_panel import scratch
    src = scratch(x, "decision_feed")
    decision_log(evaluated(x, ("regime", "vol_bucket")), "run-1", ["close", "atr_14"], "NONE").write.mode("overwrite").parquet(src)
    feed = x.spark.read.parquet(src)
    half = max(1, len(feed.inputFiles()) // 2)  # a few deliveries of any number of files
    out = SO.append_stream(x.spark, src, feed.schema, scratch(x, "decision_out"), scratch(x, "decision_state"), files_per_batch=half)
    return tidy(out.select("symbol", "decision_ts", "strategy_id", "stage"))
