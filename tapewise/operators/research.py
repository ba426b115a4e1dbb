"""Performance, stability and calibration tables of a run's trades and equity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import ratio
from tapewise.functions.stats import deflated_sharpe, student_p, welch, wilson_interval
from tapewise.operators.asof import asof_backward, beside
from tapewise.operators.bootstrap import bootstrap_means, interval
from tapewise.operators.ranking import exact_quantiles, longest_run
from tapewise.params import DAYS_PER_YEAR, HOLDOUT_START, ResearchParams

GROUPS = ("year", "quarter", "regime", "vol_bucket", "direction", "symbol", "cluster", "strategy_id")


def by_time() -> Window:
    return Window.orderBy("ts")  # equity curves hold one row per session


# -- equity ------------------------------------------------------------------------

def with_returns(equity: DataFrame, value: str = "equity", name: str = "ret") -> DataFrame:
    return equity.withColumn(name, ratio(F.col(value), F.lag(value).over(by_time())) - 1.0)


def with_drawdown(equity: DataFrame) -> DataFrame:
    peak = F.max("equity").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    out = equity.withColumn("peak", peak)
    return out.withColumn("drawdown_pct", F.greatest(
        F.lit(0.0), F.coalesce(ratio(F.col("peak") - F.col("equity"), F.col("peak")), F.lit(0.0))))


def longest_underwater(drawdowns: DataFrame) -> DataFrame:
    """Longest span in days between the first and last row of an underwater run."""
    under = F.col("drawdown_pct") > 0
    runs = drawdowns.withColumn("_run", F.sum(F.when(under, 0).otherwise(1)).over(
        by_time().rowsBetween(Window.unboundedPreceding, 0))).where(under)
    span = runs.groupBy("_run").agg(F.datediff(F.max("ts"), F.min("ts")).alias("_d"))
    return span.agg(F.coalesce(F.max("_d"), F.lit(0)).cast("double").alias("max_drawdown_duration_days"))


def _years(lo: Column, hi: Column) -> Column:
    return F.floor((F.unix_timestamp(hi) - F.unix_timestamp(lo)) / 86400) / DAYS_PER_YEAR


def return_risk(equity: DataFrame, p: ResearchParams = ResearchParams()) -> DataFrame:
    """Return, growth, Sharpe, Sortino, drawdown, Calmar and ulcer, one row."""
    e = with_drawdown(with_returns(equity))
    down = F.when(F.col("ret") < 0, F.col("ret")).when(F.col("ret").isNotNull(), 0.0)
    a = e.agg(
        F.min_by("equity", "ts").alias("_a"), F.max_by("equity", "ts").alias("_z"), F.min("ts").alias("_t0"),
        F.max("ts").alias("_t1"), F.count(F.lit(1)).alias("_rows"), F.count("ret").alias("_n"), F.avg("ret").alias("_m"),
        F.stddev_samp("ret").alias("_s"), F.sqrt(F.avg(down * down)).alias("_d"), F.max("drawdown_pct").alias("max_drawdown_pct"),
        F.sqrt(F.avg(F.col("drawdown_pct") * F.col("drawdown_pct"))).alias("ulcer_index"))
    yr = _years(F.col("_t0"), F.col("_t1"))
    root = math.sqrt(p.bars_per_year)
    a = a.withColumn("_y", yr).withColumn("_g", ratio(F.col("_z"), F.col("_a")))
    a = a.withColumn("cagr_pct", F.when((F.col("_y") > 0) & (F.col("_a") > 0), F.pow("_g", 1.0 / F.when(F.col("_y") > 0, F.col("_y"))) - 1.0))
    out = a.select(
        (F.col("_g") - 1.0).alias("total_return_pct"), "cagr_pct",
        F.when(F.col("_n") >= 2, ratio(F.col("_m"), F.col("_s")) * root).alias("sharpe"),
        (ratio(F.col("_m"), F.col("_d")) * root).alias("sortino"), "max_drawdown_pct",
        F.when(F.col("max_drawdown_pct") > 0, F.col("cagr_pct") / F.when(F.col("max_drawdown_pct") > 0, F.col("max_drawdown_pct"))).alias("calmar"),
        "ulcer_index")
    return beside(out, longest_underwater(e))


def monthly_grid(equity: DataFrame) -> DataFrame:
    """Monthly returns, a row per year and a column per month."""
    m = equity.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.max_by("equity", "ts").alias("_e"))
    w = Window.orderBy("year", "month")  # one row per month
    r = m.withColumn("_r", ratio(F.col("_e"), F.lag("_e").over(w)) - 1.0)
    g = r.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("_r"))
    return g.select("year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)])


def equity_with_benchmark(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Equity joined with the benchmark carried forward and rebased, and drawdown."""
    keyed = equity.withColumn("_k", F.lit(1))  # one session row each: the key is constant
    b = benchmark.select("ts", F.col("close").alias("_b")).withColumn("_k", F.lit(1))
    j = asof_backward(keyed, b, ["_k"], "ts", "ts", ["_b"]).drop("_k")
    base = F.first("_b", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return with_drawdown(j.withColumn("benchmark", ratio(F.col("_b"), base)).drop("_b"))


def benchmark_regression(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Slope, annual intercept and its t value of equity on benchmark returns."""
    y = with_returns(equity, name="_y").select("ts", "_y")
    x = with_returns(benchmark.select("ts", "close"), "close", "_x").select("ts", "_x")
    j = y.join(F.broadcast(x), "ts").where("_y is not null and _x is not null")
    a = j.agg(F.regr_count("_y", "_x").alias("n"), F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"),
              F.regr_sxx("_y", "_x").alias("_xx"), F.regr_syy("_y", "_x").alias("_yy"), F.regr_sxy("_y", "_x").alias("_xy"),
              F.avg("_x").alias("_mx"))
    ok = (F.col("n") >= 3) & (F.col("_xx") > 0)
    sse = F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.when(F.col("_xx") > 0, F.col("_xx")), F.lit(0.0))
    mse = sse / F.when(F.col("n") > 2, F.col("n") - 2)
    se = F.sqrt(mse * (1.0 / F.when(F.col("n") > 0, F.col("n")) + F.col("_mx") * F.col("_mx") / F.when(F.col("_xx") > 0, F.col("_xx"))))
    return a.select(F.when(ok, F.col("_b")).alias("beta"), F.when(ok, F.col("_a") * 252.0).alias("alpha_annualised_pct"),
                    F.when(ok, ratio(F.col("_a"), se)).alias("t_alpha"), "n")


def window_returns(equity: DataFrame, p: ResearchParams = ResearchParams(), windows=None) -> DataFrame:
    """Return inside each named window, NULL with fewer than two points."""
    spark = equity.sparkSession
    names = spark.createDataFrame(list(windows or p.crash_windows), "window string, start string, end string")
    names = names.withColumn("_s", F.to_timestamp("start")).withColumn("_e", F.to_timestamp("end"))
    j = equity.select("ts", "equity").join(F.broadcast(names), (F.col("ts") >= F.col("_s")) & (F.col("ts") < F.col("_e")))
    per = j.groupBy("window").agg(F.count(F.lit(1)).alias("_n"), F.min_by("equity", "ts").alias("_a"), F.max_by("equity", "ts").alias("_z"))
    r = F.when(F.col("_n") >= 2, ratio(F.col("_z"), F.col("_a")) - 1.0)
    return names.join(F.broadcast(per), "window", "left").select(
        "window", "start", "end", r.alias("return_pct"), F.coalesce(r < p.crash_return, F.lit(False)).alias("fails_15pct"))


# -- trades ------------------------------------------------------------------------

def group_keys() -> dict[str, Column]:
    """Group labels of a trade; quarters read like 1998Q2."""
    return {"year": F.year("entry_ts").cast("string"),
            "quarter": F.concat(F.year("entry_ts").cast("string"), F.lit("Q"), F.quarter("entry_ts").cast("string")),
            **{c: F.col(c) for c in GROUPS[2:]}}


def group_mean_r(trades: DataFrame, dimensions: tuple[str, ...] = GROUPS) -> DataFrame:
    """n, mean and sum of R for every value of every dimension, in one pass."""
    keys = {k: v for k, v in group_keys().items() if k in dimensions}
    base = trades.where("realised_r is not null").select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("group")) for k, v in keys.items()])).alias("_g"),
        "realised_r").select("_g.*", "realised_r").where(F.col("group").isNotNull())
    return base.groupBy("dimension", "group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("realised_r").alias("mean_r"), F.sum("realised_r").alias("sum_r"))


def pnl_share(trades: DataFrame) -> DataFrame:
    """Share of each symbol in the absolute total of R."""
    per = trades.where("realised_r is not null and symbol is not null").groupBy(F.col("symbol").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("realised_r").alias("mean_r"), F.sum("realised_r").alias("sum_r"))
    total = per.agg(F.sum(F.abs("sum_r")).alias("_t"))
    return beside(per, total).select("group", "n", "mean_r", "sum_r",
                                                            ratio(F.col("sum_r"), F.col("_t")).alias("pnl_share"))


def top_share(trades: DataFrame, n: int = 3) -> DataFrame:
    per = pnl_share(trades).select("group", "sum_r")
    top = per.orderBy(F.col("sum_r").desc(), "group").limit(n).agg(F.sum("sum_r").alias("_top"))
    return beside(per.agg(F.sum("sum_r").alias("_all")), top).select(
        ratio(F.col("_top"), F.col("_all")).alias("top_share"))


def trade_statistics(trades: DataFrame, order: str = "_order") -> DataFrame:
    """The trade metrics, one row. ``order`` (unique) fixes the streak of losses."""
    r = F.col("realised_r")
    one = trades.withColumn("_g", F.lit(1))
    a = one.groupBy("_g").agg(
        F.count("realised_r").alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("avg_win_r"),
        F.avg(F.when(r < 0, r)).alias("avg_loss_r"), F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("std_r"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_w"), F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("_l"),
        F.avg("bars_held").alias("avg_bars_held"), F.avg("mae_r").alias("mae_r_mean"), F.avg("mfe_r").alias("mfe_r_mean"))
    med = exact_quantiles(one.select("_g", "realised_r"), ["_g"], "realised_r", {"median_r": 0.5})
    streak = longest_run(one, ["_g"], order, F.coalesce(r < 0, F.lit(False)), "max_consecutive_losses")
    j = a.join(F.broadcast(med), "_g", "left").join(F.broadcast(streak), "_g", "left")
    factor = F.when(F.col("_l") != 0, F.col("_w") / F.abs(F.when(F.col("_l") != 0, F.col("_l")))).when(
        F.col("_w") > 0, F.lit(float("inf")))
    return j.select(
        F.col("n").cast("double").alias("n_trades"), "win_rate", "avg_win_r", "avg_loss_r", "mean_r", "median_r", "std_r",
        factor.alias("profit_factor"), F.col("mean_r").alias("expectancy_r"),
        ratio(F.col("avg_win_r"), F.abs(F.col("avg_loss_r"))).alias("payoff_ratio"),
        F.col("max_consecutive_losses").cast("double").alias("max_consecutive_losses"), "avg_bars_held", "mae_r_mean", "mfe_r_mean")


def exposed_sessions(trades: DataFrame, equity: DataFrame) -> DataFrame:
    """Number of trades open at each session: +1 at entry, -1 after exit, summed."""
    ups = trades.groupBy(F.col("entry_ts").alias("ts")).agg(F.count(F.lit(1)).alias("_d"), F.lit(0).cast("long").alias("_x"))
    downs = trades.groupBy(F.col("exit_ts").alias("ts")).agg(F.lit(0).cast("long").alias("_d"), F.count(F.lit(1)).alias("_x"))
    marks = equity.select("ts", F.lit(0).cast("long").alias("_d"), F.lit(0).cast("long").alias("_x"), F.lit(1).alias("_m"))
    line = ups.unionByName(downs).withColumn("_m", F.lit(0)).unionByName(marks).groupBy("ts").agg(
        F.sum("_d").alias("_d"), F.sum("_x").alias("_x"), F.max("_m").alias("_m"))
    w = by_time()  # one row per distinct entry, exit or session instant
    held = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(
        F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return line.withColumn("open_trades", held).where("_m = 1").select("ts", "open_trades")


def activity_and_cost(trades: DataFrame, equity: DataFrame) -> DataFrame:
    e = equity.agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.avg("equity").alias("_me"))
    x = exposed_sessions(trades, equity).agg(F.avg((F.col("open_trades") > 0).cast("double")).alias("exposure_pct"))
    t = trades.agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.abs(F.col("qty") * F.col("entry_price")) + F.abs(F.col("qty") * F.col("exit_price"))) * 0.5).alias("_nv"),
        F.sum("fees_usd").alias("total_fees_usd"), F.sum("funding_usd").alias("total_funding_usd"),
        F.sum("borrow_usd").alias("_bw"), F.sum("gross_pnl_usd").alias("_gp"))
    j = beside(beside(t, e), x).withColumn("_y", _years(F.col("_t0"), F.col("_t1")))
    y = F.when(F.col("_y") > 0, F.col("_y"))
    cost = F.col("total_fees_usd") + F.col("total_funding_usd") + F.col("_bw")
    return j.select(
        (F.col("_n") / (y * 12.0)).alias("trades_per_month"), "exposure_pct",
        F.when(F.col("_me") > 0, F.col("_nv") / F.when(F.col("_me") > 0, F.col("_me")) / y).alias("turnover_annual"),
        "total_fees_usd", "total_funding_usd",
        F.when(F.col("_gp") > 0, cost / F.when(F.col("_gp") > 0, F.col("_gp"))).alias("cost_drag_pct"))


def mean_r_interval(trades: DataFrame, row_key: Column, p: ResearchParams = ResearchParams(), keys: list[str] | None = None) -> DataFrame:
    """Bootstrap interval of mean R and the share of replicates at or below zero."""
    if not keys:
        trades, keys = trades.withColumn("_g", F.lit(1)), ["_g"]
    m = bootstrap_means(trades, keys, F.col("realised_r"), row_key, p.bootstrap_iterations, p.bootstrap_seed)
    a = (1.0 - p.confidence) / 2.0
    return m.groupBy(*keys).agg(
        F.percentile("mean", F.lit(a)).alias("mean_r_ci_low"), F.percentile("mean", F.lit(1.0 - a)).alias("mean_r_ci_high"),
        F.avg((F.col("mean") <= 0).cast("double")).alias("p_value_mean_r")).drop("_g")


def sharpe_interval(equity: DataFrame, p: ResearchParams = ResearchParams(), row_key: Column | None = None) -> DataFrame:
    """Bootstrap interval of the annual Sharpe ratio from weighted moments."""
    e = with_returns(equity).where("ret is not null").withColumn("_g", F.lit(1))
    key = F.unix_timestamp("ts") if row_key is None else row_key
    s = bootstrap_means(e, ["_g"], F.col("ret"), key, p.bootstrap_iterations, p.bootstrap_seed, sums_only=True)
    mean = F.col("weighted") / F.col("weight")
    var = (F.col("weighted_sq") - F.col("weighted") * mean) / F.when(F.col("weight") > 1, F.col("weight") - 1)
    s = s.withColumn("_sharpe", ratio(mean, F.sqrt(var)) * math.sqrt(p.bars_per_year))
    return interval(s, ["_g"], "_sharpe", p.confidence, "sharpe_ci_low", "sharpe_ci_high").drop("_g")


def return_moments(equity: DataFrame) -> DataFrame:
    """Per-bar Sharpe, skewness and kurtosis (3 for a normal) of returns."""
    return with_returns(equity).agg(
        F.count("ret").alias("n_obs"), ratio(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe_per_bar"),
        F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3.0).alias("kurtosis"))


def deflated_sharpe_row(moments: DataFrame, n_trials: int) -> DataFrame:
    """The deflated Sharpe ratio of the one-row moments."""
    value = deflated_sharpe(F.col("sharpe_per_bar"), n_trials, F.col("n_obs"), F.col("skew"), F.col("kurtosis"))
    return moments.select(value.alias("deflated_sharpe"), F.lit(float(n_trials)).alias("n_trials"), "sharpe_per_bar")


def run_metrics(trades: DataFrame, equity: DataFrame, row_key: Column, order: str = "_order", n_trials: int = 1,
                p: ResearchParams = ResearchParams()) -> DataFrame:
    """Every metric of a run as one row."""
    parts = [return_risk(equity, p), trade_statistics(trades, order), activity_and_cost(trades, equity),
             mean_r_interval(trades, row_key, p), sharpe_interval(equity, p),
             deflated_sharpe_row(return_moments(equity), n_trials)]
    out = parts[0]
    for part in parts[1:]:
        out = beside(out, part)
    return out


def headline_metrics(trades: DataFrame, equity: DataFrame) -> DataFrame:
    """Total return, drawdown, trades, hit rate, mean R and outcome counts."""
    dd = with_drawdown(equity).agg(
        (ratio(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1.0).alias("total_return_pct"),
        F.max("drawdown_pct").alias("max_drawdown_pct"), F.max_by("equity", "ts").alias("final_equity"))
    n = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("long")
    t = trades.agg(F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("realised_r") > 0).cast("double")).alias("win_rate"),
                   F.avg("realised_r").alias("mean_r"), n("TARGET").alias("n_target"), n("STOP").alias("n_stop"), n("TIME").alias("n_time"))
    return beside(dd, t)


def trades_per_month(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.date_format("entry_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_trades"))


def gap_decomposition(trades: DataFrame) -> DataFrame:
    """How often and how far stopped trades lost more than planned."""
    s = trades.where("outcome = 'STOP' and realised_r is not null").withColumn("_g", F.lit(1))
    r = F.col("realised_r")
    a = s.agg(F.count(F.lit(1)).alias("n_stop"), F.avg(r).alias("mean_r"), F.avg((r < -1.5).cast("double")).alias("frac_below_minus_1_5"))
    q = exact_quantiles(s.select("_g", "realised_r"), ["_g"], "realised_r", {"p05_r": 0.05}).drop("_g")
    return beside(a, q, "left").select("n_stop", "mean_r", "p05_r", "frac_below_minus_1_5")


def bin_realised(bins: DataFrame, trades: DataFrame) -> DataFrame:
    """Realised count and mean R of the trades of each bin."""
    keys = ["strategy_id", "direction", "vol_bucket"]
    got = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("realised_n"), F.avg("realised_r").alias("realised_mean_r"))
    return bins.join(got, keys, "left").withColumn("realised_n", F.coalesce("realised_n", F.lit(0)))


def _shown(x: float, digits: int) -> float:
    """An interval edge as printed: ``digits`` fraction digits after leading zeros."""
    frac, whole = math.modf(x)
    if frac == 0:
        return x
    lead = -math.floor(math.log10(abs(frac))) - 1 if whole == 0 else 0
    return round(x, lead + digits)


def calibration(trades: DataFrame, row_key: Column, n_buckets: int = 10, p: ResearchParams = ResearchParams()) -> DataFrame:
    """Predicted value in quantile buckets against the mean realised R.

    Bucket edges are exact quantiles, equal ones merged, right-closed. Where all predictions
    are equal, they fall back to one bucket of equal width on both sides. They are at
    most ``n_buckets + 1`` numbers, read once; the reported middle uses the edges
    as printed with the fewest digits (three or more) that keep them apart.
    """
    use = trades.where("ev_net_r_at_entry is not null and realised_r is not null").withColumn("_g", F.lit(1)).withColumn("_key", row_key)
    distinct = use.agg(F.countDistinct("ev_net_r_at_entry")).first()[0]
    k = min(n_buckets, max(1, distinct))
    probs = {f"q{i}": i / k for i in range(k + 1)}
    row = exact_quantiles(use.select("_g", "ev_net_r_at_entry"), ["_g"], "ev_net_r_at_entry", probs).first()
    edges = sorted({row[q] for q in probs}) if row else [0.0]
    flat = len(edges) == 1
    if flat:  # a thousandth of the value to each side
        side = 0.001 * abs(edges[0]) or 0.001
        edges = [edges[0] - side, edges[0] + side]
    digits = next((d for d in range(3, 20) if len({_shown(e, d) for e in edges}) == len(edges)), 3)
    shown = [_shown(e, digits) for e in edges]
    if not flat:
        shown[0] -= 10.0 ** -digits
    mids = F.array(*[F.lit(0.5 * (a + b)) for a, b in zip(shown, shown[1:])])
    below = F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("ev_net_r_at_entry"))
    j = use.withColumn("bucket", F.greatest(F.lit(1), F.size(below)))
    base = j.groupBy("bucket").agg(F.avg("realised_r").alias("mean_realised_r"), F.count(F.lit(1)).alias("n"))
    ci = mean_r_interval(j, F.col("_key"), p, ["bucket"]).select(
        "bucket", F.col("mean_r_ci_low").alias("ci_low"), F.col("mean_r_ci_high").alias("ci_high"))
    return base.join(F.broadcast(ci), "bucket").select(  # one row per bucket
        "bucket", F.element_at(mids, F.col("bucket")).alias("predicted_mid"), "mean_realised_r", "ci_low", "ci_high", "n")


def compare_samples(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """Welch t statistic, degrees of freedom and two-sided p-value between flagged and other rows.

    With fewer than two observations on a side, all three are null.
    """
    v, a, b = F.col(value), flag, ~flag
    m = df.agg(F.avg(F.when(a, v)).alias("m1"), F.var_samp(F.when(a, v)).alias("v1"), F.count(F.when(a, v)).alias("n1"),
               F.avg(F.when(b, v)).alias("m2"), F.var_samp(F.when(b, v)).alias("v2"), F.count(F.when(b, v)).alias("n2"))
    t, dof = welch(*[F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2")])
    return m.withColumn("t_stat", t).withColumn("dof", dof).withColumn("p_value", student_p("t_stat", "dof"))


def win_rate_interval(trades: DataFrame, keys: list[str], confidence: float = 0.90) -> DataFrame:
    a = trades.where("realised_r is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("realised_r") > 0).cast("long")).alias("wins"))
    lo, hi = wilson_interval(F.col("wins"), F.col("n"), confidence)
    return a.withColumn("ci_low", lo).withColumn("ci_high", hi)


def split_of(start: Column, end: Column) -> Column:
    """HOLDOUT when a period reaches the reserved years."""
    return F.when((end >= F.lit(HOLDOUT_START).cast("date")) & (start <= end), "HOLDOUT").otherwise("DEVELOPMENT")
