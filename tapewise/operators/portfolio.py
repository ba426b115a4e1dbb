"""Sizing, exposures, greedy allocation at a timestamp, and holding accounting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import MONEY, first_reason, is_true, ratio, round_cents, round_qty, to_decimal
from tapewise.operators.asof import asof_backward, forward_rows
from tapewise.operators.decisions import round_trip_cost
from tapewise.params import BPS, SESSIONS_PER_YEAR, CostParams, PortfolioParams, RiskParams


# -- sizing ----------------------------------------------------------------------

def raw_distance(adj_from: Column, adj_to: Column, raw_price: Column) -> Column:
    """Adjusted-price distance expressed in units of the traded price, exact decimals."""
    ref = to_decimal(adj_from)
    dist = F.abs(ref - to_decimal(adj_to)).cast(MONEY)
    scale = (raw_price / F.when(ref > 0, ref)).cast(MONEY)
    return (dist * scale).cast(MONEY)


def liquidity_multiplier(adv: Column, p: PortfolioParams) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(p.liquidity_min), F.sqrt(adv / p.liquidity_full_adv)))


def heat_multiplier(heat: Column, p: PortfolioParams) -> Column:
    used = heat / p.max_heat
    denom = 1.0 - p.heat_taper_start
    taper = F.lit(p.heat_min) if denom <= 0 else (1.0 - used) / denom
    return F.when(used <= p.heat_taper_start, 1.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(p.heat_min), taper)))


def with_position_size(df: DataFrame, p: PortfolioParams = PortfolioParams(), step: float = 1.0) -> DataFrame:
    """Add qty and actual risk: risk budget, notional and ADV caps, then the step.

    Needs equity, multiplier, reference_price, stop_price, price_raw, adv_usd_60.
    """
    equity, price = to_decimal("equity"), to_decimal("price_raw")
    mult = to_decimal("multiplier")
    risk_usd = round_cents((equity * F.lit(Decimal(str(p.risk_fraction))).cast(MONEY)).cast(MONEY) * mult)
    out = df.withColumn("_risk", risk_usd.cast(MONEY)).withColumn(
        "risk_distance", raw_distance(F.col("reference_price"), F.col("stop_price"), price))
    limits = F.least((equity * F.lit(Decimal(str(p.max_position_notional))).cast(MONEY)).cast(MONEY),
                  to_decimal(F.col("adv_usd_60") * p.max_adv_share))
    cap = F.when(F.col("adv_usd_60").isNotNull(), limits)  # no size without a known ADV
    raw = F.least((F.col("_risk") / F.when(F.col("risk_distance") > 0, F.col("risk_distance"))).cast(MONEY),
                  (cap / F.when(price > 0, price)).cast(MONEY))
    raw = F.when(cap.isNotNull(), raw)
    out = out.withColumn("qty", round_qty(raw, F.lit(Decimal(str(step))).cast(MONEY)))
    return out.withColumn("actual_risk_usd", (F.col("qty") * F.col("risk_distance")).cast(MONEY)).drop("_risk")


# -- exposures --------------------------------------------------------------------

def open_risk(mark: Column) -> Column:
    """Distance from mark to stop times size, never negative."""
    return F.greatest(F.col("sign") * (mark - F.col("stop_price")), F.lit(0.0)) * F.abs(F.col("qty"))


def exposures(positions: DataFrame, equity: DataFrame, keys: list[str]) -> DataFrame:
    """Heat, gross and net beta of each book as shares of equity."""
    risk = open_risk(F.col("entry_price"))
    per = positions.groupBy(*keys).agg(
        F.sum(risk).alias("_risk"), F.sum(F.abs(F.col("qty")) * F.col("entry_price")).alias("_gross"),
        F.sum(F.col("sign") * risk * F.col("beta_bench_90")).alias("_beta"), F.count(F.lit(1)).alias("n_positions"))
    out = equity.join(per, keys, "left")
    eq = F.when(F.col("equity") != 0, F.col("equity"))
    share = lambda c: F.coalesce(F.col(c) / eq, F.lit(0.0))
    peak, start = F.col("peak_equity"), F.col("day_start_equity")
    return out.withColumns({
        "heat_pct": share("_risk"), "gross_pct": share("_gross"), "net_beta_pct": share("_beta"),
        "n_positions": F.coalesce("n_positions", F.lit(0)),
        "drawdown_pct": F.greatest(F.lit(0.0), F.coalesce((peak - F.col("equity")) / F.when(peak > 0, peak), F.lit(0.0))),
        "day_loss_pct": F.greatest(F.lit(0.0), F.coalesce((start - F.col("equity")) / F.when(start > 0, start), F.lit(0.0))),
    }).drop("_risk", "_gross", "_beta")


def cluster_exposures(positions: DataFrame, equity: DataFrame, keys: list[str]) -> DataFrame:
    per = positions.groupBy(*keys, "cluster").agg(
        F.sum(open_risk(F.col("entry_price"))).alias("_risk"), F.count(F.lit(1)).alias("cluster_positions"))
    eq = F.when(F.col("equity") != 0, F.col("equity"))
    return per.join(equity.select(*keys, "equity"), keys).select(
        *keys, "cluster", F.coalesce(F.col("_risk") / eq, F.lit(0.0)).alias("cluster_risk_pct"), "cluster_positions")


def breaker(r: RiskParams) -> Column:
    return (is_true(F.col("day_loss_pct") >= r.max_daily_loss) | is_true(F.col("drawdown_pct") >= r.max_drawdown)
            | is_true(F.col("trades_today") >= r.max_trades_per_day)
            | is_true(F.col("bars_since_breaker") < r.cooldown_bars))


# -- greedy allocation -----------------------------------------------------------

#: The verdict on a candidate.
VERDICT = "rank int, accepted boolean, reason string, qty double, notional_usd double, risk_usd double, size_multiplier double, final_cost_r double"
_VERDICT = [c.split() for c in VERDICT.split(", ")]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _taken(p: PortfolioParams, r: RiskParams, c: CostParams):
    """The step of the fold: (book so far, candidate) to the book with one more verdict."""
    step_equity = lambda x: to_decimal(x["equity"])

    def share(usd: Column, x: Column) -> Column:
        return (usd / step_equity(x)).cast("double")

    def sized(book: Column, x: Column) -> Column:
        """Quantity, size multiplier, and what the position would risk and cost."""
        mult = x["sentiment_multiplier"] * x["liquid"] * heat_multiplier(F.coalesce(share(book["heat"], x), F.lit(0.0)), p)
        budget = round_cents((step_equity(x) * F.lit(Decimal(str(p.risk_fraction))).cast(MONEY)).cast(MONEY) * to_decimal(mult)).cast(MONEY)
        raw = F.least((budget / F.when(x["unit"] > 0, x["unit"])).cast(MONEY), x["most"])
        qty = round_qty(raw, to_decimal(x["step_size"]))
        return F.struct(qty.alias("qty"), (qty * x["unit"]).cast(MONEY).alias("risk"), (qty * to_decimal(x["price_raw"])).cast(MONEY).alias("notional"), mult.alias("mult"))

    def judged(book: Column, x: Column, s: Column) -> Column:
        own = F.filter(book["clusters"], lambda k: k["cluster"].eqNullSafe(x["cluster"]))
        risk_here = F.aggregate(own, F.lit(0).cast(MONEY), lambda t, k: (t + k["risk"]).cast(MONEY))
        beta = (book["beta"] + x["sign"] * s["risk"] * to_decimal(x["beta_bench_90"])).cast(MONEY)
        cost = round_trip_cost(s["notional"].cast("double"), s["risk"].cast("double"), x["expected_bars_held"], x["price_raw"], x["atr_pct"],
                               x["spread_bps_est"], x["adv_usd_60"], x["direction"], c)["cost_r"]
        reason = first_reason([
            (F.lit(not r.trading_enabled), "KILL_SWITCH"),
            (x["tripped"] | (book["trades"] >= r.max_trades_per_day), "CIRCUIT_BREAKER"),
            (x["in_position"] | F.array_contains(book["symbols"], x["symbol"]), "ALREADY_IN_POSITION"),
            (book["count"] >= p.max_positions, "MAX_POSITIONS"),
            (x["sentiment_multiplier"] <= 0, "SENTIMENT_VETO"),
            (~is_true(s["qty"] > 0) | (s["notional"] < to_decimal(x["min_notional_usd"])), "SIZE_BELOW_MIN_NOTIONAL"),
            (share((book["heat"] + s["risk"]).cast(MONEY), x) > p.max_heat, "PORTFOLIO_HEAT_CAP"),
            ((share((to_decimal(x["cluster_usd"]) + risk_here + s["risk"]).cast(MONEY), x) > p.max_cluster_risk)
             | (x["cluster_positions"] + F.size(own) + 1 > p.max_per_cluster), "CLUSTER_CAP"),
            (F.abs(share(beta, x)) > p.max_net_beta, "BETA_CAP"),
            (share((book["gross"] + s["notional"]).cast(MONEY), x) > p.max_gross, "GROSS_EXPOSURE_CAP"),
            (~is_true(x["ev_r_lcb"] - cost >= p.min_ev_net_r), "BELOW_EV_THRESHOLD"),
        ])
        return F.struct(reason.alias("reason"), beta.alias("beta"), cost.alias("cost"))

    def add(book: Column, x: Column) -> Column:
        def verdict(s: Column) -> Column:
            def after(j: Column) -> Column:
                yes = j["reason"].isNull()
                own = [x["rank"], yes, j["reason"], *[F.when(yes, v.cast("double")) for v in (s["qty"], s["notional"], s["risk"], s["mult"], j["cost"])]]
                out = F.struct(*[v.cast(t).alias(n) for v, (n, t) in zip(own, _VERDICT)])
                one = F.when(yes, 1).otherwise(0)
                return F.struct(
                    F.when(yes, (book["heat"] + s["risk"]).cast(MONEY)).otherwise(book["heat"]).alias("heat"),
                    F.when(yes, (book["gross"] + s["notional"]).cast(MONEY)).otherwise(book["gross"]).alias("gross"),
                    F.when(yes, j["beta"]).otherwise(book["beta"]).alias("beta"),
                    (book["trades"] + one).cast("long").alias("trades"), (book["count"] + one).cast("long").alias("count"),
                    F.when(yes, F.concat(book["symbols"], F.array(x["symbol"]))).otherwise(book["symbols"]).alias("symbols"),
                    F.when(yes, F.concat(book["clusters"], F.array(F.struct(x["cluster"].alias("cluster"), s["risk"].alias("risk"))))).otherwise(
                        book["clusters"]).alias("clusters"),
                    F.concat(book["verdicts"], F.array(out)).alias("verdicts"))
            return _let(judged(book, x, s), after)
        return _let(sized(book, x), verdict)

    return add


def _fold(head: DataFrame, keys: list[str], p: PortfolioParams, r: RiskParams, c: CostParams) -> DataFrame:
    """Verdicts on each book's few best candidates, each seeing those before it.

    A book's candidates (at most ``top_n``) are one short sorted array, folded with the book
    as the accumulator: what it risks, holds and has judged so far.
    """
    price = to_decimal("price_raw")
    cap = F.least((to_decimal("equity") * F.lit(Decimal(str(p.max_position_notional))).cast(MONEY)).cast(MONEY), to_decimal(F.col("adv_usd_60") * p.max_adv_share))
    rows = head.withColumns({
        "unit": raw_distance(F.col("reference_price"), F.col("stop_price"), price),
        "most": F.when(F.col("adv_usd_60").isNotNull(), (cap / F.when(price > 0, price)).cast(MONEY)),  # no size without a known ADV
        "liquid": liquidity_multiplier(F.col("adv_usd_60"), p),
        "sign": F.when(F.col("direction") == "LONG", 1).otherwise(-1),
    })
    columns = ["rank", *[x for x in rows.columns if x not in ("rank", *keys)]]
    books = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_c"))
    first = F.col("_c")[0]
    empty = F.from_json(F.lit('{"s": [], "k": [], "v": []}'), f"s array<string>, k array<struct<cluster: string, risk: decimal(38,12)>>, v array<struct<{', '.join(f'{n}: {t}' for n, t in _VERDICT)}>>")
    zero = F.struct(
        to_decimal(first["heat_usd"]).alias("heat"), to_decimal(first["gross_usd"]).alias("gross"), to_decimal(first["beta_usd"]).alias("beta"),
        first["trades_today"].cast("long").alias("trades"), first["n_positions"].cast("long").alias("count"),
        empty["s"].alias("symbols"), empty["k"].alias("clusters"), empty["v"].alias("verdicts"))
    return books.select(*keys, F.explode(F.aggregate("_c", zero, _taken(p, r, c))["verdicts"]).alias("_v")).select(*keys, "_v.*")


def allocate(ranked: DataFrame, books: DataFrame, positions: DataFrame, keys: list[str],
             p: PortfolioParams = PortfolioParams(), r: RiskParams = RiskParams(), c: CostParams = CostParams()) -> DataFrame:
    """Walk each book's ranked candidates; every candidate gets one verdict.

    Only candidates ranked within ``top_n`` can be taken, so only those (top_n rows
    per book, whatever the number of candidates) go through the sequential step.
    The books they start from are aggregated beforehand, and the rest are judged
    by columns against the book they leave behind.
    """
    risk = open_risk(F.col("entry_price"))
    per = positions.groupBy(*keys).agg(
        F.sum(risk).alias("heat_usd"), F.sum(F.abs(F.col("qty")) * F.col("entry_price")).alias("gross_usd"),
        F.sum(F.col("sign") * risk * F.col("beta_bench_90")).alias("beta_usd"), F.count(F.lit(1)).alias("n_positions"))
    clusters = positions.groupBy(*keys, "cluster").agg(
        F.sum(risk).alias("cluster_usd"), F.count(F.lit(1)).alias("cluster_positions"))
    held = positions.select(*keys, "symbol").distinct().withColumn("in_position", F.lit(True))
    state = books.join(per, keys, "left").fillna(
        {"heat_usd": 0.0, "gross_usd": 0.0, "beta_usd": 0.0, "n_positions": 0})
    eq, peak, start = F.col("equity"), F.col("peak_equity"), F.col("day_start_equity")
    state = state.withColumns({
        "drawdown_pct": F.greatest(F.lit(0.0), F.coalesce((peak - eq) / F.when(peak > 0, peak), F.lit(0.0))),
        "day_loss_pct": F.greatest(F.lit(0.0), F.coalesce((start - eq) / F.when(start > 0, start), F.lit(0.0))),
    }).withColumn("tripped", breaker(r))
    rows = ranked.join(state, keys).join(clusters, [*keys, "cluster"], "left").join(held, [*keys, "symbol"], "left").fillna(
        {"cluster_usd": 0.0, "cluster_positions": 0, "in_position": False})
    head = rows.where(F.col("rank") <= p.top_n)
    verdicts = _fold(head, keys, p, r, c)
    took = head.select(*keys, "rank", "symbol").join(verdicts.where("accepted").select(*keys, "rank"), [*keys, "rank"])
    after = took.groupBy(*keys).agg(F.count(F.lit(1)).alias("_new"), F.collect_set("symbol").alias("_took"))  # <= top_n
    tail = rows.where(F.col("rank") > p.top_n).join(after, keys, "left")
    new = F.coalesce("_new", F.lit(0))
    tail_reason = first_reason([
        (F.lit(not r.trading_enabled), "KILL_SWITCH"),
        (F.col("tripped") | (F.col("trades_today") + new >= r.max_trades_per_day), "CIRCUIT_BREAKER"),
        (F.col("in_position") | F.array_contains("_took", F.col("symbol")), "ALREADY_IN_POSITION"),
        (F.col("n_positions") + new >= p.max_positions, "MAX_POSITIONS"),
    ], F.lit("BELOW_TOP_N"))
    tail = tail.select(*keys, "rank", F.lit(False).alias("accepted"), tail_reason.alias("reason"),
                       *[F.lit(None).cast("double").alias(n) for n, _ in _VERDICT[3:]])
    return ranked.join(verdicts.unionByName(tail), [*keys, "rank"])


# -- holdings ---------------------------------------------------------------------

def raw_scale() -> Column:
    """Traded over adjusted close; 1 when the adjusted close is unusable."""
    return F.coalesce(ratio(F.col("close_raw"), F.col("close")), F.lit(1.0))


def entry_fill(open_: Column, sign: Column, slip_bps: Column) -> Column:
    return open_ * (1.0 + sign * slip_bps / BPS)


def stop_fill(open_: Column, stop: Column, sign: Column) -> Column:
    """A gap through the stop fills at the worse of the two."""
    return F.when(sign > 0, F.least(open_, stop)).otherwise(F.greatest(open_, stop))


def commission(qty: Column, price: Column, c: CostParams) -> Column:
    return F.least(F.greatest(qty * c.commission_per_share, F.lit(c.commission_min)),
                   qty * price * c.commission_max_share) * c.multiplier


def holding_sessions(trades: DataFrame, bars: DataFrame, max_hold: int) -> DataFrame:
    """Each trade's own bars after entry up to its exit (row numbers, no pairs beyond)."""
    return forward_rows(trades, bars, "asset_id", "entry_rn", F.col("bars_held"), max_hold,
                        ["ts", "session", "high", "low", "close", "close_raw"])


def trade_pnl(trades: DataFrame, bars: DataFrame, actions: DataFrame, max_hold: int, borrow_bps: float = 30.0,
              c: CostParams = CostParams()) -> DataFrame:
    """Money result of closed trades from bars and actions.

    Splits while held scale the size and divide the prices; dividends are signed by
    side; shorts pay borrow on each session's close. Needs trade_id, asset_id,
    sign, qty, entry_price, stop_price, exit_price (at exit-day scale), entry_rn,
    bars_held.
    """
    held = holding_sessions(trades, bars, max_hold)
    day = actions.groupBy("asset_id", F.col("ex_date").alias("fwd_session")).agg(
        F.product(F.when((F.col("action_type") == "SPLIT") & (F.col("split_ratio") > 0), F.col("split_ratio"))
                  .otherwise(1.0)).alias("_split"),
        F.sum(F.when(F.col("action_type") == "DIVIDEND", F.col("cash_amount")).otherwise(0.0)).alias("_cash"))
    held = held.join(day, ["asset_id", "fwd_session"], "left")
    w = Window.partitionBy("trade_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # <= max_hold rows
    held = held.withColumn("_units", F.col("qty") * F.product(F.coalesce("_split", F.lit(1.0))).over(w))
    scale = F.coalesce(ratio(F.col("fwd_close_raw"), F.col("fwd_close")), F.lit(1.0))
    risk = F.abs(F.col("entry_price") - F.col("stop_price"))
    per_unit = F.col("qty") / F.col("_units")  # prices shrink as the size grows
    hi = F.col("sign") * (F.col("fwd_high") * scale / per_unit - F.col("entry_price")) / F.when(risk > 0, risk)
    lo = F.col("sign") * (F.col("fwd_low") * scale / per_unit - F.col("entry_price")) / F.when(risk > 0, risk)
    sums = held.groupBy("trade_id").agg(
        F.sum(F.col("sign") * F.col("_units") * F.coalesce("_cash", F.lit(0.0))).alias("dividends_usd"),
        F.sum(F.when(F.col("sign") < 0, F.col("_units") * F.col("fwd_close_raw") * borrow_bps / BPS / SESSIONS_PER_YEAR)
              .otherwise(0.0)).alias("borrow_usd"),
        F.max_by("_units", "step").alias("exit_qty"),
        F.min(F.least(hi, lo)).alias("_worst"), F.max(F.greatest(hi, lo)).alias("_best"))
    out = trades.join(sums, "trade_id")
    grown = F.col("exit_qty") / F.col("qty")
    gross = F.col("sign") * (F.col("exit_price") - F.col("entry_price") / grown) * F.col("exit_qty")
    fees = commission(F.col("qty"), F.col("entry_price"), c) + commission(F.col("exit_qty"), F.col("exit_price"), c)
    out = out.withColumn("gross_pnl_usd", gross).withColumn("fees_usd", fees).withColumn(
        "net_pnl_usd", F.col("gross_pnl_usd") - F.col("fees_usd") - F.col("borrow_usd") + F.col("dividends_usd"))
    return out.withColumn("realised_r", ratio(F.col("net_pnl_usd"), risk * F.col("qty"))).withColumn(
        "mae_r", F.least(F.lit(0.0), F.col("_worst"))).withColumn("mfe_r", F.greatest(F.lit(0.0), F.col("_best"))).drop(
        "_worst", "_best")


def mark_to_market(trades: DataFrame, sessions: DataFrame, bars: DataFrame, initial: float, max_hold: int) -> DataFrame:
    """Equity per session: cash plus signed size times the last known close.

    A position contributes at its own bars while open and its cash flows at entry
    and exit; everything is summed per session before it is ordered.
    """
    held = holding_sessions(trades, bars, max_hold)
    entry_cash = held.where("step = 1").select(
        F.col("fwd_session").alias("session"), (-F.col("sign") * F.col("qty") * F.col("entry_price")).alias("cash"))
    exit_cash = held.where(F.col("step") == F.col("bars_held")).select(
        F.col("fwd_session").alias("session"), (F.col("sign") * F.col("qty") * F.col("exit_price")).alias("cash"))
    cash = entry_cash.unionByName(exit_cash).groupBy("session").agg(F.sum("cash").alias("cash"))
    # carry each open position over sessions its asset did not trade
    spans = held.where(F.col("step") < F.col("bars_held")).withColumn("_next", F.lead("fwd_session").over(
        Window.partitionBy("trade_id").orderBy("step")))
    last = held.where(F.col("step") == F.col("bars_held")).select("trade_id", F.col("fwd_session").alias("_exit"))
    spans = spans.join(last, "trade_id").select(
        F.col("fwd_session").alias("_from"), F.coalesce("_next", "_exit").alias("_to"),
        (F.col("sign") * F.col("qty") * F.col("fwd_close_raw")).alias("value"))
    moves = spans.select(F.col("_from").alias("session"), "value").unionByName(
        spans.select(F.col("_to").alias("session"), (-F.col("value")).alias("value"))).groupBy("session").agg(
        F.sum("value").alias("moved"))
    line = sessions.select("session").join(F.broadcast(cash), "session", "left").join(F.broadcast(moves), "session", "left")
    w = Window.orderBy("session")  # bounded: one row per trading session
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn("cash", F.lit(initial) + F.coalesce(F.sum("cash").over(run), F.lit(0.0))).withColumn(
        "unrealised", F.coalesce(F.sum("moved").over(run), F.lit(0.0)))
    out = out.withColumn("equity", F.col("cash") + F.col("unrealised"))
    return out.withColumn("peak_equity", F.greatest(F.lit(initial), F.max("equity").over(run))).withColumn(
        "day_start_equity", F.coalesce(F.lag("equity").over(w), F.lit(initial))).withColumn(
        "day_pnl", F.col("equity") - F.col("day_start_equity"))


def last_marks(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Newest traded close at or before each position's mark timestamp."""
    return asof_backward(positions, bars.select("asset_id", "ts", "close_raw"), ["asset_id"], "ts", "ts", ["close_raw"])
