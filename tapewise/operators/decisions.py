"""Decision candidates: gates, detection, bin lookup, cost, expected value, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.functions.exprs import first_reason, is_true, present, ratio
from tapewise.operators.edge import BIN, edge_at, usable_bin
from tapewise.operators.labels import with_earnings_flag
from tapewise.operators.ranking import with_position
from tapewise.operators.setups import market_allows, regime_allows, setup_of
from tapewise.params import BPS, SESSIONS_PER_YEAR, CostParams, EdgeParams, GateParams, PortfolioParams
from tapewise.session import broadcast_rows, staged

# The stage each rejection reason belongs to; the rest is GATE.
STAGE_OF = {
    "INSUFFICIENT_BIN_SAMPLES": "EDGE", "COST_UNAVAILABLE": "EDGE", "BELOW_EV_THRESHOLD": "RANK",
    "NO_SETUP": "STRATEGY", "ALREADY_IN_POSITION": "PORTFOLIO", "PORTFOLIO_HEAT_CAP": "PORTFOLIO",
    "CLUSTER_CAP": "PORTFOLIO", "BETA_CAP": "PORTFOLIO", "GROSS_EXPOSURE_CAP": "PORTFOLIO",
    "MAX_POSITIONS": "PORTFOLIO", "BELOW_TOP_N": "PORTFOLIO", "SENTIMENT_VETO": "PORTFOLIO",
    "KILL_SWITCH": "PORTFOLIO", "CIRCUIT_BREAKER": "PORTFOLIO", "SIZE_BELOW_MIN_NOTIONAL": "SIZE",
}
COST_PARTS = ("entry_fee_bps", "exit_fee_bps", "spread_bps", "slippage_bps", "impact_bps", "funding_bps")
# The decision log contract, in order.
DECISION_COLUMNS = (
    "run_id", "decision_ts", "symbol", "strategy_id", "stage", "accepted", "rejection_reason", "direction", "regime",
    "vol_bucket", "reference_price", "stop_price", "target_price", "reward_risk_ratio", "bin_key", "bin_n",
    "ev_r_point", "ev_r_lcb", "cost_r", "ev_net_r", "ev_per_bar_r", "rank", "sentiment_score",
    "sentiment_confidence", "sentiment_multiplier", "portfolio_heat_pct", "cluster", "size_multiplier", "qty",
    "notional_usd", "adv_usd_30", "spread_bps_est", "features_json",
)


def round_trip_cost(notional: Column, risk_capital: Column, hold: Column, price_raw: Column, atr_pct: Column,
                    spread: Column, adv: Column, direction: Column, p: CostParams = CostParams()) -> dict[str, Column]:
    """Cost components in bps of notional, their total, and the cost in R."""
    if p.multiplier < 1.0:
        raise ValueError("the cost multiplier must be at least 1")
    n = F.when(notional != 0, notional)
    shares = ratio(notional, price_raw)
    side = F.least(F.greatest(shares * p.commission_per_share, F.lit(p.commission_min)), notional * p.commission_max_share)
    fee = side / n * BPS
    years = hold / float(SESSIONS_PER_YEAR)
    carry = p.borrow_bps_per_year * years + p.dividend_yield * BPS * years
    parts = {
        "entry_fee_bps": fee, "exit_fee_bps": fee,
        "spread_bps": F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0)) * 2.0),
        "slippage_bps": (atr_pct * p.slippage_vol_coef * BPS + p.slippage_fixed_bps) * 2.0,
        "impact_bps": F.when(adv.isNotNull(), atr_pct * p.impact_coef * BPS
                             * F.sqrt(notional / F.greatest(adv, F.lit(p.min_adv)))),
        "funding_bps": F.when(direction == "SHORT", carry).otherwise(0.0),
    }
    parts = {k: v * p.multiplier for k, v in parts.items()}
    total = parts["entry_fee_bps"]
    for k in COST_PARTS[1:]:
        total = total + parts[k]
    usd = total / BPS * notional
    return {**parts, "total_bps": total, "cost_usd": usd, "cost_r": ratio(usd, risk_capital)}


def valid_cost() -> Column:
    """Finite components, none negative but funding, and a positive cost."""
    ok = is_true(F.col("cost_r") > 0) & present("cost_r") & present("total_bps")
    for c in COST_PARTS:
        ok = ok & present(c)
        if c != "funding_bps":
            ok = ok & is_true(F.col(c) >= 0)
    return ok


def expected_value(lcb: Column, cost_r: Column, mean_hold: Column) -> tuple[Column, Column]:
    net = lcb - cost_r
    return net, net / F.greatest(mean_hold, F.lit(1.0))


def gate_reason(g: GateParams, min_gap: int, earnings: Column, direction: Column | None = None,
                borrow_bps: Column | None = None, bar_age: Column | None = None) -> Column:
    """First failing decision gate, NULL when all pass."""
    if g.require_universe:
        out = F.when(F.col("universe_reason").isNull(), "NOT_IN_UNIVERSE").when(
            F.col("universe_reason") != "", F.col("universe_reason"))
    else:
        out = F.when(F.lit(False), F.lit(""))
    if g.require_warm:
        out = out.when(~is_true(F.col("is_warm")), "INSUFFICIENT_HISTORY")
    else:
        out = out.when(F.col("is_warm").isNull(), "INSUFFICIENT_HISTORY")  # no feature row at all
    out = out.when(F.col("bars_since_gap") < min_gap, "DATA_GAP")
    if bar_age is not None:
        out = out.when(is_true(bar_age > g.max_staleness_bars), "STALE_DATA")
    out = out.when(F.col("xs_population") < g.min_xs_population, "THIN_CROSS_SECTION").when(earnings, "EARNINGS_IN_WINDOW")
    if not g.skip_hard_to_borrow and direction is not None and borrow_bps is not None:
        out = out.when(is_true((direction == "SHORT") & (borrow_bps > g.hard_to_borrow_max_bps)), "HARD_TO_BORROW")
    return out


def snapshot_rows(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every snapshot entry at every session it is in force for.

    A session maps to one snapshot (a calendar-sized table), which its entries
    are then unpacked from by an equi join.
    """
    stamps = snapshots.select(F.col("ts").alias("stamp")).distinct()
    points = stamps.agg(F.array_sort(F.collect_list("stamp")).alias("_p")).withColumn("_one", F.lit(1))
    cal = calendar.select(F.col("close_utc").alias("ts"), "session_index").withColumn("_one", F.lit(1)).join(
        F.broadcast(points), "_one").withColumn(
        "stamp", F.try_element_at(F.filter("_p", lambda s: s <= F.col("ts")), F.lit(-1))).drop("_p", "_one")
    entries = snapshots.select(F.col("ts").alias("stamp"), "asset_id", "symbol", F.col("reason").alias("universe_reason"),
                               "adv_usd_60", "spread_bps_est")
    return entries.join(F.broadcast(cal.where("stamp is not null")), "stamp")


def evaluate(features: DataFrame, snapshots: DataFrame, calendar: DataFrame, strategies: list, edge: DataFrame,
             events: DataFrame, assets: DataFrame, equity: Column, g: GateParams = GateParams(),
             costs: CostParams = CostParams(), edge_params: EdgeParams = EdgeParams(),
             book: PortfolioParams = PortfolioParams(), min_gap: int = 10,
             warmups: dict[str, int] | None = None) -> DataFrame:
    """One row per (session, snapshot entry, strategy) with exactly one reason.

    ``reason`` is NULL for an opportunity. ``equity`` is a column (a literal or an
    input), so all sessions are evaluated at once.

    The universe gate is judged on the snapshot entries alone, the other gates that don't
    depend on the strategy on the rest with their features, which are written once. An entry that fails
    there gives its rows without more work; only the others are unpacked by strategy, looked
    up in the earnings windows and the bins, and of these only rows with a setup that may
    trade are priced. A caller that needs few columns of the entries outside the universe takes the parts.
    """
    inside, outside = universe_split(snapshot_rows(snapshots, calendar), assets, equity, g, book)
    judged = evaluate_entries(inside, features, calendar, strategies, edge, events, assets, g, costs, edge_params, book, min_gap, warmups)
    return judged.unionByName(stopped_at_universe(outside, strategies, features), allowMissingColumns=True)


def universe_split(entries: DataFrame, assets: DataFrame, equity: Column, g: GateParams, book: PortfolioParams) -> tuple[DataFrame, DataFrame]:
    """The entries that pass the universe gate, which comes first and needs no features, and the others."""
    entries = entries.join(assets.select("asset_id", "cluster", "is_etf"), "asset_id", "left").withColumn("risk_capital", equity * book.risk_fraction)
    passed = is_true(F.col("universe_reason") == "") if g.require_universe else F.lit(True)
    return entries.where(passed), entries.where(~passed)


def unpacked(entries: DataFrame, strategies: list) -> DataFrame:
    """A row for each entry and strategy."""
    names = F.array(*[F.struct(F.lit(s.strategy_id).alias("strategy_id"), F.lit(s.max_hold_bars).alias("max_hold_bars")) for s in strategies])
    return entries.withColumn("_opt", F.explode(names)).select("*", "_opt.*").drop("_opt")


def stopped_at_universe(outside: DataFrame, strategies: list, features: DataFrame | None = None) -> DataFrame:
    """Rows of the entries that the universe gate stops, beside those columns of their features that are asked for."""
    if features is not None:
        outside = outside.join(features.drop("symbol", "session_index", "eligible"), ["asset_id", "ts"], "left")
    rows = unpacked(outside.withColumn("reason", F.coalesce("universe_reason", F.lit("NOT_IN_UNIVERSE"))), strategies)
    return rows.withColumn("stage", stage_of(F.col("reason")))


#: Entries up to which their keys are sent to the features instead of the features to them.
KEYS_SENT = 1_000_000


def evaluate_entries(inside: DataFrame, features: DataFrame, calendar: DataFrame, strategies: list, edge: DataFrame,
                     events: DataFrame, assets: DataFrame, g: GateParams = GateParams(), costs: CostParams = CostParams(),
                     edge_params: EdgeParams = EdgeParams(), book: PortfolioParams = PortfolioParams(), min_gap: int = 10,
                     warmups: dict[str, int] | None = None) -> DataFrame:
    """The rows of the entries that pass the universe gate; see :func:`evaluate`."""
    inside = staged(inside)  # read by the key filter and the join
    keys = broadcast_rows(inside.select("asset_id", "ts"), KEYS_SENT)
    feats = features.drop("symbol", "session_index", "eligible").join(keys, ["asset_id", "ts"], "left_semi")
    entries = inside.join(feats, ["asset_id", "ts"], "left")
    entries = staged(entries.withColumn("_gate", gate_reason(g, min_gap, F.lit(False))))
    stopped = unpacked(entries.where("_gate is not null"), strategies)
    stopped = stopped.withColumnRenamed("_gate", "reason").withColumn("stage", stage_of(F.col("reason")))
    need = warmups or {s.strategy_id: s.warmup_bars for s in strategies}
    options = F.array(*[F.struct(
        F.lit(s.strategy_id).alias("strategy_id"), F.lit(s.max_hold_bars).alias("max_hold_bars"),
        F.lit(need[s.strategy_id]).alias("_need"), market_allows(s).alias("_market"), regime_allows(s).alias("_regime"),
        setup_of(s).alias("_setup")) for s in strategies])
    rows = entries.where("_gate is null").drop("_gate").withColumn("_opt", F.explode(options)).select("*", "_opt.*").drop("_opt")
    rows = with_earnings_flag(rows, events, calendar, assets.select("asset_id", "is_etf"),
                              [s.max_hold_bars for s in strategies], "_earnings")
    first = first_reason([
        (F.col("_earnings"), "EARNINGS_IN_WINDOW"),
        (~present("atr_14") | (F.col("atr_14") <= 0) | (F.col("bars_available") < F.col("_need")), "INSUFFICIENT_HISTORY"),
        (~F.col("_market") if g.require_regime else F.lit(False), "MARKET_REGIME_BLOCKED"),
        (~F.col("_regime") if g.require_regime else F.lit(False), "REGIME_BLOCKED"),
        (F.col("_setup").isNull(), "NO_SETUP"),
        (F.lit(not g.skip_hard_to_borrow) & (F.col("_setup.direction") == "SHORT")
         & F.lit(costs.borrow_bps_per_year > g.hard_to_borrow_max_bps), "HARD_TO_BORROW"),
    ])
    rows = rows.withColumn("_first", first)
    going = F.col("_first").isNull()
    rows = rows.withColumns({c: F.when(going, F.col(f"_setup.{c}")) for c in
                             ("direction", "sign", "reference_price", "stop_price", "target_price")})
    rows = edge_at(rows, edge)
    risk = F.abs(F.col("reference_price") - F.col("stop_price"))
    rows = rows.withColumns({
        "risk_per_unit": risk,
        "reward_risk_ratio": ratio(F.abs(F.col("target_price") - F.col("reference_price")), risk),
        "notional": ratio(F.col("risk_capital"), risk) * F.col("reference_price"),
        "expected_bars_held": F.greatest(F.col("bin_mean_bars_held"), F.lit(1.0)),
    })
    parts = round_trip_cost(
        F.col("notional"), F.col("risk_capital"), F.col("expected_bars_held"), F.col("close_raw"), F.col("atr_pct"),
        F.col("spread_bps_est"), F.col("adv_usd_60"), F.col("direction"), costs)
    rows = rows.withColumns({c: F.when(going, v) for c, v in parts.items()})
    net, per_bar = expected_value(F.col("bin_ev_r_lcb"), F.col("cost_r"), F.col("bin_mean_bars_held"))
    rows = rows.withColumns({"ev_net_r": net, "ev_per_bar_r": per_bar})
    rows = rows.withColumn("reason", F.coalesce("_first", first_reason([
        (~usable_bin(edge_params, "bin_"), "INSUFFICIENT_BIN_SAMPLES"),
        (~is_true(F.col("close_raw") > 0) | F.col("cluster").isNull() | ~is_true(F.col("risk_capital") > 0)
         | ~is_true(F.col("risk_per_unit") > 0) | ~valid_cost(), "COST_UNAVAILABLE"),
        (~is_true(F.col("ev_net_r") >= book.min_ev_net_r), "BELOW_EV_THRESHOLD"),
    ])))
    priced = F.col("reason").isNull() | (F.col("reason") == "BELOW_EV_THRESHOLD")
    rows = rows.withColumns({
        **{c: F.when(priced, F.col(c)) for c in ("cost_r", "ev_net_r", "ev_per_bar_r")},
        "stage": stage_of(F.col("reason")),
        "bin_key": F.when(F.col("direction").isNotNull(), F.concat_ws("|", *BIN)),
    })
    return rows.drop("_need", "_market", "_regime", "_setup", "_earnings", "_first").unionByName(stopped, allowMissingColumns=True)


def stage_of(reason: Column) -> Column:
    out = F.when(reason.isNull(), "ACCEPTED")
    for stage in ("EDGE", "RANK", "STRATEGY", "PORTFOLIO", "SIZE"):
        out = out.when(reason.isin(*[r for r, s in STAGE_OF.items() if s == stage]), stage)
    return out.otherwise("GATE")


def rank_opportunities(candidates: DataFrame, min_ev: float, keys: list[str] | None = None) -> DataFrame:
    """Keep enough expected value; rank by value per bar, then symbol, strategy."""
    keys = keys or ["ts"]
    kept = candidates.where(F.col("ev_net_r") >= min_ev)
    order = F.struct((-F.col("ev_per_bar_r")).alias("neg"), "symbol", "strategy_id")
    return with_position(kept.withColumn("_ord", order), keys, "_ord", name="rank").drop("_ord", "group_rows").withColumn(
        "rank", F.col("rank").cast("int"))


def below_top_n(top_n: int) -> Column:
    return F.when(F.col("rank") > top_n, "BELOW_TOP_N")


def funnel(decisions: DataFrame) -> DataFrame:
    """Considered candidates by rejection reason, plus the accepted remainder."""
    rejected = F.col("reason").isNotNull()
    return decisions.groupBy(
        F.when(rejected, "REJECT").otherwise("ACCEPTED").alias("stage"),
        F.coalesce("reason", F.lit("")).alias("rejection_reason")).agg(F.count(F.lit(1)).alias("n"))


def features_json(columns: list[str], policy: str, stage: Column) -> Column:
    """Compact JSON of the feature row where the policy asks for it."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    wanted = {"NONE": F.lit(False), "ALL": F.lit(True), "ACCEPTED": stage == "ACCEPTED",
              "ACCEPTED_AND_RANKED": stage.isin("ACCEPTED", "EDGE", "RANK")}[policy]
    return F.when(wanted, body)


def decision_log(decisions: DataFrame, run_id: str, feature_columns: list[str], policy: str = "ACCEPTED_AND_RANKED") -> DataFrame:
    """Project evaluated rows to the fixed log contract; absent columns are typed NULLs."""
    text = {"run_id", "symbol", "strategy_id", "stage", "rejection_reason", "direction", "regime", "vol_bucket",
            "bin_key", "cluster", "features_json"}
    have = {
        "run_id": F.lit(run_id), "decision_ts": F.col("ts"), "rejection_reason": F.col("reason"),
        "accepted": F.col("reason").isNull(), "ev_r_point": F.col("bin_mean_r"), "ev_r_lcb": F.col("bin_ev_r_lcb"),
        "adv_usd_30": F.col("adv_usd_60"), "features_json": features_json(feature_columns, policy, F.col("stage")),
    }
    out = []
    for c in DECISION_COLUMNS:
        kind = "string" if c in text else "boolean" if c == "accepted" else "timestamp" if c == "decision_ts" else "double"
        v = have.get(c, F.col(c) if c in decisions.columns else F.lit(None))
        out.append(v.cast(kind).alias(c))
    return decisions.select(*out)
