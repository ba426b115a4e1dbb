"""Triple-barrier outcomes of setups, earnings overlap, and the label table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import is_true, present
from tapewise.operators.asof import asof_backward, next_on_or_after
from tapewise.operators.indicators import over_asset, with_bar_number
from tapewise.operators.setups import detect_setups
from tapewise.params import EARNINGS_BAND
from tapewise.session import staged

# The label contract, in order.
LABEL_COLUMNS = (
    "asset_id", "symbol", "setup_ts", "entry_ts", "resolution_ts", "strategy_id", "direction", "regime",
    "market_regime", "vol_bucket", "reference_price", "entry_price", "stop_price", "exit_price", "target_price",
    "risk_per_unit", "reward_risk_ratio", "entry_gap_atr", "outcome", "bars_held", "realised_r_gross", "mae_r",
    "mfe_r", "atr_pct", "efficiency_ratio_20", "beta_bench_90", "adv_usd_60", "mom_252_xs_pct",
    "overnight_var_share_60", "xs_population", "had_earnings_in_window",
)
KEY = ["asset_id", "ts", "strategy_id", "direction"]


#: Bars of a block.
BLOCK_BARS = 16


def bar_blocks(line: DataFrame, ahead: int, size: int = BLOCK_BARS) -> DataFrame:
    """One row per (asset, block of ``size`` bars): its bars, and the extremes of the ``ahead`` blocks that follow."""
    per = line.withColumn("_blk", F.floor(F.col("_rn") / size)).groupBy("asset_id", "_blk").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_rn").alias("rn"), "ts", "open", "high", "low", "close"))).alias("_bars"),
        F.max("_rn").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min(F.least("open", "low")).alias("dip"), F.max(F.greatest("open", "high")).alias("peak"),
        F.min(F.least("high", "low")).alias("worst"), F.max(F.greatest("high", "low")).alias("best"))
    follow = Window.partitionBy("asset_id").orderBy("_blk").rowsBetween(1, ahead)
    return per.select("asset_id", "_blk", "_bars", F.collect_list(F.struct(
        F.col("_blk").alias("blk"), "last", "low", "high", "dip", "peak", "worst", "best")).over(follow).alias("_next"))


def within_reach(line: DataFrame, setups: DataFrame, ahead: int) -> DataFrame:
    """The rows of ``line`` that setups look at: their own (``_own``) and the ``ahead`` bars that follow.

    An asset's setup times travel as one array (bounded by the calendar) and meet its bars in the
    partitioning of the bars, which stay where they are.
    """
    per = setups.groupBy("asset_id").agg(F.collect_set("ts").alias("_times"))
    near = F.max("_own").over(over_asset().rowsBetween(-ahead, 0))
    out = line.join(per, "asset_id").withColumn("_own", F.array_contains("_times", F.col("ts"))).drop("_times")
    return out.withColumn("_near", near).where("_near").drop("_near")


def resolve(setups: DataFrame, bars: DataFrame, max_hold: int, tie_rule: str = "STOP", size: int = BLOCK_BARS) -> DataFrame:
    """Enter at the next open, carry the planned distances, first barrier wins.

    Per forward bar, in order: open beyond the stop exits at the open; stop and
    target touches exit at the level (both in one bar: the stop, unless
    ``tie_rule`` is TARGET); an open beyond the target exits at the open; the last
    allowed bar exits at its close. Too few bars leave the setup OPEN.

    A setup meets two rows of bars whatever its horizon. The first is the block of its
    entry, which is scanned bar by bar and brings the extremes of the following blocks: the
    first of these whose extremes reach a barrier, or else the block of the last allowed bar,
    holds the exit. That block is the second row. Excursions come from the scanned bars
    and the extremes of the blocks between.
    """
    # setup, bars and next bar share the asset's timeline; the other bars take no part
    line = with_bar_number(bars.select("asset_id", "ts", "open", "high", "low", "close"), "_rn")
    line = within_reach(line, setups, max_hold)
    nxt = line.withColumn("_entry", F.lead("open").over(over_asset())).withColumn(
        "_entry_ts", F.lead("ts").over(over_asset())).where("_own").select("asset_id", "ts", "_rn", "_entry", "_entry_ts")
    at = setups.join(nxt, ["asset_id", "ts"], "left")
    sign, risk, entry = F.col("sign"), F.col("risk_per_unit"), F.col("_entry")
    entered = present("_entry")
    at = at.withColumns({
        "_stop": entry - sign * risk,
        "_target": entry + sign * F.col("reward_per_unit"),
        "_end": F.when(entered, F.col("_rn") + F.col("max_hold_bars")),
        "_blk": F.when(entered, F.floor((F.col("_rn") + 1) / size)),
    })
    long_, stop, target = sign > 0, F.col("_stop"), F.col("_target")

    def event(x: Column) -> Column:
        o, h, low, c = (x[k] for k in ("open", "high", "low", "close"))
        gap_stop = is_true(F.when(long_, o <= stop).otherwise(o >= stop))
        hit_stop = is_true(F.when(long_, low <= stop).otherwise(h >= stop))
        hit_target = is_true(F.when(long_, h >= target).otherwise(low <= target))
        gap_target = is_true(F.when(long_, o >= target).otherwise(o <= target))
        if tie_rule == "TARGET":
            hit_stop = hit_stop & ~hit_target

        def leave(outcome: str, price: Column) -> Column:
            return F.struct(F.lit(outcome).alias("outcome"), price.alias("price"), x["ts"].alias("ts"), (x["rn"] - F.col("_rn")).cast("int").alias("step"))

        return (F.when(gap_stop, leave("STOP", o)).when(hit_stop, leave("STOP", stop))
                .when(hit_target, leave("TARGET", F.when(gap_target, o).otherwise(target)))
                .when(x["rn"] >= F.col("_end"), leave("TIME", c)))

    def first_event(bars_: str) -> Column:
        return F.get(F.filter(F.transform(bars_, event), lambda e: e.isNotNull()), F.lit(0))

    def allowed(bars_: str) -> Column:
        return F.filter(bars_, lambda x: (x["rn"] > F.col("_rn")) & (x["rn"] <= F.col("_end")))

    reached = lambda b: is_true(F.when(long_, (b["dip"] <= stop)).otherwise(b["peak"] >= stop)) | is_true(
        F.when(long_, b["high"] >= target).otherwise(b["low"] <= target))
    blocks = bar_blocks(line, -(-max_hold // size) + 1, size)
    out = at.join(blocks, ["asset_id", "_blk"], "left").withColumn("_head", allowed("_bars")).withColumn("_first", first_event("_head"))
    out = out.withColumn("_next", F.filter("_next", lambda b: b["blk"] * size <= F.col("_end")))
    final = F.filter("_next", lambda b: b["last"] >= F.col("_end"))
    out = out.withColumn("_scan", F.when(F.col("_first").isNull(), F.coalesce(
        F.get(F.filter("_next", reached), F.lit(0))["blk"], F.get(final, F.lit(0))["blk"]))).drop("_bars", "_blk")
    second = blocks.select("asset_id", F.col("_blk").alias("_scan"), F.col("_bars").alias("_more"))
    out = out.join(second, ["asset_id", "_scan"], "left").withColumn("_tail", allowed("_more"))
    out = out.withColumn("_exit", F.coalesce("_first", first_event("_tail")))
    # bars seen, and the excursions up to the exit
    known = F.greatest(F.array_max(F.transform("_next", lambda b: b["last"])), F.array_max(F.transform("_head", lambda x: x["rn"])))
    upto = F.filter(F.concat(F.coalesce("_head", F.array()), F.coalesce("_tail", F.array())),
                    lambda x: F.coalesce(x["rn"] - F.col("_rn") <= F.col("_exit.step"), F.lit(True)))
    between = F.when(F.col("_first").isNull(), F.filter("_next", lambda b: F.coalesce(b["blk"] < F.col("_scan"), F.lit(True))))

    def extreme(side: str) -> Column:
        pick, whole = (F.array_min, F.least) if side == "worst" else (F.array_max, F.greatest)
        hi_r, lo_r = (lambda x: sign * (x["high"] - entry) / risk), (lambda x: sign * (x["low"] - entry) / risk)
        own = F.when(long_, F.lit(side)).otherwise("best" if side == "worst" else "worst")
        blocks_r = F.transform(between, lambda b: sign * (F.when(own == "worst", b["worst"]).otherwise(b["best"]) - entry) / risk)
        return whole(F.lit(0.0), pick(F.transform(upto, lambda x: whole(hi_r(x), lo_r(x)))), pick(blocks_r))

    out = out.withColumns({"mae_r": extreme("worst"), "mfe_r": extreme("best"), "_seen": (F.least(known, F.col("_end")) - F.col("_rn")).cast("int")})
    done = F.col("_exit").isNotNull()
    return out.withColumns({
        "setup_ts": F.col("ts"),
        "entry_ts": F.when(entered, F.col("_entry_ts")).otherwise(F.col("ts")),
        "entry_price": F.when(entered, entry),
        "resolution_ts": F.col("_exit.ts"),
        "exit_price": F.col("_exit.price"),
        "outcome": F.coalesce(F.col("_exit.outcome"), F.lit("OPEN")),
        "bars_held": F.coalesce(F.when(done, F.col("_exit.step")).otherwise(F.col("_seen")), F.lit(0)).cast("int"),
        "realised_r_gross": F.when(done, sign * (F.col("_exit.price") - entry) / risk),
        "mae_r": F.coalesce("mae_r", F.lit(0.0)),
        "mfe_r": F.coalesce("mfe_r", F.lit(0.0)),
        "stop_price": F.when(entered, stop).otherwise(F.col("stop_price")),
        "target_price": F.when(entered, target).otherwise(F.col("target_price")),
        "entry_gap_atr": F.when(entered & (F.col("atr_14") > 0),
                                sign * (entry - F.col("reference_price")) / F.when(F.col("atr_14") > 0, F.col("atr_14"))),
    }).drop("_rn", "_entry", "_entry_ts", "_stop", "_target", "_end", "_scan", "_next", "_head", "_first", "_more", "_tail", "_exit", "_seen")


def earnings_of_assets(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per asset: its events as (session index, band, when first known) and a summary.

    Events of one session and band are merged to the earliest knowable one, so an asset has no
    more than two for each session of the calendar.
    """
    ev = next_on_or_after(events.select("asset_id", "earnings_date", "available_ts"), calendar, "earnings_date",
                          [("session_index", "_idx")])
    known = F.coalesce("available_ts", F.lit("0001-01-01").cast("timestamp"))
    band = F.when(F.col("available_ts").isNull(), EARNINGS_BAND).otherwise(0)
    per = ev.groupBy("asset_id", "_idx", band.alias("band")).agg(F.min(known).alias("known"))
    return per.groupBy("asset_id").agg(
        F.min("known").alias("first_known"), F.min(F.when(F.col("_idx").isNull(), F.col("known"))).alias("beyond_known"),
        F.collect_list(F.when(F.col("_idx").isNotNull(), F.struct(F.col("_idx").alias("idx"), "band", "known"))).alias("_events"))


def with_earnings_flag(rows: DataFrame, events: DataFrame, calendar: DataFrame, etf: DataFrame, holds: list[int],
                       name: str = "had_earnings_in_window") -> DataFrame:
    """True when a known event may fall in the holding window; missing knowledge blocks.

    ``holds`` lists the holding times that are judged: a row with another has no window.
    """
    per = earnings_of_assets(events, calendar)
    out = rows.join(per, "asset_id", "left").join(etf.select("asset_id", F.col("is_etf").alias("_etf")), "asset_id", "left")
    ts, t, hold = F.col("ts"), F.col("session_index"), F.col("max_hold_bars")
    meets = F.exists("_events", lambda e: (t >= e["idx"] - e["band"] - hold) & (t <= e["idx"] + e["band"] - 1) & (e["known"] <= ts))
    flag = (F.when(is_true(F.col("_etf")), False).when(F.col("session_index").isNull() | (F.col("session_index") < 0), True)
            .when(~is_true(F.col("first_known") <= ts), True).when(is_true(F.col("beyond_known") <= ts), True)
            .otherwise(is_true(hold.isin(*holds) & meets)))
    return out.withColumn(name, flag).drop("_events", "first_known", "beyond_known", "_etf")


def label_setups(features: DataFrame, bars: DataFrame, strategies: list, snapshots: DataFrame, events: DataFrame,
                 etf: DataFrame, calendar: DataFrame, tie_rule: str = "STOP", done: DataFrame | None = None) -> DataFrame:
    """Detect, resolve, and tag every setup. ``done`` lists assets to skip on resume."""
    feats = features if done is None else features.join(done.select("asset_id").distinct(), "asset_id", "left_anti")
    holds = [s.max_hold_bars for s in strategies]
    res = resolve(detect_setups(feats, strategies), bars, max(holds), tie_rule)
    res = with_earnings_flag(res, events, calendar, etf, holds).select("ts", *[c for c in LABEL_COLUMNS if c != "adv_usd_60"])
    res = staged(res)  # the as-of join reads it twice
    adv = snapshots.select("asset_id", F.col("ts").alias("_snap"), "adv_usd_60")
    return asof_backward(res, adv, ["asset_id"], "ts", "_snap", ["adv_usd_60"]).select(*LABEL_COLUMNS)


def label_summary(labels: DataFrame) -> DataFrame:
    open_ = F.col("outcome") == "OPEN"
    return labels.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(open_.cast("long")).alias("open"),
        F.sum((~open_).cast("long")).alias("resolved"))


