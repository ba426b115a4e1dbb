"""Raw bars and corporate actions to an adjusted, calendar-keyed, flagged panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import ratio, session_close_utc, session_of
from tapewise.operators.asof import asof_backward, many_to_one
from tapewise.params import PRICED_ACTIONS

PANEL_COLUMNS = ("asset_id", "symbol", "ts", "session_index", "open", "high", "low", "close",
                 "close_raw", "volume", "dollar_volume", "is_suspect")
LARGE_LOG_RETURN = 1.0
STALE_SESSIONS = 5


def build_calendar(spark, start: str, end: str, holidays: DataFrame, early_closes: DataFrame) -> DataFrame:
    """Weekday sessions from ``start`` to ``end`` without the listed holidays.

    Opens 09:30 and closes 16:00 New York (13:00 on an early-close day), in UTC.
    """
    span = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    open_days = span.where(F.dayofweek("session").between(2, 6)).join(
        F.broadcast(holidays.select("session").distinct()), "session", "left_anti")
    early = early_closes.select("session").distinct().withColumn("is_half_day", F.lit(True))
    cal = open_days.join(F.broadcast(early), "session", "left").withColumn(
        "is_half_day", F.coalesce("is_half_day", F.lit(False)))
    half_hour = F.expr("INTERVAL 30 MINUTES")
    return cal.select(
        "session",
        (session_close_utc(F.col("session"), 9) + half_hour).alias("open_utc"),
        F.when(F.col("is_half_day"), session_close_utc(F.col("session"), 13))
        .otherwise(session_close_utc(F.col("session"), 16)).alias("close_utc"),
        "is_half_day",
        (F.row_number().over(Window.orderBy("session")) - 1).cast("int").alias("session_index"),
    )


def contemporaneous_dividends(actions: DataFrame) -> DataFrame:
    """Dividend cash per share outstanding then: times every later split ratio."""
    later = Window.partitionBy("asset_id").orderBy(F.datediff("ex_date", F.lit("1970-01-01")).desc()).rangeBetween(
        Window.unboundedPreceding, -1)
    factor = F.when((F.col("action_type") == "SPLIT") & (F.col("split_ratio") > 0), F.col("split_ratio")).otherwise(1.0)
    scaled = actions.withColumn("_f", F.coalesce(F.product(factor).over(later), F.lit(1.0)))
    return scaled.withColumn(
        "cash_amount",
        F.when(F.col("action_type") == "DIVIDEND", F.col("cash_amount") * F.col("_f")).otherwise(F.col("cash_amount")),
    ).drop("_f")


def _scaled(kind: Column, split: Column, cash: Column, before: Column) -> Column:
    """Price factor of one action, given the close before its day; 1 where it has none."""
    cash_f = 1.0 - ratio(cash, before)
    f = F.when(kind == "SPLIT", F.when(split > 0, F.lit(1.0) / F.when(split > 0, split))).otherwise(
        F.when((before > 0) & (cash_f > 0), cash_f))
    return F.coalesce(f, F.lit(1.0))


def _product(day: Column) -> Column:
    """Product of a day's (action type, factor), in a fixed order, so that equal assets have equal prices to the last place."""
    return F.aggregate(F.array_sort(day), F.lit(1.0), lambda x, e: x * e["_f"])


def event_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Price factor per (asset, ex date): product over that day's priced actions."""
    acts = contemporaneous_dividends(actions).where(F.col("action_type").isin(*PRICED_ACTIONS))
    probe = acts.withColumn("_before", F.date_sub("ex_date", 1))
    prev = asof_backward(probe, bars.select("asset_id", "session", F.col("close").alias("_prev")),
                         ["asset_id"], "_before", "session", ["_prev"])
    f = _scaled(*[F.col(c) for c in ("action_type", "split_ratio", "cash_amount", "_prev")])
    day = prev.withColumn("_f", f).groupBy("asset_id", "ex_date").agg(F.collect_list(F.struct("action_type", "_f")).alias("_day"))
    return day.select("asset_id", "ex_date", _product(F.col("_day")).alias("event_factor"))


def adjust_bars(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Back-adjusted OHLCV; ``close_raw`` and ``volume_raw`` keep what was traded.

    Each day's actions are laid on the asset's own timeline, where they meet the close before
    them (the factors are those of :func:`event_factors`) and are multiplied from the newest
    backwards; a bar is scaled by the events strictly after it. Bars are read and shuffled once.
    """
    acts = contemporaneous_dividends(actions).where(F.col("action_type").isin(*PRICED_ACTIONS))
    days = acts.groupBy("asset_id", F.col("ex_date").alias("_d")).agg(
        F.collect_list(F.struct("action_type", "split_ratio", "cash_amount")).alias("_acts"))
    rest = F.struct(*[c for c in bars.columns if c not in ("asset_id", "session")])
    both = bars.select(rest.alias("b")).schema["b"].dataType
    ev = days.select("asset_id", "_d", F.lit(1).alias("_ev"), "_acts", F.lit(None).cast(both).alias("_bar"))
    line = bars.select("asset_id", F.col("session").alias("_d"), F.lit(0).alias("_ev"),
                       F.lit(None).cast(days.schema["_acts"].dataType).alias("_acts"), rest.alias("_bar")).unionByName(ev)
    # oldest first; on one day the event comes before that day's bar, so does not see its close
    older = Window.partitionBy("asset_id").orderBy("_d", F.col("_ev").desc()).rowsBetween(Window.unboundedPreceding, 0)
    close = F.when(F.col("_bar").isNotNull() & F.col("_d").isNotNull(), F.struct(F.col("_bar.close").alias("close")))
    line = line.withColumn("_prev", F.last(close, ignorenulls=True).over(older)["close"])
    day = F.transform("_acts", lambda a: F.struct(
        a["action_type"].alias("action_type"), _scaled(a["action_type"], a["split_ratio"], a["cash_amount"], F.col("_prev")).alias("_f")))
    line = line.withColumn("_f", F.when(F.col("_ev") == 1, _product(day)).otherwise(1.0)).drop("_acts", "_prev")
    # newest first; on one day the bar comes before that day's event, so is not scaled by it
    w = Window.partitionBy("asset_id").orderBy(F.col("_d").desc(), "_ev").rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn("factor", F.product("_f").over(w)).where("_ev = 0").select(
        *[c if c == "asset_id" else F.col("_d" if c == "session" else f"_bar.{c}").alias(c) for c in bars.columns],
        "factor")  # the line's own key, not renamed, keeps its partitioning
    return out.withColumns({
        "close_raw": F.col("close"), "volume_raw": F.col("volume"),
        **{c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")},
        "volume": F.col("volume") / F.col("factor"),
    })


def join_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Session close as ``ts``; days off the calendar keep a fallback close and -1."""
    cal = calendar.select("session", "close_utc", "session_index")  # one row per session
    out = many_to_one(bars, cal, ["session"], bounded=True)
    return out.withColumn("ts", F.coalesce("close_utc", session_close_utc(F.col("session")))).withColumn(
        "session_index", F.coalesce("session_index", F.lit(-1)).cast("int")).drop("close_utc")


def stale_close() -> tuple[Column, Column]:
    """(continues the previous bar's run, run member can be stale)."""
    w = Window.partitionBy("asset_id").orderBy("session_index", "session")
    cont = ((F.col("session_index") == F.lag("session_index").over(w) + 1)
            & (F.col("volume") > 0) & (F.lag("volume").over(w) > 0)
            & (F.col("close_raw") == F.lag("close_raw").over(w)))
    return F.coalesce(cont, F.lit(False)), F.col("volume") > 0


def quality_flags(bars: DataFrame, actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """The five suspect checks as boolean columns plus ``is_suspect``; no row is lost."""
    w = Window.partitionBy("asset_id").orderBy("session_index", "session")
    # an asset's days with actions (bounded by the calendar) meet its bars in the partitioning of the windows
    priced = actions.where(F.col("action_type").isin(*PRICED_ACTIONS)).groupBy("asset_id").agg(F.collect_set("ex_date").alias("_days"))
    known = calendar.select("session").distinct().withColumn("_open", F.lit(True))
    out = bars.join(priced, "asset_id", "left").withColumn(
        "_action", F.when(F.array_contains("_days", F.col("session")), True)).drop("_days")
    out = out.join(F.broadcast(known), "session", "left")
    prev = F.lag("close_raw").over(w)
    adjacent = F.col("session_index") == F.lag("session_index").over(w) + 1
    jump = F.when(adjacent & (F.col("close_raw") > 0) & (prev > 0), F.abs(F.log(ratio(F.col("close_raw"), prev))))
    cont, moving = stale_close()
    out = out.withColumn("_jump", jump).withColumn("_cont", cont)
    out = out.withColumn("_run", F.sum(F.when(F.col("_cont"), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.count(F.lit(1)).over(Window.partitionBy("asset_id", "_run"))
    out = out.withColumns({
        "ohlc_invalid": (F.col("high") < F.col("low")) | (F.col("close") < F.col("low")) | (F.col("close") > F.col("high")),
        "large_return": F.coalesce(F.col("_jump") > LARGE_LOG_RETURN, F.lit(False)) & F.col("_action").isNull(),
        "zero_volume": F.col("volume") == 0,
        "stale_close": (length >= STALE_SESSIONS) & moving,
        "not_in_calendar": F.col("_open").isNull() | (F.col("session_index") < 0),
    })
    flags = ("ohlc_invalid", "large_return", "zero_volume", "stale_close", "not_in_calendar")
    any_flag = F.lit(False)
    for c in flags:
        any_flag = any_flag | F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("is_suspect", any_flag).drop("_action", "_open", "_jump", "_cont", "_run")


def processed_panel(bars: DataFrame, actions: DataFrame, calendar: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw bars to panel: adjust, key by calendar, flag, project."""
    flagged = quality_flags(join_calendar(adjust_bars(bars, actions), calendar), actions, calendar)
    return flagged.withColumn("dollar_volume", F.col("close_raw") * F.col("volume_raw")).select(*PANEL_COLUMNS, *keep)


def suspect_rate(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_suspect").cast("long")).alias("suspect_rows"),
                     F.coalesce(F.avg(F.col("is_suspect").cast("double")), F.lit(0.0)).alias("suspect_rate"))


# -- reads in time ---------------------------------------------------------------

def as_of(df: DataFrame, ts) -> DataFrame:
    return df.where(F.col("ts") <= F.lit(ts).cast("timestamp"))


def rows_at(df: DataFrame, ts) -> DataFrame:
    return df.where(F.col("ts") == F.lit(ts).cast("timestamp"))


def slice_asset(df: DataFrame, asset_id: str) -> DataFrame:
    return df.where(F.col("asset_id") == asset_id).orderBy("ts")


def latest(df: DataFrame, ts) -> DataFrame:
    """Newest row per asset at or before ``ts`` (a partially aggregated max)."""
    rest = [c for c in df.columns if c not in ("asset_id", "ts")]
    best = as_of(df, ts).groupBy("asset_id").agg(F.max_by(F.struct("ts", *rest), "ts").alias("_r"))
    return best.select("asset_id", "_r.*")


def schema_gap(df: DataFrame, expected: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns against a fixed contract."""
    have = set(df.columns)
    return sorted(set(expected) - have), sorted(have - set(expected))


def first_session_of_period(calendar: DataFrame, frequency: str = "monthly", start=None, end=None) -> DataFrame:
    """First session close of each calendar month or ISO week, bounds inclusive."""
    ts = F.col("close_utc")
    cal = calendar
    if start is not None:
        cal = cal.where(ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        cal = cal.where(ts <= F.lit(end).cast("timestamp"))
    if frequency == "monthly":
        keys = [F.year(ts).alias("_y"), F.month(ts).alias("_p")]
    elif frequency == "weekly":
        keys = [F.extract(F.lit("YEAROFWEEK"), ts).alias("_y"), F.weekofyear(ts).alias("_p")]
    else:
        raise ValueError(f"frequency must be 'monthly' or 'weekly', got {frequency!r}")
    return cal.groupBy(*keys).agg(
        F.min_by(F.struct(ts.alias("ts"), "session", "session_index"), ts).alias("_s")
    ).select("_s.*")


