"""Point-in-time joins: validated lookups, as-of, and bounded range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (empty when the key is unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", *, bounded: bool = False) -> DataFrame:
    """Left join that fails while running if a right key is not unique.

    ``bounded`` says that the right side is limited by a calendar or a closed set and may be broadcast.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    guarded = right.withColumn("_copies", n).where(
        F.assert_true(F.col("_copies") == 1, F.lit("right side of a many-to-one join repeats a key")).isNull()
    ).drop("_copies")
    return left.join(F.broadcast(guarded) if bounded else guarded, keys, how)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order.

    The winner is found by a partially aggregated ``min``/``max`` of a struct, so
    a hot key is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    names = [f"_o{i}" for i in range(len(order))]
    picked = df.select(*keys, F.struct(*[o.alias(n) for o, n in zip(order, names)],
                                       *rest).alias("_row"))
    best = picked.groupBy(*keys).agg(F.min("_row").alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def beside(df: DataFrame, one_row: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the columns of a one-row frame (an aggregate without keys) to each row."""
    side = F.broadcast(one_row.withColumn("_beside", F.lit(1)))
    return df.withColumn("_beside", F.lit(1)).join(side, "_beside", how).drop("_beside")


def with_validity(right: DataFrame, key: list[str], ts: str, until: str = "valid_until") -> DataFrame:
    """Add the timestamp at which the next version of the same key starts."""
    return right.withColumn(until, F.lead(ts).over(Window.partitionBy(*key).orderBy(ts)))


#: Days (or units of a numeric time) of a block of the as-of timeline.
BLOCK = 256


def time_block(df: DataFrame, c: str, width: float) -> Column:
    """Number of the block of ``width`` days or units that a time lies in; one block for other types."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(F.col(c)) / F.lit(width)).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(F.col(c)) / F.lit(width * 86_400_000_000)).cast("long")
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(c) / F.lit(width)).cast("long")
    return F.lit(0).cast("long")


def asof_backward(
    left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str,
    payload: list[str], *, right_ts_as: str | None = None, width: float = BLOCK,
) -> DataFrame:
    """Latest right row at or before each left timestamp, NULLs when there is none.

    Time is cut into blocks of ``width`` days (units, for numbers) and both sides are
    laid on one timeline per key and block, where the last right row is carried forward.
    What a block inherits is found on a table with one row per key and block, the last
    right row of each: a scan over the blocks of a key finds the newest one before, which
    becomes the first row of the timeline. So a key with a third of all rows is spread over
    tasks by time, no pairs are produced, and a task sorts what one key has in one block.

    The payload travels as one struct: a NULL field in the newest row stays NULL. Rows
    without a time match nothing. Both sides are read twice, the second time without
    the columns of the left side: stage a side that is costly to compute.
    """
    pay = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in payload])
    lcols = list(left.columns)
    right = right.where(F.col(right_ts).isNotNull())
    lblock, rblock = time_block(left, left_ts, width), time_block(right, right_ts, width)
    ltype = left.select(F.struct(*lcols).alias("l")).schema["l"].dataType
    rtype = right.select(pay.alias("p")).schema["p"].dataType
    ends = right.select(*key, rblock.alias("_blk"), F.col(right_ts).alias("_t"), pay.alias("_p")).groupBy(*key, "_blk").agg(
        F.max_by("_p", "_t").alias("_end"), F.lit(False).alias("_asks"))
    asks = left.select(*key, lblock.alias("_blk")).where("_blk is not null").distinct().select(
        *key, "_blk", F.lit(None).cast(rtype).alias("_end"), F.lit(True).alias("_asks"))
    earlier = Window.partitionBy(*key).orderBy("_blk").rangeBetween(Window.unboundedPreceding, -1)  # one row per block
    inherited = (ends.unionByName(asks).withColumn("_right", F.last("_end", ignorenulls=True).over(earlier))
                 .where("_asks and _right is not null"))
    line = left.select(
        *key, lblock.alias("_blk"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*lcols).alias("_left"), F.lit(None).cast(rtype).alias("_right"),
    ).unionByName(right.select(
        *key, rblock.alias("_blk"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(ltype).alias("_left"), pay.alias("_right"),
    )).unionByName(inherited.select(
        *key, "_blk", F.lit(None).cast(left.schema[left_ts].dataType).alias("_t"), F.lit(0).alias("_side"),
        F.lit(None).cast(ltype).alias("_left"), "_right",
    ))
    w = Window.partitionBy(*key, "_blk").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    extra = [F.col("_hit._rts").alias(right_ts_as)] if right_ts_as else []
    return out.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in payload], *extra)


def asof_interval(
    left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, payload: list[str],
) -> DataFrame:
    """As-of join for a short right side per key (monthly versions, say)."""
    r = with_validity(right.select(*key, right_ts, *payload), key, right_ts, "_until")
    r = r.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col(right_ts).alias("_r_ts"), "_until", *payload)
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    t = left[left_ts]
    cond = cond & (F.col("_r_ts") <= t) & (F.col("_until").isNull() | (t < F.col("_until")))
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in key], "_r_ts", "_until")


def next_on_or_after(left: DataFrame, calendar: DataFrame, date_col: str, out: list[tuple[str, str]]) -> DataFrame:
    """First calendar session on or after a date.

    Each session is widened to the days since the session before it and exploded
    to single days, so the lookup is an equi join on the date against a table
    bounded by the calendar's length in days. Dates before the first session take
    the first one (a single row read on the driver), later ones take none.
    """
    cal = calendar.select("session", *[c for c, _ in out if c != "session"])
    prev = F.lag("session").over(Window.orderBy("session"))  # one row per session
    days = cal.withColumn("_prev", prev).select(
        F.explode(F.when(F.col("_prev").isNull(), F.array("session"))
                  .otherwise(F.sequence(F.date_add("_prev", 1), F.col("session")))).alias("_day"),
        *[F.col(c).alias(n) for c, n in out])
    head = cal.orderBy("session").first()
    j = left.join(F.broadcast(days), left[date_col] == F.col("_day"), "left").drop("_day")
    if head is None:
        return j
    early = F.col(date_col) < F.lit(head["session"])
    for c, n in out:
        j = j.withColumn(n, F.when(early, F.lit(head[c])).otherwise(F.col(n)))
    return j


def forward_rows(
    left: DataFrame, bars: DataFrame, key: str, rn: str, span: Column, max_span: int,
    take: list[str], step: str = "step",
) -> DataFrame:
    """Join each left row to the next ``span`` bars of its key by row number.

    Bars are cut into blocks of ``max_span`` rows and a left row looks into the
    at most two blocks its horizon touches: the equi key is (key, block), so a key
    with a long history is spread out and pairs per left row stay under
    ``2 * max_span``.
    """
    block = lambda c: F.floor(c / F.lit(max_span))
    horizon = F.array_distinct(F.array(block(F.col(rn) + 1), block(F.col(rn) + span)))
    probe = left.withColumn("_block", F.explode(horizon)).withColumn("_span", span)
    side = bars.select(F.col(key).alias("_bkey"), F.col(rn).alias("_brn"), block(F.col(rn)).alias("_bblock"),
                       *[F.col(c).alias(f"fwd_{c}") for c in take])
    cond = ((F.col(key) == F.col("_bkey")) & (F.col("_block") == F.col("_bblock"))
            & (F.col("_brn") > F.col(rn)) & (F.col("_brn") <= F.col(rn) + F.col("_span")))
    return probe.join(side, cond).withColumn(step, (F.col("_brn") - F.col(rn)).cast("int")).drop(
        "_block", "_span", "_bkey", "_brn", "_bblock")
