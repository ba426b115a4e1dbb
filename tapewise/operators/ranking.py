"""Exact order statistics inside groups of any size.

A plain ``Window.partitionBy(key).orderBy(value)`` sorts a whole group in one
task, which fails when one timestamp or bin holds a large share of all rows.
Here all rows are laid out in one order, group by group, by range partitioning: Spark
picks the bounds from samples of every input partition, in proportion to its rows, so a
group takes as many partitions as it has rows for, and a small one shares a partition.
Running totals inside the partitions, and the totals of the partitions before (one row
a partition), give the place of each row in the whole order; the place in a group is
the difference to the group's first. The layout is written once before it is read by more
than one consumer, so a recomputed task can't see other bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.session import staged


def laid_out(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``_before``: the rows (or the total of the long column ``weight``) before each row in the order ``by``."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    if weight is None:
        dealt = staged(dealt.withColumn("_id", F.monotonically_increasing_id()))  # partition number and place
        place, own = F.col("_id").bitwiseAND((1 << 33) - 1), F.lit(1)
        dealt = dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_local", place).drop("_id")
    else:
        dealt, own = staged(_running(dealt, weight)), F.col(weight)
    ends = dealt.groupBy("_part").agg(F.max(F.col("_local") + own).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ends.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("_before", F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def _running(dealt: DataFrame, weight: str) -> DataFrame:
    """Add the partition's number and the total of the rows before, inside the partition."""
    schema = T.StructType([*dealt.schema, T.StructField("_part", T.LongType()), T.StructField("_local", T.LongType())])
    at = dealt.columns.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = total + np.cumsum(b.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[total], upto[:-1]]) if len(upto) else upto
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(before)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _beside_group(df: DataFrame, per_group: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Attach one row per group; Spark broadcasts it only if it turns out small, unless ``bounded``."""
    side = per_group.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in per_group.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return df.join(F.broadcast(side) if bounded else side, cond).drop(*[f"_g_{k}" for k in keys])


def with_position(df: DataFrame, keys: list[str], order: str, *, name: str = "position", total: str = "group_rows",
                  bounded: bool = False) -> DataFrame:
    """Add the 1-based position of each row in its group and the group size.

    ``order`` must be unique in a group; use a struct column with tie-breakers.
    ``bounded`` says that the number of *groups* is limited by a calendar or a
    closed set, so what is known of the groups may be broadcast.
    """
    laid = laid_out(df, [*keys, order])
    per = laid.groupBy(*keys).agg(F.min("_before").alias("_start"), F.count(F.lit(1)).alias(total))
    return _beside_group(laid, per, keys, bounded).withColumn(name, (F.col("_before") - F.col("_start") + 1).cast("long")).drop("_before", "_start")


def value_counts_with_rank(df: DataFrame, keys: list[str], value: str, *, bounded: bool = False) -> DataFrame:
    """One row per (group, distinct value): copies, rows below, rows in the group.

    Equal values are merged before the shuffle, so a value shared by a third of
    all rows becomes one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    laid = laid_out(counts, [*keys, value], "copies")
    per = laid.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum("copies").alias("group_rows"))
    return _beside_group(laid, per, keys, bounded).select(
        *keys, value, "copies", (F.col("_before") - F.col("_start")).alias("rows_below"), "group_rows")


#: Parts that the rows without a value are dealt into when ranks are joined back.
SALTS = 1024


def average_pct_ranks(df: DataFrame, keys: list[str], values: dict[str, str], *, bounded: bool = False) -> DataFrame:
    """Rank columns for several value columns of one type, in one pass: in (0, 1], ties at their average rank; NULL for a NULL value."""
    long = None
    for i, v in enumerate(values):
        part = df.where(F.col(v).isNotNull()).select(*keys, F.lit(i).alias("_which"), F.col(v).alias("_value"))
        long = part if long is None else long.unionByName(part)
    ranks = value_counts_with_rank(long, [*keys, "_which"], "_value", bounded=bounded)
    pct = (F.col("rows_below") + (F.col("copies") + 1) / 2) / F.col("group_rows")
    out = df
    for i, (v, name) in enumerate(values.items()):
        side = ranks.where(F.col("_which") == i).select(
            *[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_value").alias("_g_value"), F.lit(0).alias("_g_salt"), pct.alias(name))
        salt = F.when(F.col(v).isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS - 1))).otherwise(0).cast("int")
        cond = (F.col(v) == F.col("_g_value")) & (F.col("_salt") == F.col("_g_salt"))
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        out = out.drop(name).withColumn("_salt", salt).join(side, cond, "left").drop("_salt", "_g_value", "_g_salt", *[f"_g_{k}" for k in keys])
    return out


def average_pct_rank(df: DataFrame, keys: list[str], value: str, name: str, *, bounded: bool = False) -> DataFrame:
    """Rank in (0, 1] with ties at their average rank; NULL for a NULL value."""
    return average_pct_ranks(df, keys, {value: name}, bounded=bounded)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, bounded: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    Only the values that cover a wanted position leave their range; a group is
    never gathered in one place.
    """
    ranked = value_counts_with_rank(df, keys, value, bounded=bounded)
    first, last = F.col("rows_below"), F.col("rows_below") + F.col("copies") - 1

    def at(p: float, up: bool) -> Column:
        h = (F.col("group_rows") - 1) * F.lit(float(p))
        k = F.ceil(h) if up else F.floor(h)
        return F.max(F.when((first <= k) & (last >= k), F.col(value)))

    aggs = []
    for i, p in enumerate(probs.values()):
        aggs += [at(p, False).alias(f"_lo{i}"), at(p, True).alias(f"_hi{i}")]
    got = ranked.groupBy(*keys).agg(F.max("group_rows").alias("_n"), *aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (h - F.floor(h))).alias(name))
    return got.select(*keys, *out)


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """Longest streak of ``flag`` in order, per group, for groups of any size.

    The rows of a streak have the same number of breaks before them, so a streak is a
    group of its own whose length is summed before the shuffle.
    """
    rows = df.select(*keys, order, F.when(flag, 0).otherwise(1).cast("long").alias("_break"))
    laid = laid_out(rows, [*keys, order], "_break")
    streaks = laid.groupBy(*keys, "_before").agg(F.sum(1 - F.col("_break")).alias("_len"))
    return streaks.groupBy(*keys).agg(F.max("_len").alias(name))


def split_points(df: DataFrame, keys: list[str], order: str, slots: int) -> DataFrame:
    """One row per group: ``_splits``, at most ``slots`` sorted order values."""
    picked = (
        df.where(F.col(order).isNotNull())
        .select(*keys, order, F.xxhash64(order).alias("_h"))
        .groupBy(*keys, F.pmod("_h", F.lit(slots)).alias("_slot"))
    )
    kind = df.schema[order].dataType
    if isinstance(kind, (T.StructType, T.StringType)):
        picked = picked.agg(F.min(F.struct("_h", order)).alias("_m")).select(*keys, F.col(f"_m.{order}").alias(order))
    else:  # fixed width: stays in hash aggregation; the hash of one number has no collisions
        picked = picked.agg(F.min_by(order, "_h").alias(order))
    return picked.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_splits"))
