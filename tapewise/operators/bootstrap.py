"""Resampling on Spark: Poisson bootstrap weights computed from row keys.

Every row gets a Poisson(1) weight per replicate from an integer mix of its key,
the replicate number and the seed. The weights do not depend on partitioning, on
task retries or on the order of rows, and replicates are summed on the map side,
so only (tasks x replicates) rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A Mersenne prime modulus, odd multipliers, and the cumulative
# probabilities of a Poisson variable with mean 1 for 0, 1, 2, ... 9.
PRIME = 2147483647
MIX_ROW, MIX_REP, MIX_OUT = 1103515245, 48271, 69621
POISSON_CUMULATIVE = (
    0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265634,
    0.99940581518241836, 0.99991675885071203, 0.99998975080332536, 0.99999887479740203, 0.99999988857452171,
)


#: Rows whose weights for all replicates a task holds at a time.
CHUNK_ROWS = 256


def with_weight(df: DataFrame, key: str, replicate: str, seed: int, name: str = "_w") -> DataFrame:
    """Add a Poisson(1) weight of an integer key and a replicate number.

    Integer arithmetic only (every product fits 63 bits), one step per projection.
    """
    steps = {
        "_a": f"((CAST({key} AS BIGINT) % {PRIME}) * {MIX_ROW} + {seed}) % {PRIME}",
        "_b": f"((CAST({replicate} AS BIGINT) + 1) * {MIX_REP} + {seed}) % {PRIME}",
    }
    out = df.selectExpr("*", *[f"{v} AS {k}" for k, v in steps.items()])
    out = out.selectExpr("*", f"(_a + _b) % {PRIME} AS _x1")
    out = out.selectExpr("*", f"((_x1 * _x1) % {PRIME} + _a) % {PRIME} AS _x2")
    out = out.selectExpr("*", f"((_x2 * _x2) % {PRIME} + _b * {MIX_OUT}) % {PRIME} AS _x3")
    out = out.selectExpr("*", f"(_x3 * _x3) % {PRIME} / {float(PRIME)}D AS _u")
    counts = " ".join(f"WHEN _u < {t!r}D THEN {k}" for k, t in enumerate(POISSON_CUMULATIVE))
    return out.withColumn(name, F.expr(f"CASE {counts} ELSE {len(POISSON_CUMULATIVE)} END")).drop("_a", "_b", "_x1", "_x2", "_x3", "_u")


def weights(keys: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """The weights of :func:`with_weight` for all replicates: a row for each key."""
    a = (np.fmod(keys.astype(np.int64), PRIME) * MIX_ROW + seed) % PRIME
    b = (np.arange(1, iterations + 1, dtype=np.int64) * MIX_REP + seed) % PRIME
    x = (a[:, None] + b) % PRIME
    x = ((x * x) % PRIME + a[:, None]) % PRIME
    x = ((x * x) % PRIME + b * MIX_OUT) % PRIME
    return np.searchsorted(POISSON_CUMULATIVE, (x * x) % PRIME / float(PRIME), side="right")


def weighted_sums(df: DataFrame, keys: list[str], sums: dict[str, Column], row_key: Column, iterations: int, seed: int) -> DataFrame:
    """Per group and replicate: ``weight`` and the weighted sum of each named column.

    Rows with a null in any summed column are left out. The narrow rows are laid out by group and
    key first, so a group lies in one task, or in as many as it has rows for. Each task sums its
    rows of a group for all replicates in arrays, ``CHUNK_ROWS`` rows at a time, so the replicates that
    are shuffled grow with the sum of tasks and groups, neither with their product nor with rows.
    """
    rows = df.select(*keys, *[c.cast("double").alias(n) for n, c in sums.items()], row_key.cast("long").alias("_k"))
    names = list(sums)
    rows = rows.dropna(subset=[*names, "_k"]).repartitionByRange(*keys, "_k")
    kept = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*kept, T.StructField("replicate", T.IntegerType()), T.StructField("weight", T.DoubleType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), dtype=int)
            order = np.argsort(code, kind="stable")
            for at in np.array_split(order, max(1, -(-len(order) // CHUNK_ROWS))):
                if not len(at):
                    continue
                w = weights(pdf["_k"].to_numpy()[at], iterations, seed).astype(float)
                first = np.flatnonzero(np.diff(code[at], prepend=-1))
                part = {"weight": np.add.reduceat(w, first, axis=0)}
                for n in names:
                    part[n] = np.add.reduceat(w * pdf[n].to_numpy()[at][:, None], first, axis=0)
                head = pdf[keys].iloc[np.repeat(at[first], iterations)].reset_index(drop=True)
                yield head.assign(replicate=np.tile(np.arange(iterations, dtype=np.int32), len(first)), **{n: v.ravel() for n, v in part.items()})

    part = rows.mapInPandas(run, schema)
    return part.groupBy(*keys, "replicate").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(n) for n in names]).where("weight > 0")


def bootstrap_means(df: DataFrame, keys: list[str], value: Column, row_key: Column, iterations: int, seed: int,
                    sums_only: bool = False) -> DataFrame:
    """Weighted mean of ``value`` per group and replicate."""
    sums = weighted_sums(df, keys, {"weighted": value, "weighted_sq": value * value}, row_key, iterations, seed)
    return sums if sums_only else sums.withColumn("mean", F.col("weighted") / F.col("weight"))


def interval(means: DataFrame, keys: list[str], stat: str, confidence: float, low: str, high: str) -> DataFrame:
    """Two-sided interval over replicates: ``iterations`` numbers per group."""
    a = (1.0 - confidence) / 2.0
    return means.groupBy(*keys).agg(
        F.percentile(stat, F.lit(a)).alias(low), F.percentile(stat, F.lit(1.0 - a)).alias(high))


def bootstrap_statistic(df: DataFrame, keys: list[str], sums: dict[str, Column], row_key: Column, iterations: int,
                        seed: int, statistic: str) -> DataFrame:
    """Replicates of a statistic given as a SQL expression over weighted sums.

    ``sums`` names the columns to sum; the expression may use their names and
    ``weight``, the sum of weights. Groups may have any size.
    """
    return weighted_sums(df, keys, sums, row_key, iterations, seed).select(*keys, "replicate", F.expr(statistic).cast("double").alias("stat"))
