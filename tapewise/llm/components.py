"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.session import release, staged


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): each linked node with the smallest node it reaches.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    to its smallest neighbour, then its smaller ones. Each step sums up to one row for
    each node before it is joined back, so a node of very many links is only a key whose
    join may be split. The links are written to the shared folder after each round,
    and what the round shuffled is let go.
    """
    e = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        del both, low, moved
        release(links.sparkSession)  # each round shuffles as often as all that came before it
        if state == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
