"""Cosine near-duplicates by a subspace pigeonhole join.

Two unit vectors of cosine >= t lie within squared distance D = 2 - 2t. The vectors are
rotated (random signs, then a Walsh-Hadamard transform, which spreads their energy) and
their axes are split into ``BLOCKS`` blocks. At least one block must hold no more than
its share of D, so each block is range-joined under that share, and the union of the
candidates is verified by the full cosine in double precision.

The range join of a block lays a grid of sign cells over its first axes; the number of
axes grows with the number of vectors. A vector is at home in one cell and visits each
cell of a higher number that its ball reaches, so a pair meets in one cell at most.
Cells of many vectors are cut into tiles of bounded size. A pair that several blocks
find is counted by the first of them. Equal vectors are joined once, as a class.

A tile gives, for each vector, the number of its links and the smallest vector of its
group within the tile; pairs are folded into these as they are found, so a tile in which
all vectors are linked holds no more than one of few links. Groups are put together by connected components.

Cases: null, empty and zero vectors and those with null or non-finite components link
with nothing and are components of their own; vectors of unequal length don't link;
repeated rows are vectors of their own, equal to each other; rows without vec_id take
no part (no links, no component); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm.components import components
from tapewise.session import staged

COSINE = 0.9
BLOCKS = 8
#: Vectors that a cell may have at home on average, and in a tile at most on each side.
CELL = 16384
TILE = 16384
#: Rows of a tile compared at a time, and the slack of the comparison in single precision.
STRIPE = 512
COARSE = 1e-5
SEED = 20240229
SLACK = 1e-9
#: Candidate pairs verified at a time, and distances held at a time (4 bytes each).
PAIRS = 20_000
CELLS_HELD = 1 << 22


def rotated(x: np.ndarray) -> np.ndarray:
    """Random signs and a Walsh-Hadamard transform, row by row: a rotation.

    It adds and subtracts in a fixed order, so a row's result doesn't depend on the
    rows it comes with. Rows are padded with zeros to a power of two.
    """
    n = 1 << max(0, math.ceil(math.log2(max(1, x.shape[1]))))
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], size=n)
    y = np.zeros((len(x), n))
    y[:, :x.shape[1]] = x
    y *= signs
    h = 1
    while h < n:
        z = y.reshape(len(x), n // (2 * h), 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return y / math.sqrt(n)


def unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def block_bounds(dim: int) -> list[tuple[int, int]]:
    """Axis ranges of the blocks of rotated vectors of some padded length."""
    n = min(BLOCKS, dim)
    at = [dim * i // n for i in range(n + 1)]
    return list(zip(at, at[1:]))


def cells(y: np.ndarray, axes: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for the sign cells of the first axes that each row's ball reaches."""
    g = min(axes, y.shape[1])
    home = (y[:, :g] > 0) @ (1 << np.arange(g))
    rows, cell, own = [np.arange(len(y))], [home], [np.ones(len(y), bool)]
    square = y[:, :g] ** 2
    for flip in range(1, 1 << g):
        bits = (flip >> np.arange(g)) & 1
        other = home ^ flip
        hit = np.flatnonzero((square @ bits <= reach + SLACK) & (other > home))
        rows.append(hit)
        cell.append(other[hit])
        own.append(np.zeros(len(hit), bool))
    return np.concatenate(rows), np.concatenate(cell), np.concatenate(own)


def spread(classes: DataFrame, axes: int, t: float) -> DataFrame:
    """Rows (dim, block, cell, home, rep, n, vec) for every cell that a class is in or visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, rep, n = batch.column("vec").to_pylist(), batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            size = np.array([len(v) for v in raw])
            for dim in np.unique(size).tolist():
                mine = np.flatnonzero(size == dim)
                for part in np.array_split(mine, max(1, len(mine) // 1000)):
                    y = rotated(unit(np.stack([np.frombuffer(raw[i], dtype="<f4") for i in part])))
                    for b, (lo, hi) in enumerate(block_bounds(y.shape[1])):
                        r, c, own = cells(y[:, lo:hi], axes, (2 - 2 * t) * (hi - lo) / y.shape[1])
                        if len(r):
                            yield pa.RecordBatch.from_pydict({
                                "dim": pa.array(np.full(len(r), dim // 4), pa.int32()), "block": pa.array(np.full(len(r), b), pa.int32()),
                                "cell": pa.array(c, pa.int64()), "home": pa.array(own), "rep": pa.array(rep[part][r], pa.int64()),
                                "n": pa.array(n[part][r], pa.int64()), "vec": pa.array([raw[i] for i in part[r]], pa.binary())})

    return classes.mapInArrow(run, "dim int, block int, cell long, home boolean, rep long, n long, vec binary")


def smallest_linked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's group, given that of earlier links (``root``) and more links (i, j)."""
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, block: int, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) that are linked and first found by ``block``, PAIRS at most at a time."""
    bounds = block_bounds(y.shape[1])
    lo, hi = bounds[block]
    share = (2 - 2 * t) / y.shape[1]
    a, b = y[left, lo:hi].astype(np.float32), y[right, lo:hi].astype(np.float32)
    # one product gives |a|^2 + |b|^2 - 2ab, in single precision with slack
    a = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a), np.float32)])
    b = np.ascontiguousarray(np.column_stack([b, np.ones(len(b), np.float32), (b * b).sum(axis=1)]).T)
    rows = max(1, min(STRIPE, CELLS_HELD // max(1, len(right))))
    for r in range(0, len(left), rows):
        from_col = r if same else 0
        at = np.flatnonzero(a[r:r + rows] @ b[:, from_col:] <= np.float32(share * (hi - lo) + COARSE))
        for k in range(0, len(at), PAIRS):
            some = at[k:k + PAIRS]
            p, q = some // (len(right) - from_col) + r, some % (len(right) - from_col) + from_col
            if same:
                p, q = p[p < q], q[p < q]
            i, j = left[p], right[q]
            linked = np.einsum("ij,ij->i", x[i], x[j]) >= t
            i, j = i[linked], j[linked]
            gap = (y[i] - y[j]) ** 2
            found = [gap[:, u:v].sum(axis=1) <= share * (v - u) + SLACK for u, v in bounds[:block + 1]]
            first = found[-1] & ~np.any([np.zeros(len(i), bool), *found[:-1]], axis=0)  # earlier blocks count theirs
            if first.any():
                yield i[first], j[first]


def tile_result(table: pa.Table, t: float) -> pa.Table:
    """Links within one tile: rows (rep, links, root) of the vectors that have any."""
    side, rep, n = table.column("side").to_numpy(), table.column("rep").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(rep, kind="stable")
    side, rep, n = side[order], rep[order], n[order]
    raw = table.column("vec").to_pylist()
    x = unit(np.stack([np.frombuffer(raw[i], dtype="<f4") for i in order]))
    y = rotated(x)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in tile_links(x, y, left, left if same else right, same, table.column("block")[0].as_py(), t):
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        apart = root[i] != root[j]  # links within a group that is known add nothing to it
        if apart.any():
            root = smallest_linked(root, i[apart], j[apart])
    has = np.flatnonzero(links > 0)
    return pa.table({"rep": pa.array(rep[has], pa.int64()), "links": pa.array(links[has]), "root": pa.array(rep[root[has]], pa.int64())})


def tiles(placed: DataFrame) -> DataFrame:
    """``placed`` rows copied to the tiles (key, side) of their cells.

    Homes and visitors of a cell are dealt into chunks of about TILE; a tile is a chunk
    of homes with itself, with a later chunk of homes, or with a chunk of visitors.
    """
    where = ["dim", "block", "cell"]
    count = placed.groupBy(*where).agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("hc"), F.ceil(F.count_if(~F.col("home")) / TILE).cast("int").alias("vc"))
    p = placed.join(F.broadcast(count), where).where("hc > 0")  # at most 2**axes cells of a block, fixed by the number of vectors
    chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("hc")).otherwise(F.col("vc"))).cast("int")
    p = p.withColumn("chunk", chunk)
    homes = p.where("home").selectExpr("*", "explode(sequence(0, hc + vc - 1)) AS o").selectExpr(
        *where, "rep", "n", "vec", "CASE WHEN o >= hc OR chunk <= o THEN chunk ELSE o END AS i",
        "CASE WHEN o >= hc OR chunk <= o THEN o ELSE chunk END AS j", "CASE WHEN o >= hc OR chunk <= o THEN 0 ELSE 1 END AS side")
    guests = p.where("NOT home").selectExpr("*", "explode(sequence(0, hc - 1)) AS i").selectExpr(
        *where, "rep", "n", "vec", "i", "hc + chunk AS j", "1 AS side")
    return homes.unionByName(guests)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", t: float = COSINE) -> DataFrame:
    """Per vector row: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("v"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.hash("v", F.lit(7)))
    key = ["k1", "k2"]
    named = rows.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    named = staged(named.select(*key, "rep", F.col("n").cast("long").alias("n"), as_floats("v").alias("vec")))
    size = max(1, named.count())
    axes = max(1, math.ceil(math.log2(max(1, size / CELL))))
    placed = tiles(spread(named.select("rep", "n", "vec"), axes, t))
    found = placed.groupBy("dim", "block", "cell", "i", "j").applyInArrow(lambda table: tile_result(table, t), "rep long, links long, root long")
    found = staged(found.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    root = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep").withColumnRenamed("root", "top")
    classes = (named.select(*key, "rep", "n").join(links, "rep", "left").join(root, "rep", "left")
               .select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("top", "rep").alias("component_id")))
    out = rows.select("vec_id", "good", *key).join(classes.withColumn("good", F.lit(True)), [*key, "good"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def as_floats(name: str):
    """The bytes of an array of floats, little endian, made inside Spark tasks."""
    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        ends = v.offsets.to_numpy()
        flat = v.values.to_numpy(zero_copy_only=False).astype("<f4")
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    return pack(name)


SQL = f"""
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) >= {COSINE} * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
r AS (SELECT a AS n, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(coalesce(c.m, e.vec_id), e.vec_id) AS component_id,
       e.vec_id = least(coalesce(c.m, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""
