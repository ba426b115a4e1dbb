"""N-gram Jaccard join of documents by signature trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of
equal sets are one class, joined once. Classes link when their sets' Jaccard
similarity reaches the threshold; linked classes form components.

1. Which classes can meet. Each class has a sketch, its ``SKETCH`` smallest hashes. Of
   the smallest hashes of the union of two linked sets, each is in both with a chance of
   at least 3/4, so they share at least ``SHARED`` sketch hashes (all but 4e-16 of the
   time, less than two 64-bit hashes collide over a corpus; exactly so for sets no
   larger than a sketch). A class with fewer hashes seen in other sketches links with
   nothing. Of the rest, a class leaves out its ``SHARED - 1`` most frequent hashes:
   the rarest common hash of a linked pair is left in both. Passages that many
   documents share are frequent and so drop out.
2. Copies first. The leader of a hash is, of the classes that hold it, the one whose
   sketch hashes are the most frequent: of near copies, the one that was edited least.
   Each class is compared exactly with the leader that it shares most kept hashes with;
   what links is put together. Large groups of near copies become components at the
   price of one comparison for each member.
3. Signature trees. For each kept hash that still joins different components, the
   classes that hold it are the leaves of a tree. A node holds the OR of its leaves'
   token bitmaps, their range of sizes and of components, and the most tokens that a
   leaf's bitmap loses to collisions. Two trees (or a tree and itself) are traversed
   together: those of the classes outside the hash's largest component, and of all; a pair of nodes is pruned when the sizes are too far apart, when all of it
   is one component already, or when the overlap that the bitmaps allow is too small.
   The leaf pairs that remain are edges between components. At first the edges of a
   spanning forest of the likeliest ones are compared, which are fewer than the classes
   of a tile; when all of these link, so does what the others would join. Then all that
   are left between different components are. Both comparisons are exact.

Hashes held by very many classes are cut into blocks, so no task sees more than two
blocks of one hash at a time. Sets travel only for pairs that are compared.

Cases: null and wordless texts have empty sets and link with nothing; texts of fewer
words than a shingle are one shingle; rows of one doc_id belong together, so if their
sets differ these link; texts of any length are hashed in chunks; rows without doc_id take no part and have no component; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import PART_BYTES, forget, give_back, map_texts
from tapewise.llm.components import components
from tapewise.session import broadcast_rows, release, staged

WORDS = 5
SKETCH = 48
SHARED = 10
FORESTS = 1
BITS = 2048
FANOUT = 8
BLOCK_ROWS = 4096
#: Node pairs held at a time, and ids that may be broadcast (16 MB).
FRONTIER = 1 << 15
#: Candidate pairs of a tile that are folded into its forest at a time.
FOLD = 1 << 18
BROADCAST_IDS = 1_000_000
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20

_U = np.uint64
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
BASE = 0x9E3779B97F4A7C15
LANES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = (x ^ (x >> _U(30))) * LANES[0]
    x = (x ^ (x >> _U(27))) * LANES[1]
    return x ^ (x >> _U(31))


def word_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sum) of the words of some bytes: polynomials in a word's bytes, from running sums."""
    upper = (b >= 65) & (b <= 90)
    low = np.where(upper, b + 32, b).astype(_U)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[_U(1)], np.full(max(0, len(b) - 1), BASE, dtype=_U)]))
        run = np.concatenate([[_U(0)], np.cumsum((low + _U(1)) * power[:len(b)])])
        back = np.cumprod(np.concatenate([[_U(1)], np.full(max(0, len(b) - 1), pow(BASE, -1, 1 << 64), dtype=_U)]))
        return starts, ends, (run[ends] - run[starts]) * back[starts]


def word_hashes(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums ^ mix(sizes.astype(_U)))


def shingles(word: np.ndarray) -> np.ndarray:
    """The hash of every shingle of consecutive words, as signed 64-bit integers."""
    full = np.zeros(max(0, len(word) - WORDS + 1), dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            full += word[k:len(word) - WORDS + 1 + k] * LANES[k]
        return mix(full ^ _U(WORDS)).view(np.int64)


def one_set(word: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's words; with fewer words than a shingle, all of them as one."""
    if len(word) >= WORDS:
        return np.unique(shingles(word))
    if not len(word):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return mix((word * LANES[:len(word)]).sum(keepdims=True, dtype=_U) ^ _U(len(word))).view(np.int64)


def long_set(raw: bytes) -> np.ndarray:
    """The set of a long text, a chunk at a time.

    A word that a chunk's end cuts is continued in the next chunk, and the last words of
    a chunk are the first ones of the next, so the set is that of the whole text.
    """
    found, fresh, held = np.zeros(0, np.int64), [], 0
    last = np.zeros(0, dtype=_U)
    part, size = _U(0), 0  # sum and bytes of the word that is cut
    for at in range(0, len(raw), CHUNK):
        starts, ends, sums = word_sums(np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at))
        sizes = ends - starts
        if size and len(starts) and starts[0] == 0:
            with np.errstate(over="ignore"):
                sums[0] = part + sums[0] * _U(pow(BASE, size, 1 << 64))
            sizes[0] += size
        elif size:
            sums, sizes, ends = np.concatenate([[part], sums]), np.concatenate([[size], sizes]), np.concatenate([[0], ends])
        part, size = _U(0), 0
        if len(ends) and ends[-1] == CHUNK and at + CHUNK < len(raw):
            part, size = sums[-1], int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        word = np.concatenate([last, word_hashes(sums, sizes)])
        if len(word) < WORDS:
            last = word
            continue
        fresh.append(np.unique(shingles(word)))
        held += len(fresh[-1])
        last = word[-WORDS + 1:]
        if held > len(found):  # merged when there is as much new as old
            found, fresh, held = np.unique(np.concatenate([found, *fresh])), [], 0
    found = np.unique(np.concatenate([found, *fresh])) if fresh else found
    return found if len(found) else one_set(last)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed 64-bit integers.

    Short texts are hashed together, long ones each by itself in chunks.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    short = [r for r in raw if len(r) <= CHUNK]
    starts, ends, sums = word_sums(np.frombuffer(b" ".join(short) + b" ", dtype=np.uint8))
    word = word_hashes(sums, ends - starts)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in short])])).tolist()
    spans = iter(zip(first, first[1:]))
    out = []
    for r in raw:
        if len(r) > CHUNK:
            out.append(long_set(r))
        else:
            i, j = next(spans)
            out.append(one_set(word[i:j]))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set, which with its size name it."""
    with np.errstate(over="ignore"):
        return int(s.sum()), int(mix(s.view(_U) ^ LANES[2]).sum(dtype=_U).view(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[(s.view(_U) >> _U(20)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(bits).view(_U)


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, n, fp1, fp2, sketch): size and fingerprint of each document's set."""
    fields = [T.StructField("n", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()),
              T.StructField("sketch", T.ArrayType(T.LongType(), True))]

    def run(texts: list[str | None]) -> list[pa.Array]:
        sets = shingle_sets(texts)
        names = [fingerprint(s) for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([f[0] for f in names], pa.int64()), pa.array([f[1] for f in names], pa.int64()),
                pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))]

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text", ["doc_id"], fields, lambda: run, PART_BYTES)


def ids_of_several(rows: DataFrame) -> DataFrame | None:
    """The ids (doc_id) under which rows have different sets; None without any."""
    key = F.struct("n", "fp1", "fp2")
    several = staged(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
                     .where("_a <> _b").select("doc_id"))
    return None if several.isEmpty() else several


def named(df: DataFrame, several: DataFrame | None) -> DataFrame:
    """``df`` of (doc_id, n, fp1, fp2) with column node: the doc_id, or the set's own key where one id has different sets."""
    if several is None:
        return df.withColumn("node", F.col("doc_id"))
    mark = broadcast_rows(several, BROADCAST_IDS).withColumn("_more", F.lit(True))
    return df.join(mark, "doc_id", "left").withColumn("node", F.when(F.col("_more"), F.xxhash64("n", "fp1", "fp2")).otherwise(F.col("doc_id"))).drop("_more")


def set_store(docs: DataFrame, owners: DataFrame, several: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """Rows (node, set, bits, n) of the nodes, from the texts of the documents (doc_id) that name them."""
    fields = [T.StructField("set", T.ArrayType(T.LongType(), False)), T.StructField("bits", T.BinaryType()), T.StructField("n", T.LongType()),
              T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType())]

    def run(texts: list[str | None]) -> list[pa.Array]:
        sets = shingle_sets(texts)
        names = [fingerprint(s) for s in sets]
        return [pa.array(sets, pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([f[0] for f in names], pa.int64()), pa.array([f[1] for f in names], pa.int64())]

    wanted = broadcast_rows(owners, BROADCAST_IDS)
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).join(wanted, "doc_id")
    sets = named(map_texts(some, "_text", ["doc_id"], fields, lambda: run, PART_BYTES).where("n > 0"), several)
    return sets.select("node", "set", "bits", "n").dropDuplicates(["node"])


def shared_ids(rows: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one doc_id are in."""
    key = ["n", "fp1", "fp2"]
    at = rows.join(broadcast_rows(several, BROADCAST_IDS), "doc_id").select("doc_id", *key).distinct().join(classes.select(*key, "node"), key)
    low = at.groupBy("doc_id").agg(F.min("node").alias("a"))
    return at.join(low, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))


def compared(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection.

    Each side of the store is cut to the nodes of that side before it is shuffled.
    """
    pairs = staged(pairs.select("a", "b"))

    def side(c: str) -> DataFrame:
        wanted = broadcast_rows(staged(pairs.select(F.col(c).alias("node")).distinct()), BROADCAST_IDS)
        return store.select("node", "set").join(wanted, "node", "left_semi").select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))

    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * inter >= 75 * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


class Tree:
    """Levels of nodes from the leaves (level 0) to the root."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        lost = n - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, n, n, lost, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, lost, c0, c1 = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(lost, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def may_link(self, other: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether nodes i here and j there may hold leaves that link and aren't together yet."""
        b1, lo1, hi1, lost1, c1, d1 = (v[i] for v in self.levels[min(level, len(self.levels) - 1)])
        b2, lo2, hi2, lost2, c2, d2 = (v[j] for v in other.levels[min(level, len(other.levels) - 1)])
        fit = (4 * hi1 >= 3 * lo2) & (4 * hi2 >= 3 * lo1) & ~((c1 == d1) & (c2 == d2) & (c1 == c2))
        most = np.minimum(np.bitwise_count(b1 & b2).sum(axis=1) + np.minimum(lost1, lost2), np.minimum(hi1, hi2))
        return fit & (7 * most >= 3 * (lo1 + lo2))

    def children(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes at a level, one level below."""
        if level >= len(self.levels):  # a lower tree waits at its root
            return i, np.ones(len(i), dtype=np.int64)
        first = i * FANOUT
        return first, np.minimum(FANOUT, len(self.levels[level - 1][0]) - first)


def traverse(one: Tree, two: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that no bound prunes; depth first over slices of the frontier."""
    top = max(len(one.levels), len(two.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        ok = one.may_link(two, level, i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        a, na = one.children(level, i)
        b, nb = two.children(level, j)
        total = na * nb
        parent = np.repeat(np.arange(len(i)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = a[parent] + k // nb[parent], b[parent] + k % nb[parent]
        for s in range(0, len(x), FRONTIER):
            stack.append((level - 1, x[s:s + FRONTIER], y[s:s + FRONTIER]))


def spanning(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """Positions of the edges (u, v) of the best spanning forest of ``count`` vertices; edges come best first."""
    label, left, kept = np.arange(count), np.arange(len(u)), [np.zeros(0, np.int64)]
    while True:
        a, b = label[u[left]], label[v[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.unique(np.concatenate(kept))
        first = np.full(count, len(u))  # the best edge that leaves each tree
        np.minimum.at(first, a, left)
        np.minimum.at(first, b, left)
        tree = np.flatnonzero(first < len(u))
        edge = first[tree]
        kept.append(edge)
        to = np.arange(count)
        to[tree] = label[u[edge]] + label[v[edge]] - tree
        both = to[to] == np.arange(count)  # two trees that leave by one edge: the smaller stays
        to[both] = np.minimum(to[both], np.flatnonzero(both))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def tile_pairs(side: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, forest: bool) -> list[np.ndarray] | None:
    """Candidate pairs (a, b) of one tile: all, or those of a spanning forest of the components; None without any.

    Side 0 seeks, 1 is met, 2 does both here, 3 is met here and seeks in another tile.
    """
    picks = []
    for at in (np.flatnonzero((side == 0) | (side == 2)), np.flatnonzero(side != 0)):
        if not len(at):
            return None
        picks.append(at[np.lexsort((n[at], comp[at]))] if len(at) > 1 else at)
    one, two = (Tree(bits[p], n[p], comp[p]) for p in picks)
    names, vertex = np.unique(comp, return_inverse=True)
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    fresh: list[list[np.ndarray]] = []

    def fold() -> None:
        nonlocal kept
        kept = [np.concatenate(c) for c in zip(kept, *fresh, strict=True)]
        fresh.clear()
        if forest:
            order = np.lexsort((node[kept[1]], node[kept[0]], -kept[2]))
            i, j = kept[0][order], kept[1][order]
            order = order[spanning(vertex[i], vertex[j], len(names))]
            kept = [c[order] for c in kept]

    for i, j in traverse(one, two):
        i, j = picks[0][i], picks[1][j]
        once = (side[j] == 1) | (node[i] < node[j])  # a pair of two that seek is found from both
        i, j = i[once], j[once]
        fresh.append([i, j, np.bitwise_count(bits[i] & bits[j]).sum(axis=1) / (n[i] + n[j])])
        if sum(len(f[0]) for f in fresh) >= FOLD:
            fold()
    fold()
    return [node[kept[0]], node[kept[1]]] if len(kept[0]) else None


def candidates(rows: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) that the trees of each hash let through: all, or those of a spanning forest of
    each tile's components.

    ``rows`` holds (token, node, n, comp, bits). Of each hash, the classes outside its
    most frequent component meet all classes that hold it. Both sides are cut into
    blocks, so no tile grows with its hash; a hash of one block is sent once.
    """
    size = rows.groupBy("token", "comp").agg(F.count("*").alias("_c"))
    count = size.groupBy("token").agg(F.max(F.struct("_c", "comp")).alias("_m"), F.sum("_c").alias("_all")).select(
        "token", F.col("_m.comp").alias("_main"), F.ceil((F.col("_all") - F.col("_m._c")) / BLOCK_ROWS).cast("int").alias("_few"),
        F.ceil(F.col("_all") / BLOCK_ROWS).cast("int").alias("_every"))
    at = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    to = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("comp") == F.col("_main"), 1).otherwise(2).alias("side"))
    seek = F.transform(F.sequence(F.lit(0), F.col("_every") - 1), lambda j: F.struct((at % F.col("_few")).cast("int").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    meet = F.transform(F.sequence(F.lit(0), F.col("_few") - 1), lambda i: F.struct(
        i.alias("i"), (at % F.col("_every")).cast("int").alias("j"), F.when(F.col("comp") == F.col("_main"), 1).otherwise(3).alias("side")))
    tiles = F.when(F.col("_every") == 1, F.array(to)).when(F.col("comp") == F.col("_main"), meet).otherwise(F.concat(seek, meet))
    sent = rows.join(count, "token").select("token", F.explode(tiles).alias("_t"), "node", "n", "comp", "bits").select("token", "_t.*", "node", "n", "comp", "bits")
    key = ["token", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[pa.RecordBatch] = []

        def tiles(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            side, node, n, comp = (t.column(c).to_numpy() for c in ("side", "node", "n", "comp"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=_U).reshape(len(node), -1)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            begin = 0
            found = []
            for end in [*cut.tolist(), *([len(k)] if last else [])]:
                if end - begin > 1:
                    at = slice(begin, end)
                    pairs = tile_pairs(side[at], node[at], n[at], comp[at], bits[at], forest)
                    if pairs is not None:
                        found.append(pairs)
                begin = end
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=PAIR_SCHEMA)
            held[:] = t.slice(begin).to_batches() if begin < len(k) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from tiles(False)
        if held:
            yield from tiles(True)
        give_back()

    out = sent.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) after staged links (a, b) are added; those there were come in as stars, not as the links that made them."""
    if comp is None:
        return staged(components(links, "a", "b"))
    return comp if links.isEmpty() else staged(components(links.union(comp.select("root", "node")), "a", "b"))


def with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` of hashes that still join different components, with column comp."""
    r = rows.withColumn("comp", F.col("node")) if comp is None else (
        rows.join(comp.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    alive = r.groupBy("token").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("token")
    return r.join(alive, "token")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id."""
    rows = staged(digests(docs, doc_id, text))
    key = ["n", "fp1", "fp2"]
    several = ids_of_several(rows)
    classes = staged(named(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key)
                           .agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch")), several))
    held = classes.select("node", "n", F.explode("sketch").alias("token"))
    df = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * 0.75)).cast("int")
    ranked = (held.join(df, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_s"))
              .where(F.size("_s") >= need))
    hub = F.aggregate("_s.df", F.lit(0.0), lambda x, d: x + F.log2(d)).cast("float")
    kept = ranked.select("node", "n", hub.alias("hub"), F.explode(F.slice("_s.token", F.lit(1), F.size("_s") - need + 1)).alias("token"))
    posts = staged(kept)
    owners = posts.select("node").distinct()
    if several is None:
        owners = owners.withColumnRenamed("node", "doc_id")
    else:
        owners = classes.join(owners, "node", "left_semi").select("doc_id").distinct()
    store = staged(set_store(docs, staged(owners), several, doc_id, text))
    del held, df, ranked, kept
    release(docs.sparkSession)

    comp = None if several is None else joined(None, staged(shared_ids(rows, classes, several)))
    alive = staged(with_components(posts, comp))
    lead = alive.groupBy("token").agg(F.max(F.struct("hub", "node", "n", "comp")).alias("l"))
    pairs = (alive.join(lead, "token").where("comp <> l.comp AND 4 * n >= 3 * l.n AND 4 * l.n >= 3 * n")
             .groupBy("node", F.col("l.node").alias("leader")).agg(F.count("*").alias("c")))
    best = pairs.groupBy("node").agg(F.max(F.struct("c", "leader")).alias("m")).select(F.col("node").alias("a"), F.col("m.leader").alias("b"))
    comp = joined(comp, staged(compared(best, store)))
    del alive, lead, pairs, best
    release(docs.sparkSession)
    for k in range(FORESTS + 1):  # forests of the likeliest first: what they join needs no more comparisons
        alive = staged(with_components(posts.drop("hub"), comp))
        found = staged(candidates(alive.join(store.select("node", "bits"), "node"), k < FORESTS))
        comp = joined(comp, staged(compared(found, store)))
        del alive, found
        release(docs.sparkSession)
    root = classes.select(*key, "node", F.col("doc_id").alias("low")).join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if several is None:  # nodes are ids, so a root is the smallest one
        root = root.select(*key, "root")
    else:
        root = root.join(root.groupBy("root").agg(F.min("low").alias("_low")), "root").select(*key, F.col("_low").alias("root"))
    out = rows.join(root, key, "left")
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the one of the smallest doc_id.

    Of rows equal in doc_id and text one stays. Rows without doc_id all stay.
    """
    found = staged(near_duplicates(docs).where("doc_id IS NOT NULL"))
    went = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = staged(found.groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1").select("doc_id"))
    kept = docs.join(went, "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():  # no repeated rows: nothing more to do
        return kept
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS v, b AS m FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = w.doc_id"""
