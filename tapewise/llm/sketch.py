"""Document fingerprints: bottom-k sketches of hashed word shingles.

A text's shingles are its runs of five words (lower case for A-Z; a text of fewer words
is one shingle). The hash of a shingle is the exclusive or of five 64-bit values, one for
each place and word: the first half of the word's MD5 times the place's factor, plus the
second half. So it costs five look-ups, and the same numbers come from SQL. A sketch
holds the ``k`` smallest distinct hashes in order.

The sketch of two parts is the ``k`` smallest of both sketches (``merged``), so texts of
any length and groups of any size are sketched part by part. From two sketches follow
the resemblance (the share of hashes in both among the k smallest of the union), the
distinct shingles of each (exact up to k - 1, else (k - 1) divided by the k-th hash as a
share of all), and the containment. With fewer than k shingles all are exact. The standard
error of a resemblance r is sqrt(r (1 - r) / k): 0.044 at most here, 0.038 at 0.75.

``report`` needs each document's successor in descending doc_id. Documents are dealt into
ranges of doc_id, one for each shuffle partition, by approximate quantiles of the ids; the
first document of each range is sent also to the range before. So texts are shuffled once,
and each range is read as a sorted stream with one text held back.

Cases: null and empty texts, and texts without words, have the empty fingerprint; two
empty fingerprints resemble each other fully, an empty and another not at all; rows of one
doc_id are ordered by text and lie in one range, null ids come last; one document
alone is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import map_texts, slices

K = 128
WIDTH = 5
#: Words of a text that are hashed at a time; parts overlap by WIDTH - 1.
PART = 1 << 20
#: Groups that a task holds before it hands on their sketches.
GROUPS = 20_000
#: Words whose bits a task remembers.
REMEMBERED = 300_000
#: The factor of each place of a shingle, odd and below 2 ** 62.
PLACES = [(0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 62) | 1 for j in range(WIDTH)]
ALL = float(1 << 64)


class Words:
    """128 bits for each word, remembered while a task reads its texts."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.known, self.bits = most, {}, bytearray()

    def values(self, words: list[bytes]) -> list[np.ndarray]:
        """For each place of a shingle, the value of each (distinct) word there."""
        if len(self.known) > self.most:
            self.known, self.bits = {}, bytearray()
        known, md5 = self.known, hashlib.md5
        fresh = [w for w in words if w not in known]
        self.bits += b"".join([md5(w).digest() for w in fresh])
        known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        two = np.frombuffer(bytes(self.bits), dtype=">u8").reshape(-1, 2)[[known[w] for w in words]].astype(np.uint64)
        return [two[:, 0] * np.uint64(c) + two[:, 1] for c in PLACES]


def _hashes(words: list[bytes], sizes: np.ndarray, known: Words) -> list[np.ndarray]:
    """The shingle hashes of each text, whose words follow one another."""
    if not words:
        return [np.zeros(0, dtype=np.uint64) for _ in sizes]
    ids = pa.array(words, pa.binary()).dictionary_encode()
    at = ids.indices.to_numpy(zero_copy_only=False)
    values = [v[at] for v in known.values(ids.dictionary.to_pylist())]
    n = len(words)
    whole = values[0].copy()
    for j in range(1, WIDTH):
        whole[:n - j] ^= values[j][j:]
    ends = np.cumsum(sizes)
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(whole[a:b - WIDTH + 1])
        elif b > a:
            out.append(np.array([np.bitwise_xor.reduce([values[j][a + j] for j in range(b - a)])], dtype=np.uint64))
        else:
            out.append(whole[:0])
    return out


def sketches(texts: list[str | None], k: int = K, known: Words | None = None) -> list[np.ndarray]:
    """The sketch of each text."""
    parts, sizes, owner = [], [], []
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()  # of bytes: A-Z alone, and parts at \x20 and \x09-\x0D alone
        for a in range(0, max(1, len(words) - WIDTH + 1), PART):
            own = words[a:a + PART + WIDTH - 1]
            parts += own
            sizes.append(len(own))
            owner.append(i)
    out: list[np.ndarray] = []
    for i, h in zip(owner, _hashes(parts, np.array(sizes, dtype=np.int64), known or Words()), strict=True):
        own = np.unique(h)[:k]
        if i < len(out):
            out[i] = merged(out[i], own, k)
        else:
            out.append(own)
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of what two sketches stand for together."""
    return np.union1d(a, b)[:k]


def packed(sketch: np.ndarray) -> str:
    """A sketch as text: sixteen hexadecimal digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def unpacked(s: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s or ""), dtype=">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    both = merged(a, b, k)
    if not len(both):
        return 1.0
    return float(np.searchsorted(np.intersect1d(a, b, assume_unique=True), both[-1], side="right") / len(both))


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    return float(len(sketch)) if len(sketch) < k else (k - 1) * ALL / float(sketch[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k))


def add_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K) -> DataFrame:
    """``df`` with the fingerprint of a text column."""
    return map_texts(df, text, df.columns, [T.StructField(name, T.StringType())],
                     lambda: (lambda texts, known=Words(): [pa.array([packed(s) for s in sketches(texts, k, known)], pa.string())]))


def merge_by(df: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint): one fingerprint for all rows of each group, whatever its size.

    Each task merges what it reads, so a group reaches its last task as one fingerprint a task.
    """
    schema = T.StructType([df.schema[key], T.StructField(fingerprint, T.StringType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([packed(s) for s in held.values()], pa.string())], names=schema.names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for g, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = unpacked(f)
                held[g] = merged(held[g], own, k) if g in held else own
            if len(held) > GROUPS:
                yield out()
                held = {}
        if held:
            yield out()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [packed(np.unique(np.concatenate([unpacked(f) for f in fs]))[:k]) for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.string())], names=schema.names)

    some = df.select(key, fingerprint).mapInArrow(partial, schema)
    return some.groupBy(key).agg(F.collect_list(fingerprint).alias(fingerprint)).mapInArrow(last, schema)


def compare(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """``pairs`` with resemblance, distinct_a, distinct_b, a_in_b and b_in_a of two fingerprint columns."""
    names = ["resemblance", "distinct_a", "distinct_b", "a_in_b", "b_in_a"]
    kept = [c for c in pairs.columns if c not in names]
    schema = T.StructType([pairs.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                rows.append((resemblance(x, y, k), distinct_shingles(x, k), distinct_shingles(y, k), containment(x, y, k), containment(y, x, k)))
            new = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=schema.names)

    return pairs.mapInArrow(run, schema)


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows (range, extra, doc_id, text), dealt out and sorted: in each range, documents by
    descending id, and then (extra) the first document of the next range, the last one's successor.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # one number for a range, smaller for greater ids; null ids are the last range
    bound = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    number = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bound, lambda c: c > F.col("doc_id").cast("long"))))
    dealt = docs.withColumn("range", number.cast("int")).withColumn("extra", F.lit(False))
    heads = [tuple(r) for r in dealt.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()]  # one row a range
    after = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    small = spark.createDataFrame(after, T.StructType([T.StructField("head", docs.schema["doc_id"].dataType), T.StructField("to", T.IntegerType())]))
    extra = docs.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    return (dealt.unionByName(extra).repartition("range")
            .sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), "text").select("range", "extra", "doc_id", "text"))


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, and their likeness."""
    kind = {"doc_id": docs.schema["doc_id"].dataType, "n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(),
            "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType(), "n_shingles": T.DoubleType(),
            "in_edited": T.DoubleType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kind.items()])

    def rows(batch: pa.RecordBatch, held: tuple | None, known: Words) -> tuple[list[tuple], tuple | None]:
        # held: range, doc_id, text, and the sketch of a row of the batch before
        ranges, extras, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        pairs = []  # held row, the row's own place in the batch or None, the successor's place, the edited text
        last = None
        for j, (r, x, i, t) in enumerate(zip(ranges, extras, ids, texts, strict=True)):
            if held is not None and held[0] == r:
                n = len(held[2])
                pairs.append((held, last, j, held[2][:n - n // 2] + t[:n // 2]))
            held, last = (None, None) if x else ((r, i, t, None), j)
        own = sketches([*texts, *[p[3] for p in pairs]], k, known)
        out = []
        for (h, at, j, e), c in zip(pairs, own[len(texts):], strict=True):
            s = h[3] if at is None else own[at]
            out.append((h[1], len(h[2]), hashlib.sha256(e.encode()).hexdigest(), packed(s), packed(c), resemblance(s, c, k), resemblance(s, own[j], k),
                        distinct_shingles(s, k), containment(s, c, k)))
        return out, None if held is None else held if last is None else (*held[:3], own[last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, Words()
        for whole in batches:
            for b in slices(whole, "text"):
                out, held = rows(b, held, known)
                columns = list(zip(*out)) or [[]] * len(kind)
                types = [whole.column(2).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    if not docs.take(1):
        return docs.sparkSession.createDataFrame([], schema)
    return with_successor(docs).mapInArrow(run, schema)


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS i, count(*) OVER () AS m FROM documents),
e AS (SELECT d.i, left(d.t, CAST(length(d.t) - length(d.t) // 2 AS BIGINT)) || left(x.t, CAST(length(d.t) // 2 AS BIGINT)) AS t FROM d JOIN d x ON x.i = d.i % d.m + 1),
u AS (SELECT i, false AS edited, t FROM d UNION ALL SELECT i, true, t FROM e),
w AS (SELECT i, edited, unnest(l) AS w, generate_subscripts(l, 1) AS p, len(l) AS n
      FROM (SELECT i, edited, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM u)),
v AS (SELECT w, [CAST((CAST(CAST('0x' || left(md5(w), 16) AS UBIGINT) AS HUGEINT) * c + CAST('0x' || right(md5(w), 16) AS UBIGINT)) % 18446744073709551616 AS UBIGINT)
         FOR c IN [{', '.join(f'CAST({c} AS HUGEINT)' for c in PLACES)}]] AS v FROM (SELECT DISTINCT w FROM w)),
s AS (SELECT i, edited, p, n, xor(xor(xor(xor(v[1], coalesce(lead(v[2], 1) OVER o, 0)), coalesce(lead(v[3], 2) OVER o, 0)), coalesce(lead(v[4], 3) OVER o, 0)), coalesce(lead(v[5], 4) OVER o, 0)) AS h
      FROM w JOIN v USING (w) WINDOW o AS (PARTITION BY i, edited ORDER BY p)),
h AS (SELECT DISTINCT i, edited, h FROM s WHERE p <= greatest(1, n - {WIDTH - 1})),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY i, edited ORDER BY h) <= {K}),
f AS (SELECT u.i, u.edited, coalesce(string_agg(format('{{:016x}}', h), '' ORDER BY h), '') AS f, count(h) AS c, max(h) AS top
      FROM u LEFT JOIN k ON u.i = k.i AND u.edited = k.edited GROUP BY ALL),
q AS (SELECT d.i, false AS ae, d.i AS bi, true AS be FROM d UNION ALL SELECT i, false, i % m + 1, false FROM d),
z AS (SELECT q.i, q.be, h, count(*) AS c FROM q JOIN k ON (k.i = q.i AND k.edited = q.ae) OR (k.i = q.bi AND k.edited = q.be) WHERE NOT (q.i = q.bi AND NOT q.be) GROUP BY ALL),
y AS (SELECT i, be, count(*) FILTER (WHERE c = 2) AS both, count(*) AS n, max(h) AS top
      FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY i, be ORDER BY h) <= {K}) GROUP BY ALL),
a AS (SELECT d.*, f.f, f.c, f.top, x.f AS ef, coalesce(CAST(ye.both AS DOUBLE) / ye.n, 1.0) AS re, ye.n AS un, ye.top AS utop,
             CASE WHEN m = 1 THEN 1.0 ELSE coalesce(CAST(yn.both AS DOUBLE) / yn.n, 1.0) END AS rn
      FROM d JOIN f ON f.i = d.i AND NOT f.edited JOIN f x ON x.i = d.i AND x.edited LEFT JOIN y ye ON ye.i = d.i AND ye.be LEFT JOIN y yn ON yn.i = d.i AND NOT yn.be),
b AS (SELECT *, CASE WHEN c < {K} THEN CAST(c AS DOUBLE) ELSE {K - 1}.0 * 18446744073709551616.0 / CAST(top AS DOUBLE) END AS da,
             CASE WHEN un < {K} THEN CAST(un AS DOUBLE) ELSE {K - 1}.0 * 18446744073709551616.0 / CAST(utop AS DOUBLE) END AS du FROM a)
SELECT b.doc_id, CAST(length(b.t) AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, b.f AS fingerprint, b.ef AS edited_fingerprint,
       re AS near_edited, rn AS near_next, da AS n_shingles, CASE WHEN c = 0 THEN 1.0 ELSE least(1.0, re * du / da) END AS in_edited
FROM b JOIN e USING (i)"""
