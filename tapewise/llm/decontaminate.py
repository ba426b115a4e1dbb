"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of ``SPAN`` words holds ``WINDOW`` k-grams (``SPAN = GRAM + WINDOW - 1``).
Both sides keep the k-gram of the smallest hash of each such window, so a run of
``SPAN`` words shared by a document and a benchmark item always leaves one common
fingerprint at the same place of the run. Fingerprints are joined, and each hit is
extended along its diagonal by comparing the words themselves: a word is hit when
it lies in a run of at least ``SPAN`` equal words. Items of fewer words than
``SPAN`` are one window each and are met by the hash of the whole item.

Cases: null and wordless texts have no words and no hits. Benchmark rows without
item_id can't be named and are left out. Rows of one doc_id with equal texts get
equal results; with unequal texts, each is judged by itself. Extra columns of either
table are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.session import broadcast_rows, staged

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A packed fingerprint is a hash with the word position in its low bits. A string has less
#: than 2**31 bytes, so less than 2**30 words; equal hashes of unlike words are only candidates.
POSITION_BITS = 30
POSITION = (1 << POSITION_BITS) - 1
#: Fingerprint rows of the benchmark that may be broadcast: 24 bytes each, 48 MB at most.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    plain = F.coalesce(text, F.lit(""))
    lower = F.when(plain.rlike(r"[^\x00-\x7F]"), F.translate(plain, UPPER, LOWER)).otherwise(F.lower(plain))
    return F.filter(F.split(lower, BREAKS), lambda w: w != "")


def gram_hash(w: Column, i: Column, k: int) -> Column:
    """Hash of the k words from position i (from 0)."""
    return F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(k)])


def packed(w: str, k: int) -> str:
    """Array of packed k-gram hashes of the word array column ``w``; null with fewer words."""
    items = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return (f"CASE WHEN size({w}) >= {k} THEN transform(sequence(0, size({w}) - {k}), "
            f"i -> (xxhash64({items}) & {~POSITION}L) | i) END")


def selected(h: str) -> str:
    """The packed hashes that are smallest in some window of ``WINDOW`` k-grams."""
    least = ", ".join(f"{h}[i + {j}]" for j in range(WINDOW))
    return (f"CASE WHEN size({h}) >= {WINDOW} THEN array_distinct(transform(sequence(0, size({h}) - {WINDOW}), "
            f"i -> least({least}))) ELSE array() END")


def fingerprints(df: DataFrame, keep: list[str], short: list[int], broad: bool = True) -> DataFrame:
    """Rows (keep..., k, print, pos) of a table with a word array ``w``.

    ``short`` lists the lengths of short windows; their k-grams are all kept, under
    their own k. k is 0 for the winnowed fingerprints.
    """
    parts = []
    if broad:
        parts.append(df.withColumn("_h", F.expr(packed("w", GRAM)))
                     .select(*keep, F.lit(0).alias("k"), F.explode(F.expr(selected("_h"))).alias("_p")))
    for k in short:
        parts.append(df.select(*keep, F.lit(k).alias("k"), F.explode(F.expr(packed("w", k))).alias("_p")))
    if not parts:
        parts.append(df.select(*keep, F.lit(0).alias("k"), F.lit(0).cast("long").alias("_p")).where("false"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keep, "k", F.expr(f"_p & {~POSITION}L").alias("print"), F.expr(f"cast(_p & {POSITION} AS int)").alias("pos"))


def runs(w: str, c: str) -> str:
    """Word positions of the hit runs of one candidate ``c`` (item words and diagonals).

    The equal stretches of a diagonal are cut where the words differ; stretches of
    at least min(SPAN, item length) words are hits. A diagonal is the document position
    of the item's first word.
    """
    lo, hi = "greatest(0, d)", f"least(size({w}), d + size({c}.iw))"
    differ = f"filter(sequence({lo}, {hi} - 1), j -> {w}[j] <> {c}.iw[j - d])"
    cuts = f"concat(array({lo} - 1), {differ}, array({hi}))"
    stretch = (f"transform(sequence(1, size(cuts) - 1), q -> CASE WHEN cuts[q] - cuts[q - 1] - 1 >= least({SPAN}, size({c}.iw)) "
               "THEN sequence(cuts[q - 1] + 1, cuts[q] - 1) ELSE array() END)")
    return f"array_distinct(flatten(transform({c}.diags, d -> flatten(flatten(transform(array({cuts}), cuts -> {stretch}))))))"


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: the word array, hit positions and contaminating items.

    Columns: doc_id, text, w (words), hits (sorted word positions), items (sorted ids
    as strings). Documents are shuffled at most once, to meet their own candidates;
    fingerprints of documents meet those of the benchmark in a broadcast join while
    the benchmark has at most BROADCAST_ROWS of them, in a shuffled join beyond.
    """
    items = staged(benchmark.where(F.col(item_id).isNotNull())
                   .select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("iw"))
                   .where(F.size("iw") > 0).distinct().withColumn("row", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in items.where(F.size("iw") < SPAN).select(F.size("iw")).distinct().collect())  # nine values at most
    prints = fingerprints(items.where(F.size("iw") >= SPAN).select("row", F.col("iw").alias("w")), ["row"], [])
    for k in short:
        prints = prints.unionByName(fingerprints(items.where(F.size("iw") == k).select("row", F.col("iw").alias("w")), ["row"], [k], broad=False))
    prints = prints.select("k", "print", F.col("pos").alias("ipos"), "row")
    narrow = staged(prints.select("k", "print").distinct())

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = base.select("doc_id", F.xxhash64("text").alias("_t"), words(F.col("text")).alias("w"))
    met = fingerprints(key, ["doc_id", "_t"], short).join(broadcast_rows(narrow, BROADCAST_ROWS), ["k", "print"], "left_semi")
    # words of items join once for each document and item that share a fingerprint
    cand = (met.join(prints, ["k", "print"])
            .select("doc_id", "_t", "row", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
            .groupBy("doc_id", "_t", "row").agg(F.collect_list("diag").alias("diags")).join(items, "row")
            .groupBy("doc_id", "_t").agg(F.collect_list(F.struct("item", "iw", "diags")).alias("cand")))
    full = (base.withColumn("_t", F.xxhash64("text")).alias("b")
            .join(cand.alias("c"), F.col("b.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("b._t") == F.col("c._t")), "left")
            .select("b.doc_id", "b.text", "c.cand"))
    found = (full.withColumn("w", words(F.col("text")))
             .withColumn("_r", F.expr(f"transform(cand, c -> struct(c.item AS item, {runs('w', 'c')} AS at))"))
             .withColumn("_r", F.filter("_r", lambda r: F.size(r["at"]) > 0)))
    none = F.expr("CAST(array() AS array<int>)")
    return found.select(
        "doc_id", "text", "w",
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.col("_r.at")))), none).alias("hits"),
        F.coalesce(F.array_sort(F.array_distinct(F.col("_r.item"))), F.expr("CAST(array() AS array<string>)")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row with counts and the digest of its items."""
    r = contamination(docs, benchmark)
    return r.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of which no word is hit, with their own columns."""
    bad = contamination(docs, benchmark).where(F.size("hits") > 0).select("doc_id", F.xxhash64("text").alias("_t")).distinct()
    d = docs.withColumn("_t", F.xxhash64("text")).alias("d")
    cond = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._t") == F.col("b._t"))
    return d.join(bad.alias("b"), cond, "left_anti").drop("_t")


#: Words, windows and hits again, straight from the definition.
SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""
