"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary linear classifier over
hashed byte n-grams of the lower-case text predicts it. A text is decoded to the
codeword of the least loss: each bit adds its logistic loss, weighted by how well that
bit is predicted on rows kept aside from the fit. The score is the share of the best
codeword in the soft minimum of losses; a text whose two best codewords lie close
together is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``), an
equal share of each language, chosen by a hash; everything else sees all rows. Whole
texts are counted, in slices of bounded size.

Cases: null texts and texts without a letter are ``und`` with score 0; if nothing can
be learned (no labelled row with a letter), all are; with a single language, every text
with a letter gets it. Rows with a null doc_id are not learned from and count as not
held out. Repeated rows get equal predictions; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import PART_BYTES, PART_ROWS, forget, give_back, map_texts

TRAIN_ROWS = 2_000
BUCKETS = 4096
UNDETERMINED = "und"
#: Below this lead of the best codeword's share over the second, a text is ambiguous.
AMBIGUOUS = 0.1
#: Texts scored below this are rejected as a corpus filter.
LEAST_SCORE = 0.35
HELD_OUT = 2
LETTER = re.compile(r"[^\W\d_]")
#: Bytes below "a" that are no letters of lower-case text become spaces.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def features(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of the square roots of hashed 2- and 3-gram counts, a row for each text."""
    raw = [(t or "").lower().encode("utf-8", "replace") + b"   " for t in texts]
    b = FOLD[np.frombuffer(b" ".join(raw), dtype=np.uint8)].astype(np.uint32)
    lengths = np.array([len(r) + 1 for r in raw])
    row = np.repeat(np.arange(len(raw), dtype=np.int64), lengths)[: b.size]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    blank = np.flatnonzero((b[:-2] == 32) & (b[1:-1] == 32))
    out = np.zeros((len(raw), BUCKETS), dtype=np.float32)
    for gram, seed in ((two[:-1], 0x9E3779B1), (three, 0x85EBCA6B)):
        at = ((gram * np.uint32(seed)) >> np.uint32(20)).astype(np.int64) + row[:-2] * BUCKETS
        at = np.delete(at, blank)
        out += np.bincount(at, minlength=out.size).reshape(out.shape)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def codewords(n: int) -> np.ndarray:
    """Codewords of n classes, a row of +1 and -1 each.

    All splits of the classes in two for up to five classes; beyond, columns drawn with
    a fixed seed, the draw with the largest least distance between rows.
    """
    if n == 1:
        return np.ones((1, 1), dtype=np.int8)
    if n <= 5:
        cols = [c for c in product((1, -1), repeat=n) if c[0] == 1 and min(c) == -1]
        return np.array(cols, dtype=np.int8).T
    width, rng = 15 + 4 * int(np.ceil(np.log2(n))), np.random.default_rng(n)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        code[0] = 1
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -width)
        least = (width - agree.max()) // 2
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


def fit_bits(x: np.ndarray, bits: np.ndarray, steps: int = 120, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights and intercepts of all bits at once, by accelerated gradient steps."""
    w = np.zeros((x.shape[1], bits.shape[1]), dtype=np.float32)
    b = np.zeros(bits.shape[1], dtype=np.float32)
    vw, vb = w.copy(), b.copy()
    for k in range(steps):
        aw, ab = w + 0.9 * vw, b + 0.9 * vb
        g = -bits / (1 + np.exp(np.clip(bits * (x @ aw + ab), -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ g / len(x) + decay * aw)
        vb = 0.9 * vb - rate * 0.1 * g.mean(axis=0)
        w, b = w + vw, b + vb
    return w.astype(np.float32), b.astype(np.float32)


class Model:
    """Languages, codewords, bit classifiers and bit weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        if len(languages) < 2:
            return
        self.code = codewords(len(languages)).astype(np.float32)
        aside = np.arange(len(x)) % 5 == 4
        w, b = fit_bits(x[~aside], self.code[y[~aside]])
        right = ((x[aside] @ w + b) * self.code[y[aside]] > 0).mean(axis=0) if aside.any() else np.ones(self.code.shape[1])
        self.trust = (np.clip(2 * right - 1, 0.05, 1) / len(right)).astype(np.float32) * self.code.shape[1]
        self.w, self.b = fit_bits(x, self.code[y])

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The share of each language for each row."""
        f = x @ self.w + self.b
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lettered = np.array([bool(t) and LETTER.search(t) is not None for t in texts], dtype=bool)
        names, scores, doubt = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        at = np.flatnonzero(lettered)
        if not self.languages or not len(at):
            return names, scores, doubt
        if len(self.languages) == 1:
            share = np.ones((len(at), 1))
        else:
            share = self.shares(features([texts[i] for i in at]))
        order = np.sort(share, axis=1)
        lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        for i, k, s, d in zip(at.tolist(), share.argmax(axis=1).tolist(), order[:, -1].tolist(), lead.tolist()):
            names[i], scores[i], doubt[i] = self.languages[k], float(min(1.0, s)), d < AMBIGUOUS
        return names, scores, doubt


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of all fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages of the labelled documents that are not held out."""
    usable = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_l")) \
        .where(F.col("_id").isNotNull() & F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}") & ~held_out(F.col("_id")))
    counts = {r[0]: r[1] for r in usable.groupBy("_l").count().collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, int))
    languages = sorted(counts)
    share = max(20, rows // len(languages))
    limit = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.5 * share / counts[k]))])
    drawn = F.pmod(F.xxhash64("_t", "_id"), F.lit(1 << 20)) / float(1 << 20)
    some = usable.where(drawn < F.element_at(limit, F.col("_l"))).select("_l", "_t", drawn.alias("_d"))

    def make():
        return lambda texts: [pa.array([v.tobytes() for v in features(texts).astype(np.float16)], pa.binary())]

    got = map_texts(some, "_t", ["_l", "_d"], [T.StructField("_x", T.BinaryType())], make, PART_BYTES, PART_ROWS).orderBy("_d", "_l", "_x").limit(2 * max(rows, share * len(languages))).collect()
    taken: dict[str, int] = {}
    xs, ys = [], []
    for r in got:
        if taken.get(r["_l"], 0) < share:
            taken[r["_l"]] = taken.get(r["_l"], 0) + 1
            xs.append(np.frombuffer(r["_x"], dtype=np.float16))
            ys.append(languages.index(r["_l"]))
    if not xs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, int))
    return Model(languages, np.stack(xs).astype(np.float32), np.array(ys))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns lang_pred, score and ambiguous beside the kept columns."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]

    def make():
        return lambda texts: [pa.array(c, t) for c, t in zip(model.predict(texts), (pa.string(), pa.float64(), pa.bool_()), strict=True)]

    return map_texts(docs, text, docs.columns if keep is None else keep, fields, make, PART_BYTES, PART_ROWS)


def report(docs: DataFrame) -> DataFrame:
    """The predicted language of every document."""
    r = identify(docs, fit(docs), keep=["doc_id"])
    return r.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose language can be told, with their own columns.

    Python sees the texts alone and answers yes or no, so no text comes back from it.
    """
    model = fit(docs, text=text)

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            items, out, a = texts.tolist(), [], 0
            while a < len(items):  # so many rows and characters at a time
                b, size = a + 1, len(items[a] or "")
                while b < len(items) and b - a < PART_ROWS and size + len(items[b] or "") <= PART_BYTES:
                    size += len(items[b] or "")
                    b += 1
                names, scores, _ = model.predict(items[a:b])
                out += [n != UNDETERMINED and s >= LEAST_SCORE for n, s in zip(names, scores, strict=True)]
                a = b
            yield pd.Series(out, dtype=bool)
        give_back()

    return docs.where(told(F.col(text)))
