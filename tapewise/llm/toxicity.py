"""Toxicity by a classifier chain with out-of-fold predictions.

Categories are predicted one after the other by linear (logistic) models over hashed
words; each link of the chain also sees the log-odds of the categories before it. A
link is fitted on what its predecessors would say about documents they haven't seen:
the training rows are dealt into folds, and each fold's earlier probabilities come from
models fitted on the other folds. For new documents, the models fitted on all training
rows give the earlier probabilities. A category's threshold is the one that does best
(F1) on the out-of-fold probabilities.

Words are weighted by their smoothed log-odds in the training rows of the category
before the fit, so that rare words have little to say. The models are fitted on a
bounded sample of labelled documents (``TRAIN_ROWS``), chosen by a hash of doc_id; all
documents are scored, over their whole texts.

Cases: null and wordless texts score the base rate of each link; labels that are null
don't count; a category without both classes in the sample is predicted by its rate,
and not flagged; a doc_id labelled twice is learned twice; repeated rows score alike;
columns besides id, text and labels are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import map_texts

TRAIN_ROWS = 4_000
BUCKETS = 1 << 17
FOLDS = 4
WORD = re.compile(r"[^\W\d_]+")
#: The chain: names and how each is read from the label columns.
CHAIN = ("low_quality", "toxic")
REMEMBERED = 300_000
#: Lengths of word beginnings that are features, so that inflected and joined words count.
STARTS = (4, 5, 6)


class Words:
    """Distinct hashed words of texts and beginnings of words, remembered for short words."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.starts: dict[str, int] = {}

    @staticmethod
    def bucket(s: str) -> int:
        return zlib.crc32(s.encode("utf-8", "replace")) % BUCKETS

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        starts = {w[:n] for w in words for n in STARTS if len(w) > n}
        for known, new, mark in ((self.known, words, ""), (self.starts, starts, "^")):
            if len(known) > REMEMBERED:
                known.clear()
            for w in new.difference(known):
                known[w] = self.bucket(mark + w)
        both = [*map(self.known.__getitem__, words), *map(self.starts.__getitem__, starts)]
        return np.unique(np.array(both, dtype=np.int32))


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.scale = 1 / np.sqrt(np.maximum(self.size, 1))

    def pick(self, at: np.ndarray) -> Rows:
        ends = np.cumsum(self.size)
        return Rows([self.flat[ends[i] - self.size[i]:ends[i]] for i in at.tolist()])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.flat], minlength=len(self.size)) * self.scale

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=(r * self.scale)[self.row], minlength=BUCKETS)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Link:
    """One logistic model over weighted words and earlier log-odds."""

    def __init__(self, x: Rows, extra: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 0.1):
        self.rate = float(y.mean()) if len(y) else 0.0
        self.learned = bool(len(y)) and 0 < self.rate < 1
        if not self.learned:
            return
        with_word = x.back(y / x.scale) + 0.5
        all_words = np.bincount(x.flat, minlength=BUCKETS) + 1.0
        share = with_word / all_words
        odds = np.log(share / (1 - share)) - np.log(self.rate / (1 - self.rate))
        seen = all_words - 1
        self.weight = odds * (seen / (seen + 5.0))  # a word of few documents says little
        balance = np.where(y > 0, 0.5 / self.rate, 0.5 / (1 - self.rate))
        w, e, b = np.zeros(BUCKETS), np.zeros(extra.shape[1]), 0.0
        vw, ve, vb = w.copy(), e.copy(), 0.0
        curve = max(1e-6, float(np.mean(x.dot(self.weight ** 2))))
        step = 1.0 / curve
        for _ in range(steps):
            z = x.dot(self.weight * (w + 0.9 * vw)) + extra @ (e + 0.9 * ve) + b + 0.9 * vb
            r = balance * (sigmoid(z) - y) / len(y)
            vw = 0.9 * vw - step * (self.weight * x.back(r) + decay * w / len(y))
            ve = 0.9 * ve - 0.2 * (extra.T @ r)
            vb = 0.9 * vb - 0.5 * r.sum()
            w, e, b = w + vw, e + ve, b + vb
        self.w, self.e, self.b = self.weight * w, e, b

    def scores(self, x: Rows, extra: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        if not self.learned:
            p = min(max(self.rate, 1e-6), 1 - 1e-6)
            return np.full(len(x.size), np.log(p / (1 - p)))
        return x.dot(self.w) + extra @ self.e + self.b


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway between the scores it parts."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((score[order[k]] + score[order[k + 1]]) / 2) if k + 1 < len(y) else float(score[order[k]])


class Chain:
    """Links in order, each with its threshold."""

    def __init__(self, names: tuple[str, ...], x: Rows, ys: np.ndarray):
        """``ys`` has a column for each category; NaN where a row has no label."""
        self.names, self.links, self.cuts = names, [], []
        fold = np.arange(len(x.size)) % FOLDS
        earlier = np.zeros((len(x.size), 0))
        for k in range(len(names)):
            y = ys[:, k]
            have = ~np.isnan(y)
            seen = np.zeros(len(y))
            for f in range(FOLDS):
                fit, out = np.flatnonzero(have & (fold != f)), np.flatnonzero(fold == f)
                seen[out] = Link(x.pick(fit), earlier[fit], y[fit]).scores(x.pick(out), earlier[out])
            at = np.flatnonzero(have)
            link = Link(x.pick(at), earlier[at], y[at])
            self.links.append(link)
            self.cuts.append(best_threshold(seen[at], y[at]) if link.learned else np.inf)
            earlier = np.column_stack([earlier, np.clip(seen, -8, 8)])

    def predict(self, x: Rows) -> list[tuple[np.ndarray, np.ndarray]]:
        """Probability and flag of each category."""
        out, earlier = [], np.zeros((len(x.size), 0))
        for link, cut in zip(self.links, self.cuts):
            s = link.scores(x, earlier)
            out.append((sigmoid(s), s >= cut))
            earlier = np.column_stack([earlier, np.clip(s, -8, 8)])
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text",
        rows: int = TRAIN_ROWS) -> Chain:
    """A chain for the categories, read from the label columns in their order."""
    names = tuple(categories)
    lab = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), *[categories[n].cast("double").alias(f"_y{k}") for k, n in enumerate(names)])
    sample = lab.orderBy(F.xxhash64("_id"), *lab.columns).limit(rows)  # a bounded sample: broadcast below
    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(sample), "_id")

    def make():
        words = Words()
        return lambda texts: [pa.array([words(t).tobytes() for t in texts], pa.binary())]

    got = map_texts(some, "_t", ["_id", *lab.columns[1:]], [T.StructField("_w", T.BinaryType())], make).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"], bytes(r["_w"])))
    x = Rows([np.frombuffer(r["_w"], dtype=np.int32) for r in got])
    ys = np.array([[np.nan if r[f"_y{k}"] is None else r[f"_y{k}"] for k in range(len(names))] for r in got], dtype=float).reshape(len(got), len(names))
    return Chain(names, x, ys)


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns p_<category> and <category> (flag) beside the kept columns."""
    fields = [f for n in chain.names for f in (T.StructField(f"p_{n}", T.DoubleType()), T.StructField(n, T.BooleanType()))]

    def make():
        words = Words()

        def run(texts: list[str | None]) -> list[pa.Array]:
            x = Rows([words(t) for t in texts])
            return [a for p, flag in chain.predict(x) for a in (pa.array(p, pa.float64()), pa.array(flag, pa.bool_()))]
        return run

    return map_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the probabilities and flags of the chain."""
    chain = fit(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic")})
    return score(docs, chain, keep=["doc_id"])
