"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a maximal stretch of words with smallest period q (words q apart are equal)
and a length of at least max(6, 4 q).

The texts of a slice (a few megabytes; a longer text is a slice by itself) are one
sequence of word ids with a different separator after each text, and share a grammar.
Each round counts the pairs of neighbouring symbols and replaces, at once, all pairs that
stand twice or more and are more frequent than those they overlap; where no pair repeats,
what is left of each text is joined two by two. Every replaced place is a node of the
derivation: (rule, first word).

A run lies across the middle of the lowest node that contains it. So each rule is
searched once, at its first place, for the stretches across its middle b. If at least half
of a run lies behind b, its first two words behind b stand q further on again; these q
are looked up in the sorted places of each pair of words. With f equal words from b and
b + q on, all greater q up to f are multiples of q or can't be smallest periods
(Fine and Wilf), and are passed over; so the few periods of a middle are found with few
look-ups. The mirrored text gives the runs with more than half before the middle. What is
found is carried to all places of the rule, and stretches that go on there are dropped:
the whole run is found in the node above.

Cases: null and empty texts have no words and no runs; repeated rows give equal rows; a
null doc_id has no planted repetition; an empty table gives no rows;
columns besides id and text are ignored. Memory is about 150 bytes for each word of a slice.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapewise.llm.common import map_texts, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words compared at a time, at first and at most, where a stretch is followed.
STEP, MOST_STEP = 8, 1 << 14


def _pairs_met(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of neighbours: its number, whether it may be replaced, and how often it stands."""
    key = s[:-1] * (int(s.max()) + 1) + s[1:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    # in a row of one symbol, every second pair overlaps the one before
    place = np.arange(len(key))
    begin = np.ones(len(key), dtype=bool)
    begin[1:] = number[1:] != number[:-1]
    free = (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
    return number, free, np.bincount(number[free], minlength=int(number.max()) + 1)


def grammar(words: np.ndarray, n_symbols: int, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Re-Pair of ``words``, whose texts end before the separators at ``cuts``.

    Returns the rules' first, middle and end word at their first place, and for every
    node of the derivation its rule and first word.
    """
    s, at, end = words.astype(np.int64), np.arange(len(words)), len(words)
    low, mid, high, rule_of, place_of, rules = [], [], [], [], [], 0
    separator = np.zeros(len(words), dtype=bool)
    separator[cuts] = True
    while len(s) > 1:
        number, free, count = _pairs_met(s)
        often = np.where(free, count[number], 0)
        often[often < 2] = 0
        # ties by scrambled numbers: in the order of the text, only the last pair of a repeated passage would win
        rank = (often << 32) | ((number * 2654435761) & 0xFFFFFFFF)
        best = often > 0
        best[1:] &= rank[1:] > np.where(free[:-1], rank[:-1], -1)
        best[:-1] &= rank[:-1] > np.where(free[1:], rank[1:], -1)
        used = np.bincount(number[best], minlength=len(count))
        best &= used[number] > 1
        i = np.flatnonzero(best)
        if not len(i):
            break
        found, first, which = np.unique(number[i], return_index=True, return_inverse=True)
        low.append(at[i[first]])
        mid.append(at[i[first] + 1])
        high.append(np.append(at, end)[i[first] + 2])
        rule_of.append(rules + which)
        place_of.append(at[i])
        s[i] = n_symbols + rules + which
        rules += len(found)
        gone = np.zeros(len(s), dtype=bool)
        gone[i + 1] = True
        s, at = s[~gone], at[~gone]
    # the rest of each text, two by two: nodes that stand once
    text = np.searchsorted(cuts, at)
    inside = ~separator[at]
    at, text = at[inside], text[inside]
    while True:
        index = np.arange(len(at))
        begin = np.ones(len(at), dtype=bool)
        begin[1:] = text[1:] != text[:-1]
        even = (index - np.maximum.accumulate(np.where(begin, index, 0), dtype=np.int64)) % 2 == 0 if len(at) else begin
        i = np.flatnonzero(even[:-1] & ~begin[1:]) if len(at) > 1 else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        after = np.where(np.append(begin[1:], True), cuts[text], np.append(at[1:], 0))  # where each part ends
        low.append(at[i])
        mid.append(at[i + 1])
        high.append(after[i + 1])
        rule_of.append(rules + np.arange(len(i)))
        place_of.append(at[i])
        rules += len(i)
        keep = np.ones(len(at), dtype=bool)
        keep[i + 1] = False
        at, text = at[keep], text[keep]
    none = [np.zeros(0, dtype=np.int64)]
    return tuple(np.concatenate(x or none) for x in (low, mid, high, rule_of, place_of))


def _equal_words(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, ``most`` at most."""
    out, step = np.zeros(len(a), dtype=np.int64), STEP
    live = np.flatnonzero(most > 0)
    while len(live):
        k = np.arange(step)
        x = np.minimum(out[live, None] + k, most[live, None])
        inside = x < most[live, None]
        x = np.where(inside, x, 0)
        equal = (words[a[live, None] + x] == words[b[live, None] + x]) & inside
        whole = equal.all(axis=1)
        out[live] += np.where(whole, step, np.argmin(equal, axis=1))
        live = live[whole]
        step = min(step * 2, max(STEP, MOST_STEP // max(1, len(live))))
    return out


class Pairs:
    """The places of each pair of neighbouring words, in order."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        key = words[:-1] * (int(words.max()) + 1) + words[1:]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        group = np.cumsum(new) - 1
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = group
        self.order, self.sorted = order, group * self.n + order

    def next(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place at or behind ``least`` with the same pair as ``at``; n where there is none."""
        k = np.searchsorted(self.sorted, self.group[at] * self.n + least)
        place = self.order[np.minimum(k, len(self.order) - 1)]
        return np.where((k < len(self.order)) & (self.group[place] == self.group[at]) & (least < self.n), place, self.n)


def _across(words: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of stretches across the middles that have half of their length behind them."""
    pairs, back = Pairs(words), words[::-1]
    n, out = len(words), []
    live = np.flatnonzero((high - low >= LEAST_LENGTH) & (high - mid >= 3))
    least = np.ones(len(live), dtype=np.int64)
    while len(live):
        b, h = mid[live], high[live]
        place = pairs.next(b, b + least)
        q = place - b
        ok = (place < n) & (2 * q <= h - b) & (LEAST_EXPONENT * q <= h - low[live])
        live, b, h, q = live[ok], b[ok], h[ok], q[ok]
        f = _equal_words(words, b, b + q, h - b - q)
        half = np.flatnonzero(f >= q)
        g = _equal_words(back, n - b[half], n - b[half] - q[half], b[half] - low[live[half]])
        length = g + f[half] + q[half]
        good = (g > 0) & (length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * q[half]))
        k = half[good]
        out.append((live[k], b[k] - g[good], b[k] + f[k] + q[k], q[k]))
        least = np.maximum(q, f) + 1
    return tuple(np.concatenate([x[c] for x in out] or [np.zeros(0, dtype=np.int64)]) for c in range(4))


def find_runs(words: np.ndarray, n_symbols: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence of texts, by start and period."""
    n = len(words)
    low, mid, high, rule_of, place_of = grammar(words, n_symbols, cuts)
    none = np.zeros(0, dtype=np.int64)
    if not len(low):
        return none, none, none
    rule, start, end, q = _across(words, low, mid, high)
    rule2, start2, end2, q2 = _across(np.ascontiguousarray(words[::-1]), n - high, n - mid, n - low)
    rule, start, end, q = (np.concatenate(x) for x in ((rule, rule2), (start, n - end2), (end, n - start2), (q, q2)))
    if not len(rule):
        return none, none, none
    # to all places of the rules
    order = np.argsort(rule_of, kind="stable")
    first = np.searchsorted(rule_of[order], np.arange(len(low) + 1))
    times = first[rule + 1] - first[rule]
    which = np.repeat(np.arange(len(rule)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    shift = place_of[order[first[rule[which]] + nth]] - low[rule[which]]
    s, e, p = start[which] + shift, end[which] + shift, q[which]
    ends = ((s == 0) | (words[s - 1] != words[s - 1 + p])) & (words[np.minimum(e, n - 1)] != words[e - p])
    found = np.unique(np.stack([s[ends], p[ends], e[ends]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the planted repetition: every tenth id ends in one."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // len(period) + 1))[:n - a]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, given as words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    ids = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    n_words = len(ids.dictionary)
    where = np.repeat(np.arange(len(texts)), sizes)
    sequence = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
    sequence[np.arange(len(where)) + where] = ids.indices.to_numpy(zero_copy_only=False)
    cuts = np.cumsum(sizes + 1) - 1
    sequence[cuts] = n_words + np.arange(len(texts))
    s, e, q = find_runs(sequence, n_words + len(texts), cuts)
    doc = np.searchsorted(cuts, s)
    begin = np.append(0, cuts[:-1] + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, row in zip(doc.tolist(), zip((s - begin[doc]).tolist(), (e - s).tolist(), q.tolist(), strict=True), strict=True):
        out[d].append(row)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, x in zip(words, np.cumsum(gone[:-1]).tolist()) if not x]


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_RUN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns runs (array of start, length, period in words) and collapsed (the text without what they repeat)."""
    fields = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]

    def make():
        def compute(texts: list[str | None]) -> list[pa.Array]:
            words = [(t or "").encode().split() for t in texts]
            runs = runs_of(words)
            names = ("start", "length", "period")
            return [pa.array([[dict(zip(names, x)) for x in r] for r in runs], _RUN_ARROW),
                    pa.array([None if t is None else b" ".join(collapsed(w, r)).decode() for t, w, r in zip(texts, words, runs, strict=True)], pa.string())]
        return compute

    return map_texts(df, text, df.columns if keep is None else keep, fields, make)


def digests(doc_ids: list[int | None], texts: list[str | None]) -> list[list]:
    """For each document: n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    words = [periodic((t or "").encode().split(), d) for d, t in zip(doc_ids, texts, strict=True)]  # bytes.split() parts at \x20 and \x09-\x0D
    out = []
    for w, runs in zip(words, runs_of(words), strict=True):
        top = runs[0] if runs else (None, None, None)
        for r in runs[1:]:  # exact comparison of length / period; runs are by start and period
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append([len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()])
    return out


def report(docs: DataFrame) -> DataFrame:
    """Per document the count of runs, the one of most repetitions, and digests."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    own = docs.select("doc_id", "text")
    schema = T.StructType([own.schema["doc_id"], *[T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in names]])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows = digests(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                columns = [pa.array([r[k] for r in rows], pa.string() if n.endswith("sha256") else pa.int64()) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *names])

    return own.mapInArrow(run, schema)
