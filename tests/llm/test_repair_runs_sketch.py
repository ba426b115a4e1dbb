"""Conversation repair, periodic runs and fingerprints against brute-force versions on odd cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tapewise.llm import repair, runs, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# conversation repair

def least_edits(turns):
    """Cheapest (cost, audit, lines) by filling in every prefix, with up to two inserts before each turn."""
    names, after = {"u": "user", "a": "assistant"}, {"^": "u", "s": "u", "u": "a", "a": "u"}
    best = {"^": (0, "", ())}

    def inserts(states):
        out = dict(states)
        for q, (c, a, t) in states.items():
            for _ in range(2):
                q = after[q]
                c, a, t = c + 2, a + "I", (*t, names[q] + ":")
                out[q] = min(out.get(q, (c, a, t)), (c, a, t))
        return out

    for role, text, fault in turns:
        step = {}
        for q, (c, a, t) in inserts(best).items():
            ways = [(q, (c + 3, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                r = role[:1] if role[:1] in ("s", "u", "a") else "x"
                if q + r in ("^s", "^u", "su", "ua", "au"):
                    ways.append((r, (c + more, a + "K", (*t, f"{role}:{text}"))))
                ways.append((after[q], (c + 2 + more, a + "R", (*t, f"{names[after[q]]}:{text}"))))
            for k, w in ways:
                step[k] = min(step.get(k, w), w)
        best = step
    last = inserts(best)
    return min(last[q] for q in ("^", "a") if q in last)


def brute_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            turns += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        judged, seen, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            judged.append((role, text, fault))
        first = [r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = least_edits(judged)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "assistant"], ["Yes.", "No!", "so so", " \t\n", None, "", "Why?", "été。", "x" * 3000 + "."]
    rows = [(c, None if rng.random() < 0.05 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{t} {rng.random()}.")
            for c in range(60) for t in range(rng.randint(1, 14))]
    rows += [(None, 1, "user", "Hm?"), (None, 2, "assistant", "Hm."), (None, None, None, None), (70, None, "user", "a"), (70, None, "user", "a"), (71, 5, "x", "y")]
    rows += [(80, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(90)]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("own") for c in ("copies", "fault", "_d", "part", "seq", "audit", "begin", "first")})


@pytest.mark.parametrize("segment", [512, 4])
def test_repair(spark, conversations, segment):
    got = repair.repair(repair.damaged(conversations), segment).collect()
    want = brute_repair(odd_conversations())
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want
    assert repair.report(conversations.where("false")).collect() == []


def test_repaired_turns(conversations):
    whole = {}
    for r in repair.repaired_turns(repair.damaged(conversations), 4).collect():
        whole.setdefault(r["conv_id"], []).append((r["part"], r["seq"], r["position"], f"{r['role']}:{r['text']}"))
    want = brute_repair(odd_conversations())
    empty = hashlib.sha256(b"").hexdigest()
    got = {c: hashlib.sha256("\n".join(x[3] for x in sorted(v)).encode()).hexdigest() for c, v in whole.items()}
    assert got == {c: w[7] for c, w in want.items() if w[7] != empty}


def test_search_is_cheapest_and_least():
    rng = random.Random(2)
    for _ in range(3000):
        turns = [(rng.choice("ssuuuaaax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 9))]
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
        want = least_edits([(names[r], "t", ["", "truncated", "blank"][s]) for r, s in turns])
        assert repair.cheapest(turns) == want[:2]


def test_search_on_long_conversations():
    rng = random.Random(3)
    turns = [(rng.choice("ua"), rng.choice([0, 0, 1, 2])) for _ in range(500)]
    names = {"u": "user", "a": "assistant"}
    assert repair.cheapest(turns) == least_edits([(names[r], "t", ["", "truncated", "blank"][s]) for r, s in turns])[:2]


# periodic runs

def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                out.append((s, i + q - s, q))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(rng):
    n, names = rng.randint(0, 80), [c.encode() for c in "abcde"[:rng.choice([1, 2, 2, 3, 5])]]
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice(names) for _ in range(n)]
    if kind < 0.7:
        w = []
        while len(w) < n:
            w += [rng.choice(names) for _ in range(rng.randint(1, 7))] * rng.randint(1, 9)
        return w[:n]
    a, b = [b"a"], [b"b"]  # Fibonacci words hold as many runs as any
    while len(b) < n:
        a, b = b, b + a
    return b[:n] if kind < 0.85 else (b[:max(1, n // 8)] * 9)[:n]


def test_runs_are_those_of_all_periods():
    rng = random.Random(7)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(1, 10))]
        assert runs.runs_of(texts) == [brute_runs(w) for w in texts]


def test_runs_in_long_texts():
    assert runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    phrase = [b"%d" % i for i in range(1000)]
    assert runs.runs_of([[b"x", *(phrase * 40), b"y"], [], phrase]) == [[(1, 40_000, 1000)], [], []]


def test_runs_report(spark):
    texts = [(i, " ".join(f"w{k % (i % 7 + 1)}" for k in range(3 * i))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \n\t"), (103, "a " * 5), (103, "a " * 6), (None, "b  " * 8), (104, "p q " * 4 + "r " * 30), (105, "é\x0bé\x0c" * 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("runs", "start", "collapsed", "n_runs")})
    want = []
    for d, t in texts:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((d, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    key = str
    assert sorted(map(tuple, runs.report(docs).collect()), key=key) == sorted(want, key=key)
    assert runs.report(docs.where("false")).collect() == []
    found = {r["doc_id"]: r for r in runs.find(docs).collect()}
    assert found[104]["collapsed"] == "p q r" and [tuple(x) for x in found[104]["runs"]] == [(0, 8, 2), (8, 30, 1)] and found[100]["collapsed"] is None


# fingerprints

def shingle_set(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def shingle_hash(s):
    h = 0
    for c, w in zip(sketch.PLACES, s):
        bits = hashlib.md5(w.encode()).hexdigest()
        h ^= (int(bits[:16], 16) * c + int(bits[16:], 16)) % (1 << 64)
    return h


def brute_sketch(t, k=sketch.K):
    return sorted({shingle_hash(s) for s in shingle_set(t)})[:k]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    names = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.choice([0, 1, 3, 5, 40, 400])))) for i in range(40)]
    rows += [(50, rows[5][1]), (51, rows[5][1]), (51, "two texts of one id are neighbours"), (None, None), (None, "no id at all here"), (60, None), (61, "日本 語 x Y Z é")]
    return rows


def test_fingerprints(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("range", "extra", "head", "fingerprint", "to")})
    got = sorted((tuple(r) for r in sketch.report(docs).collect()), key=str)
    rows = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        a, b, c = brute_sketch(t), brute_sketch(e), brute_sketch(u)

        def alike(x, y):
            both = sorted(set(x) | set(y))[:sketch.K]
            return len(set(x) & set(y) & set(both)) / len(both) if both else 1.0

        def count(x):
            return float(len(x)) if len(x) < sketch.K else (sketch.K - 1) * 2.0**64 / x[-1]

        inside = min(1.0, alike(a, b) * count(sorted(set(a) | set(b))[:sketch.K]) / count(a)) if a else 1.0
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{h:016x}" for h in a), "".join(f"{h:016x}" for h in b),
                     alike(a, b), alike(a, c), count(a), inside))
    assert [g[:7] for g in got] == [w[:7] for w in sorted(want, key=str)]
    assert [g[7:] for g in got] == [pytest.approx(w[7:]) for w in sorted(want, key=str)]
    assert sketch.report(docs.where("false")).collect() == []
    alone = sketch.report(docs.where("doc_id = 61")).collect()
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 12)]


def test_sketches_of_parts_and_estimates(spark, texts, monkeypatch):
    whole = sketch.sketches([t for _, t in texts])
    monkeypatch.setattr(sketch, "PART", 7)
    assert [list(s) for s in sketch.sketches([t for _, t in texts])] == [list(s) for s in whole]
    monkeypatch.undo()
    docs = sketch.add_fingerprint(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("g", F.col("doc_id") % 3)
    union = {g: set() for g in (None, 0, 1, 2)}
    for d, t in texts:
        union[None if d is None else d % 3] |= shingle_set(t)
    got = {r["g"]: r["fingerprint"] for r in sketch.merge_by(docs.repartition(5), "g").collect()}
    assert got == {g: "".join(f"{h:016x}" for h in sorted(map(shingle_hash, s))[:sketch.K]) for g, s in union.items()}
    # estimates of large sets: four standard errors
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(6000)]
    a, b = sketch.sketches([" ".join(words[:4500]), " ".join(words[1500:])])
    assert abs(sketch.resemblance(a, b) - 0.5) < 4 * (0.25 / sketch.K) ** 0.5
    assert abs(sketch.distinct_shingles(a) / 4496 - 1) < 4 / sketch.K ** 0.5
    assert abs(sketch.containment(a, b) - 2 / 3) < 0.25
    pair = docs.where("doc_id = 50").select(F.col("fingerprint").alias("a"), F.lit("").alias("b"), F.lit(1).alias("resemblance"))
    r = sketch.compare(pair, "a", "b").first()
    assert (r["resemblance"], r["b_in_a"], r["a_in_b"], r["distinct_b"]) == ((0.0, 1.0, 0.0, 0.0) if texts[5][1] else (1.0, 1.0, 1.0, 0.0))
