"""Conversation structure repair by iterative-deepening A*.

The turns of a conversation, in order, are edited until the initials of their roles
form ``(s?(ua)+)?``: an optional system turn, then user and assistant in turns. Edits:
Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate turns must
go), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.

``cheapest`` searches depth first, trying edits in ASCII order (D, I, K, R) under a cost
bound that rises to the least estimate that broke it. The estimate of what is to come
counts the turns that must go, the truncated ones, and one for each adjacent pair of
the other turns that can't follow one another: no edit costs less than one for each
pair it mends, so it is never too high. A state (turns read, last role) that fails leaves
in the table what its failure proved of its cost, for all later visits. The first
accepting path is thus the cheapest, and of equally cheap ones the ASCII-least.

Turns are dealt out by ranges of (conversation, turn, ...) and read as a sorted stream, so
a conversation may lie across tasks. One that lies whole in a task and has at most
``SEGMENT`` turns is searched at once. Others are cut into segments; each is searched
from every role it may begin after to every role it may end with, and a small fold over
the segments picks the cheapest way through, ties by the audit. So neither search nor
memory depends on the length of a conversation, save for its audit, which is one value,
and its digest, which is one sequential hash, computed as a stream.

Cases: null roles and texts are one space, a null conversation or turn is one space in
the damage key; null turns come first, turns of one number are ordered by role and text;
repeated rows are duplicates; roles beginning otherwise than s, u, a can't be kept; a
conversation without turns has no edits; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapewise.session import staged

#: Turns and characters of a segment.
SEGMENT, SEGMENT_CHARS = 512, 4_000_000
#: Results of a task are handed on in parts of so many conversations or characters.
OUT_ROWS, OUT_CHARS = 1_000, 4_000_000
WHITE = " \t\n\x0b\x0c\r"
BEGIN, GOALS = "^", ("^", "a")
NEXT = {"^": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
FOLLOWS = {"^s", "^u", "su", "ua", "au"}
DELETE, INSERT, REROLE = 3, 2, 2
SOUND, TRUNCATED, GOES = 0, 1, 2


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") and role else "x"


def cheapest(turns: list[tuple[str, int]], begin: str = BEGIN, goals: tuple[str, ...] = GOALS) -> tuple[int, str]:
    """(cost, audit) of turns (initial, SOUND | TRUNCATED | GOES) from the role ``begin`` to one of ``goals``.

    A goal must be reachable by inserts: u or a, or ``begin`` itself.
    """
    n = len(turns)
    certain, head, pairs = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        first, state = turns[i]
        if state == GOES:
            certain[i], head[i], pairs[i] = certain[i + 1] + DELETE, head[i + 1], pairs[i + 1]
        else:
            after = head[i + 1]
            certain[i], head[i] = certain[i + 1] + state, first
            pairs[i] = pairs[i + 1] + (first + after not in FOLLOWS if after else first not in goals)
    failed: dict[tuple[int, str], int] = {}

    def estimate(i: int, q: str) -> int:
        known = failed.get((i, q))
        if known is None:
            known = certain[i] + pairs[i] + (q + head[i] not in FOLLOWS if head[i] else q not in goals)
        return known

    def moves(i: int, q: str) -> Iterator[tuple[str, int, int, str]]:
        if i < n:
            yield "D", DELETE, i + 1, q
        yield "I", INSERT, i, NEXT[q]
        if i < n and turns[i][1] != GOES:
            first, state = turns[i]
            if q + first in FOLLOWS:
                yield "K", state, i + 1, first
            if first != NEXT[q]:
                yield "R", REROLE + state, i + 1, NEXT[q]

    bound = estimate(0, begin)
    while True:
        # a frame: turns read, last role, cost so far, moves left, least cost proved by its failed moves, the last move's cost
        stack, audit = [[0, begin, 0, moves(0, begin), 1 << 60, 0]], []
        while stack:
            top = stack[-1]
            i, q, spent, left = top[:4]
            if i == n and q in goals:
                return spent, "".join(audit)
            for edit, cost, j, r in left:
                to_come = cost + estimate(j, r)
                if spent + to_come <= bound:
                    top[5] = cost
                    audit.append(edit)
                    stack.append([j, r, spent + cost, moves(j, r), 1 << 60, 0])
                    break
                top[4] = min(top[4], to_come)
            else:
                failed[i, q] = max(failed.get((i, q), 0), top[4])
                stack.pop()
                if stack:
                    audit.pop()
                    stack[-1][4] = min(stack[-1][4], stack[-1][5] + failed[i, q])
        bound = failed[0, begin]


def passages(turns: list[tuple[str, int]]) -> list[tuple[str, str, int, str]]:
    """(begin, end, cost, audit) of every way a segment can be passed."""
    n, out = len(turns), []
    for q in (BEGIN, "s"):  # nothing but a kept system turn leads to s, and nothing to the beginning
        out.append((q, q, DELETE * n, "D" * n))
    kept = [(s, -i) for i, (first, s) in enumerate(turns) if first == "s" and s != GOES]
    if kept:
        s, i = min(kept)
        out.append((BEGIN, "s", DELETE * (n - 1) + s, "D" * -i + "K" + "D" * (n - 1 + i)))
    return out + [(q, r, *cheapest(turns, q, (r,))) for q in (BEGIN, "s", "u", "a") for r in ("u", "a")]


def edited(begin: str, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns (role, text)."""
    q, i, out = begin, 0, []
    for edit in audit:
        if edit in "IR":
            q = NEXT[q]
            out.append((NAMES[q], texts[i] if edit == "R" else ""))
        elif edit == "K":
            q = initial(roles[i])
            out.append((roles[i], texts[i]))
        i += edit != "I"
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the planted faults, and the number of copies of each (0: dropped)."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                    (F.crc32(key) % 20).alias("_d"))
    return r.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text) with copies, and the fault of their first copy.

    A row's first fault is blank, duplicate or truncated. Repeated rows are merged before
    the shuffle; the first of equal turns is found by a minimum for each, joined back.
    """
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns({
        "_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text"), "_turn": F.struct(F.col("turn").isNotNull().alias("x"), F.col("turn").alias("y"))})
    first = same.where((F.col("copies") > 0) & (bare != "")).groupBy("conv_id", "role", "_a", "_b").agg(F.min("_turn").alias("_first"))
    s, f = same.alias("s"), first.alias("f")
    met = s.join(f, F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("s.role") == F.col("f.role"))
                 & (F.col("s._a") == F.col("f._a")) & (F.col("s._b") == F.col("f._b")), "left")
    fault = F.when(bare == "", "blank").when(F.col("_turn") > F.col("_first"), "duplicate").when(
        ~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    return met.select("s.conv_id", "turn", "s.role", "text", "copies", fault.alias("fault"))


_LONGS = ("blank", "duplicate", "truncated", "illegal")
_MOVE = T.StructType([T.StructField("begin", T.StringType()), T.StructField("end", T.StringType()),
                      T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])


def _fields(conv, turn) -> list[T.StructField]:
    return [conv, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType()),
            T.StructField("low", turn), T.StructField("high", turn), T.StructField("turns", T.LongType()),
            *[T.StructField(c, T.LongType()) for c in _LONGS], T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
            T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("digest", T.StringType()),
            T.StructField("moves", T.ArrayType(_MOVE)), T.StructField("roles", T.ArrayType(T.StringType())),
            T.StructField("texts", T.ArrayType(T.StringType()))]


class _Segment:
    """The turns of a stretch of one conversation, as they are read."""

    def __init__(self):
        self.roles, self.texts, self.states, self.chars = [], [], [], 0
        self.counts = dict.fromkeys(_LONGS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        first = initial(role)
        if self.states:
            self.counts["illegal"] += self.states[-1][0] + first not in ("su", "ua", "au")
        if fault:
            self.counts[fault] += 1
        self.states.append((first, {"": SOUND, "truncated": TRUNCATED}.get(fault, GOES)))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self, whole: bool, keep: bool) -> dict:
        out = {"whole": whole, "low": self.low, "high": self.high, "turns": self.turns, **self.counts,
               "first": self.states[0][0] if self.states else None, "last": self.states[-1][0] if self.states else None}
        if whole:
            cost, audit = cheapest(self.states)
            lines = edited(BEGIN, audit, self.roles, self.texts)
            out |= {"cost": cost, "audit": audit, "digest": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()}
        else:
            out["moves"] = [dict(zip(("begin", "end", "cost", "audit"), m)) for m in passages(self.states)]
        if keep or not whole:
            out |= {"roles": self.roles, "texts": self.texts}
        return out


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, chars in rows:
        held.append(row)
        size += chars
        if len(held) >= OUT_ROWS or size >= OUT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def segments(rows: DataFrame, segment: int = SEGMENT, keep: bool = False) -> DataFrame:
    """Whole conversations with their repair, and the segments of the others with the ways through them."""
    schema = T.StructType(_fields(rows.schema["conv_id"], rows.schema["turn"].dataType))
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        part, seq, conv, own, alone = TaskContext.get().partitionId(), 0, None, None, False

        def closed(whole: bool) -> tuple[dict, int]:
            nonlocal seq
            seq += 1
            return {"conv_id": conv, "part": part, "seq": seq} | own.row(whole, keep), own.chars

        for b in batches:
            for c, turn, role, text, copies, fault in zip(*[b.column(k).to_pylist() for k in range(6)]):
                if own is None or c != conv:
                    if own is not None:
                        yield closed(alone)
                    alone = own is not None  # a task's first conversation may have begun in another
                    conv, own = c, _Segment()
                for k in range(copies):
                    if len(own.states) >= segment or own.chars >= SEGMENT_CHARS:
                        yield closed(False)
                        own, alone = _Segment(), False
                    own.add(turn, role, text, fault if k == 0 or fault == "blank" else "duplicate")
        if own is not None:
            yield closed(False)  # it may go on in another task

    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(lambda bs: _batches(read(bs), arrow), schema)


def _by_conversation(parts: DataFrame) -> DataFrame:
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    from itertools import groupby
    return groupby(_rows(batches), key=lambda r: r["conv_id"])


def ways(parts: DataFrame) -> DataFrame:
    """For each segment (part, seq) its begin role and audit; the last of a conversation has the totals."""
    schema = T.StructType([f for f in parts.schema if f.name not in ("whole", "first", "last", "moves", "roles", "texts", "digest", "audit", "low", "high", "turns")]
                          + [T.StructField("gaps", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("begin", T.StringType()), T.StructField("piece", T.StringType())])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for conv, own in _grouped(batches):
            best, steps, keys = {BEGIN: (0, "")}, [], []
            total, low, high, turns, last = dict.fromkeys(_LONGS, 0), None, None, 0, None
            for r in own:
                step = {}
                for m in r["moves"]:
                    if m["begin"] in best:
                        cost, audit = best[m["begin"]]
                        way = (cost + m["cost"], audit + m["audit"], m["begin"], m["audit"])
                        step[m["end"]] = min(step.get(m["end"], way), way)
                best = {q: w[:2] for q, w in step.items()}
                steps.append({q: w[2:] for q, w in step.items()})
                keys.append((r["part"], r["seq"]))
                for c in _LONGS:
                    total[c] += r[c]
                if last and r["first"]:
                    total["illegal"] += last + r["first"] not in ("su", "ua", "au")
                last = r["last"] or last
                turns += r["turns"] - (r["low"] is not None and r["low"] == high)
                low, high = r["low"] if low is None else low, high if r["high"] is None else r["high"]
            (cost, audit), q = min((best[g], g) for g in GOALS if g in best)
            pieces = []
            for step in reversed(steps):
                q, piece = step[q]
                pieces.append((q, piece))
            gaps = 0 if low is None else high - low + 1 - turns
            for k, ((part, seq), (begin, piece)) in enumerate(zip(keys, reversed(pieces))):
                row = {"conv_id": conv, "part": part, "seq": seq, "begin": begin, "piece": piece}
                if k == len(keys) - 1:
                    row |= {**total, "gaps": gaps, "cost": cost, "audit": audit}
                yield row, len(piece)

    narrow = parts.drop("roles", "texts", "digest", "audit")
    return _by_conversation(narrow).mapInArrow(lambda bs: _batches(fold(bs), arrow), schema)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal pairs, cost, audit, digest of the repaired turns.

    ``rows`` has conv_id, turn, role, text and copies (see ``damaged``).
    """
    parts = staged(segments(judged(rows), segment))
    names = ["conv_id", "gaps", *_LONGS, "cost", "audit", "repaired_sha256"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = parts.where("whole").select("conv_id", gaps.alias("gaps"), *_LONGS, "cost", "audit", F.col("digest").alias("repaired_sha256"))
    cut = parts.where("not whole")
    met = cut.select("part", "seq", "roles", "texts").join(ways(cut), ["part", "seq"])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in whole.schema]])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for _, own in _grouped(batches):
            sha, between = hashlib.sha256(), ""
            for r in own:
                lines = edited(r["begin"], r["piece"], r["roles"], r["texts"])
                if lines:
                    sha.update((between + "\n".join(f"{a}:{t}" for a, t in lines)).encode())
                    between = "\n"
            yield {k: r[k] for k in names[:-1]} | {"repaired_sha256": sha.hexdigest()}, len(r["audit"])

    split = _by_conversation(met.select("conv_id", "part", "seq", "gaps", *_LONGS, "cost", "audit", "begin", "piece", "roles", "texts"))
    return whole.unionByName(split.mapInArrow(lambda bs: _batches(digest(bs), arrow), schema))


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired turns: conv_id, (part, seq, position) in their order, role, text."""
    parts = staged(segments(judged(rows), segment, keep=True))
    whole = parts.where("whole").select("conv_id", "part", "seq", F.lit(BEGIN).alias("begin"), F.col("audit").alias("piece"), "roles", "texts")
    cut = parts.where("not whole")
    split = cut.select("part", "seq", "roles", "texts").join(ways(cut).select("conv_id", "part", "seq", "begin", "piece"), ["part", "seq"])
    all_parts = whole.unionByName(split)
    schema = T.StructType([*[all_parts.schema[c] for c in ("conv_id", "part", "seq")], T.StructField("position", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for r in _rows(batches):
            for k, (role, text) in enumerate(edited(r["begin"], r["piece"], r["roles"], r["texts"])):
                yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "position": k, "role": role, "text": text}, len(text)

    return all_parts.mapInArrow(lambda bs: _batches(turns(bs), arrow), schema)


def report(rows: DataFrame) -> DataFrame:
    """The repair of the damaged conversations."""
    return repair(damaged(rows))


SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * length(s)), lambda b: (CAST(ascii(substr(s, CAST(b // 8 + 1 AS BIGINT), 1)) AS BIGINT) >> CAST(b % 8 AS BIGINT)) & 1)),
           lambda x, y: xor(x >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS r FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
n AS (SELECT ids.conv_id, count(f.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
             count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM ids LEFT JOIN f ON ids.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY ids.conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '^' AS q, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS b FROM n
      UNION ALL
      SELECT conv_id, i, q, min(b) AS b FROM (
        SELECT z.conv_id, z.i + (CASE WHEN e.e = 'E' THEN 0 ELSE 1 END) AS i,
               CASE WHEN e.e IN ('D', 'E') THEN z.q WHEN e.e = 'K' THEN f.r ELSE z.nx END AS q,
               {'c': z.b.c + CASE e.e WHEN 'D' THEN 3 WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.e IN ('K', 'R') AND f.fault = 't' THEN 1 ELSE 0 END,
                'a': z.b.a || e.e,
                't': CASE e.e WHEN 'D' THEN z.b.t WHEN 'K' THEN z.b.t || f.role || ':' || f.text || chr(10)
                     ELSE z.b.t || CASE z.nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END} AS b
        FROM (SELECT conv_id, i, q2 AS q, CASE q2 WHEN 'u' THEN 'a' ELSE 'u' END AS nx, b2 AS b FROM (
                SELECT conv_id, i, unnest([q, CASE q WHEN 'u' THEN 'a' ELSE 'u' END, CASE q WHEN 'u' THEN 'u' ELSE 'a' END]) AS q2,
                       unnest([b, {'c': b.c + 2, 'a': b.a || 'I', 't': b.t || CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10)},
                               {'c': b.c + 4, 'a': b.a || 'II', 't': b.t || CASE q WHEN 'u' THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10)}]) AS b2 FROM w)) z
        JOIN f ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = z.i + 1
        JOIN (VALUES ('D'), ('K'), ('R')) e(e) ON e.e = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.e = 'R' OR z.q || f.r IN ('^s', '^u', 'su', 'ua', 'au')))) GROUP BY conv_id, i, q),
l AS (SELECT n.conv_id, min(CASE q WHEN 's' THEN {'c': b.c + 4, 'a': b.a || 'II', 't': b.t || 'user:' || chr(10) || 'assistant:' || chr(10)}
                          WHEN 'u' THEN {'c': b.c + 2, 'a': b.a || 'I', 't': b.t || 'assistant:' || chr(10)} ELSE b END) AS b
      FROM n JOIN w ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n GROUP BY n.conv_id)
SELECT n.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(l.b.c AS BIGINT) AS cost, l.b.a AS audit,
       sha256(CASE WHEN l.b.t = '' THEN '' ELSE left(l.b.t, length(l.b.t) - 1) END) AS repaired_sha256
FROM n JOIN l ON n.conv_id IS NOT DISTINCT FROM l.conv_id"""
