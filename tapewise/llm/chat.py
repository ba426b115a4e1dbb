"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function of a list of (role, text) turns. For each conversation the
successive prefixes of its turns are rendered. While an output begins with the output
before it, the rest is the span of the new turn. Where the text lies inside a span is
found by rendering the turn with two other texts: they part exactly where a text
begins, and what follows them is what follows the text. A prefix whose output doesn't
begin with the one before shows a template that rewrites history; such conversations
are flagged, and have no spans, since a mask made of them would be wrong.

The templates here mark turns and escape their own control strings inside roles and
texts: in ``<`` + backslashes + ``|``, one backslash is added, which is undone on
reading back.

A conversation is one record and is rendered in one task; different conversations
spread over all tasks. Rendering the prefixes of n turns costs n times the length.

Cases: null roles and texts are empty; rows are ordered by turn (null first), then role
and text; repeated rows are turns of their own; a null conv_id is a conversation; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
#: Fixed values of the format.
START, SAYS, END = "<|start|>", "<|says|>", "<|end|>\n"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
PROBES = ("a", "b")


def escape(s: str) -> str:
    return _CONTROL.sub(r"<\1\\|", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"<\1|", s)


def tagged(turns: Turns) -> str:
    """Every turn between marks; a prefix of the turns renders to a prefix of the output."""
    return "".join(f"{START}{escape(r)}{SAYS}{escape(t)}{END}" for r, t in turns)


def last_answer_only(turns: Turns) -> str:
    """A template that rewrites history: earlier assistant texts lose their reasoning part."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return tagged([(r, t.rpartition("</think>")[2] if r == "assistant" and i != last else t) for i, (r, t) in enumerate(turns)])


def render_incrementally(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The output, (span start, text start, text end, span end) of each turn, and whether history was rewritten."""
    before, spans, rewritten = template([]), [], False
    for k, (role, _) in enumerate(turns):
        now = template(turns[:k + 1])
        if not now.startswith(before):
            rewritten = True
        elif not rewritten:
            a, b = (template([*turns[:k], (role, p)]) for p in PROBES)
            start = len(before) + len(commonprefix([a[len(before):], b[len(before):]]))
            after = len(a) - start - len(PROBES[0])
            spans.append((len(before), start, len(now) - after, len(now)))
        before = now
    return before, [] if rewritten else spans, rewritten


def format_conversations(rows: DataFrame, template: Template = tagged, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, spans, rewrites_history.

    ``spans`` holds role, start, end, text_start, text_end (code points) and whether the
    loss mask covers the text: it does for turns of the role ``learned``.
    """
    grouped = (rows.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_row"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
        .select("conv_id", F.col("_rows.role").alias("roles"), F.col("_rows.text").alias("texts")))
    names = ["role", "start", "end", "text_start", "text_end", "loss"]
    kinds = [T.StringType(), *[T.LongType()] * 4, T.BooleanType()]
    span = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    schema = T.StructType([grouped.schema["conv_id"], T.StructField("formatted", T.StringType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("rewrites_history", T.BooleanType())])
    arrow = pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in names[1:5]], ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                turns = list(zip(b.column("roles")[i].as_py(), b.column("texts")[i].as_py(), strict=True))
                out, spans, rewritten = render_incrementally(turns, template)
                marks = [{"role": r, "start": a, "end": d, "text_start": s, "text_end": e, "loss": r == learned}
                         for (r, _), (a, s, e, d) in zip(turns, spans)]
                yield pa.RecordBatch.from_arrays([b.column("conv_id").slice(i, 1), pa.array([out], pa.string()),
                                                  pa.array([marks], arrow), pa.array([rewritten], pa.bool_())], names=schema.names)

    return grouped.mapInArrow(run, schema)


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a text formatted by ``tagged``."""
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1\|")

    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x.startswith(START))
    return F.transform(parts, lambda x: F.struct(
        plain(F.split_part(F.substring(x, len(START) + 1, 1 << 30), F.lit(SAYS), F.lit(1))).alias("role"),
        plain(F.split_part(x, F.lit(SAYS), F.lit(2))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    masked = F.filter(spans, lambda s: s["loss"])
    cut = F.transform(masked, lambda s: F.regexp_replace(
        F.substring(formatted, (s["text_start"] + 1).cast("int"), (s["text_end"] - s["text_start"]).cast("int")), r"<\\(\\*)\|", r"<$1\|"))
    return F.array_join(cut, "")


def report(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    extra = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    r = format_conversations(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
                             .unionByName(extra))
    r = r.withColumn("_turns", read_back(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("spans")))
    both = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(both, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "rewrites_history")


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS joined,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
      string_agg('<|start|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || '<|says|>' || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10), ''
                 ORDER BY turn NULLS FIRST, role, text) AS f FROM r GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(joined) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(length(f) AS BIGINT) AS formatted_chars, false AS rewrites_history FROM g"""
