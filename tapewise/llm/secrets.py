"""Secrets in texts: patterned spans, and strings that a tokenizer finds unlikely.

Three kinds are found by their form: values assigned to a secret's name, access key
ids, and long hexadecimal runs. Besides, a string of letters, digits and key symbols
that mixes letters with digits or small letters with capitals is a secret of kind
``token`` when a tiktoken vocabulary needs many tokens for it: words and names cost few
tokens for each character, random strings cost many. If the string as a whole passes,
its stretches that cost many tokens are tested, so that readable parts joined to a
secret by ``= + / _ -`` don't hide it. Letters of one case are not told from words.
Strings that look like digests, identifiers, paths, links, dates or
numbers are left out of that test. Patterned spans are cut out of a string, and what
is left on either side is tested by itself.

Cases: null is the empty text; spans count code points, end exclusive, and are ordered
by start and then kind (assign, access, hex, token); a very long run is one string;
repeated rows give equal results; columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import map_texts

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
#: Strings that may be tokens: this long at least, and of these characters.
TOKEN_LENGTH = 16
STRING = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LENGTH)
#: Characters for each token at which a string counts as random.
EFFICIENCY = 2.2
#: Known forms that are no secrets: digests by length, UUIDs, snake and kebab names, numbers.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
KNOWN = (UUID, re.compile(r"[0-9_=+/-]+"))
NAME = re.compile(r"[A-Za-z]+(?:[_/-][A-Za-z]+)*[0-9]{0,4}")
MIXED_CASE = re.compile(r"[a-z][A-Z]")
#: A string's parts, each with the separators after it.
SEPARATORS = "=+/_-"
PART = re.compile(r"[A-Za-z0-9]+[=+/_-]*")
DIGEST = re.compile(r"(?:sha\d+-|sha\d+=)?[0-9A-Fa-f]+")


class Finder:
    """Finds the spans of a text with one tiktoken vocabulary file and word pattern."""

    def __init__(self, ranks_path: str, pattern: str, efficiency: float = EFFICIENCY):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.efficiency = efficiency

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterned kinds, leftmost and non-overlapping for each kind."""
        out = []
        if "=" in text or ":" in text:
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_VALUE]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def is_known(self, s: str) -> bool:
        """Whether a string has the form of a digest or identifier."""
        core = s.strip("=-_/+")
        if any(k.fullmatch(core) for k in KNOWN) or NAME.fullmatch(core) and not MIXED_CASE.search(core):
            return True
        return self.is_digest(core)

    def is_digest(self, core: str) -> bool:
        return bool(DIGEST.fullmatch(core)) and len(core.split("-")[-1]) in DIGEST_LENGTHS

    def is_random(self, s: str) -> bool:
        """Whether a string mixes kinds of characters and costs many tokens."""
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s) or MIXED_CASE.search(s)):
            return False
        return len(s) < self.efficiency * len(self.encode(s))

    def stretches(self, s: str):
        """(start, end) of the stretches of a string's parts that cost many tokens and are long enough.

        A part's gain is the tokens above the limit; the stretches are all those of
        greatest total gain (Ruzzo and Tompa), between identifiers and digests.
        """
        parts = list(PART.finditer(s))
        if len(parts) < 2:
            return
        ids = [m.span() for m in UUID.finditer(s)]
        runs, total = [[]], 0.0  # of (start, end, total before, total after, the last one with a lower total before)
        for m in parts:
            core = m[0].rstrip(SEPARATORS)
            while ids and ids[0][1] <= m.start():
                ids.pop(0)
            if ids and ids[0][0] < m.start() + len(core) or self.is_digest(core):
                runs.append([])
                continue
            before, total = total, total + self.efficiency * len(self.encode(m[0])) - len(m[0])
            if total <= before:
                continue
            own, start, j = runs[-1], m.start(), len(runs[-1]) - 1
            while True:
                while j >= 0 and own[j][2] >= before:
                    j = own[j][4]
                if j < 0 or own[j][3] >= total:
                    own.append((start, m.end(), before, total, j))
                    break
                start, _, before, _, link = own[j]
                del own[j:]
                j = link
        for a, b, *_ in (x for own in runs for x in own):
            b = a + len(s[a:b].rstrip(SEPARATORS)) if b < len(s) else b
            if b - a >= TOKEN_LENGTH and not self.is_known(s[a:b]) and self.is_random(s[a:b]):
                yield a, b

    def pieces(self, text: str, found: list[tuple[int, int, int]]):
        """(start, end) of the strings of a text, without the patterned spans, and long enough."""
        cuts, k, past = sorted((x, y) for x, _, y in found), 0, 0
        for m in STRING.finditer(text):
            a, b = max(m.start(), past), m.end()
            while k < len(cuts) and cuts[k][0] < b:
                x, y = cuts[k]
                if x - a >= TOKEN_LENGTH:
                    yield a, x
                past, k = max(past, y), k + 1
                a = max(a, past)
            if b - a >= TOKEN_LENGTH:
                yield a, b

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        found = self.base(text)
        more = []
        for a, b in self.pieces(text, found):
            s = text[a:b]
            if UUID.fullmatch(s.strip(SEPARATORS)) or self.is_digest(s.strip(SEPARATORS)):
                continue
            if not self.is_known(s) and self.is_random(s):
                more.append((a, 3, b))
            else:
                more += [(a + x, 3, a + y) for x, y in self.stretches(s)]
        return sorted(found + more)


def find_secrets(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
                 efficiency: float = EFFICIENCY) -> DataFrame:
    """Column spans (array of kind, start, end), ordered by start and kind, beside the kept columns."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def make():
        finder = Finder(ranks_path, pattern, efficiency)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return lambda texts: [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in finder.spans(t)] for t in texts], kind)]

    return map_texts(df, text, df.columns if keep is None else keep, [T.StructField("spans", T.ArrayType(span))], make)


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the counts of patterned spans, their digest, and all spans as text."""
    r = find_secrets(docs, ranks_path, pattern, keep=["doc_id"])

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return r.select("doc_id", n("assign"), n("access"), n("hex"),
                    F.sha2(line(F.filter("spans", lambda s: s["kind"] != "token")), 256).alias("base_sha256"),
                    line(F.col("spans")).alias("spans"))
