"""BPE encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that no vocabulary token has inside it can never be
merged over, so it is a certain cut. A word is cut at all such pairs, each fragment
is merged by itself (the last one with the end-of-word mark), and the ids are put
together. Words repeat and their fragments more so: both are remembered, in tables
of bounded size, and new fragments are merged in batches by the library's BPE model.

The ids equal those of the tokenizers library for the BPE files that have a
NFC / white space / lower case normalizer, a regular expression splitting off words,
and an end-of-word suffix. Texts holding characters whose handling differs between
Unicode tables (control separators, scripts beyond Latin, Greek and Cyrillic) are
normalised and split by the library's own normalizer before the fragments are merged.

Cases: null is the empty text; the empty text has no ids and decodes to the empty
string; special token strings inside a text become their ids, as in the library;
repeated rows are encoded alike; other columns of the input pass through, and a
column named like an output column is replaced by it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewise.llm.common import map_texts, remembered
from tapewise.llm.pieces import AT_ONCE, REMEMBERED, PieceEncoder

#: Letters of these blocks lower and compose alike in all Unicode tables in use.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7E\xA1-ſΑ-Ωα-ωА-я]|İ")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves; the others get the characters from 256 on,
    in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE(PieceEncoder):
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer, models

        super().__init__("i", remembered)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.normalizer = Tokenizer.from_file(path).normalizer
        #: Merge rules alone, for a fragment that ends a word and for one that doesn't.
        self.ending = Tokenizer(models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None))
        self.inner = Tokenizer(models.BPE(vocab=self.vocab, merges=merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for k, v in [*self.vocab.items(), *self.special.items()]:
            self.names[v] = k
        marks = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split if marks else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.spaces = regex.compile(r"\s+")
        self.alphabet = byte_alphabet()
        self.inside = self._inside_pairs()
        letters = "abcdefghijklmnopqrstuvwxyz"
        #: Whether letters always make one word that is only lowered, and what finds the pairs of letters that are certain cuts.
        self.plain_words = self.words(letters) == [letters] and self.normalizer.normalize_str(letters.upper()) == letters
        cuts = [a + b for a in letters for b in letters if a + b not in self.inside]
        self.cut_letters = re.compile("|".join(cuts) or "(?!)").search
        self.fragments: dict[tuple[str, bool], bytes] = {}

    def _inside_pairs(self) -> set[str]:
        """All pairs of neighbouring characters inside some vocabulary token."""
        out: set[str] = set()
        for token in self.vocab:
            t = token.removesuffix(self.suffix) if self.suffix and len(token) > len(self.suffix) else token
            out.update(map(add, t, t[1:]))
        return out

    def cut(self, word: str) -> list[str]:
        """The fragments of a word of byte characters between its certain cuts."""
        inside = self.inside
        at = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in inside]
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def normalised(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.lower()
        if PLAIN.search(piece):
            return self.normalizer.normalize_str(piece)
        return self.spaces.sub(" ", unicodedata.normalize("NFC", piece).replace("Σ", "σ")).lower()

    def keys(self, piece: str) -> list[tuple[str, bool]]:
        """The fragments of a stretch of text, each with whether it ends its word."""
        if self.plain_words and piece.isascii() and piece.isalpha():  # one word, often without a certain cut
            w = piece.lower()
            if not self.cut_letters(w):
                return [(w, True)]
        out = []
        for w in self.words(self.normalised(piece)):
            chars = w if w.isascii() and w.isprintable() else "".join(map(self.alphabet.__getitem__, w.encode("utf-8")))
            parts = self.cut(chars)
            out += [(f, False) for f in parts[:-1]]
            out.append((parts[-1], True))
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        keys = list(map(self.keys, pieces))
        if len(self.fragments) > self.remembered:
            self.fragments.clear()
        known = self.fragments
        new: tuple[dict, dict] = {}, {}  # inner and ending fragments
        for ks in keys:
            for k in ks:
                if k not in known:
                    new[k[1]][k] = None
        for merger, fresh in ((self.inner, list(new[False])), (self.ending, list(new[True]))):
            for i in range(0, len(fresh), AT_ONCE):
                some = fresh[i:i + AT_ONCE]
                for k, e in zip(some, merger.encode_batch_fast([k[0] for k in some], add_special_tokens=False), strict=True):
                    known[k] = self.packed(e.ids)
        return [known[ks[0]] if len(ks) == 1 else b"".join([known[k] for k in ks]) for ks in keys]

    def split(self, text: str) -> list[str] | None:
        return None if self.at_special and any(s in text for s in self.special) else text.split(" ")

    def whole(self, text: str) -> list[int]:
        """Ids of a text with special token strings, which stand for their own ids."""
        out: list[int] = []
        for part in self.at_special(text):
            out += [self.special[part]] if part in self.special else array(self.code, b"".join(self.learn(part.split(" ")))).tolist()
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids for a file without decoder: token strings joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def loaded(path: str) -> ForcedBoundaryBPE:
    """One codec for the tasks that a Python worker runs, with what it remembers."""
    return remembered(("bpe", path), lambda: ForcedBoundaryBPE(path))


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ids (array of int) and decoded (string) beside the kept columns."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def make():
        codec = loaded(path)

        def run(texts: list[str | None]) -> list[pa.Array]:
            packed = codec.encode_many(texts)
            ends = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=ends[1:])
            flat = np.frombuffer(b"".join(packed), dtype=np.int32)
            t = pa.list_(pa.field("element", pa.int32(), False))
            text = [codec.decode(flat[i:j].tolist()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=t), pa.array(text, pa.string())]
        return run

    return map_texts(df, text, df.columns if keep is None else keep, fields, make, holds=True)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text."""
    r = encode_decode(docs, path, keep=["doc_id"])
    return r.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
