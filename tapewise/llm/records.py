"""Token ids as length-delimited binary records with a separate offset index.

A shard is a file of records in ascending document order. A record is framed as

    length    8 bytes, little endian
    checksum  4 bytes: masked CRC-32C of the length
    payload   ``length`` bytes: one byte with the width of an id (2 or 4), then the ids
    checksum  4 bytes: masked CRC-32C of the payload

with mask(c) = rotate_right(c, 15) + 0xA282EAD8, which readers of record files of
this kind verify. Beside each shard, an index file holds 40 bytes for each record:
doc_id, whether doc_id is null, the record's offset, its number of ids, and the ids
before it in the shard. With it, records are read in any order.

Documents are dealt into shards by ranges of doc_id, so shard k holds smaller ids than
shard k + 1. A task writes one shard, streaming, under a private name, and renames it
when it is whole: a task that runs again replaces its shard by the same bytes. Files
go to a folder that driver and executors share.

Cases: null and empty texts are records with the end id alone; null doc_ids come
first; rows of one doc_id stay together in text order; special token strings in texts
become their ids, as in the library; an empty table gives no records.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm.bpe import byte_alphabet
from tapewise.llm.common import filesystem, remembered, shared_path, slices
from tapewise.llm.pieces import AT_ONCE, LONGEST, PieceEncoder
from tapewise.session import staged

#: Fixed values of the record framing: the reflected Castagnoli polynomial and the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK, BLOCKS = 512, 64
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8"), ("before", "<i8")])
BUFFER = 1 << 20
#: Stretches in a generation of what a worker remembers: about 120 MB each.
REMEMBERED = 700_000
#: Words that a worker remembers besides, as parts of stretches.
WORDS = 100_000
#: Marks the first stretch of a text, which has no space before it.
FIRST = "\0"
#: The character of byte-level vocabularies that stands for the space.
SPACE = "\u0120"


def _tables() -> np.ndarray:
    """Row k: what each byte value adds to the checksum with k bytes behind it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 255])
    return np.stack(rows)


class Checksum:
    """CRC-32C of byte strings, a block of bytes at a time."""

    def __init__(self):
        rows = _tables()
        self.flat = np.ascontiguousarray(rows[::-1]).reshape(-1)
        self.base = (np.arange(BLOCK, dtype=np.intp) * 256)
        self.shift = [rows[BLOCK - 1 - j].tolist() for j in range(4)]  # the register's byte j, moved over one block

    def crc(self, data: bytes) -> int:
        n = len(data)
        if n < 4:  # the register's preset reaches past so short a string
            state = 0xFFFFFFFF
            for x in data:
                state = self._byte(state, x)
            return state ^ 0xFFFFFFFF
        b = np.array(np.frombuffer(data, dtype=np.uint8))
        b[:4] ^= np.uint8(255)  # the preset register, moved into the string
        head, state = n % BLOCK, 0
        if head:
            state = int(np.bitwise_xor.reduce(self.flat.take(self.base[BLOCK - head:] + b[:head])))
        s0, s1, s2, s3 = self.shift
        full = b[head:].reshape(-1, BLOCK)
        for k in range(0, len(full), BLOCKS):  # few enough for the processor's cache
            for c in np.bitwise_xor.reduce(self.flat.take(self.base + full[k:k + BLOCKS]), axis=1).tolist():
                state = s0[state & 255] ^ s1[(state >> 8) & 255] ^ s2[(state >> 16) & 255] ^ s3[state >> 24] ^ c
        return state ^ 0xFFFFFFFF

    def _byte(self, state: int, x: int) -> int:
        return (state >> 8) ^ int(self.flat[(BLOCK - 1) * 256 + ((state ^ x) & 255)])

    def masked(self, data: bytes) -> int:
        c = self.crc(data)
        return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF

    def frame(self, payload: bytes) -> bytes:
        n = struct.pack("<Q", len(payload))
        return b"".join((n, struct.pack("<I", self.masked(n)), payload, struct.pack("<I", self.masked(payload))))

    def unframe(self, record: bytes) -> bytes:
        """The payload of a record whose checksums hold."""
        (n,), payload = struct.unpack("<Q", record[:8]), record[12:-4]
        if len(payload) != n or struct.unpack("<I", record[8:12])[0] != self.masked(record[:8]) \
                or struct.unpack("<I", record[-4:])[0] != self.masked(payload):
            raise ValueError("a token record is damaged")
        return payload


class Known(dict):
    """The ids of stretches, where one that is missing is encoded as it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = got
        return got


class ByteLevelPieces(PieceEncoder):
    """A byte-level tokenizer file, used piece by piece.

    Its words never reach over a space that stands before another character, so such
    spaces divide a text into stretches that are encoded independently. A text with
    special token strings or with white space after a space is encoded at once.

    A stretch of plain characters is cut into words here, and only a word that isn't known
    is merged: "end," and "end." share the word of "end". Texts of plain characters look up
    their stretches once; those of other texts are first collected and learned together.
    """

    RUN = re.compile(r" (?:\s|\Z)")
    #: Characters that all Unicode tables hold for the same kind, and the words that the file's pre-tokenizer finds among them.
    PLAIN = re.compile(r"[\n!-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
    PLAIN_TEXT = re.compile(r"[\n -~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
    WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
    PROBE = " Plain letters, l'\xe9t\xe9's 42nd_day\n\n(it's 'so'\n"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, models
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        #: Merge rules alone, for one word.
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.tokenize = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0).tokenize  # what is known isn't asked again
        self.shown = dict(enumerate(byte_alphabet()))
        self.words: dict[str, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(names.values()) + 1, dtype=bool)
        self.after_space[[i for n, i in names.items() if n[0] == SPACE]] = True
        super().__init__("H" if self.library.get_vocab_size() <= 1 << 16 else "I", remembered)
        kind = spec["pre_tokenizer"] or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") \
            and not spec.get("normalizer") and not any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")) \
            and self.packed(self.whole(self.PROBE)) == b"".join(map(self.word, self.WORD.findall(self.PROBE)))

    def split(self, text: str) -> list[str] | None:
        """The stretches; all but the first stand for a space and what follows it."""
        if self.RUN.search(text) or FIRST in text or any(s in text for s in self.special):
            return None
        return (FIRST + text).split(" ")

    def merged(self, w: str) -> bytes:
        """The ids of one word, by the merge rules alone."""
        if w.isascii() and "\n" not in w:
            shown = SPACE + w[1:] if w[0] == " " else w
        else:
            shown = w.encode("utf-8").decode("latin-1").translate(self.shown)
        return self.packed([t.id for t in self.tokenize(shown)])

    def word(self, w: str) -> bytes:
        """As ``merged``, for a word inside a stretch: it is remembered, or was one with the space before it."""
        got = self.words.get(w) or (self.known.get(w[1:]) if w[0] == " " else None)
        if got is None:
            got = self.merged(w)
            if len(w) <= LONGEST:
                self.words[w] = got
        return got

    def stretch(self, p: str) -> bytes:
        """The ids of a stretch of plain characters."""
        got = self.older.get(p)
        if got is not None:
            return got
        if p.isalpha():
            return self.merged(" " + p)
        if len(self.words) >= WORDS:
            self.words.clear()
        return b"".join(map(self.word, self.WORD.findall(p[1:] if p[0] == FIRST else " " + p)))

    def fresh(self) -> dict[str, bytes]:
        return Known(self.stretch)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return super().encode_many(texts)
        if len(self.known) > self.remembered:
            self.known, self.older = self.fresh(), self.known
        get, out, others = self.known.__getitem__, [], []
        for k, t in enumerate(texts):
            parts = self.split(t) if t and self.PLAIN_TEXT.fullmatch(t) else None
            out.append(b"" if parts is None else b"".join(map(get, parts)))
            if t and parts is None:
                others.append(k)
        for k, b in zip(others, super().encode_many([texts[k] for k in others]), strict=True):
            out[k] = b
        return out

    def learn(self, pieces: list[str]) -> list[list[int] | bytes]:
        """Ids of the stretches: plain ones word by word; others after a space in one string,
        and cut again where a token begins with a space, which is where a stretch begins."""
        got = {p: self.stretch(p) for p in filter(self.PLAIN.fullmatch, pieces)} if self.cuts else {}
        behind = [p for p in pieces if p[:1] != FIRST and p not in got]
        for k in range(0, len(behind), AT_ONCE):
            some = behind[k:k + AT_ONCE]
            (e,) = self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, dtype=self.code)
            at = np.flatnonzero(self.after_space[ids]) * ids.itemsize
            raw, ends = ids.tobytes(), [*at[1:].tolist(), ids.nbytes]
            got.update((p, raw[i:j]) for p, i, j in zip(some, at.tolist(), ends, strict=True))
        for p in pieces:
            if p not in got:
                got[p] = self.whole(p[1:])
        return [got[p] for p in pieces]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


def loaded(path: str) -> ByteLevelPieces:
    """One encoder for the tasks that a Python worker runs, with what it remembers."""
    return remembered(("records", path), lambda: ByteLevelPieces(path))


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents; a row for each shard: shard, n_records, n_tokens, n_bytes.

    The documents are shuffled once, by ranges of doc_id. The returned table is staged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        private = f"{root}/.{uuid.uuid4().hex}"
        codec, check = loaded(path), Checksum()
        width = 2 if codec.code == "H" else 4
        end = codec.packed([end_id])
        lead = bytes([width])
        index: list[tuple[int, int, int, int, int]] = []
        offset = before = 0
        with fs.open_output_stream(private, buffer_size=BUFFER) as f:
            for whole in batches:
                for b in slices(whole, "text"):
                    texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
                    for d, packed in zip(ids, codec.encode_many(texts), strict=True):
                        record = check.frame(lead + packed + end)
                        n = len(packed) // width + 1
                        f.write(record)
                        index.append((0 if d is None else d, int(d is None), offset, n, before))
                        offset, before = offset + len(record), before + n
        if not index:
            fs.delete_file(private)
            return
        with fs.open_output_stream(private + "x") as f:
            f.write(np.array(index, dtype=INDEX).tobytes())
        fs.move(private, f"{root}/{shard:07d}.records")
        fs.move(private + "x", f"{root}/{shard:07d}.index")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_records": pa.array([len(index)], pa.int64()),
                                          "n_tokens": pa.array([before], pa.int64()), "n_bytes": pa.array([offset], pa.int64())})

    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return staged(ordered.mapInArrow(run, "shard long, n_records long, n_tokens long, n_bytes long"))


def read_at(folder: str, shard: int, picks: np.ndarray, check: Checksum) -> Iterator[np.ndarray]:
    """The ids of the records at some rows of a shard's index, in any order."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{shard:07d}.records") as f:
        for offset in picks["offset"].tolist():
            (n,) = struct.unpack("<Q", f.read_at(8, offset))
            payload = check.unframe(f.read_at(n + 16, offset))
            yield np.frombuffer(payload, dtype="<u2" if payload[0] == 2 else "<u4", offset=1)


def read_index(folder: str, shard: int) -> np.ndarray:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{shard:07d}.index") as f:
        return np.frombuffer(f.read(), dtype=INDEX)


def read_records(shards: DataFrame, folder: str, seed: int | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) read from the files, verified.

    ``start`` counts the ids of all documents before; ``ids`` holds unsigned 32-bit
    little-endian integers. With a seed, each shard is read in a shuffled order.
    """
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("start"))
    n = max(1, int(shards.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Checksum()
        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist(), strict=True):
                index = read_index(folder, shard)
                if seed is not None:
                    index = index[np.random.default_rng([seed, shard]).permutation(len(index))]
                rows = iter(read_at(folder, shard, index, check))
                at = 0
                while at < len(index):
                    size = np.cumsum(index["n_tokens"][at:]) * 4
                    k = max(1, int(np.searchsorted(size, 4 * BUFFER, side="right")))
                    part = index[at:at + k]
                    got = [next(rows).astype("<u4").tobytes() for _ in range(len(part))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part["doc_id"], pa.int64(), mask=part["null"] == 1), pa.array(part["before"] + start, pa.int64()),
                        pa.array(part["n_tokens"], pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at += k

    return starts.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def report(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write all documents, read the files back, and digest what was read."""
    folder = shared_path(spark, "token-records")
    shards = write_records(docs, path, folder)
    return read_records(shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
