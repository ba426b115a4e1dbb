"""Helpers shared by the operators: Arrow batches of bounded size, and shared files."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapewise.session import checkpoint_dir

#: Bytes of text that a task holds in Python at a time; a longer text is a slice by itself.
SLICE_BYTES = 2_000_000
#: Rows of a slice of short texts.
SLICE_ROWS = 4_096
#: Bytes and rows of a slice for work that takes dozens of bytes for each byte of text, or kilobytes for each row.
PART_BYTES, PART_ROWS = 1 << 18, 512

_HELD: dict[tuple, object] = {}


def remembered(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, held by a Python worker for its next tasks of this kind.

    Workers serve one task after another, of all operators of a session. They hold one
    such thing at a time.
    """
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Let go of what this worker holds for tasks of another kind."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand the memory that is free in this worker to the system, where the executor can use it.

    The C library keeps most of what was freed for the next request, unless it is told to trim.
    """
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes in ``column``, and ``rows`` rows at most."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most or i - start >= rows:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
              make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], most: int = SLICE_BYTES, rows: int = SLICE_ROWS,
              holds: bool = False) -> DataFrame:
    """Columns ``keep`` of ``df`` and new ``fields`` computed from the text column.

    ``make()`` runs once in a task and returns the function of a list of texts that
    gives one Arrow array per field. A new field replaces a kept column of its name.
    ``most`` bytes of text and ``rows`` rows at most are given to it at a time. ``holds``
    says that ``make`` asks for what is :func:`remembered`.
    """
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    wanted = list(dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            forget()
        f = make()
        for whole in batches:
            for b in slices(whole, text, most, rows):
                new = [a if a.type == t else a.cast(t) for a, t in zip(f(b.column(text).to_pylist()), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], names=[*kept, *[x.name for x in fields]])
        give_back()

    return df.select(*wanted).mapInArrow(run, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow file system and path of a folder that driver and executors share."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
