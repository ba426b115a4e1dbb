"""Encoding many texts by encoding each distinct stretch between spaces once."""

from __future__ import annotations

import os
from array import array

#: Pieces in a generation of what a task remembers; two generations are held.
REMEMBERED = 200_000
LONGEST = 64
#: New pieces given to a tokenizer in one call; its results are large objects.
AT_ONCE = 4_000


class PieceEncoder:
    """Texts to ids, with the ids of short pieces remembered as bytes.

    ``learn`` gives the ids of pieces; ``split`` gives the pieces of a text, or None
    where ``whole`` has to encode the text at once. ``code`` is the array type of ids.
    A task has one core, so the tokenizers library starts no threads unless
    ``TOKENIZERS_PARALLELISM`` says so.
    """

    def __init__(self, code: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.code, self.remembered = code, remembered
        self.known = self.fresh()
        self.older: dict[str, bytes] = {}

    def fresh(self) -> dict[str, bytes]:
        """An empty table of pieces and their ids."""
        return {}

    def learn(self, pieces: list[str]) -> list[list[int] | bytes]:
        raise NotImplementedError

    def split(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def packed(self, ids: list[int] | bytes) -> bytes:
        return ids if type(ids) is bytes else array(self.code, ids).tobytes()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as an array of ``code`` in bytes; none for null."""
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.older = self.fresh(), self.known
        known, older = self.known, self.older
        missing = set().union(*(p for p in parts if p)).difference(known)
        known.update({p: older[p] for p in missing.intersection(older)})
        missing = list(missing.difference(older))
        fresh = dict(zip(missing, map(self.packed, self.learn(missing)), strict=True))
        known.update(fresh)
        get = known.__getitem__
        out = [self.packed(self.whole(t)) if p is None else b"".join(map(get, p)) for p, t in zip(parts, texts, strict=True)]
        for p in [p for p in fresh if len(p) > LONGEST]:  # long strings rarely come again
            del known[p]
        return out
