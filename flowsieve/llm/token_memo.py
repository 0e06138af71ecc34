"""Token ids of text pieces, in batches balanced by bytes, and a memo of short pieces.

Corpora repeat their words. A worker keeps the result of pieces it has met, and
only unknown pieces go to the tokenizer. The memo is bounded by bytes: when it is
half full its pieces become the old ones, of which those met again stay; pieces above 64 bytes (words of scripts without spaces,
base64) are forgotten after their text, so memory does not depend on the corpus.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import filterfalse

MEMO_BYTES = 96 << 20
# Longest piece that is kept, and what an entry costs beside the bytes of its two values.
KEPT_BYTES, ENTRY_BYTES = 64, 170
BATCH_BYTES = 1 << 18


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file; one thread, as Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_bytes(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about ``limit`` bytes; a longer piece comes alone."""
    batch, held = [], 0
    for piece in pieces:
        size = len(piece) if piece.isascii() else len(piece.encode())
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


def encode(tokenizer, pieces: Sequence[str]) -> Iterator[list[int]]:
    for batch in by_bytes(pieces):
        for encoding in tokenizer.encode_batch_fast(batch, add_special_tokens=False):
            yield encoding.ids


class Memo(dict):
    """What ``make`` gives for each of the pieces (bytes) asked for.

    ``learn`` makes all of them ready to look up; ``trim``, called after each text,
    forgets the long ones. New and old pieces hold half of ``room`` bytes each: when the
    new ones are full they become the old ones, and what was old and not met since is forgotten.
    """

    def __init__(self, make: Callable[[Sequence[bytes]], Iterable[bytes]], room: int = MEMO_BYTES):
        super().__init__()
        self.make, self.room, self.held = make, room, 0
        self.passing: list[bytes] = []
        self.old: dict[bytes, bytes] = {}

    def learn(self, pieces: Iterable[bytes]) -> None:
        new = list(filterfalse(self.__contains__, dict.fromkeys(pieces)))
        if self.old and new:
            unknown = []
            for piece in new:
                if (value := self.old.pop(piece, None)) is None:
                    unknown.append(piece)
                else:
                    self[piece] = value
                    self.held += ENTRY_BYTES + len(piece) + len(value)
            new = unknown
        if not new:
            return
        made = list(self.make(new))
        self.update(zip(new, made))
        self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, made))
        for piece, value in zip(new, made):
            if len(piece) > KEPT_BYTES:
                self.passing.append(piece)
                self.held -= ENTRY_BYTES + len(piece) + len(value)

    def trim(self) -> None:
        for piece in self.passing:
            del self[piece]
        self.passing.clear()
        if self.held > self.room // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
