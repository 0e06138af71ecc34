"""Documents as token pieces, and vector best-fit packing of pieces into sequences."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import REMEMBERED, map_batches, staged, texts
from flowsieve.llm.token_memo import Memo, encode, load

# Pieces which one task packs: it bounds memory and the search for the best bin.
GROUP_PIECES = 8192
# Bytes of whole words a worker remembers.
WORD_BYTES = 160 << 20

# ASCII signs that always form pieces of their own after a word (no apostrophe: contractions).
_TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
# In any case of letters: the library finds them before it lowers, so lowering must not make new ones.
_SPECIAL = re.compile(r"<\|(start|end)oftext\|>", re.IGNORECASE)
# Marks that compose with small letters where there is no capital (h, j, t, w, y).
_MARKS = re.compile("[\u0300-\u036f]")


def _id_bytes(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def core_ids(tokenizer, words: list[bytes]) -> list[bytes]:
    """Ids of words that hold no blanks, A-Z already lowered in words of ASCII.

    A word of letters is one piece for the pre-tokenizer, so the model alone encodes
    it; Latin letters beyond ASCII are normalised many words at a time first.
    Everything else goes through the whole tokenizer.
    """
    found: dict[bytes, bytes] = {}
    direct = lambda piece: _id_bytes([t.id for t in tokenizer.model.tokenize(piece)])
    latin, other = [], []
    for word in words:
        if word.isalpha():  # of bytes: ASCII letters only
            found[word] = direct(word.decode())
        else:
            text = word.decode()
            (latin if text.isalpha() and max(text) < "\u0250" else other).append(text)
    for at in range(0, len(latin), 256):
        some = latin[at : at + 256]
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(" ".join(some)))
        if len(pieces) == len(some):
            found.update((t.encode(), direct(piece)) for t, (piece, _) in zip(some, pieces))
        else:
            other += some
    found.update((t.encode(), _id_bytes(ids)) for t, ids in zip(other, encode(tokenizer, other)))
    return [found[w] for w in words]


@lru_cache(maxsize=2)
def _words(path: str) -> Memo:
    tokenizer = load(path)
    cores = Memo(lambda words: core_ids(tokenizer, words))

    @lru_cache(maxsize=None)
    def ends(last: str) -> bool:
        # Signs join into one piece, so only after other characters is a tail a piece of its own.
        return tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(last + "."))[-1][0] == "."

    def cut(word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(_TAIL)
        if len(core) == len(word):
            return word, b""
        whole = core and not core[-1:].isalnum() and not ends(core.decode()[-1])
        return (word, b"") if whole else (core, word[len(core):])

    def make(words):
        # A word is its core and the signs that trail it; few cores are new.
        split = [cut(w) for w in words]
        cores.learn(filter(None, chain.from_iterable(split)))
        made = [(cores[a] if a else b"") + (cores[b] if b else b"") for a, b in split]
        cores.trim()
        return made

    return Memo(make, WORD_BYTES)


REMEMBERED[__name__] = _words.cache_clear


def word_ids(text: str, path: str) -> bytes:
    """Ids of a text as little-endian 32-bit numbers, for a tokenizer that drops white
    space and case. Words never influence each other there, so they are looked up one
    by one; a text with a special string, in whatever case, goes to the tokenizer as it is."""
    if _SPECIAL.search(text):
        return _id_bytes(load(path).encode(text, add_special_tokens=False).ids)
    memo = _words(path)
    if not text.isascii() and _MARKS.search(text):
        words = [w.lower() if w.isascii() else w for w in text.encode().split()]
    else:  # ASCII letters may be lowered before normalisation: no composition depends on it
        words = text.encode().lower().split()
    memo.learn(words)
    ids = b"".join(map(memo.__getitem__, words))
    memo.trim()
    return ids


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids (little-endian uint32).

    A document's ids are followed by ``end_id``; only documents above ``size`` ids are
    cut, the last piece may be shorter. Null and empty texts give one piece of one id.
    Repeated rows give their pieces again; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = _id_bytes([end_id])
        row, piece, start, length, ids = [], [], [], [], []
        for i, text in enumerate(texts(batch)):
            all_ids = word_ids(text, tokenizer) + end
            for p, at in enumerate(range(0, len(all_ids), 4 * size)):
                part = all_ids[at : at + 4 * size]
                row.append(i), piece.append(p), start.append(at // 4), length.append(len(part) // 4), ids.append(part)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()))]
    return map_batches(docs.select("doc_id", "text"), run, fields)


def vector_best_fit(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin's order for each item (rows of ``needs``: tokens, documents, cost).

    Items come by decreasing weighted need. Of the open bins with room in every
    dimension the tightest is chosen: by ``norm``, the least weighted norm of what would
    be left, or by ``dot``, the least weighted dot-product of the item and what would
    be left. A new bin opens if none has room. An item above the capacity is an error.
    """
    if len(needs) and (needs > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    share = needs / capacity
    order = np.argsort(-(share @ weights), kind="stable")
    left = np.empty((len(needs), needs.shape[1]))
    bins, used = np.empty(len(needs), np.int64), 0
    open_bins = np.empty(0, np.int64)
    smallest = share.min(axis=0) if len(needs) else None
    for count, i in enumerate(order):
        rest = left[open_bins] - share[i]
        fits = (rest >= -1e-12).all(axis=1)
        if fits.any():
            score = rest @ (weights * share[i]) if rule == "dot" else (rest * rest) @ weights
            at = open_bins[np.argmin(np.where(fits, score, np.inf))]
            left[at] -= share[i]
        else:
            at, used = used, used + 1
            left[at] = 1.0 - share[i]
            open_bins = np.append(open_bins, at)
        bins[i] = at
        if (left[at] < smallest - 1e-12).any():  # not even the smallest item goes in
            open_bins = open_bins[open_bins != at]
    return bins, order


def pack(pieces: DataFrame, size: int = 4096, max_docs: int = 1024, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """``pieces`` with sequence_id and offset: vector best-fit under three capacities.

    A sequence holds at most ``size`` tokens, ``max_docs`` pieces and an attention cost
    (sum of squared lengths) of ``max_cost``, by default ``size`` squared. Pieces are
    dealt by a hash of their place in the stored table into groups of about
    ``GROUP_PIECES``, however many are equal, each packed by one task; a group leaves a few sequences partly filled. All columns of ``pieces`` are kept, but
    columns named sequence_id or offset are replaced. Ties go by the order of the
    group; an empty table gives an empty result.
    """
    pieces = staged(pieces.drop("sequence_id", "offset"), "pieces")  # places must not change
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    spread = [c for c, t in pieces.dtypes if t in ("int", "bigint", "string")]
    keyed = pieces.withColumn("sequence_id", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    capacity = np.array([size, max_docs, max_cost or float(size) ** 2])
    weight = np.array(weights)
    schema = T.StructType([*keyed.schema.fields, T.StructField("offset", T.LongType())])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in spread])  # whatever order the shuffle brought
        lengths = group.column("length").to_numpy()
        needs = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
        bins, order = vector_best_fit(needs, capacity, weight, rule)
        offset = pd.Series(lengths[order]).groupby(bins[order]).cumsum().to_numpy() - lengths[order]
        at = np.empty(len(lengths), np.int64)
        at[order] = offset
        number = group.column("sequence_id").to_numpy() * (1 << 32) + bins
        place_of = group.schema.get_field_index("sequence_id")
        return group.set_column(place_of, "sequence_id", pa.array(number)).append_column("offset", pa.array(at))

    return keyed.groupBy("sequence_id").applyInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces put together: sequence_id, n_tokens, ids (little-endian uint32).
    At most one sequence's tokens come together."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, **limits) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are reduced to their checksum before the shuffle; ``pack(token_pieces(...))``
    keeps them, and ``sequences`` puts them together.
    """
    pieces = token_pieces(docs, tokenizer, size).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, size, **limits)
