"""Near-duplicate documents by min-max hashing of word shingles, links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import REMEMBERED, map_batches, staged, texts
from flowsieve.llm.components import components

#: Permutations (each gives two values), and values per band: 90 * 2 / 6 = 30 bands. At a
#: similarity of 0.85 a pair shares no band with probability 7e-7, at 0.8 with 1.2e-4.
PERMUTATIONS, BAND_ROWS = 90, 6
# One task compares blocks of at most so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 19
_CHUNK = 1 << 13
_SEED = 9

_rng = np.random.default_rng(_SEED)
_SCALE = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words of at most 64 bytes met by a worker; starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHashes()
REMEMBERED[__name__] = _hashes.clear


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (A-Z lowered); of the whole
    sequence if it is shorter; nothing without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    mix = np.full(n, span, np.uint64)
    for i in range(span):
        mix = mix * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + n]
        mix ^= mix >> np.uint64(31)
    return np.unique(_mixed(mix))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least and the greatest value under each permutation, in steps of bounded memory."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        values = np.multiply.outer(_SCALE, shingles[at : at + _CHUNK])
        values += _SHIFT[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    # Neighbours in a band come from different permutations.
    return np.concatenate([low, high])


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), bands (array of long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, bands = [], [], []
        for text in texts(batch):
            shingles = shingle_set(text, width)
            sizes.append(len(shingles)), digests.append(_digest(shingles))
            if len(shingles):
                rows = signature(shingles).reshape(-1, BAND_ROWS)
                bands.append(np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], np.uint64).view(np.int64))
            else:
                bands.append(None)
        out = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_shingles", "digest", "bands"])

    fields = [docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_batches(docs.select("doc_id", "text"), run, fields)


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digest, block columns and the whole set of the rows of ``docs`` whose text has ``digest``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, sets = [], []
        for i, (text, digest) in enumerate(zip(texts(batch), batch.column("digest").to_pylist())):
            shingles = shingle_set(text, width)
            if _digest(shingles) == digest:
                keep.append(i), sets.append(shingles.tobytes())
        if not keep:
            return None
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("blocks").take(at), pa.array(sets, pa.binary())], ["doc_id", "blocks", "shingles"])

    fields = [docs.schema["doc_id"], docs.schema["blocks"], T.StructField("shingles", T.BinaryType())]
    return map_batches(docs.select("doc_id", "digest", "blocks", "text"), run, fields)


def linked_pairs(sets: list[np.ndarray], similarity: Fraction) -> Iterator[tuple[int, int]]:
    """A forest of index pairs that connects the sets exactly as all their links would.

    Shared shingles become columns of a 0/1 matrix, whose products count intersections;
    shingles of one set alone only count in the sizes.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    column = np.cumsum(often > 1)[code[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _CHUNK // 2):
        a, b = np.searchsorted(column, [start, start + _CHUNK // 2])
        flags = np.zeros((len(sets), min(_CHUNK // 2, int(column[-1]) + 1 - start)), np.float32)
        flags[owner[a:b], column[a:b] - start] = 1
        common += flags @ flags.T
    both = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = both * similarity.denominator >= union * similarity.numerator
    waiting = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front:
            node = front.pop()
            new = np.flatnonzero(linked[node] & waiting)
            waiting[new] = False
            front.extend(new)
            yield from ((node, int(n)) for n in new)


def _blocks(members: DataFrame, similarity: Fraction) -> DataFrame:
    """Members (doc_id, digest, n_shingles, family) with the blocks they are compared in.

    Sets as similar as asked for differ in size by the similarity at most, so sizes fall
    into classes of which only equal and adjoining ones are compared. A class is dealt by
    hash into parts of bounded size, and every two parts that may hold a link share a block.
    A family that fits a block is one class and one part.
    """
    whole = members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total")).where("docs > 1")
    fits = (F.col("docs") <= BLOCK_DOCS) & (F.col("total") <= BLOCK_SHINGLES)
    step = -math.log(float(similarity)) * (1 + 1e-9)
    level = F.when(fits, F.lit(0)).otherwise(F.floor(F.log("n_shingles") / step)).cast("int")
    rows = members.join(whole, "family").withColumn("level", level)
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    counts = rows.groupBy("family", "level").agg(parts.alias("parts")).where("parts > 0")
    around = counts
    for name, by in (("parts_above", 1), ("parts_below", -1)):
        other = counts.select("family", (F.col("level") - by).alias("level"), F.col("parts").alias(name))
        around = around.join(other, ["family", "level"], "left")
    rows = rows.join(around, ["family", "level"])
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part)

    def pairs(other: Column, make) -> Column:
        return F.when(F.coalesce(other, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), other - 1), make)).otherwise(F.array())

    key = lambda a, i, b, j: F.xxhash64("family", a, i, b, j)
    here, mine = F.col("level"), F.col("part")
    same = pairs(F.col("parts"), lambda j: key(here, F.least(mine, j), here, F.greatest(mine, j)))
    above = pairs(F.col("parts_above"), lambda j: key(here, mine, here + 1, j))
    below = pairs(F.col("parts_below"), lambda j: key(here - 1, j, here, mine))
    return rows.select("doc_id", "digest", F.concat(same, above, below).alias("blocks"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of ``width`` words, A-Z lowered; with fewer
    words, all of them as one. Documents whose sets have a Jaccard similarity of at
    least ``similarity`` are linked; component_id is the smallest doc_id reachable.

    Documents of equal sets are one class. Each class representative is banded by its
    min-max signature; buckets of equal bands connect representatives into families.
    Whole sets are compared within a family only, block against block, and only enough
    links to connect a block leave its task.

    Null or empty texts have no set and are linked with nothing. Rows without doc_id are
    kept and linked with nothing (component_id null). Rows of one doc_id are one
    document: they get one component and stay or go together. Other columns are
    ignored; an empty table gives an empty result.
    """
    least = Fraction(str(similarity))
    prints = staged(fingerprints(docs, width), "fingerprints")
    known = prints.where("digest is not null and doc_id is not null")
    classes = staged(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    first = banded.groupBy("band", "value").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").drop("last")
    touching = banded.join(first, ["band", "value"]).select("a", F.col("rep").alias("b")).where("a < b").distinct()
    families = components(touching).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = classes.drop("bands").join(families, "rep").select(F.col("rep").alias("doc_id"), "digest", "n_shingles", "family")
    wanted = staged(_blocks(members, least), "blocks")
    # Candidates grow with the documents: one plan at every size, never a broadcast.
    sets = _full_sets(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id"), width)
    dealt = sets.select("doc_id", "shingles", F.explode("blocks").alias("block"))

    def confirm(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").combine_chunks()
        found = list(linked_pairs([np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()], least)) if len(ids) > 1 else []
        a, b = (pa.array([p[i] for p in found], pa.int64()) for i in (0, 1))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    kind = docs.schema["doc_id"].dataType
    links = dealt.groupBy("block").applyInArrow(confirm, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    same_id = known.groupBy("digest", "doc_id").agg(F.lit(1).alias("one")).join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = known.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc_id")
    glue = same_id.join(repeated.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    comps = components(links.unionByName(glue)).select(F.col("node").alias("rep"), F.col("component"))
    of_class = classes.select("digest", "rep").join(comps, "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_component"))
    out = prints.drop("bands").join(of_class, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns."""
    gone = near_duplicates(docs, width, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
