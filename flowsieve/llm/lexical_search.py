"""Exact ranked lexical search by a dual-tree walk.

Items and documents are vectors over the items' terms: weights times repeats on one
side, saturated term counts on the other, all integers. Both sides get a hierarchy whose
nodes hold the maximum of every coordinate. The product of two nodes' maxima bounds the
score of every pair below them; a pair of nodes whose bound does not reach the weakest
score its items still need is dropped whole, everything else is scored exactly.

Items are taken in blocks of bounded size (a stated query set); documents stay spread as
they are stored, in batches of bounded size, and only the best of each task move.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.common import map_batches, staged
from flowsieve.session import local_frame

# An item block holds about this many terms (with repeats) and items at most.
BLOCK_TERMS, BLOCK_ITEMS = 16_384, 512
ITEM_LEAF, DOC_LEAF, BATCH_DOCS = 8, 64, 4096
# Share of the documents, drawn by hash, whose results give the first limits.
PILOT = 64
LAST_ID = (1 << 63) - 1
# Bytes of a term: ASCII digits and letters, A-Z lowered, and all beyond ASCII; the rest is blank.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return [t for t in text.translate(TERM_BYTES).split(b" ") if t]


def raw_texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    for value in batch.column("text").cast(pa.binary()):
        yield value.as_py() or b""


class Tree(NamedTuple):
    """Points in ``order``; a node is order[start:stop], its children follow by number."""

    order: np.ndarray
    start: list[int]
    stop: list[int]
    children: list[tuple[int, int] | None]


def grow(points: np.ndarray, leaf: int) -> Tree:
    """Halve the points at the coordinate of the greatest spread until ``leaf`` are left."""
    tree = Tree(np.arange(len(points)), [0], [len(points)], [None])
    todo = [0]
    while todo:
        node = todo.pop()
        start, stop = tree.start[node], tree.stop[node]
        if stop - start <= leaf:
            continue
        inside = tree.order[start:stop]
        spread = points[inside].max(axis=0) - points[inside].min(axis=0)
        middle = (stop - start) // 2
        tree.order[start:stop] = inside[np.argpartition(points[inside, spread.argmax()], middle)]
        tree.children[node] = len(tree.start), len(tree.start) + 1
        todo += tree.children[node]
        tree.start.extend((start, start + middle))
        tree.stop.extend((start + middle, stop))
        tree.children.extend((None, None))
    return tree


def maxima(tree: Tree, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Node by coordinate: the greatest value below the node, from sparse entries."""
    place = np.empty(len(tree.order), np.int64)
    place[tree.order] = np.arange(len(tree.order))
    top = np.zeros((len(tree.start), width))
    leaves = sorted((n for n, c in enumerate(tree.children) if c is None), key=tree.start.__getitem__)
    leaf = np.array(leaves)[np.searchsorted([tree.stop[n] for n in leaves], place[rows], side="right")]
    key = leaf * width + columns
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    top.flat[key[first]] = np.maximum.reduceat(values[by_key], first)
    for node in range(len(tree.start) - 1, -1, -1):
        if tree.children[node]:
            top[node] = np.maximum(*top[list(tree.children[node])])
    return top


class Items(NamedTuple):
    """A block of items: entries (item, term, weight times repeats) and their hierarchy."""

    n: int
    width: int
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def built(self) -> _ItemTree:
        return _ItemTree(self)


class _ItemTree:
    def __init__(self, items: Items):
        dense = np.zeros((items.n, items.width))
        dense[items.item, items.term] = items.weight
        self.tree = grow(dense @ dense.T, ITEM_LEAF)
        self.top = maxima(self.tree, items.item, items.term, items.weight, items.width)
        self.leaves = {}
        means = []
        for node, children in enumerate(self.tree.children):
            if children is None:
                inside = self.tree.order[self.tree.start[node] : self.tree.stop[node]]
                support = np.flatnonzero(dense[inside].any(axis=0))
                at = np.full(items.width, -1)
                at[support] = np.arange(len(support))
                self.leaves[node] = inside, at, dense[np.ix_(inside, support)]
                means.append(dense[inside].mean(axis=0))
        self.means = np.array(means)


class _Best:
    """The k best documents of each item, from a limit per item upwards."""

    def __init__(self, limits: np.ndarray, k: int):
        self.k, self.limit = k, limits.copy()
        self.rows: list[np.ndarray] = [np.empty((0, 2), np.int64) for _ in limits]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        both = np.vstack([self.rows[item], np.column_stack([scores, ids])])
        both = both[np.lexsort((both[:, 1], -both[:, 0]))][: self.k]
        self.rows[item] = both
        if len(both) == self.k:
            self.limit[item] = both[-1, 0]


def walk(items: _ItemTree, best: _Best, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Feed ``best`` with all documents of a batch that can matter.

    Entries (doc, term, value) are sorted by doc; ``ids`` are the documents' ids.
    """
    width = items.top.shape[1]
    first = np.searchsorted(doc, np.arange(len(ids)))
    profile = np.column_stack([np.add.reduceat(value * mean[term], first) for mean in items.means])
    tree = grow(profile, DOC_LEAF)
    top = maxima(tree, doc, term, value.astype(np.float64), width)
    bound = items.top @ top.T
    exact = bound[0, 0] < float(1 << 53)  # all partial sums are integers below 2**53
    bound *= 1 + 1e-9
    last = np.r_[first[1:], len(doc)]
    entries: dict[int, tuple[np.ndarray, ...]] = {}
    todo = [(0, 0)]
    while todo:
        i, d = todo.pop()
        inside = items.tree.order[items.tree.start[i] : items.tree.stop[i]]
        if bound[i, d] < best.limit[inside].min():
            continue
        below_i, below_d = items.tree.children[i], tree.children[d]
        if below_i or below_d:
            # The side with more points opens; the child with the higher bound is seen first.
            by_doc = below_d and (not below_i or tree.stop[d] - tree.start[d] > len(inside))
            pairs = [(i, c) for c in below_d] if by_doc else [(c, d) for c in below_i]
            todo += sorted(pairs, key=lambda p: bound[p])
            continue
        if d not in entries:
            docs = tree.order[tree.start[d] : tree.stop[d]]
            spans = [np.arange(first[x], last[x]) for x in docs]
            at = np.concatenate(spans)
            entries[d] = docs, np.repeat(np.arange(len(docs)), [len(s) for s in spans]), term[at], value[at]
        docs, row, column, found = entries[d]
        inside, at, weights = items.leaves[i]
        held = at[column] >= 0
        dense = np.zeros((len(docs), weights.shape[1]))
        dense[row[held], at[column[held]]] = found[held]
        score = weights @ dense.T if exact else weights.astype(np.int64) @ dense.astype(np.int64).T
        score = score.astype(np.int64)
        for n in np.flatnonzero((score >= best.limit[inside][:, None]).any(axis=1)):
            hit = np.flatnonzero(score[n] >= best.limit[inside[n]])
            best.add(inside[n], score[n, hit], ids[docs[hit]])


def _searched(postings: DataFrame, items: Items, limits: np.ndarray, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """item (number in the block), score, id: the k best of every task."""
    schema = T.StructType.fromDDL("item int, score long, id long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, best = items.built(), _Best(limits, k)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(start, BATCH_DOCS)
                n, tf = batch.column("n").to_numpy(), _numbers(batch.column("tfs")).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), pa.compute.binary_length(batch.column("terms")).to_numpy() // 4)
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
                walk(tree, best, batch.column("id").to_numpy(), doc, _numbers(batch.column("terms")), value)
        rows = np.vstack(best.rows)
        item = np.repeat(np.arange(items.n), [len(r) for r in best.rows])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((item, rows[:, 0], rows[:, 1]), arrow.types)], schema=arrow)

    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return postings.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbers(column: pa.Array) -> np.ndarray:
    """All numbers of a column of packed lists."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column), "<i4")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n (terms with repeats), terms and tfs (of the vocabulary) of every document.

    Lists are packed as little-endian bytes, read back without a copy per number.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found, counts = [], [], []
        for text in raw_texts(batch):
            seen = Counter(terms(text))
            sizes.append(sum(seen.values()))
            ours = [(vocabulary[t], n) for t, n in seen.items() if t in vocabulary]
            found.append(np.array([t for t, _ in ours], "<i4").tobytes())
            counts.append(np.array([n for _, n in ours], "<i4").tobytes())
        lists = [pa.array(x, pa.binary()) for x in (found, counts)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    fields = [T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())]
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")
    return staged(map_batches(named, run, fields), "postings")


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """Results of one block of items (rows of item_id, terms, repeats)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in block for t in r["terms"]}))}
    postings = _postings(docs, vocabulary)
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        term, n = np.unique(_numbers(batch.column("terms")), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64())], ["t", "n"])

    counts = map_batches(postings.select("terms"), held, [T.StructField("t", T.IntegerType()), T.StructField("n", T.LongType())])
    # A row per term of the block at most.
    df = {r["t"]: r["n"] for r in counts.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    entries = [(i, t, weight[t] * n) for i, r in enumerate(block) for t, n in zip(map(vocabulary.get, map(bytes, r["terms"])), r["repeats"]) if weight.get(t)]
    if not entries:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    items = Items(len(block), len(vocabulary), *np.array(entries, np.int64).T)
    scored = postings.where(F.octet_length("terms") > 0)
    limits = np.ones(items.n, np.int64)
    pilot = _searched(scored.where(F.pmod(F.xxhash64("id", "n"), F.lit(PILOT)) == 0), items, limits, k, n_docs, n_terms)
    for r in pilot.where(F.col("rank") == k).collect():  # a row per item of the block at most
        limits[r["item"]] = r["score"]
    found = _searched(scored, items, limits, k, n_docs, n_terms)
    names = local_frame(spark, [(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item.

    ``docs`` holds doc_id, text, ``items`` item_id, text. Terms, weights and scores are
    those of the module's constants: integer arithmetic, equal scores by ascending
    doc_id, scores of 0 left out. Whole texts count, however long. A null or empty text
    has no terms: as a document it counts for nothing, as an item it has no results. A
    null doc_id comes last among ties. Repeated rows are rows of their own on both sides.
    Other columns are ignored; an empty table on either side gives an empty result.
    """

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = [Counter(terms(t)) for t in raw_texts(batch)]
        columns = [pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), *columns], ["item_id", "terms", "repeats"])

    fields = [T.StructField("item_id", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("repeats", T.ArrayType(T.LongType()))]
    bagged = map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), bags, fields)
    bagged = staged(bagged.where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()), "items")
    n_items, n_terms = bagged.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-n_terms // block_terms), -(-n_items // block_items), 1)
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    # Each block comes to the driver alone: its size is bounded by the figures above.
    parts = [_search_block(docs, bagged.where(number == b).orderBy("row").collect(), k) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
