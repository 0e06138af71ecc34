"""Hard negatives: the best rows of another label below a share of a positive's score.

Anchors are clustered by direction. For a cluster and a chunk of candidates the
candidates are sorted once by an upper bound of their inner product with any member
(norm times the cosine of the angle to the centre less the cluster's radius). Every
member walks that shared list until no later bound reaches the weakest score it still
needs, which certifies that the list holds nothing more for it.

Clusters are cut into parts of bounded size and candidates into chunks, so a task holds
one part and one chunk whatever the table. Chunks are visited in rounds of growing
share; each round starts from the weakest kept scores of the rounds before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import map_batches, staged

CLUSTERS, SAMPLE_ROWS = 8, 20_000
CHUNK_ROWS, PART_ROWS, ROUND_GROWTH = 65_536, 16_384, 8
# Members scored together, and list entries per step of their walk.
MEMBERS, STEP = 512, 2048
# Norms stay below this, so that scores and their percentages fit 64 bits.
NORM_LIMIT = float(1 << 28)
LAST_ID = (1 << 63) - 1
NEVER = (1 << 62) - 1
Q = T.StructField("q", T.BinaryType())
FOUND = "anchor long, want int, score long, id long, row long"


def quantised(vectors: DataFrame, anchors: Column, scale: int) -> DataFrame:
    """Rows that take part, numbered (row), with integer vectors q as little-endian bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("embedding")
        lengths = pa.compute.list_value_length(lists).to_numpy()
        x = np.floor(lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
        row = np.repeat(np.arange(len(lengths)), lengths)
        finite = np.isfinite(x)
        with np.errstate(over="ignore"):
            norm2 = np.bincount(row, np.where(finite, x, np.inf) ** 2, len(lengths))
        usable = norm2 < NORM_LIMIT**2
        offsets = np.r_[0, 4 * np.cumsum(lengths)].astype("<i4")
        data = np.where(usable[row], x, 0).astype("<i4")
        q = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        columns = [batch.column(c) for c in ("id", "label", "is_anchor")] + [q]
        return pa.RecordBatch.from_arrays(columns, ["id", "label", "is_anchor", "q"]).filter(pa.array(usable))

    named = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return staged(map_batches(named, run, [*named.schema.fields[:3], Q]).withColumn("row", F.monotonically_increasing_id()), "quantised")


def centres(rows: DataFrame, dims: int, clusters: int, seed: int = 17) -> np.ndarray:
    """Unit centres of k-means over at most SAMPLE_ROWS anchors, drawn by hash."""

    def pointing(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch, dims).astype(np.float64)
        lists = pa.FixedSizeListArray.from_arrays(x[x.any(axis=1)].ravel(), dims)
        return pa.RecordBatch.from_arrays([lists.cast(pa.list_(pa.float64()))], ["x"])

    drawn = rows.where("is_anchor").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("q")
    if not dims or (sample := staged(map_batches(drawn, pointing, [T.StructField("x", T.ArrayType(T.DoubleType()))]), "anchor-sample")).isEmpty():
        return np.zeros((1, 0))
    model = KMeans(k=clusters, maxIter=10, distanceMeasure="cosine", seed=seed).fit(sample.select(array_to_vector("x").alias("features")))
    found = np.array(model.clusterCenters())
    norms = np.linalg.norm(found, axis=1)
    return found[norms > 0] / norms[norms > 0, None]


def _matrix(table: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    """The integer vectors of a table, shorter ones padded with zeros."""
    column = table.column("q")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.binary_length(column).to_numpy() // 4
    flat = np.frombuffer(b"".join(v.as_buffer() for v in column), "<i4")
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    padded = np.zeros((len(lengths), dims), np.int32)
    padded[np.arange(dims) < lengths[:, None]] = flat
    return padded


def _angles(x: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    if not centre.size:
        return np.zeros(len(x))
    return np.arccos(np.clip(x @ centre / np.maximum(norms, 1e-300), -1.0, 1.0))


def _keep_first(want: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each want: high scores first, ties by place."""
    order = np.lexsort((place, -score, want))
    sorted_want = want[order]
    starts = np.flatnonzero(np.r_[True, sorted_want[1:] != sorted_want[:-1]]) if len(order) else np.array([], int)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


class _List:
    """The shared list of one cluster part: a chunk's candidates by falling bound."""

    def __init__(self, members: np.ndarray, candidates: pa.Table, centre: np.ndarray):
        x = _matrix(candidates, members.shape[1]).astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1))
        ids, rows = (candidates.column(c).to_numpy() for c in ("id", "row"))
        place = np.empty(len(x), np.int64)
        place[np.lexsort((rows, ids))] = np.arange(len(x))
        own = np.sqrt((members * members).sum(axis=1))
        radius = _angles(members, own, centre).max() + 1e-6
        bound = norms * np.cos(np.clip(_angles(x, norms, centre) - radius, 0.0, np.pi))
        order = np.lexsort((place, -bound))
        self.x, self.bound, self.place = x[order], bound[order], place[order]
        self.ids, self.rows, self.labels = ids[order], rows[order], candidates.column("label").to_numpy()[order]
        self.slack = 1e-9 * norms.max(initial=0.0)
        self.exact = norms.max(initial=0.0) * own.max(initial=0.0) < float(1 << 53)

    def scores(self, members: np.ndarray, part: slice) -> np.ndarray:
        if self.exact:  # every partial sum of a product is an integer below 2**53
            return (members @ self.x[part].T).astype(np.int64)
        return members.astype(np.int64) @ self.x[part].astype(np.int64).T

    def walk(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, floors: np.ndarray, caps: np.ndarray, k: int, same: bool):
        """Best k entries of each (member, want) with floor <= score <= cap."""
        wants = floors.shape[1]
        weakest, last = floors.copy(), np.full(floors.shape, LAST_ID)
        found = [np.empty((0,), np.int64)] * 3  # want number, score, list position
        norms = np.sqrt((x * x).sum(axis=1))
        active = np.arange(len(x))
        for start in range(0, len(self.x), STEP):
            reach = norms[active] * (self.bound[start] + self.slack) + 1e-6
            active = active[reach >= weakest[active].min(axis=1)]
            if not len(active):
                break
            part = slice(start, start + STEP)
            score = self.scores(x[active], part)
            allowed = ((labels[active][:, None] == self.labels[part]) == same) & (rows[active][:, None] != self.rows[part])
            for j in range(wants):
                floor, at = weakest[active, j, None], last[active, j, None]
                ok = allowed & (score <= caps[active, j, None]) & ((score > floor) | ((score == floor) & (self.place[part] < at)))
                if ok.sum() > 4 * k * len(active) and ok.shape[1] > k:
                    cut = np.partition(np.where(ok, score, -LAST_ID), -k, axis=1)[:, -k, None]
                    ok &= score >= cut
                r, c = np.nonzero(ok)
                if not len(r):
                    continue
                number = active[r] * wants + j
                merged = [np.concatenate(pair) for pair in zip(found, (number, score[r, c], c + start))]
                kept = _keep_first(merged[0], merged[1], self.place[merged[2]], k)
                found = [m[kept] for m in merged]
            # Wants that are full need more than their weakest entry from now on.
            ends = np.flatnonzero(np.r_[found[0][1:] != found[0][:-1], True]) if len(found[0]) else np.array([], int)
            sizes = np.diff(np.r_[-1, ends])
            full = ends[sizes == k]
            weakest.flat[found[0][full]] = found[1][full]
            last.flat[found[0][full]] = self.place[found[2][full]]
        return found


def _limits(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    """A row of numbers per text of comma-separated ones."""
    rows = [text.as_py().split(",") for text in column]
    width = max(map(len, rows))
    return np.array([r + [missing] * (width - len(r)) for r in rows]).astype(np.int64)


def _cells(k: int, same: bool, heart: np.ndarray, dims: int):
    """The grouped function of a pass: one part of a cluster with one chunk of candidates."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sides = table.column("floors").is_valid()
        members, candidates = table.filter(sides), table.filter(pa.compute.invert(sides))
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if members.num_rows and candidates.num_rows:
            x = _matrix(members, dims).astype(np.float64)
            shared = _List(x, candidates, heart[key[0].as_py()])
            rows, labels = members.column("row").to_numpy(), members.column("label").to_numpy()
            floors, caps = _limits(members.column("floors"), NEVER), _limits(members.column("caps"), -NEVER)
            width = floors.shape[1]
            for start in range(0, len(x), MEMBERS):
                part = slice(start, start + MEMBERS)
                number, score, at = shared.walk(x[part], rows[part], labels[part], floors[part], caps[part], k, same)
                for column, values in zip(out, (rows[part][number // width], number % width, score, shared.ids[at], shared.rows[at])):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "want", "score", "id", "row"])

    return run


def _rounds(chunks: int) -> Iterator[tuple[int, int]]:
    start, stop = 0, 1
    while start < chunks:
        yield start, min(stop, chunks)
        start, stop = stop, stop * ROUND_GROWTH


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(members: DataFrame, rows: DataFrame, pieces: list[tuple[int, int]], chunks: int, heart: np.ndarray, dims: int, k: int, same: bool) -> DataFrame:
    """anchor, want, score, id, row, rank: the k best of each want of ``members`` over all rows."""
    # Limits travel as text: null lists make Arrow batches slow to write.
    none = F.lit(None).cast("string")
    texts = [F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))).alias(c) for c in ("floors", "caps")]
    shared = ["row", "id", "label", "q"]
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    places = F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(p).alias("piece")) for c, p in pieces]))
    best: DataFrame | None = None
    for start, stop in _rounds(chunks):
        open_ = members
        if best is not None:
            # A want with k entries so far takes nothing below the weakest of them.
            weakest = best.groupBy("anchor", "want").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            lists = weakest.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("want", "s"))).alias("kept"))
            raised = F.transform("floors", lambda f, i: F.greatest(f, F.element_at("kept", i)))
            open_ = members.join(lists, F.col("row") == F.col("anchor"), "left").withColumn("floors", F.when(F.col("kept").isNull(), F.col("floors")).otherwise(raised))
        left = open_.withColumn("chunk", F.explode(F.sequence(F.lit(start), F.lit(stop - 1)))).select("cluster", "piece", "chunk", *shared, *texts)
        right = chunked.where(F.col("chunk").between(start, stop - 1)).withColumn("place", places)
        right = right.select("place.cluster", "place.piece", "chunk", *shared, none.alias("floors"), none.alias("caps"))
        found = left.unionByName(right).groupBy("cluster", "piece", "chunk").applyInArrow(_cells(k, same, heart, dims), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = staged(_first(found, k), "walked")
    return best


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, clusters: int = CLUSTERS, chunk_rows: int = CHUNK_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` holds vec_id, embedding, integer label. Components become
    floor(scale * x), scores are inner products of those integers, exact in 64 bits.
    An anchor's positives are the first ``positives`` other rows of its label; for each
    the first ``negatives`` rows of other labels are returned whose score lies between
    ``low`` and ``high`` per cent of the positive's. Higher scores come first, ties by
    smaller vec_id.

    Rows with a null label, a null vector, a null or non-finite component, or a
    quantised norm of 2**28 and more take no part. Shorter vectors count as padded with
    zeros, so an empty one scores 0 with all. A null vec_id comes last among ties and is
    an anchor only if the condition says so. Repeated rows are rows of their own: each
    may be a positive or negative, and a repeated anchor answers as often as it is there.
    Other columns are ignored; an empty table, or one without anchors, gives an empty
    result. There are no texts.
    """
    rows = quantised(vectors, anchors, scale)
    n_rows, longest = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("q"))).first()
    dims = (longest or 0) // 4
    heart = centres(rows, dims, clusters)

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch, dims).astype(np.float64)
        cluster = (x @ heart.T).argmax(axis=1) if heart.shape[1] else np.zeros(len(x), np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32())], [*batch.schema.names, "cluster"])

    own = rows.where("is_anchor").select("row", "id", "label", "q")
    placed = staged(map_batches(own, nearest, [*own.schema.fields, T.StructField("cluster", T.IntegerType())]), "anchors")
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # at most ``clusters`` rows
    pieces = {c: -(-n // part_rows) for c, n in sizes.items()}
    chunks = max(1, -(-n_rows // chunk_rows))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not pieces:
        return vectors.sparkSession.createDataFrame([], schema)
    per = F.create_map(*[F.lit(v) for pair in pieces.items() for v in pair])
    members = placed.withColumn("piece", F.pmod(F.xxhash64("row", F.lit(1)), F.element_at(per, F.col("cluster"))).cast("int"))
    cells = [(c, p) for c, n in pieces.items() for p in range(n)]
    anyone = members.withColumns({"floors": F.array(F.lit(-NEVER)), "caps": F.array(F.lit(NEVER))})
    near = _search(anyone, rows, cells, chunks, heart, dims, positives, same=True)

    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("list"))
    floor = F.expr(f"transform(list, p -> IF(p.score < 0, {NEVER}L, ({low} * p.score + 99) div 100))")
    cap = F.expr(f"transform(list, p -> ({high} * p.score) div 100)")
    bounded = members.join(listed.select("anchor", floor.alias("floors"), cap.alias("caps")), F.col("row") == F.col("anchor")).drop("anchor")
    hard = _search(staged(bounded, "windows"), rows, cells, chunks, heart, dims, negatives, same=False)

    def plain(column: str) -> Column:
        return F.when(F.col(column) != LAST_ID, F.col(column))

    positive = near.select("anchor", (F.col("rank") - 1).alias("want"), plain("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = members.select(F.col("row").alias("anchor"), plain("id").alias("anchor_id"))
    negative = hard.select("anchor", "want", "rank", plain("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negative.join(positive, ["anchor", "want"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
