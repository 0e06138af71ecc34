"""Near-duplicate vectors: sorted projection passes find components, whole counts follow inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.common import map_batches, staged
from flowsieve.llm.components import components

#: Passes (least), bits of a pass's concatenated hash, and neighbours compared on each side in its order (least).
PASSES, BITS, WINDOW = 24, 62, 24
#: Mean chance with which a pair at the limit, without other relatives, is to be found.
RECALL = 0.99
#: Windows are widened, up to so many rows, while more passes than this would be needed.
WIDE, MANY_PASSES = 6144, 48
#: Passes that the density of the codes is read from.
_PROBES = 3
#: Rows of a block when the links inside a component are counted.
BLOCK_ROWS = 512
_SEED = 17


def _planes(passes: int, dims: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dims]).standard_normal((passes, BITS, dims))


def units(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles of unit length, as bytes) of every row; vector is null where
    it links with nothing: null, empty, zero, or with null or non-finite components."""

    def unit(value: list | None) -> bytes | None:
        if not value or any(x is None for x in value):
            return None
        x = np.array(value, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top  # so that no square overflows
        return (x / np.sqrt(x @ x)).tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [unit(v) for v in batch.column("embedding").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.binary())], ["vec_id", "vector"])

    return map_batches(vectors.select("vec_id", "embedding"), run, [vectors.schema["vec_id"], T.StructField("vector", T.BinaryType())])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def centres(reps: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each length. A row per task and length reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column("vector").to_pylist()])
            for dims in map(int, np.unique(sizes)):
                x = _matrix(batch.column("vector").take(pa.array(np.flatnonzero(sizes == dims))))
                sums[dims] = sums.get(dims, 0) + np.append(x.sum(axis=0), len(x))
        for dims, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dims", "total"])

    found: dict[int, np.ndarray] = {}
    for r in reps.select("vector").mapInArrow(run, "dims int, total binary").collect():
        found[r.dims] = found.get(r.dims, 0) + np.frombuffer(r.total, np.float64)
    # Rounded, so that the order of the sums does not matter.
    return {dims: np.round(total[:-1] / total[-1], 9) for dims, total in found.items()}


def sorted_passes(reps: DataFrame, passes: int, centre: dict[int, np.ndarray]) -> DataFrame:
    """dims, turn, code, rep, vector: every vector once per pass with its concatenated hash.

    The bits are the sides of random planes through the mean of all vectors that the vector
    lies on, as vectors that all lean one way would else share their codes; sorted by code,
    vectors that agree on a long row of leading bits are neighbours.
    """
    schema = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("code", T.LongType()), reps.schema["rep"], T.StructField("vector", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column("vector").to_pylist()])
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                x = _matrix(part.column("vector"))
                for turn, planes in enumerate(_planes(passes, int(dims))):
                    code = (((x - centre[int(dims)]) @ planes.T) > 0).astype(np.int64) @ power
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, turn, np.int32)), pa.array(code), part.column("rep").cast(arrow.field("rep").type), part.column("vector")], schema=arrow)

    return reps.select("rep", "vector").mapInArrow(run, schema)


def _window_links(ordered: DataFrame, cosine: float, window: int) -> DataFrame:
    """Links (a, b) between rows at most ``window`` apart in the order of their partition,
    and the rows at its ends (a, and what else places them), for the seams between partitions."""
    kind = ordered.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), *(ordered.schema[c] for c in ("dims", "turn", "vector"))])
    arrow = to_arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["dims", "turn", "rep", "vector"]
        tail, head = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch.select(names)])
            edge = min(window - head, new.num_rows)
            if edge > 0:  # the first rows of the partition close its left seam
                yield _seam(new.slice(0, edge), part, 1, arrow)
                head += edge
            rows = new if tail is None else pa.concat_tables([tail, new])
            old = 0 if tail is None else tail.num_rows
            yield from _links(rows, old, cosine, window, arrow)
            tail = rows.slice(max(0, rows.num_rows - window))
        if tail is not None:
            yield _seam(tail, part, 0, arrow)

    return ordered.mapInArrow(compare, schema)


def _seam(rows: pa.Table, part: int, side: int, arrow: pa.Schema) -> pa.RecordBatch:
    rows, n = rows.combine_chunks(), rows.num_rows
    null = pa.nulls(n, arrow.field("b").type)
    columns = [rows.column("rep").combine_chunks(), null, pa.array([part] * n, pa.int32()), pa.array([side] * n, pa.int32()), *(rows.column(c).combine_chunks() for c in ("dims", "turn", "vector"))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _links(rows: pa.Table, old: int, cosine: float, window: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of the links of the rows from ``old`` on with up to ``window`` rows before each, as
    many as connect these rows: a family in a window needs one link a row, not all pairs."""
    dims, turn = (rows.column(c).to_numpy() for c in ("dims", "turn"))
    reps, vectors = rows.column("rep").combine_chunks(), rows.column("vector").combine_chunks()
    end = np.arange(len(dims))

    def root(i: int) -> int:
        while end[i] != i:
            end[i] = end[end[i]]
            i = end[i]
        return i

    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = _matrix(vectors.take(pa.array(at)))
        step = max(64, window)
        for low in range(int(np.searchsorted(at, old)), len(at), step):
            high, back = min(low + step, len(at)), max(0, low - window)
            i, j = np.nonzero(x[low:high] @ x[back:high].T >= cosine)
            first, second = at[back + j], at[low + i]
            near = (first < second) & (second - first <= window) & (turn[first] == turn[second])
            first, second = first[near], second[near]
            kept = []
            # Next neighbours first: in a family they connect all, which leaves no other pair to look at.
            beside = second - first == 1
            for part in (beside, ~beside):
                a, b = first[part], second[part]
                while len(a):
                    ends = np.array([[root(p), root(q)] for p, q in zip(a[:256], b[:256])])
                    for p, q, (m, n) in zip(a[:256], b[:256], ends):
                        m, n = root(m), root(n)
                        if m != n:
                            end[n] = m
                            kept.append((p, q))
                    a, b = a[256:], b[256:]
                    open_ = end[a] != end[b]
                    a, b = a[open_], b[open_]
            if kept:
                a, b = (reps.take(pa.array(side)) for side in zip(*kept))
                yield pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(a), f.type) for f in list(arrow)[2:])], schema=arrow)


def _depths(reps: DataFrame, cosine: float, windows: list[int], centre: dict[int, np.ndarray]) -> dict[int, list[tuple[float, int, int]]]:
    """Per window: chance of a bit to be alike in a pair at the limit, leading bits the pair must
    agree on to be that near in the order, and rows of which this is so.

    A row and the one a window on share some leading bits: with one more, a bucket is within
    the window. Rows linked with the one a window on are left out, as their windows
    hold their family. The distance to the mean gives the angle of a pair seen from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = (new if rest is None else pa.concat_tables([rest, new])).combine_chunks()
            old = 0 if rest is None else rest.num_rows
            dims, turn, code = (rows.column(c).to_numpy() for c in ("dims", "turn", "code"))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(rows.column("vector").combine_chunks().take(pa.array(at)))
                apart = ((x - centre[int(d)]) ** 2).sum(axis=1)
                alike = 1 - np.arccos(np.clip(1 - (1 - cosine) / np.maximum(apart, 1e-9), -1, 1)) / np.pi
                for w in windows:
                    # Rows that have no row a window on in their pass need no bit at all.
                    last = np.arange(max(0, old - w - int(at[0])) if old else 0, max(0, len(at) - w))
                    last = last[(at[last + w] >= old) & (turn[at[last]] == turn[at[last + w]])]
                    last = last[np.einsum("ij,ij->i", x[last], x[last + w]) < cosine]
                    differ = (code[at[last]] ^ code[at[last + w]]).astype(np.float64)
                    shared = np.where(differ > 0, BITS - np.frexp(differ)[1], BITS)
                    for key, n in zip(*np.unique(np.column_stack([np.round(alike[last] * 50), np.minimum(shared + 1, BITS)]).astype(int), axis=0, return_counts=True)):
                        counts[w, *map(int, key)] = counts.get((w, *map(int, key)), 0) + int(n)
            rest = rows.slice(max(0, rows.num_rows - max(windows)))
        if counts:
            w, p, k = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["window", "alike", "bits", "rows"])

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sorted_passes(reps, _PROBES, centre).repartitionByRange(parts, "dims", "turn", "code", "rep").sortWithinPartitions("dims", "turn", "code", "rep")
    found = ordered.select("dims", "turn", "code", "vector").mapInArrow(run, "window int, alike int, bits int, rows long")
    out: dict[int, list[tuple[float, int, int]]] = {w: [] for w in windows}
    for r in found.groupBy("window", "alike", "bits").agg(F.sum("rows").alias("rows")).collect():
        out[r["window"]].append((r["alike"] / 50, r["bits"], r["rows"]))
    return out


def passes_for(depths: list[tuple[float, int, int]], recall: float = RECALL) -> int:
    """Passes after which pairs at the limit are found with a mean chance of ``recall``."""
    if not depths:
        return 1
    alike, bits, rows = (np.array(c, float) for c in zip(*depths))
    hit = np.clip(alike, 0.5, 1 - 1e-12) ** bits

    def enough(passes: int) -> bool:
        return rows @ (1 - (1 - hit) ** passes) >= recall * rows.sum()

    high = 1
    while not enough(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def plan(reps: DataFrame, cosine: float, centre: dict[int, np.ndarray], passes: int | None = None, window: int | None = None) -> tuple[int, int]:
    """Passes and window for ``RECALL`` on this table, where they are not given: the least
    window that needs at most ``MANY_PASSES``, else the widest with as many as it needs."""
    if passes and window:
        return passes, window
    windows = [window] if window else [WINDOW << i for i in range(20) if WINDOW << i <= WIDE]
    depths = _depths(reps, cosine, windows, centre)
    for w in windows:
        needed = passes or max(PASSES, passes_for(depths[w]))
        if needed <= MANY_PASSES:
            break
    return needed, w


def find_links(reps: DataFrame, cosine: float, passes: int | None = None, window: int | None = None) -> DataFrame:
    """Links (a, b) found by the sorted passes, each verified by its cosine. Partitions of
    the order overlap by a window, through their end rows; so partitions do not matter."""
    parts = reps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    centre = centres(reps)
    passes, window = plan(reps, cosine, centre, passes, window)
    ordered = sorted_passes(reps, passes, centre).repartitionByRange(int(parts), "dims", "turn", "code", "rep").sortWithinPartitions("dims", "turn", "code", "rep")
    found = staged(_window_links(ordered, cosine, window), "window-links")
    links = found.where("b is not null").select("a", "b")
    ends = found.where("b is null")
    # Partitions that hold rows, in order: at most as many as tasks.
    filled = ends.select("part").distinct().withColumn("next", F.lead("part").over(Window.orderBy("part")))
    right = ends.where("place = 1").select("part", F.col("a").alias("rep"), "dims", "turn", "vector", F.lit(1).alias("side"))
    left = ends.where("place = 0").join(filled, "part").where("next is not null").select(F.col("next").alias("part"), F.col("a").alias("rep"), "dims", "turn", "vector", F.lit(0).alias("side"))
    kind = reps.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    full = to_arrow_schema(T.StructType([*schema.fields, T.StructField("x", T.IntegerType())]))

    def across(group: pa.Table) -> pa.Table:
        # Both ends hold a window of rows at most; comparing all of them only adds neighbours.
        out = [pa.table({"a": b.column(0), "b": b.column(1)}) for b in _links(group.sort_by("side"), 0, cosine, 2 * window, full)]
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    seams = right.unionByName(left).groupBy("part").applyInArrow(across, schema)
    return links.unionByName(seams)


def _count_blocks(members: DataFrame, cosine: float) -> DataFrame:
    """rep, print, near: for members (rep, print, vector, copies, component), the copies of other
    members linked with each. Two blocks of rows meet in a task; nothing leaves it but sums."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = members.join(size, "component").withColumn("block", F.pmod(F.hash("rep", "print"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("component", "rep", "print", "vector", "copies", "block", other)
    rows = rows.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), (F.col("block") == F.col("other")).alias("same"), (F.col("block") <= F.col("other")).alias("low"), "component", "rep", "print", "vector", "copies")
    schema = T.StructType([members.schema["rep"], T.StructField("print", T.LongType()), T.StructField("near", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(group: pa.Table) -> pa.Table:
        component = group.column("component").to_numpy()
        low = group.column("low").to_numpy() | group.column("same").to_numpy()
        high = ~low | group.column("same").to_numpy()
        copies, vectors = group.column("copies").to_numpy(), group.column("vector").combine_chunks()
        near = np.zeros(len(group), np.int64)
        sizes = np.array([len(v) for v in vectors.to_pylist()])
        for c in np.unique(component):
            for s in np.unique(sizes[component == c]):
                ours = (component == c) & (sizes == s)
                a, b = np.flatnonzero(ours & low), np.flatnonzero(ours & high)
                if not len(a) or not len(b):
                    continue
                linked = _matrix(vectors.take(pa.array(a))) @ _matrix(vectors.take(pa.array(b))).T >= cosine
                if group.column("same").to_numpy()[a[0]]:
                    linked[np.arange(len(a)), np.arange(len(a))] = False
                    near[a] += linked @ copies[b]
                else:
                    near[a] += linked @ copies[b]
                    near[b] += linked.T @ copies[a]
        return pa.table([group.column("rep").combine_chunks().cast(arrow.field("rep").type), group.column("print").combine_chunks(), pa.array(near)], schema=arrow)

    return rows.groupBy("pair").applyInArrow(count, schema).groupBy("rep", "print").agg(F.sum("near").alias("near"))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, passes: int | None = None, window: int | None = None) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one representative with a number of copies. Each pass sorts the
    representatives by the concatenated hashes of random planes and verifies neighbours
    in a window; links of all passes are united to components. Passes and window, unless
    given, follow from the density of the codes, so that a pair at the limit is found with
    a mean chance of ``RECALL`` at every size. Links are then
    counted whole inside each component, block against block, so a family larger than
    any window loses none of its links.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as vectors of different length do; so does a row without vec_id. Rows of one
    vec_id are one node, each row with the links of its own vector. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = staged(units(vectors), "units")
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    reps = rows.where(usable).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = staged(reps.withColumn("print", F.xxhash64("vector")), "representatives")
    comps = components(find_links(reps, cosine, passes, window)).select(F.col("node").alias("rep"), "component")
    near = _count_blocks(reps.join(comps, "rep"), cosine)
    n_links = (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    facts = reps.join(comps, "rep", "left").join(near, ["rep", "print"], "left").select("vector", F.coalesce("component", "rep").alias("component_id"), n_links)
    linked = rows.where(usable).join(facts, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
