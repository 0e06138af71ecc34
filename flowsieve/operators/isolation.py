"""Isolation forest: small trees built in parallel, rows scored in place.

Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008). A tree sees at most
``SAMPLE_ROWS`` rows, so the forest is a few thousand nodes whatever the table
holds; it travels to the tasks as one broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.functions.hashing import row_hash
from flowsieve.operators.quantiles import quantiles
from flowsieve.operators.selection import take_n
from flowsieve.session import local_frame, stage

TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.15
SWEEP = (0.10, 0.15, 0.20)
EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, threshold double, size bigint, depth int"
# Rows walked together: an Arrow batch of Spark's size goes whole.
SCORE_STEP = 10_240
# Hash digits by which rows are counted before a sample is taken: at most 4,096 counts.
NEAR_DIGITS = 3


def mean_path(n: int) -> float:
    """Mean search depth among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def tree_samples(
    train: DataFrame,
    features: Sequence[str],
    key: Sequence[str] | None,
    trees: int,
    rows: int,
    seed: int,
    order: str | None = None,
) -> tuple[DataFrame, int]:
    """(tree, x) with ``min(rows, table)`` rows without replacement in every tree.

    The first ``trees * rows`` rows of a random order are drawn, or all there are, and
    laid out in a circle. Tree ``t`` starts at place ``t`` and takes ``rows`` places at
    equal steps, the widest that fit once round. So samples are disjoint where the
    table is large enough, and overlap where it is not. ``order`` names a
    column that stores ``row_hash(seed, key)``.
    """
    key = list(key or features)
    columns = [ref(c) for c in dict.fromkeys([*key, *features])]
    hashed = train.select(*columns, (ref(order) if order else row_hash(seed, key)).alias("_h"))
    near, size = _first_by_hash(hashed, trees * rows)
    rows = min(rows, size)
    drawn = take_n(near, trees * rows, None if key == list(features) else key, seed)
    vector = F.array(*[ref(f).cast("double") for f in features]).alias("x")
    # At most trees * rows rows reach this window.
    place = F.row_number().over(Window.orderBy("_h", "x")) - 1
    placed = drawn.select(vector, row_hash(seed, key).alias("_h")).select("x", place.alias("_place"))
    circle = max(1, min(size, trees * rows))
    step = max(1, circle // max(1, rows))
    ahead = lambda t: F.pmod(F.col("_place") - t, F.lit(circle))
    mine = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: (ahead(t) % step == 0) & (ahead(t) < step * rows),
    )
    return placed.select(F.explode(mine).alias("tree"), "x"), rows


def _first_by_hash(hashed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A part of the table that holds the first ``n`` rows by the hash ``_h``, and the table's size.

    One pass counts the rows by the first digits of their hash, a second stores those up
    to the digits at which ``n`` are reached. Where that is most of the table, as with
    many copies of a row, the table itself is returned.
    """
    digits, table = F.substring("_h", 1, NEAR_DIGITS), hashed.drop("_h")
    counts = sorted(hashed.groupBy(digits.alias("digits")).count().collect())
    size, held, last = sum(c["count"] for c in counts), 0, ""
    for last, count in counts:
        held += count
        if held >= n:
            break
    return (table if 2 * held > size else stage(hashed.filter(digits <= last).drop("_h"), "near")), size


def grow(sample: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    """Nodes of one tree, numbered as a heap: children of i are 2i+1 and 2i+2."""
    x = np.stack(sample["x"].to_numpy())
    x = x[np.lexsort(x.T[::-1])]
    tree = int(sample["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    while todo:
        node, members, depth = todo.pop()
        feature, threshold = -1, 0.0
        if depth < max_depth and len(members) > 1:
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            varying = np.flatnonzero(low < high)
            if len(varying):
                feature = int(rng.choice(varying))
                threshold = float(rng.uniform(low[feature], high[feature]))
                left = x[members, feature] <= threshold
                todo.append((2 * node + 2, members[~left], depth + 1))
                todo.append((2 * node + 1, members[left], depth + 1))
        nodes.append((tree, node, feature, threshold, len(members), depth))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "size", "depth"])


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees. ``offset`` is the score below which a row is an outlier."""

    nodes: tuple[tuple, ...]
    features: tuple[str, ...]
    trees: int
    rows: int
    offset: float | None = None

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        features: Sequence[str],
        key: Sequence[str] | None = None,
        trees: int = TREES,
        sample_rows: int = SAMPLE_ROWS,
        seed: int = 42,
        order: str | None = None,
    ) -> IsolationForest:
        """``order`` names a column of ``train`` that stores ``row_hash(seed, key)``: no pass hashes again."""
        samples, rows = tree_samples(train, features, key, trees, sample_rows, seed, order)
        depth = max(1, math.ceil(math.log2(max(2, rows))))
        grown = samples.groupBy("tree").applyInPandas(lambda s: grow(s, seed, depth), NODES)
        # At most trees * (2 * sample_rows - 1) rows.
        nodes = sorted(tuple(r) for r in grown.collect())
        return cls(tuple(nodes), tuple(features), trees, rows)

    def with_offset(self, offset: float) -> IsolationForest:
        return replace(self, offset=offset)

    def _arrays(self, depth: int) -> list[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
        """For each tree: split features and thresholds of every level, and the path length by last place.

        Trees are laid out in full: place ``i`` of a level leads to ``2i`` (left) and
        ``2i + 1`` of the next. Nothing exceeds the threshold below a leaf, so every row
        takes the same number of steps.
        """
        places = 2 ** (depth + 1) - 1
        grouped: dict[int, list[tuple]] = {}
        for n in self.nodes:
            grouped.setdefault(n[0], []).append(n)
        arrays = []
        for tree in sorted(grouped):
            splits, threshold, path = np.zeros(places, np.intp), np.full(places, np.inf), np.zeros(2**depth)
            for _, node, feature, limit, size, level in grouped[tree]:
                if feature >= 0:
                    splits[node], threshold[node] = feature, limit
                else:
                    path[(node + 1 << depth - level) - 2**depth] = level + mean_path(size)
            ends = [2**level - 1 for level in range(depth + 1)]
            arrays.append(([(splits[a:b], threshold[a:b]) for a, b in zip(ends, ends[1:])], path))
        return arrays

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of a matrix of features: ``-2 ** (-mean depth / expected depth)``, lower is more unusual."""
        depth = max(n[5] for n in self.nodes)
        return partial(_scored, trees=self._arrays(depth), expected=mean_path(self.rows) or 1.0)

    def score_column(self, spark: SparkSession) -> Column:
        shared = spark.sparkContext.broadcast(self.scorer())

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(shared.value(np.column_stack([s.to_numpy(dtype=float) for s in batch])))

        return score(*[ref(f).cast("double") for f in self.features])

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.withColumn(out, self.score_column(df.sparkSession))

    def offsets(
        self,
        train: DataFrame,
        contaminations: Sequence[float] = SWEEP,
        method: str = "exact",
        scored: str | None = None,
    ) -> dict[float, float]:
        """Outlier thresholds of several contamination levels from one scored pass.

        ``scored`` names a stored column of ``train`` which holds the scores already.
        """
        if scored is None:
            scores = stage(train.select(self.score_column(train.sparkSession).alias("score")), "scores")
        else:
            scores = train.select(ref(scored).alias("score"))
        found = quantiles(scores, ["score"], contaminations, method)["score"]
        return dict(zip(contaminations, found))

    def predict(self, df: DataFrame, out: str = "code") -> DataFrame:
        """Add the detector code: -1 outlier, 1 inlier."""
        if self.offset is None:
            raise ValueError("the forest has no offset yet")
        return self.score(df, "_score").withColumn(
            out, detector_code(F.col("_score"), self.offset)
        ).drop("_score")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = F.lit(self.offset).cast("double").alias("offset")
        names = F.array(*[F.lit(f) for f in self.features]).alias("features")
        frame = local_frame(spark, list(self.nodes), NODES)
        frame.select("*", F.lit(self.rows).alias("rows"), meta, names).coalesce(1).write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        rows = spark.read.parquet(path).collect()
        nodes = sorted(tuple(r)[:6] for r in rows)
        trees = max(n[0] for n in nodes) + 1
        head = rows[0]
        return cls(tuple(nodes), tuple(head["features"]), trees, head["rows"], head["offset"])


def _scored(x: np.ndarray, trees: list, expected: float) -> np.ndarray:
    out = np.empty(len(x))
    for i in range(0, len(x), SCORE_STEP):
        out[i : i + SCORE_STEP] = mean_depth(x[i : i + SCORE_STEP], trees)
    return -np.exp2(-out / expected)


def mean_depth(x: np.ndarray, trees: list) -> np.ndarray:
    """Mean leaf depth of each row over all trees."""
    rows = len(x)
    columns = np.ascontiguousarray(x.T)
    cells, row = columns.ravel(), np.arange(rows)
    total = np.zeros(rows)
    for levels, path in trees:
        node = np.zeros(rows, np.intp)
        for feature, threshold in levels:
            if len(feature) == 1:
                node += columns[feature[0]] > threshold[0]
                continue
            at = (feature * rows).take(node)
            at += row
            right = cells.take(at) > threshold.take(node)
            node += node
            node += right
        total += path.take(node)
    return total / len(trees)


def detector_code(score: Column, offset: float | Column) -> Column:
    return F.when(score < offset, F.lit(-1)).otherwise(F.lit(1))
