"""Quality rules: rule statistics of texts, and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import map_batches, staged, texts, unit_draw
from flowsieve.operators.metrics import RANGE_ROWS, score_ranges
from flowsieve.session import local_frame

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What the forest and the rule ensemble look at; shares, so that length alone is no anomaly.
STATS = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "long_share", "bar_share", "bang_share")
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"


def _repeated(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    keys = list(zip(*(words[i : i + n] for i in range(window))))
    first = [seen.setdefault(k, i) for i, k in enumerate(keys)]
    if len(seen) == n:
        return 0
    first = np.asarray(first)
    twice = np.bincount(first, minlength=n)[first] > 1
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= twice
    return int(covered.sum())


def _duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARK = b"!\"'(),-./:;?[]_`{}~"


def _dropped(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def text_stats(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and STATS of one whole text. Words are runs between ASCII blanks."""
    data = text.encode()
    words = data.split()
    n = len(words)
    blanks = len(data) - sum(map(len, words))
    word_chars = len(text) - blanks
    counts = [n, word_chars, _dropped(data, SYMBOLS), _duplicate_lines(data), _repeated(words)]
    lines = data.count(b"\n") + 1
    per_word, per_char = 1.0 / max(n, 1), 1.0 / max(word_chars, 1)
    stats = [
        float(np.log1p(n)), word_chars * per_word, counts[2] * per_word, counts[3] / lines, counts[4] * per_word,
        _dropped(data, _UPPER) * per_char, _dropped(data, _MARK) * per_word, _dropped(data, _DIGIT) * per_char,
        len(set(words)) * per_word, sum(len(w) > 12 for w in words) * per_word, data.count(b"|") * per_word, data.count(b"!") * per_word,
    ]
    return counts, stats


def with_stats(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the COUNTS (long) and the STATS (double) of every whole text.
    Null and empty texts count 0 everywhere."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [text_stats(t) for t in texts(batch)]
        columns = [batch.column(c) for c in keep]
        columns += [pa.array([c[i] for c, _ in both], pa.int64()) for i in range(len(COUNTS))]
        columns += [pa.array([s[i] for _, s in both], pa.float64()) for i in range(len(STATS))]
        return pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS, *STATS])

    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in STATS]
    return map_batches(docs.select(*keep, "text"), run, fields)


class Forest:
    """Trees of random splits as flat arrays: feature (-1: leaf), cut, left child, length.

    The right child follows the left one. ``length`` is a leaf's path length, with the
    mean length of an unsplit rest of its rows added.
    """

    def __init__(self, roots: list[int], feature: list[int], cut: list[float], left: list[int], length: list[float], rows: int):
        self.roots, self.feature, self.cut = roots, np.array(feature), np.array(cut)
        self.left, self.length, self.rows = np.array(left), np.array(length), rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 2 to the power of minus the mean path over the usual one."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                feature = self.feature[at]
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = self.left[node] + (x[inner, feature[inner]] >= self.cut[node])
            total += self.length[at]
        return 2.0 ** (-total / (len(self.roots) * max(_usual(self.rows), 1e-9)))


def _usual(rows: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of so many rows."""
    if rows <= 1:
        return 0.0
    return 1.0 if rows == 2 else 2.0 * (np.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows


def grow(rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """An isolation forest; every tree sees ``sample`` rows drawn without replacement."""
    draw = np.random.default_rng(seed)
    roots, feature, cut, left, length = [], [], [], [], []

    def add() -> int:
        feature.append(-1), cut.append(0.0), left.append(-1), length.append(0.0)
        return len(feature) - 1

    sample = min(sample, len(rows))
    deepest = int(np.ceil(np.log2(max(sample, 2))))
    for _ in range(trees):
        root = add()
        roots.append(root)
        open_nodes = [(root, rows[draw.choice(len(rows), sample, replace=False)], 0)]
        while open_nodes:
            node, x, depth = open_nodes.pop()
            low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
            usable = np.flatnonzero(high > low)
            if depth >= deepest or not len(usable):
                length[node] = depth + _usual(len(x))
                continue
            f = int(draw.choice(usable))
            c = draw.uniform(low[f], high[f])
            c = high[f] if c <= low[f] else c
            a, b = add(), add()
            feature[node], cut[node], left[node] = f, c, a
            right = x[:, f] >= c
            open_nodes += [(a, x[~right], depth + 1), (b, x[right], depth + 1)]
    return Forest(roots, feature, cut, left, length, sample)


# Length is no fault of its own.
FOREST_STATS = tuple(s for s in STATS if s != "log_words")
TREES, TREE_ROWS = 200, 256
#: Labelled rows that ``labelled`` draws by hash at most.
LABELLED_ROWS = 20_000
#: How many times worse it is to reject a share of the good documents than to keep the same share of the bad.
GOOD_WEIGHT = 10.0


def _likely(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
    """Rows whose doc_id falls into the lowest part of its hash order that holds ``wanted``
    ids for certain: four times as many are expected, whatever the table holds."""
    known = rows.where("doc_id is not null")
    ids = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    return known.withColumn("_draw", unit_draw(F.col("doc_id"), F.lit(seed))).where(F.col("_draw") < 4 * wanted / max(ids, 1))


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS, seed: int = 5) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, quality), drawn by hash; a document
    with several labels counts by the lowest, labels without id or quality not at all."""
    one = _likely(labels.where("quality is not null"), rows, seed).groupBy("doc_id", "_draw").agg(F.min("quality").alias("quality"))
    return one.orderBy("_draw", "doc_id").limit(rows).drop("_draw")


def lowest_labels(labels: DataFrame) -> DataFrame:
    """Every labelled document (doc_id, quality), by its lowest label."""
    known = labels.where("quality is not null and doc_id is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _drawn(docs: DataFrame, rows: int, seed: int) -> DataFrame:
    ids = _likely(docs.select("doc_id"), rows, seed).distinct()
    return ids.orderBy("_draw", "doc_id").limit(rows).drop("_draw")


def base_failed(words, repeated):
    return (words < 50) | (100 * repeated > 50 * words)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> tuple[Forest, float]:
    """The forest and the score from which on documents are rejected.

    The forest is grown from documents drawn by hash, as many as its trees look at
    (``TREES`` x ``TREE_ROWS``: an isolation tree sees few rows by design). The threshold
    is calibrated on every labelled document that the base rules pass: it rejects the
    largest share of quality 0 less ``GOOD_WEIGHT`` times the share of quality 1. Without
    labels of both kinds nothing is rejected by score.
    """
    some = staged(_drawn(docs, TREES * TREE_ROWS, seed), "drawn")
    # Bounded above, so the ids may be broadcast.
    found = docs.join(F.broadcast(some), "doc_id", "left_semi")
    sample = with_stats(found).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if not len(sample):
        return grow(np.zeros((0, len(FOREST_STATS))), 1, 0, seed), 1.0
    forest = grow(sample[list(FOREST_STATS)].to_numpy(float), TREES, TREE_ROWS, seed)
    # Texts are scored where they lie; only scores meet the labels.
    scores = _judged(docs.select("doc_id", "text"), forest, 1.0, ("doc_id",), lambda batch: texts(batch))
    one = scores.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("base_failed", "score")).alias("of"))
    known = one.join(lowest_labels(labels), "doc_id").where("not of.base_failed")
    return forest, calibrated(known.select(F.col("of.score").alias("score"), (F.col("quality") == 1).alias("good")))


def _threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score up to which documents are kept."""
    if good.all() or not good.any():
        return 1.0
    order = np.argsort(-scores, kind="stable")
    gain = np.cumsum(np.where(good[order], -GOOD_WEIGHT / good.sum(), 1.0 / (~good).sum()))
    ends = np.append(scores[order][1:] < scores[order][:-1], True)  # equal scores share their fate
    best = int(np.argmax(np.where(ends, gain, -np.inf)))
    if gain[best] <= 0:
        return 1.0
    return float(scores[order][best + 1 :].max(initial=0.0) + scores[order][best]) / 2


def calibrated(known: DataFrame) -> float:
    """``_threshold`` of a table (score, good) of any size.

    Equal scores are counted together; the distinct scores are cut into stored ranges by
    falling score, running counts inside a range are shifted by the totals before it.
    """
    good, bad = F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    counts = staged(known.groupBy(F.lit("").alias("class"), "score").agg(good, bad), "label-scores")
    totals = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not totals["good"] or not totals["bad"]:
        return 1.0
    placed = score_ranges(counts, RANGE_ROWS)
    parts = sorted(placed.groupBy("range").agg(F.sum("good"), F.sum("bad")).collect())  # a row per RANGE_ROWS scores
    before, above = [], [0, 0]
    for number, g, b in parts:
        before.append((number, *above))
        above = [above[0] + g, above[1] + b]
    offsets = local_frame(placed.sparkSession, before, "range int, good_above bigint, bad_above bigint")
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    running = placed.select("range", "score", F.sum("good").over(inside).alias("g"), F.sum("bad").over(inside).alias("b"))
    gain = (F.col("b") + F.col("bad_above")) / F.lit(float(totals["bad"])) - F.lit(GOOD_WEIGHT) * (F.col("g") + F.col("good_above")) / F.lit(float(totals["good"]))
    best = running.join(offsets, "range").select("score", gain.alias("gain")).orderBy(F.desc("gain"), F.desc("score")).first()
    if best["gain"] <= 0:
        return 1.0
    below = counts.where(F.col("score") < best["score"]).agg(F.max("score")).first()[0]
    return ((below or 0.0) + best["score"]) / 2


def judge(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = 11) -> DataFrame:
    """Columns of ``keep``, COUNTS, base_failed, score and kept of every document.

    kept is false if the base rules fail (under 50 words, or over half of the words in
    repeated windows), or the anomaly score is above the calibrated threshold. Null
    and empty texts have no words and fail. Repeated rows are judged alike; an empty
    table gives an empty result. Columns of ``keep`` must not be named as the output.
    """
    forest, threshold = fit(docs, labels, seed)
    return _judged(docs.select(*dict.fromkeys([*keep, "text"])), forest, threshold, keep, lambda batch: texts(batch))


def _judged(rows: DataFrame, forest: Forest, threshold: float, keep: Sequence[str], read: Callable[[pa.RecordBatch], Iterator[str]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees x 2 x rows of a tree nodes at most
    at = [STATS.index(s) for s in FOREST_STATS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [text_stats(t) for t in read(batch)]
        counts = np.array([c for c, _ in both], dtype=np.int64)
        score = shared.value.score(np.array([s for _, s in both])[:, at])
        failed = base_failed(counts[:, 0], counts[:, COUNTS.index("n_repeat_words")])
        out = [*(batch.column(c) for c in keep), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
        out += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))]
        return pa.RecordBatch.from_arrays(out, [*keep, *COUNTS, "base_failed", "score", "kept"])

    fields = [rows.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_batches(rows, run, fields)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` which ``judge`` keeps, with all their columns. A text travels
    once, inside its row."""
    boxed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))

    def read(batch: pa.RecordBatch) -> Iterator[str]:
        return (value.as_py() or "" for value in batch.column("_row").field("text"))

    return _judged(boxed, *fit(docs, labels), ("_row",), read).where("kept").select("_row.*")
