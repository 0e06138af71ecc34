"""Mixing sources to target weights: certain whole copies, then Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import WORD, staged, unit_draw

# Steps of the first look at the order; a row-by-row look follows inside one step.
STEPS = 1 << 16
SEED = 20240607


def capped_shares(table: DataFrame, within: Sequence[str], weight: str, cap: str, total: str, name: str) -> DataFrame:
    """``total`` of a group shared among its rows by ``weight``, none above its ``cap``,
    the excess shared again by weight until none is above; as column ``name``.

    By rising cap per weight, the level is what the caps so far have left over the
    weights from here on. It rises while rows are capped and falls afterwards, so the
    level that holds is the highest.
    """
    order = Window.partitionBy(*within).orderBy(F.col(cap) / F.col(weight), *table.columns)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = table.withColumn("level", (F.col(total) - before) / rest)
    top = F.max("level").over(Window.partitionBy(*within))
    return levels.withColumn(name, F.least(F.col(cap), F.col(weight) * top)).drop("level")


def _same(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
    """Inner join on equal names, nulls equal."""
    b = b.select(*[F.col(n).alias(f"{n}_b") if n in names else F.col(n) for n in b.columns])
    on = [a[n].eqNullSafe(F.col(f"{n}_b")) for n in names]
    return a.join(b, on).drop(*[f"{n}_b" for n in names])


def _cut(rows: DataFrame, nearest: bool) -> DataFrame:
    """Per source, the last place in the Pareto order whose running words stay within
    ``open`` (``nearest``: within it up to half of the last document): source, last.

    Words per step of the order are summed first; only the step in which a source's
    cut falls is looked at row by row, so no source is ever sorted as a whole.
    """
    steps = rows.groupBy("source", "step").agg(F.sum("size").alias("words"), F.first("open").alias("open"), F.max("place").alias("end"))
    order = Window.partitionBy("source").orderBy("step")
    run = steps.withColumn("before", F.sum("words").over(order) - F.col("words"))
    full = run.where(F.col("before") + F.col("words") <= F.col("open")).groupBy("source").agg(F.max("end").alias("last"))
    split = run.where((F.col("before") <= F.col("open")) & (F.col("before") + F.col("words") > F.col("open")))
    inside = _same(rows.drop("open"), split.select("source", "step", "before", "open"), "source", "step")
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy("source", "step").orderBy("place"))
    slack = F.col("size") / 2 if nearest else F.lit(0.0)
    taken = inside.withColumn("so_far", so_far - slack).where(F.col("so_far") <= F.col("open"))
    part = taken.groupBy("source").agg(F.max("place").alias("last"))
    return full.unionByName(part).groupBy("source").agg(F.max("last").alias("last"))


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on source, nulls equal."""
    b = b.withColumnRenamed("source", "source_b")
    return a.join(b, a["source"].eqNullSafe(F.col("source_b")), "left").drop("source_b")


class MixPlan(NamedTuple):
    """What decides on a document: tables of a row per source, or per source and size in bits."""

    chances: DataFrame
    first: DataFrame
    second: DataFrame


def sized(docs: DataFrame, seed: int = SEED, *keep: Column) -> DataFrame:
    """doc_id, source, size, draw, row, bits of each document, and the columns to ``keep``."""
    return docs.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        unit_draw(F.col("doc_id"), F.lit(seed)).alias("draw"), F.monotonically_increasing_id().alias("row"), *keep,
    ).withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def _ranked(base: DataFrame, chances: DataFrame) -> DataFrame:
    rows = _same(base, chances, "source", "bits")
    odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("chance") / (1 - F.col("chance")))
    rank = odds / (1 + odds)
    place = F.when(F.col("chance").isNotNull(), F.struct(rank.alias("rank"), "doc_id", "size", "row"))
    return rows.withColumn("place", place).withColumn("step", F.floor(rank * STEPS))


def _in_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    return _left(rows, first).withColumn("in_first", F.coalesce(F.col("place") <= F.col("first_last"), F.lit(False)))


def plan_mix(base: DataFrame, weights: Sequence[float], share: float, most: float) -> MixPlan:
    """Targets, expected copies and the cuts of the Pareto order, from ``sized`` documents."""
    classes = staged(base.groupBy("source", "bits").agg(F.sum("size").cast("double").alias("words")), "classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))) + 1)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("all_words", total)
    sources = capped_shares(sources, [], "weight", "cap", "all_words", "target").select("source", "source_size", "target")

    classes = _same(classes, sources, "source").withColumn("pull", F.col("words") * F.col("bits")).withColumn("cap", F.col("words") * most)
    filled = capped_shares(classes.where("words > 0"), ["source"], "pull", "cap", "target", "share")
    expected = F.col("share") / F.col("words")
    filled = filled.withColumn("certain", F.floor(expected + 1e-9)).withColumn("chance", expected - F.col("certain"))
    sure = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    chance = F.when(F.col("chance") > 1e-9, F.col("chance")).alias("chance")
    filled = filled.select("source", "source_size", "target", "bits", "certain", chance, (F.col("target") - sure).alias("open"))
    none = [F.lit(0).cast("long").alias("certain"), F.lit(None).cast("double").alias("chance"), F.lit(0.0).alias("open")]
    empty = classes.where("words = 0").select("source", "source_size", "target", "bits", *none)
    chances = staged(filled.unionByName(empty), "chances")

    waiting = _ranked(base, chances).where("place is not null").select("source", "step", "size", "place", "open")
    first = staged(_cut(waiting, nearest=False).withColumnRenamed("last", "first_last"), "first-cut")
    waiting = _in_first(waiting, first)
    words = F.sum(F.when(F.col("in_first"), F.col("size")).otherwise(0))
    lacking = staged(waiting.groupBy("source").agg((F.first("open") - words).alias("lacks")), "lacking")
    fitting = _same(waiting.where(~F.col("in_first")), lacking, "source").where(F.col("size") <= 2 * F.col("lacks"))
    fitting = fitting.select("source", "step", "size", "place", F.col("lacks").alias("open"))
    second = staged(_same(_cut(fitting, nearest=True), lacking, "source").withColumnRenamed("last", "second_last"), "second-cut")
    return MixPlan(chances, first, second)


def decide(base: DataFrame, plan: MixPlan) -> DataFrame:
    """``base`` with source_size, target, copies and taken: comparisons with the small tables of the plan."""
    rows = _left(_in_first(_ranked(base, plan.chances), plan.first), plan.second)
    fits = (F.col("size") <= 2 * F.col("lacks")) & (F.col("place") <= F.col("second_last"))
    chosen = F.col("in_first") | F.coalesce(fits, F.lit(False))
    copies = (F.col("certain") + chosen.cast("long")).cast("long")
    out = rows.withColumn("copies", copies).withColumn("source_size", F.col("source_size").cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("place", "step", "certain", "chance", "open", "first_last", "in_first", "second_last", "lacks")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size,
    target, copies, taken (words).

    Size is the number of words. Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times all words; no target passes ``most``
    times its source. Within a source, documents expect copies in proportion to the
    bits of their size (longer ones are likelier), at most ``most``. The whole part is
    taken for certain; the fraction is the inclusion probability of a Pareto sample:
    documents are ranked by the odds of a draw over the odds of their inclusion, and
    the lowest are taken up to the words the source still lacks. A second look takes
    documents that fit what the first left.

    Draws are hashes of doc_id, so reruns agree. Null and empty texts have size 0 and
    no copies. Repeated rows count each; equal draws go by size and row. An empty table
    gives an empty result. Other columns are ignored.
    """
    base = staged(sized(docs, seed), "sizes")
    return decide(base, plan_mix(base, weights, share, most)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as ``mix`` takes it. Texts
    are not shuffled: the decision compares a row with the small tables of the plan."""
    plan = plan_mix(staged(sized(docs, seed), "sizes"), weights, share, most)
    rows = decide(sized(docs, seed, F.struct(*[F.col(c) for c in docs.columns]).alias("_row")), plan)
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.where("copies > 0").select("_row", again.alias("_copy")).select("_row.*")
