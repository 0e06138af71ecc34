"""Quality scores from a sparse rule ensemble: tree paths as rules, lasso weights,
compiled to one column expression over the statistics of a text."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import staged
from flowsieve.llm.quality_rules import STATS, labelled, with_stats

TREES, DEPTH, LASSO = 24, 3, 0.003
_TEST = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


class Rule(NamedTuple):
    """A conjunction of (statistic, sign, bound)."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        tests = [F.col(name) <= bound if sign == "<=" else F.col(name) > bound for name, sign, bound in self.terms]
        return reduce(and_, tests).cast("double")


class Ensemble(NamedTuple):
    intercept: float
    weights: list[tuple[Rule, float]]

    def column(self) -> Column:
        """Probability of label 1, of the STATS columns."""
        margin = reduce(add, [rule.column() * w for rule, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def tree_rules(description: str) -> set[Rule]:
    """All paths from a root to an inner node's side, from the printed form of a forest."""
    rules, path = set(), []
    for line in description.splitlines():
        if test := _TEST.search(line):
            depth = len(line) - len(line.lstrip())
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (STATS[int(test[2])], test[3], float(test[4]))))
            rules.add(Rule(tuple(sorted(term for _, term in path))))
        elif line.lstrip().startswith("Tree"):
            path = []
    return rules


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Ensemble:
    """The ensemble, learned from at most ``labelled``'s bound of rows outside the held-out
    fold. With labels of one value only (or none) it is a constant."""
    ours = labels.where(~held_out(F.col("doc_id")))
    sample = staged(labelled(ours), "rule-labels")  # bounded, so its ids may be broadcast
    found = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = with_stats(found).dropDuplicates(["doc_id"]).join(sample, "doc_id").withColumn("label", (F.col("quality") == 1).cast("double"))
    rows = staged(VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(rows), "rule-rows")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Ensemble({0.0: -3.0, 1.0: 3.0}.get(next(iter(seen), 1.0), 3.0), [])
    weight = F.when(F.col("label") == 1, sum(seen.values()) / (2 * seen[1.0])).otherwise(sum(seen.values()) / (2 * seen[0.0]))
    rows = rows.withColumn("weight", weight)
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=seed)
    rules = sorted(tree_rules(forest.fit(rows).toDebugString))
    if not rules:
        return Ensemble(0.0, [])
    fires = staged(rows.select("label", "weight", array_to_vector(F.array(*[r.column() for r in rules])).alias("fires")), "rule-fires")
    lasso = LogisticRegression(featuresCol="fires", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=200)
    model = lasso.fit(fires)
    return Ensemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-9])


def score(docs: DataFrame, labels: DataFrame, at_least: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from ``at_least`` on).

    Every whole text is scored, null as empty. A null id is never held out. Repeated
    rows score alike; an empty table gives an empty result; other columns are ignored.
    """
    ensemble = fit(docs, labels)
    scored = with_stats(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
