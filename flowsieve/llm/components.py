"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import staged


def _rename(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b).

    Contraction: each node points to its smallest neighbour, pointers are followed to
    their ends, and links between the ends make the next, smaller graph. Rounds grow
    with the logarithm of the graph; a hub costs one partial minimum, never a list.
    Self links, repeated links and links with a null are harmless; an empty table gives
    an empty result.
    """
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    graph = staged(links.where("a <> b").select(*ends).distinct(), "links")
    found: DataFrame | None = None
    while not graph.isEmpty():
        pointer = staged(graph.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("node"), "to"), "pointers")
        while True:
            onward = _rename(pointer, node="to", to="next")
            step = staged(pointer.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "pointers")
            pointer = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        if found is None:
            found = pointer
        else:
            later = _rename(pointer, node="to", to="next")
            found = found.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to")).unionByName(pointer)
        left, right = _rename(pointer, node="a", to="a_end"), _rename(pointer, node="b", to="b_end")
        moved = graph.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a_end", "a").alias("a"), F.coalesce("b_end", "b").alias("b"))
        graph = staged(moved.where("a <> b").select(*ends).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    roots = found.select(F.col("to").alias("node"), F.col("to").alias("component"))
    return staged(found.select("node", F.col("to").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
