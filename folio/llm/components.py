"""Connected components by repeated contraction, entirely in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); the component is its smallest id.

    Each round sends every node to the first of its neighbours and itself, in an order by hash, and
    contracts the edges.  A star is one node after two rounds; of a path a share of the nodes goes
    each time, so the rounds grow with the logarithm of the nodes and not with the length of paths.
    The neighbours of a hub meet in a minimum, combined before the shuffle.  Self-loops are allowed;
    nulls must not occur.
    """
    left = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        place = lambda c: F.xxhash64(F.lit(1), c)
        both = left.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("other")))
        first = both.groupBy("id").agg(F.min_by("other", place("other")).alias("other"))
        step = scratch.save(first.select("id", F.when(place("other") < place("id"), F.col("other")).otherwise(F.col("id")).alias("to")), "step")
        to = lambda c: step.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        if roots is None:
            roots = scratch.save(step.select("id", F.col("to").alias("root")), "roots")
        else:
            new = scratch.save(roots.join(to("root"), "root", "left").select("id", F.coalesce("root_to", "root").alias("root")), "roots")
            scratch.drop(roots)
            roots = new
        inner = left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        shorter = scratch.save(inner.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        scratch.drop(left, step)
        left = shorter
        if left.isEmpty():
            least = roots.groupBy("root").agg(F.min("id").alias("component"))
            return scratch.save(roots.join(least, "root").select("id", "component"), "components")
