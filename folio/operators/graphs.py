"""Pairs within a record, and the graphs that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.lineage import cut


def pairs(items: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) for each unordered pair of different values of a record.

    A record's values are gathered into one sorted array, so the pairs are made where it lies and
    not by a join of the table with itself.  The array is as long as one record has values.
    """
    sets = items.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("v"))
    each = sets.select(key, "v", F.posexplode("v").alias("i", "a"))
    return each.select(key, "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))


def edges(items: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    """(a, b, weight): in how many records two values occur together."""
    return pairs(items, key, value).groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def nodes(items: DataFrame, key: str, value: str) -> DataFrame:
    """(value, n): in how many records a value occurs."""
    return items.select(key, value).distinct().groupBy(value).agg(F.count("*").alias("n"))


def cooccurrence(items: DataFrame, key: str, value: str, floor: int) -> tuple[DataFrame, DataFrame]:
    """Values in ``floor`` records or more, and their pairs in as many."""
    frequent = nodes(items, key, value).where(F.col("n") >= floor)
    return frequent, edges(items.join(frequent.select(value), value, "left_semi"), key, value, floor)


def coauthor_network(items: DataFrame, key: str, author: str, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the ``top`` authors by records (ties by name).

    An edge touches a top author, and both its ends have at least a third of the records of the last
    top author (1, if there are fewer authors than ``top``).  Top authors stay without edges, too.
    """
    n = nodes(items, key, author)
    best = n.orderBy(F.desc("n"), author).limit(top)
    size = best.agg(F.count("*").alias("k"), F.min("n").alias("last"))
    floor = size.select(F.when(F.col("k") >= top, F.greatest(F.lit(1), F.floor(F.col("last") / 3))).otherwise(1).alias("floor"))
    enough = n.crossJoin(F.broadcast(floor)).where(F.col("n") >= F.col("floor")).select(author)  # one row
    # Authors below the floor are in no edge, so they make no pairs.
    all_edges = edges(items.join(enough, author, "left_semi"), key, author)
    mark = lambda c: best.select(F.col(author).alias(c), F.lit(True).alias(f"{c}_top"))
    kept = all_edges.join(mark("a"), "a", "left").join(mark("b"), "b", "left").where("a_top or b_top").select("a", "b", "weight")
    ends = kept.select(F.col("a").alias(author)).unionByName(kept.select(F.col("b").alias(author))).unionByName(best.select(author)).distinct()
    return n.join(ends, author, "left_semi"), kept


def components(edge_list: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edge_list`` (a, b): the least id that is reachable.

    Each round contracts the edges: every node goes to the first of its neighbours and itself, in an
    order by hash, so a star is one node after two rounds, and of a path a share of the nodes goes
    each time however long it is.  Rounds go on until no edge is left.
    """
    left = cut(edge_list.select("a", "b").distinct())
    label = None
    while True:
        place = lambda c: F.xxhash64(F.lit(1), c)
        both = left.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("other")))
        first = both.groupBy("id").agg(F.min_by("other", place("other")).alias("other"))
        step = cut(first.select("id", F.when(place("other") < place("id"), F.col("other")).otherwise(F.col("id")).alias("to")))
        to = lambda c: step.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        if label is None:
            label = step.select("id", F.col("to").alias("root"))
        else:
            label = cut(label.join(to("root"), "root", "left").select("id", F.coalesce("root_to", "root").alias("root")))
        inner = left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        left = cut(inner.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if left.isEmpty():
            least = label.groupBy("root").agg(F.min("id").alias("component"))
            return label.join(least, "root").select("id", "component")


def figure_graph(node_list: DataFrame, edge_list: DataFrame, node: str, top: int = 30, weight: int = 2, small: int = 2) -> tuple[DataFrame, DataFrame]:
    """The ``top`` nodes, edges of ``weight`` or more between them, without isolated nodes and components of up to ``small``."""
    best = node_list.orderBy(F.desc("n"), node).limit(top)
    inner = edge_list.where(F.col("weight") >= weight).join(best.select(F.col(node).alias("a")), "a", "left_semi").join(best.select(F.col(node).alias("b")), "b", "left_semi")
    label = components(inner)
    large = label.withColumn("size", F.count("*").over(Window.partitionBy("component"))).where(F.col("size") > small)
    kept = inner.join(large.select(F.col("id").alias("a")), "a", "left_semi")
    return best.join(large.select(F.col("id").alias(node), "component"), node), kept


def communities(edge_list: DataFrame, most: int = 20_000) -> DataFrame:
    """(id, community) of a drawn graph: communities are merged while that raises the modularity, the best pair first.

    For graphs cut down to a figure's few dozen nodes: the edges come to the driver, more than
    ``most`` are an error.  A community is named after its least member.
    """
    rows = edge_list.select("a", "b", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: cut the graph down first")
    between: dict = {}
    degree: dict = {}
    for a, b, w in rows:
        for x, y in ((a, b), (b, a)):
            between.setdefault(x, {})[y] = between.get(x, {}).get(y, 0) + w
            degree[x] = degree.get(x, 0) + w
    total, members = sum(degree.values()), {n: [n] for n in degree}
    while True:
        gains = [(2 * (w / total - degree[x] * degree[y] / total**2), x, y) for x, near in between.items() for y, w in near.items() if x < y]
        best = max(gains, key=lambda g: g[0], default=(0, None, None))
        if best[0] <= 0:
            break
        _, x, y = best
        members[x] += members.pop(y)
        degree[x] += degree.pop(y)
        for z, w in between.pop(y).items():
            between[z].pop(y)
            if z != x:
                between[x][z] = between[z][x] = between[x].get(z, 0) + w
    named = [(n, min(some)) for some in members.values() for n in some]
    kind = edge_list.schema["a"].dataType.simpleString()
    return edge_list.sparkSession.createDataFrame(named, f"id {kind}, community {kind}")


def matrix(node_list: DataFrame, edge_list: DataFrame, node: str, top: int = 20) -> DataFrame:
    """(a, b, weight) among the ``top`` nodes, both ways round: the long form of a symmetric matrix."""
    best = node_list.orderBy(F.desc("n"), node).limit(top)
    inner = edge_list.join(best.select(F.col(node).alias("a")), "a", "left_semi").join(best.select(F.col(node).alias("b")), "b", "left_semi")
    return inner.select("a", "b", "weight").unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(name, one column for each of a stated list of names)."""
    return long.groupBy(F.col("a").alias("name")).pivot("b", names).agg(F.sum("weight"))
