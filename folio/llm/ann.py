"""Approximate nearest neighbours: NN-descent builds the graph, queries walk it greedily."""

from __future__ import annotations

from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.runtime import Scratch

#: Neighbours of a node, and of those that name it as theirs the nearest; random trees; vectors in a leaf.
NEIGHBOURS, BACKWARD, TREES, LEAF = 24, 24, 6, 128
#: Descent goes on until a round changes fewer than this share of all neighbours.
SETTLED = 0.02
#: Vectors that the trees are fitted on: a fixed bound, whatever the table's size. Cells of more members are split on.
SAMPLE, CELL = 16384, 4096
#: Candidates that a query keeps for each doubling of the nodes, those it expands at once, and members of each of its cells that it starts from.
BEAM, EXPAND, ENTRIES = 24, 96, 16
#: Neighbours that a task holds to merge them before the shuffle.
HELD = 1 << 20
#: Seed of the directions along which large cells are split.
DIRECTIONS = 1
PAIR = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
LISTS = "id long, near array<struct<d: double, id: long>>"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def squared(x: np.ndarray) -> np.ndarray:
    """All squared distances within a block."""
    n = np.einsum("ij,ij->i", x, x)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


def nearest(ids: np.ndarray, x: np.ndarray, most: np.ndarray | None, k: int, rows: dict[int, list]) -> None:
    """Adds to each member its up to ``k`` nearest others closer than ``most``; distances are exact."""
    if len(ids) < 2:
        return
    d = squared(x)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    exact = np.sqrt(((x[:, None, :] - x[at]) ** 2).sum(axis=2))
    good = exact < most[:, None] if most is not None else np.ones_like(exact, bool)
    for i in np.flatnonzero(good.any(axis=1)):
        rows.setdefault(int(ids[i]), []).extend(zip(exact[i][good[i]].tolist(), ids[at[i][good[i]]].tolist(), strict=True))


def batch_of(rows: dict[int, list], k: int) -> pa.RecordBatch:
    lists = [[{"d": d, "id": i} for d, i in sorted(set(near))[:k]] for near in rows.values()]
    return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int64()), pa.array(lists, PAIR)], ["id", "near"])


def forest_of(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(planes, cuts) of trees of random hyperplanes between sampled vectors, each split at the sample's median."""
    rng, grown = np.random.default_rng(seed), []
    for _ in range(trees):
        planes, cuts = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            x = parts.pop(node)
            a, b = x[rng.integers(len(x), size=2)] if len(x) else np.zeros((2, sample.shape[1]))
            planes[node] = a - b if (a != b).any() else rng.standard_normal(sample.shape[1])
            side = x @ planes[node]
            cuts[node] = np.median(side) if len(x) else 0.0
            parts[2 * node], parts[2 * node + 1] = x[side <= cuts[node]], x[side > cuts[node]]
        grown.append((planes, cuts))
    return grown


def cells(forest: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The cell of each vector in each tree."""
    out = np.zeros((len(forest), len(x)), np.int64)
    for t, (planes, cuts) in enumerate(forest):
        node = np.ones(len(x), np.int64)
        for _ in range(len(cuts).bit_length() - 1):
            node = 2 * node + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
        out[t] = (t << 32) + node
    return out


def _route(batches, forest):
    for batch in batches:
        for row in cells(forest.value, matrix(batch.column(1))):
            yield pa.RecordBatch.from_arrays([pa.array(row), *batch.columns], ["cell", "id", "vec"])


def _leaves(ids: np.ndarray, x: np.ndarray, leaf: int, rng):
    """Parts of at most ``leaf`` members, split at the median along random directions."""
    todo = [np.arange(len(ids))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            yield part
            continue
        order = np.argsort(x[part] @ rng.standard_normal(x.shape[1]), kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]


def _within_cell(table: pa.Table, leaf: int, k: int) -> pa.Table:
    table = table.combine_chunks()
    ids, x, rows = table.column("id").to_numpy(), matrix(table.column("vec").combine_chunks()), {}
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for part in _leaves(ids, x, leaf, np.random.default_rng(int(table.column("cell")[0].as_py()) & ((1 << 63) - 1))):
        nearest(ids[part], x[part], None, k, rows)
    return pa.Table.from_batches([batch_of(rows, k)])


def _meet(batches, k: int):
    """Rows come sorted by node; its members are compared with one another, and each one's finds merged before they are dealt."""
    rows: dict[int, list] = {}
    held, count = None, 0
    for batch in chain(batches_of(batches), [None]):
        if batch is None:
            table, whole = held, True
        else:
            table, whole = batch if held is None else pa.concat_tables([held, batch]), False
        if table is None or not table.num_rows:
            continue
        node = table.column("node").to_numpy()
        edges = np.flatnonzero(node[1:] != node[:-1]) + 1
        last = table.num_rows if whole else (int(edges[-1]) if len(edges) else 0)
        held = table.slice(last)
        if not last:
            continue
        part = table.slice(0, last).combine_chunks()
        ids, kth, x = part.column("id").to_numpy(), part.column("kth").to_numpy(), matrix(part.column("vec").combine_chunks())
        bounds = [0, *[int(e) for e in edges if e < last], last]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            nearest(ids[a:b], x[a:b], kth[a:b], k, rows)
            count += (b - a) * k
            if count > HELD:
                yield batch_of(rows, k)
                rows, count = {}, 0
    if rows:
        yield batch_of(rows, k)


def batches_of(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def merge(lists: DataFrame, k: int) -> DataFrame:
    """Each id's ``k`` nearest of all its lists: a few from each task at most."""
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    return lists.groupBy("id").agg(near.alias("near")).select("id", F.slice("near", 1, k).alias("near"))


def backward(graph: DataFrame, most: int) -> DataFrame:
    """(node, id): of those that have ``node`` among their neighbours the nearest ``most``."""
    named = graph.select("id", F.explode("near").alias("n")).select(F.col("n.id").alias("node"), "id", "n.d")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("d", "id"))
    return named.withColumn("nth", nth).where(F.col("nth") <= most).select("node", "id")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: no null, NaN, infinite or all-zero vectors, and of the commonest length."""
    vec = F.col(vec_col).cast("array<double>")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and size(vec) > 0").where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    common = clean.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return clean.where(F.size("vec") == (common["n"] if common else 0))


def _sides(batches, seed: int):
    """Each member of a large cell: its place along the cell's own random direction."""
    for batch in batches:
        cell, x = batch.column(0).to_numpy(), matrix(batch.column(2))
        side = np.zeros(len(cell))
        for c in np.unique(cell):
            some = cell == c
            side[some] = x[some] @ np.random.default_rng([seed, int(c) & ((1 << 63) - 1)]).standard_normal(x.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(side)], ["cell", "id", "vec", "side"])


def cells_of(nodes: DataFrame, scratch: Scratch, count: int) -> DataFrame:
    """(cell, id, vec): every node's cell in each of the trees, none of more than about CELL members.

    The trees are fitted on a bounded sample; cells that still are large are split at the median along
    a direction of their own, all at once, until none is.
    """
    spark = nodes.sparkSession
    sample = np.array([r["vec"] for r in nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    depth = max(0, min(int(np.ceil(np.log2(max(1, count / LEAF)))), int(np.log2(max(1, len(sample) / 16)))))
    forest = spark.sparkContext.broadcast(forest_of(sample, TREES, depth))
    routed = scratch.save(nodes.mapInArrow(partial(_route, forest=forest), "cell long, id long, vec array<double>"), "cells")
    while True:
        large = scratch.save(routed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("cell"), "large")
        if large.isEmpty():
            return routed
        inside = routed.join(large, "cell", "left_semi").mapInArrow(partial(_sides, seed=DIRECTIONS), "cell long, id long, vec array<double>, side double")
        middle = inside.groupBy("cell").agg(F.percentile_approx("side", 0.5).alias("middle"))
        # A cell that lies in one point of its direction is split by hash.
        far = F.when(F.col("side") == F.col("middle"), F.xxhash64("id", "cell") % 2 == 0).otherwise(F.col("side") > F.col("middle"))
        halves = inside.join(middle, "cell").select((F.xxhash64("cell", far)).alias("cell"), "id", "vec")
        routed = scratch.save(routed.join(large, "cell", "left_anti").unionByName(halves), "cells")


def build_graph(nodes: DataFrame, cells: DataFrame, scratch: Scratch, count: int, k: int = NEIGHBOURS) -> DataFrame:
    """(id, near) for the nodes (id, vec), all different.

    Cells of random trees give first neighbours.  Each round of NN-descent then joins every node's
    neighbours, forward and backward, with each other, until few change.  Backward ones are the
    nearest BACKWARD, so a hub's neighbourhood is as small as any other's.
    """
    first = cells.groupBy("cell").applyInArrow(lambda cell: _within_cell(cell, 2 * LEAF, k), LISTS)
    graph = scratch.save(merge(first, k), "graph")
    while True:
        forward = graph.select(F.col("id").alias("node"), F.explode("near.id").alias("id"))
        edges = forward.unionByName(backward(graph, BACKWARD)).unionByName(graph.select(F.col("id").alias("node"), "id")).distinct()
        kth = F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near.d", -1))
        members = nodes.join(graph.select("id", kth.alias("kth")), "id").select("id", "vec", "kth")
        dealt = edges.join(members, "id").select("node", "id", "vec", "kth").repartition("node").sortWithinPartitions("node", "id")
        new = scratch.save(merge(graph.unionByName(dealt.mapInArrow(partial(_meet, k=k), LISTS)), k), "graph")
        before = graph.select("id", F.col("near.id").alias("before"))
        changed = new.join(before, "id").agg(F.sum(F.size(F.array_except("near.id", "before")))).first()[0] or 0
        scratch.drop(graph)
        scratch.tidy()
        graph = new
        if changed <= SETTLED * k * count:
            return graph


def distance(x: str, y: str):
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def walk(queries: DataFrame, nodes: DataFrame, graph: DataFrame, cells: DataFrame, scratch: Scratch, beam: int, expand: int = EXPAND) -> DataFrame:
    """(query, id, d) for queries (query, vec), which are nodes: greedy search from the query's node and members of its cells.

    Each step expands the nearest candidates that weren't yet, all queries at once: their graph
    neighbours, forward and backward, that weren't seen are measured, and the best ``beam`` stay.
    It ends when every candidate of every query is expanded.
    """
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    entries = cells.select("cell", "id").withColumn("nth", nth).where(F.col("nth") <= ENTRIES).select("cell", F.col("id").alias("other"))
    asked = cells.select("cell", "id").join(queries.select(F.col("query").alias("id")), "id").withColumnRenamed("id", "query")
    both = graph.select("id", F.explode("near.id").alias("other")).unionByName(backward(graph, BACKWARD).select(F.col("node").alias("id"), F.col("id").alias("other")))
    links = scratch.save(both.groupBy("id").agg(F.collect_set("other").alias("others")), "links")
    begin = asked.join(entries, "cell").select("query", "other").unionByName(queries.select("query", F.col("query").alias("other")))
    fresh = scratch.save(begin.groupBy("query").agg(F.collect_set("other").alias("fresh")), "fresh")
    state = queries.select("query", F.col("vec").alias("here"), F.expr("CAST(array() AS array<struct<d: double, id: long, done: boolean>>)").alias("best"), F.expr("CAST(array() AS array<long>)").alias("seen"))
    while True:
        pairs = fresh.select("query", F.explode("fresh").alias("id")).join(nodes.withColumnRenamed("vec", "there"), "id").join(state.select("query", "here"), "query")
        found = pairs.select("query", F.struct(distance("here", "there").alias("d"), "id", F.lit(False).alias("done")).alias("c")).groupBy("query").agg(F.collect_list("c").alias("found"))
        nearer = F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.expr("CAST(array() AS array<struct<d: double, id: long, done: boolean>>)")))), 1, beam)
        more = F.concat("seen", F.coalesce("fresh", F.expr("CAST(array() AS array<long>)")))
        met = state.join(found, "query", "left").join(fresh, "query", "left").select("query", "here", nearer.alias("best"), more.alias("seen"))
        turn = F.slice(F.filter("best", lambda c: ~c["done"]), 1, expand)["id"]
        done = F.transform("best", lambda c: F.struct(c["d"].alias("d"), c["id"].alias("id"), (c["done"] | F.array_contains("turn", c["id"])).alias("done")))
        new = scratch.save(met.withColumn("turn", turn).select("query", "here", done.alias("best"), "seen", "turn"), "beam")
        old, state = state, new
        if hasattr(old, "_folio_path"):
            scratch.drop(old)
        if state.where(F.size("turn") > 0).isEmpty():
            return state.select("query", F.explode("best").alias("c")).select("query", "c.id", "c.d")
        asks = state.select("query", F.explode("turn").alias("id")).join(links, "id").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
        unseen = F.array_except("others", "seen")
        new = scratch.save(asks.join(state.select("query", "seen"), "query").select("query", unseen.alias("fresh")), "fresh")
        scratch.drop(fresh)
        scratch.tidy()
        fresh = new


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 10, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest rows found, by Euclidean distance, ties to the smaller id.

    ``queries`` are rows of the same columns; a row isn't its own neighbour.  Equal vectors are one
    node of the graph, so a vector that a third of all rows share costs one node; a found node
    gives its rows in order of id.  Vectors that are null, zero, hold null, NaN or infinity, or have
    another length than most take no part; fewer rows than ``top`` give all.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = usable(vectors, id_col, vec_col)
    rows = scratch.save(clean.withColumn("key", F.xxhash64("vec")), "rows")
    nodes = scratch.save(rows.groupBy("key").agg(F.min_by("vec", "id").alias("vec")).select(F.col("key").alias("id"), "vec"), "nodes")
    asked = scratch.save(rows.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").select("id", "key", "vec"), "asked")
    schema = "query_id long, rank int, vec_id long, score double"
    if asked.isEmpty():
        return spark.createDataFrame([], schema)
    count = nodes.count()
    cells = cells_of(nodes, scratch, count)
    graph = build_graph(nodes, cells, scratch, count, **options)
    # Equal queries are one walk, too; a query's own node is found like any other.
    found = walk(asked.groupBy("key").agg(F.min_by("vec", "id").alias("vec")).withColumnRenamed("key", "query"), nodes, graph, cells, scratch, BEAM * max(4, count.bit_length()))
    by_id = Window.partitionBy("key").orderBy("id")
    first = rows.select("key", "id").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= top + 1)
    members = found.join(first.select(F.col("key").alias("id"), F.col("id").alias("row")), "id").select("query", "row", "d")
    ranked = Window.partitionBy("query").orderBy("d", "row")
    short = members.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= top + 1).select(F.col("query").alias("key"), "row", "d")
    each = asked.select(F.col("id").alias("query_id"), "key").join(short, "key").where("row <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "row"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("row").alias("vec_id"), F.col("d").alias("score"))
