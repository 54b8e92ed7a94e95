"""From buckets of candidates to components, without all pairs of any large bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.runtime import Scratch

#: Up to so many members a bucket gives all its pairs: at most (SMALL - 1) / 2 pairs a row.
SMALL = 8
#: Members of a large bucket outside its main component that one block holds, and members that one chunk holds.
BLOCK, CHUNK = 256, 4096
#: Members that one chunk holds where a block and a chunk are rows as a whole.
HELD = 1024
#: Keys of open buckets, the least, that a member has with it: a pair of two such keys in common is left to the lesser.
LEAST_KEYS = 8

#: SQL for whether two structs, by name, may be linked.
Near = Callable[[str, str], str]


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, ...) of keys that two or more rows have, with their number ``n``: one shuffle."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def first_pairs(shared: DataFrame, near: Near, traits: list[str]) -> DataFrame:
    """(a, b): all pairs of small buckets; of a large one each member with its leader, the member whose buckets are fullest.

    What a group of near copies derives from shares most buckets with its copies, so the star around
    it links most of them.  Pairs that ``near`` (of two structs of id and ``traits``) rules out are left out.
    """
    member = F.struct("id", *traits)
    small = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("all"))
    small = small.select(F.posexplode("all").alias("at", "x"), "all").select("x", F.explode(F.slice("all", F.col("at") + 2, F.lit(SMALL))).alias("y"))
    large = shared.where(F.col("n") > SMALL)
    fullness = shared.groupBy("id").agg(F.sum("n").alias("fullness"))
    leaders = large.join(fullness, "id").groupBy("key").agg(F.max_by(member, F.struct("fullness", -F.col("id"))).alias("y"))
    star = large.select("key", member.alias("x")).join(leaders, "key").where("x.id <> y.id").select("x", "y")
    return small.unionByName(star).where(near("x", "y")).select(*ordered("x.id", "y.id")).distinct()


def open_blocks(shared: DataFrame, components: DataFrame, traits: list[str], scratch: Scratch, most: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to compare of large buckets: members outside the bucket's main component, against all its members.

    (key, block, chunk, x) twice: those outside, dealt to blocks of about BLOCK, and all members, dealt
    to chunks of about ``most``, with whether they are of the main component; and the table that both read, to be dropped after use.  Every block meets every chunk of its bucket, so no task holds more
    than a block and a chunk however large the bucket is.  ``x`` has id, the traits and ``home``, the
    component.  Buckets within one component are done: a pair of theirs couldn't join two.
    """
    home = components.select(F.col("id").alias("_of"), F.col("component").alias("_home"))
    placed = shared.where(F.col("n") > SMALL).join(home, F.col("id") == F.col("_of"), "left").select("key", "n", F.struct("id", *traits, F.coalesce("_home", "id").alias("home")).alias("x"))
    split = placed.groupBy("key").agg(F.min("x.home").alias("lo"), F.max("x.home").alias("hi")).where("lo <> hi").select("key")
    placed = scratch.save(placed.join(split, "key", "left_semi"), "placed")
    counts = placed.groupBy("key", "x.home").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("home", F.struct("c", -F.col("home"))).alias("main"), (F.sum("c") - F.max("c")).alias("out"))
    main = main.select(F.col("key").alias("k"), "main", F.ceil(F.col("out") / BLOCK).cast("int").alias("blocks"))
    both = placed.join(main, F.col("key") == F.col("k")).withColumn("chunks", F.ceil(F.col("n") / most).cast("int"))
    mine = lambda n, seed: F.pmod(F.xxhash64("x.id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = both.where("x.home <> main").withColumn("block", mine("blocks", 1)).withColumn("chunk", every("chunks"))
    members = both.withColumn("chunk", mine("chunks", 2)).withColumn("block", every("blocks"))
    return outside.select("key", "block", "chunk", "x"), members.select("key", "block", "chunk", "x", (F.col("x.home") == F.col("main")).alias("is_main")), placed


def open_pairs(shared: DataFrame, components: DataFrame, near: Near, traits: list[str], told: Callable[[DataFrame], DataFrame], scratch: Scratch, linked: Near | None = None) -> DataFrame:
    """(a, b) of two components and one large bucket that ``near`` doesn't rule out: none that ``first_pairs`` left is missing.

    ``told`` gives, for a table of ids, what ``near`` asks for besides ``traits``.  A pair meets in every
    bucket that it shares; it becomes a row only where no lesser key among the least of both is common.
    With ``linked``, the exact test, the rows are links between components instead, by the ids that name them: two components
    that meet in a bucket are compared until one link is found, as more links between them would join nothing else.
    """
    outside, members, placed = open_blocks(shared, components, traits, scratch, HELD if linked else CHUNK)
    if placed.isEmpty():
        return placed.select(F.col("x.id").alias("a"), F.col("x.id").alias("b"))
    keys = placed.groupBy("x.id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LEAST_KEYS).alias("least"))
    more = told(placed.select("x.id").distinct())
    also = scratch.save(more.join(keys, "id"), "also")
    scratch.drop(more)
    more = also
    of = [c for c in more.columns if c != "id"]
    whole = lambda df: df.join(more.withColumnRenamed("id", "_of"), F.col("x.id") == F.col("_of")).select("key", "block", "chunk", *df.columns[4:], F.struct("x.*", *of).alias("x"))
    sooner = "exists(x.least, k -> k < key AND array_contains(y.least, k))"
    place = ["key", "block", "chunk"]
    if linked:

        def by_home(df: DataFrame, is_main: Column, name: str) -> DataFrame:
            """The rows of a block or chunk as one row of components, each with its members: one shuffle."""
            homes = df.withColumn("is_main", is_main).repartition(*place).groupBy(*place, F.col("x.home").alias("home")).agg(F.any_value("is_main").alias("is_main"), F.collect_list("x").alias("members"))
            return homes.groupBy(*place).agg(F.collect_list(F.struct("home", "is_main", "members")).alias(name))

        met = by_home(whole(outside), F.lit(False), "ours").join(by_home(whole(members), F.col("is_main"), "theirs"), place)
        # Two components that are linked with a third one here are one already; taken in order, of k that are all alike k - 1 links are looked for.
        joined = "flatten(transform(filter(found, f -> f.other = o.home), f -> transform(filter(found, g -> g.home = f.home), g -> g.other)))"
        # Two components outside the main one meet twice; the lesser's meeting is enough.
        one = f"exists(o.members, x -> exists(t.members, y -> {near('x', 'y')} AND NOT array_contains(joined, t.home) AND NOT {sooner} AND {linked('x', 'y')}))"
        other = f"transform(filter(theirs, t -> (t.is_main OR o.home < t.home) AND {one}), t -> struct(o.home AS home, t.home AS other))"
        none = "CAST(array() AS ARRAY<STRUCT<home: BIGINT, other: BIGINT>>)"
        links = f"aggregate(array_sort(ours, (p, q) -> IF(p.home < q.home, -1, 1)), {none}, (found, o) -> concat(found, transform(array({joined}), joined -> {other})[0]))"
        # Of an explode that isn't an outer one Spark infers a filter that compares everything once more.
        found = met.select(F.explode_outer(F.expr(links)).alias("found")).where("found IS NOT NULL").select(*ordered("found.home", "found.other"))
    else:
        held = whole(outside).groupBy(*place).agg(F.collect_list("x").alias("block_members"))
        close = f"filter(block_members, y -> y.home <> x.home AND {near('x', 'y')} AND NOT {sooner})"
        found = whole(members).join(held, place).select("x", F.explode_outer(F.expr(close)).alias("y")).where("y IS NOT NULL").select(*ordered("x.id", "y.id"))
    pairs = scratch.save(found.distinct(), "pairs")
    scratch.drop(placed, more)
    return pairs
