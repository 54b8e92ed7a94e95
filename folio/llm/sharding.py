"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.runtime import Scratch

#: Bytes of a bucket, which one task holds in memory to shuffle.
BUCKET_BYTES = 32 << 20


def rendezvous(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard with the highest hash of (key, shard): one more shard takes rows only into itself."""
    bids = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("bid"), F.lit(s).alias("shard")) for s in range(shards)]
    return F.array_max(F.array(*bids))["shard"]


def _fisher_yates(table: pa.Table, seed: int) -> pa.Table:
    """One bucket: put in a fixed order, then shuffled with the bucket's own seed."""
    table = table.take(pc.sort_indices(table, sort_keys=[("scatter", "ascending"), ("row", "ascending")]))
    shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
    order = np.arange(table.num_rows)
    np.random.default_rng([seed, shard, bucket]).shuffle(order)
    slot = pa.array(table.column("base")[0].as_py() + np.arange(table.num_rows), pa.int64())
    out = table.select(["record", "shard"]).take(pa.array(order))
    return out.append_column("slot", slot)


def shuffle_shards(docs: DataFrame, shard: Column, size: Column, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(record, shard, slot): every row of ``docs`` whole in ``record``, at a random gapless place of its shard.

    The first pass writes each row with a seeded hash that scatters a shard's rows uniformly over
    buckets of about ``bucket_bytes``; the hash takes in the row's place in the input, so repeated
    rows scatter like any others.  The second pass reads a bucket into one task, shuffles it
    (Fisher-Yates) and gives out slots after those of the shard's earlier buckets.  What is
    shuffled is the written table, so a lost executor's rows come back the same.

    ``shard`` (int, not null) and ``size`` (bytes) are expressions over ``docs``.  Nulls, empty
    texts, repeated rows and columns of any name are carried as they are; an empty table gives an
    empty result.  A single row larger than a bucket is a bucket of its own size.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.monotonically_increasing_id()
    first = docs.select(F.struct("*").alias("record"), shard.cast("int").alias("shard"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), row.alias("row"))
    first = scratch.save(first.withColumn("scatter", F.xxhash64(F.lit(seed), "row")), "scattered")
    total = first.groupBy("shard").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    first = first.withColumn("bucket", F.pmod("scatter", F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = first.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # As many partitions as there are buckets, so that a task reads about one however much there is; dealt once, for the join as for the shuffle.
    # Fewer than the session's own number would make the join deal them again.
    parts = max(bases.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = first.repartition(parts, "shard", "bucket")
    second = dealt.join(bases, ["shard", "bucket"]).select("record", "shard", "bucket", "row", "scatter", "base")
    schema = T.StructType([first.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return second.groupBy("shard", "bucket").applyInArrow(lambda bucket: _fisher_yates(bucket, seed), schema)


def shard_by_key(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **options) -> DataFrame:
    """(record, shard, slot, grown_shard): the id and the number of shards alone decide on the shard.

    Rendezvous hashing spreads ids evenly; ``grown_shard`` is the shard if there were one more,
    either the same or the new one.  Null ids count as one key.  All rows of one id are in one shard, as
    the law says, so an id that repeats on many rows makes a large one; it is shuffled in buckets like any.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8
    out = shuffle_shards(docs, rendezvous(F.col(id_col), shards, seed), size, seed, **options)
    return out.withColumn("grown_shard", rendezvous(F.col("record")[id_col], shards + 1, seed))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, its files sorted by slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
