"""Ranks over whole tables and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.lineage import cut


def running(df: DataFrame, sums: dict[str, Column | str], *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds running totals, each row's included, in a total order: {name: what is added up}.

    Without groups the rows are dealt to tasks by ranges of the order; a task adds up its range, and
    the totals of earlier ranges (a row for each task) are added to it.  No task sees all rows.
    """
    if by:
        line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(line) for name, value in sums.items()})
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    line = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = ranged.withColumns({name: F.sum(value).over(line) for name, value in sums.items()})
    both = inside.join(F.broadcast(before), "_range")  # a row for each task
    return both.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_range", *[f"_{name}" for name in sums])


def counted(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, ties, above): for each distinct value how many rows have it and how many have more.

    The totals run over distinct values, which are pre-aggregated, not over rows.
    """
    per = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running(per, {"above": "ties"}, F.desc(value), by=by).withColumn("above", F.col("above") - F.col("ties"))


def with_competition_rank(df: DataFrame, value: str, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """1, =2, =2, 4: the rank by falling value, ties marked."""
    ranks = counted(df, value, by).select(*by, value, F.concat(F.when(F.col("ties") > 1, "=").otherwise(""), (F.col("above") + 1).cast("string")).alias(name))
    return df.join(ranks, [*by, value])


def with_mid_rank(df: DataFrame, value: str, name: str = "mid_rank", by: tuple[str, ...] = ()) -> DataFrame:
    """The average of the places that equal values take, counted from the least."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    below = running(per, {"upto": "ties"}, F.asc(value), by=by)
    ranks = below.select(*by, value, (F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def top(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """The first ``k`` rows (of each group) in a total order, numbered from 1.

    Without groups this is a top-k of each task and then of those; the window sees k rows.
    """
    if not by:
        df = df.orderBy(*order).limit(k)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def first_of(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row for each key, the first in order; rows with a null key all stay."""
    has = " and ".join(f"{k} is not null" for k in keys)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(has).withColumn("_n", n).where("_n = 1").drop("_n").unionByName(df.where(f"not ({has})"))


def modal(df: DataFrame, keys: tuple[str, ...], value: str, seq: str) -> DataFrame:
    """(keys, value): each group's commonest value; of equally common ones the first met in order of ``seq``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def null_as_zero(column: str) -> Column:
    """Falling order in which an unknown number counts as 0."""
    return F.desc(F.coalesce(F.col(column), F.lit(0)))
