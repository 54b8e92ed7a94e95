"""Bradford zones: a ranked list cut into zones of about equal output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.ranks import running
from folio.operators.lineage import cut


def bradford_curve(ranked: DataFrame, name: str, count: str, zones: int = 3, digits: int = 2) -> DataFrame:
    """(rank, name, count, cumulative, cumulative_pct, zone) of a list with one row for each name.

    A zone closes at the first row where its own running total reaches total / zones, which then
    starts again from 0; the last row closes none, and the last zone takes the rest.  Boundaries are
    found one after another on the cumulative sums (zones - 1 aggregates of the ranked list), so
    no row depends on the one before.  The list is one row for each distinct name.
    """
    curve = cut(running(ranked.select(name, count), {"rank": F.lit(1), "cumulative": count}, F.desc(count), F.asc(name)).withColumn("rank", F.col("rank").cast("int")))
    whole = curve.agg(F.max("rank").alias("last"), F.max("cumulative").alias("total"))
    curve = curve.crossJoin(F.broadcast(whole))  # one row
    zone, before = F.lit(1), F.lit(0)
    for k in range(zones - 1):
        reached = F.col("cumulative") - before >= F.col("total") / zones
        end = curve.agg(F.min(F.when(reached & (F.col("rank") < F.col("last")), F.struct("rank", "cumulative"))).alias("_cut"))
        curve = curve.crossJoin(F.broadcast(end.select(F.col("_cut.rank").alias(f"_rank{k}"), F.col("_cut.cumulative").alias(f"_sum{k}"))))
        zone = zone + F.coalesce((F.col("rank") > F.col(f"_rank{k}")).cast("int"), F.lit(0))
        before = F.coalesce(F.col(f"_sum{k}"), F.col("total"))
    pct = F.bround(100 * F.col("cumulative") / F.col("total"), digits)
    return curve.select("rank", name, count, "cumulative", pct.alias("cumulative_pct"), zone.alias("zone"))


def bradford_zones(curve: DataFrame, count: str) -> DataFrame:
    """Per zone: names, publications, their share, and how many times the names of the zone before."""
    per = curve.groupBy("zone").agg(F.count("*").alias("names"), F.sum(count).alias("publications"))
    line = Window.orderBy("zone")
    total = F.sum("publications").over(Window.partitionBy())
    return per.withColumns({
        "publication_pct": F.bround(100 * F.col("publications") / total, 2),
        "multiplier": F.bround(F.col("names") / F.lag("names").over(line), 2),
    })
