"""Cutting the lineage of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; without one (tests) the rows are kept in memory.

    A checkpoint comes with the size that was estimated for its plan, which knows nothing of rows
    that were exploded: a large table may count as small enough to broadcast, and the driver gets
    it whole.  So the size is left open, and joins go by what was shuffled.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.persist()
    held = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)
