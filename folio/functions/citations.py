"""Citation summaries: a null count is unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_quantile(count: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p over the known values."""
    return F.percentile(count, F.lit(p))


def cite_summary(count: Column, digits: int = 1) -> list[Column]:
    """Aggregates: known and unknown counts, sum (0 if none is known), mean and quartiles of the known."""
    return [
        F.count(count).alias("n_cited_known"),
        F.count_if(count.isNull()).alias("n_cite_null"),
        F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("citation_total"),
        F.bround(F.avg(count), digits).alias("citations_mean"),
        F.bround(exact_quantile(count, 0.5), digits).alias("citations_median"),
        F.bround(exact_quantile(count, 0.25), digits).alias("citations_q1"),
        F.bround(exact_quantile(count, 0.75), digits).alias("citations_q3"),
    ]


def h_estimate(citations: Column, publications: Column) -> Column:
    """min(round(sqrt(citations / 2)), publications): an estimate, halves to even."""
    return F.least(F.bround(F.sqrt(citations * 0.5), 0).cast("long"), publications)
