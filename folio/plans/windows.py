"""Year windows: overlapping closed ranges, all answered in one pass by a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last year of the whole window, and the lengths of the nested ones that end in the last year.
START_YEAR, END_YEAR, SPANS = 1988, 2025, (25, 20, 15, 10, 5)


def year_of(text: Column) -> Column:
    """A year as a number; what isn't one is 0, which no window has."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def window_rows(start: int = START_YEAR, end: int = END_YEAR, spans: tuple[int, ...] = SPANS) -> list[tuple[str, int, int]]:
    """(name, first, last) of the whole window and each nested one."""
    return [("all_time", start, end), *((f"last_{n}yr", end - n + 1, end) for n in spans)]


def windows(spark: SparkSession, rows: list[tuple[str, int, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or window_rows(), "window string, win_start int, win_end int")


def in_windows(records: DataFrame, year: str, rows: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Each record once for every window that has its year.

    The windows are a handful of literals, exploded in place of a join: nothing moves.
    """
    named = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("win_start"), F.lit(b).alias("win_end")) for n, a, b in rows or window_rows()])
    hits = F.filter(named, lambda w: F.coalesce(F.col(year).between(w["win_start"], w["win_end"]), F.lit(False)))
    return records.withColumn("_w", F.explode(hits)).select("*", "_w.*").drop("_w")


def inside(records: DataFrame, year: str, start: int, end: int) -> DataFrame:
    """Records of a closed range of years; those without a year are in none."""
    return records.where(F.col(year).between(start, end))


def outside(records: DataFrame, year: str, start: int, end: int) -> DataFrame:
    """The complement of ``inside``, records without a year included."""
    return records.where(~F.coalesce(F.col(year).between(start, end), F.lit(False)))
