"""Yearly series and window comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.citations import exact_quantile
from folio.plans.windows import in_windows


def temporal_trends(records: DataFrame, year: str = "year", cites: str = "citation_count", by: tuple[str, ...] = ()) -> DataFrame:
    """Per observed year: count, running total, centred three-row mean, and citations known and unknown.

    The windows run over years, after the only shuffle.
    """
    c = F.col(cites)
    per = records.where(F.col(year).isNotNull()).groupBy(*by, year).agg(
        F.count("*").alias("publications"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total_citations"),
        F.count_if(c.isNull()).alias("n_cite_null"),
        F.bround(F.avg(c), 1).alias("citations_mean"),
        F.bround(exact_quantile(c, 0.5), 1).alias("citations_median"),
    )
    line = Window.partitionBy(*by).orderBy(year)
    return per.withColumns({
        "cumulative": F.sum("publications").over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "moving_avg_3yr": F.bround(F.avg("publications").over(line.rowsBetween(-1, 1)), 1),
    })


def field_h_index(records: DataFrame, cites: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, h_index): the most h such that h records have h citations or more each.

    Counts are aggregated by value first, so the window is over distinct citation counts.
    """
    per = records.where(F.col(cites) > 0).groupBy(*by, cites).agg(F.count("*").alias("n"))
    at_least = F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc(cites)).rowsBetween(Window.unboundedPreceding, 0))
    found = per.select(*by, F.least(F.col(cites).cast("long"), at_least).alias("h"))
    return found.groupBy(*by).agg(F.coalesce(F.max("h"), F.lit(0)).cast("long").alias("h_index"))


def window_comparison(records: DataFrame, year: str, cites: str, distinct: dict[str, str], rows: list[tuple[str, int, int]], country: str | None = None, authorship: DataFrame | None = None, key: str = "key", author: str = "author", minimum: int = 3) -> DataFrame:
    """One row for each window: totals, known and unknown citations, mean of the known, distinct values, field h-index.

    With ``country`` also records whose country isn't known; with ``authorship`` (key, author) also
    the authors of ``minimum`` records or more.
    """
    c, cut = F.col(cites), in_windows(records, year, rows)
    unresolved = [F.count_if(F.coalesce(F.nullif(F.col(country), F.lit("")), F.lit("Unknown")) == "Unknown").alias("records_country_unresolved")] if country else []
    out = cut.groupBy("window", "win_start", "win_end").agg(
        F.count("*").alias("total_publications"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total_citations"),
        F.count(c).alias("records_with_citation_count"),
        F.count_if(c.isNull()).alias("records_without_citation_count"),
        F.bround(F.avg(c), 1).alias("mean_cites_per_pub"),
        *unresolved,
    )
    for name, column in distinct.items():  # each distinct count by itself: no row is expanded
        known = F.count_if(F.col(column).isNotNull() & (F.col(column).cast("string") != "Unknown"))
        out = out.join(cut.select("window", column).distinct().groupBy("window").agg(known.alias(name)), "window", "left")
    if authorship is not None:
        people = cut.select("window", key).join(authorship.select(key, author), key).groupBy("window", author).agg(F.count("*").alias("n"))
        out = out.join(people.where(F.col("n") >= minimum).groupBy("window").agg(F.count("*").alias("unique_authors")), "window", "left").fillna(0, ["unique_authors"])
    h = field_h_index(cut, cites, ("window",)).withColumnRenamed("h_index", "h_index_field")
    return out.join(h, "window", "left").withColumn("h_index_field", F.coalesce("h_index_field", F.lit(0).cast("long")))


def peak_year(records: DataFrame, year: str = "year") -> DataFrame:
    """(peak_year, publications): the first year with the most records."""
    per = records.groupBy(year).agg(F.count("*").alias("publications"))
    return per.agg(F.max(F.struct("publications", -F.col(year))).alias("p")).select((-F.col("p.col2")).alias("peak_year"), "p.publications")


def year_spine(frame: DataFrame, year: str, start: int, end: int, fill: dict[str, int]) -> DataFrame:
    """Every year of a range, missing ones with ``fill``."""
    years = frame.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias(year))
    return years.join(frame, year, "left").fillna(fill)


def share_of_field(corpus: DataFrame, field: DataFrame, year: str, start: int, end: int, per: int) -> DataFrame:
    """Per year: records, the field's total, and records per ``per`` of the field; years without records are 0."""
    counts = year_spine(corpus.groupBy(year).agg(F.count("*").alias("n")), year, start, end, {"n": 0})
    return counts.join(field.select(year, "total"), year, "left").withColumn("rate", F.when(F.col("total") > 0, F.bround(F.col("n") * per / F.col("total"), 3)))


def block_concentration(records: DataFrame, year: str, journal: str, named: list[str], width: int = 5) -> DataFrame:
    """Blocks of years: records, the share of the named journals, and how many journals there are."""
    block = (F.floor(F.col(year) / width) * width).cast("int")
    cut = records.withColumn("block", block)
    base = cut.groupBy("block").agg(F.count("*").alias("n"), F.bround(100 * F.count_if(F.col(journal).isin(named)) / F.count("*"), 2).alias("named_pct"))
    return base.join(cut.select("block", journal).distinct().groupBy("block").agg(F.count(journal).alias("journals")), "block")
