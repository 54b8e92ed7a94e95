"""Keywords: frequencies, coverage, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.keywords import normalised


#: Headings that say nothing about a record's topic.
EXCLUDED_TERMS = ["cornea", "humans", "adult", "female", "male", "aged", "middle aged", "prospective studies", "retrospective studies", "treatment outcome", "follow-up studies", "visual acuity", "refraction, ocular", "young adult", "adolescent", "child", "aged, 80 and over", "animals"]


def record_terms(records: DataFrame, key: str, columns: tuple[str, ...], synonyms: DataFrame | None = None) -> DataFrame:
    """(key, term), once each; with ``synonyms`` (variant, canonical) in their normal form.

    Terms are normalised once for every different one, then joined back.
    """
    arrays = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
    terms = records.select(key, F.explode(F.array_distinct(arrays)).alias("term")).where("term is not null and term <> ''")
    if synonyms is None:
        return terms.distinct()
    forms = normalised(terms, "term", synonyms).where("normal is not null")
    return terms.join(forms, "term").select(key, F.col("normal").alias("term")).distinct()


def without_terms(terms: DataFrame, excluded: list[str] = EXCLUDED_TERMS) -> tuple[DataFrame, DataFrame]:
    """Terms to count, and how often the excluded ones occurred."""
    out = F.lower("term").isin(excluded)
    return terms.where(~out), terms.where(out).groupBy("term").agg(F.count("*").alias("n"))


def coverage(records: DataFrame, has: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Records, and those that have a keyword, in number and percent."""
    n = F.count_if(F.col(has))
    return records.groupBy(*by).agg(F.count("*").alias("n_records"), n.alias("n_with_keywords"), F.bround(100 * n / F.count("*"), 1).alias("pct"))


def trends(terms: DataFrame, records: DataFrame, key: str, year: str, has: str, wanted: DataFrame) -> DataFrame:
    """(year, term, n, share): share of a year's keyword-bearing records that have the term.

    Every year with records appears for every wanted term, with 0; the share is null where no
    record of the year has keywords.  ``wanted`` holds the few terms of a figure, one a row.
    """
    base = records.groupBy(year).agg(F.count_if(F.col(has)).alias("d"))
    grid = base.crossJoin(F.broadcast(wanted.select("term")))  # years x a figure's terms
    hits = terms.join(wanted, "term", "left_semi").join(records.select(key, year), key).groupBy(year, "term").agg(F.count("*").alias("n"))
    out = grid.join(hits, [year, "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(year, "term", "n", F.when(F.col("d") > 0, F.bround(F.col("n") / F.col("d"), 4)).alias("share"))


def trend_start(trend: DataFrame, denominators: DataFrame, year: str, floor: int = 100) -> DataFrame:
    """Trends from the first year that has ``floor`` keyword-bearing records."""
    first = denominators.where(F.col("n_with_keywords") >= floor).agg(F.min(year).alias("from"))
    return trend.crossJoin(F.broadcast(first)).where(F.col(year) >= F.col("from")).drop("from")  # one row
