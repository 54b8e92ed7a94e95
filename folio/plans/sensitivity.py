"""Supplementary tables: the same questions counted in other ways, for all years and again for a recent window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.ranks import null_as_zero, top, with_competition_rank
from folio.operators import joins, rankings, stats, terms
from folio.operators.identity import rule_off_comparison
from folio.plans import analysis as A
from folio.plans.reports import flat
from folio.plans.windows import inside

#: Rows of an institution table, of the ranking of countries side by side, of a table by mean.
INSTITUTIONS, COUNTRIES, LEAST = 40, 30, 20
#: Years of the window in which citations are compared at equal age.
FIXED_WINDOW = (2015, 2020)


def institution_tables(ranked: DataFrame, resolved: int | None = None) -> dict[str, DataFrame]:
    """One table for each level, scope and way of counting: the first INSTITUTIONS, ranked."""
    out = {}
    for scope in rankings.SCOPES:
        for counting in rankings.COUNTINGS:
            for level in ("canonical", "parent", "cluster"):
                one = with_competition_rank(rankings.institution_stats(ranked, level, scope, counting), "publications")
                out[f"institutions_{scope}_{counting}_{level}"] = top(one.withColumnRenamed("rank", "place"), INSTITUTIONS, F.desc("publications"), F.asc("institution"), name="row").drop("row")
    return out


def merged_names(ranked: DataFrame, members: list[str], cluster: str) -> DataFrame:
    """(scope, counting, treatment, institution, publications): a cluster's members apart, and the cluster as one."""
    some = ranked.where((F.col("counting") != "fractional") & (((F.col("level") == "canonical") & F.col("institution").isin(members)) | ((F.col("level") == "cluster") & (F.col("institution") == cluster))))
    return some.select("scope", "counting", F.when(F.col("level") == "cluster", "merged").otherwise("separate").alias("treatment"), "institution", "publications")


def without_group_report(records: DataFrame, authorship: DataFrame, group: DataFrame, resolved: DataFrame, population: DataFrame) -> DataFrame:
    """(table, name, publications, rank): sizes with and without the records of a group of authors, and the first of each ranking without them."""
    kept = rankings.without_group(records, authorship, group, "rec_seq", "author_id")
    count = lambda df, name: df.agg(F.count("*").cast("double").alias("publications")).select(F.lit("records").alias("table"), F.lit(name).alias("name"), "publications", F.lit("").alias("rank"))
    rows = authorship.join(kept.select("rec_seq"), "rec_seq", "left_semi")
    authors = top(rankings.author_stats(rows, "rec_seq", "author_id", "year_int", "citation_count", "journal", minimum=A.MIN_AUTHOR_PUBS), 20, F.desc("publications"), F.asc("author_id"), name="k")
    countries = top(rankings.country_stats(kept, "country", "citation_count", population).where("country <> 'Unknown'").withColumnRenamed("rank", "place"), 15, F.desc("publications"), F.asc("country"), name="k")
    levels = {"canonical": joins.at_level("canonical")}
    ranked = rankings.institution_stats(rankings.institution_rankings(resolved.join(kept.select("rec_seq"), "rec_seq", "left_semi"), levels, "rec_seq", "pos", "order", "citation_count"), counting="primary", scope="first")
    places = top(with_competition_rank(ranked, "publications", "place"), 15, F.desc("publications"), F.asc("institution"), name="k")
    named = lambda df, table, name, rank: df.select(F.lit(table).alias("table"), F.col(name).alias("name"), F.col("publications").cast("double").alias("publications"), rank.alias("rank"))
    return joins.stacked([
        count(records, "all"), count(kept, "without author group"),
        named(authors, "author", "author_id", F.lit("")), named(countries, "country", "country", F.col("place")), named(places, "institution", "institution", F.col("place")),
    ])


def tables(records: DataFrame, aliases: DataFrame, population: DataFrame, group: DataFrame | None = None, audit: DataFrame | None = None, members: tuple[list[str], str] | None = None, home: tuple[str, str] | None = None, journal_totals: DataFrame | None = None, trials: DataFrame | None = None, works: DataFrame | None = None, corrections: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every supplementary table, lazily.

    ``members`` are a cluster's canonical names and its own; ``home`` is (country, cluster) of the
    per-capita row without a cluster; ``journal_totals`` (journal, total) and ``trials`` (topic, n,
    trials) are counts from outside.
    """
    authorship = rankings.authorships(records, "rec_seq").withColumn("journal_key", F.coalesce(F.nullif("journal_abbr", F.lit("")), "journal"))
    named = authorship.where("author_id is not null and author_id <> '__collective__'")
    resolved = A.institutions_of(authorship, aliases, corrections)
    ranked = rankings.institution_rankings(resolved, {level: joins.at_level(level) for level in ("canonical", "parent", "cluster")}, "rec_seq", "pos", "order", "citation_count")
    schemes = rankings.country_schemes(authorship.select("rec_seq", "pos", "country"), records.select("rec_seq"), "rec_seq", "country")
    counts = records.where("country is not null and country not in ('', 'Unknown')").groupBy("country").agg(F.count("*").alias("publications"))
    keyed = records.withColumn("journal_key", F.coalesce(F.nullif("journal_abbr", F.lit("")), "journal"))
    means = rankings.year_means(records, "year_int", "citation_count")
    has = F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0
    by_mean = lambda df, entity: df.orderBy(null_as_zero("mncs"), F.asc(entity))
    indicators = lambda rows, entity: by_mean(rankings.citation_indicators(rows.where(F.col(entity).isNotNull()), entity, "year_int", "citation_count", LEAST, FIXED_WINDOW, means), entity)
    unknown = records.agg(F.count_if(rankings.known_name("country") == "Unknown").alias("u"))
    best = counts.orderBy(F.desc("publications"), "country").limit(2).agg(F.max("publications").alias("a"), F.min("publications").alias("b"))
    both = records.where("citation_count is not null and citation_count_crossref is not null")
    out = {
        **{f"countries_{s}": schemes.where(F.col("scheme") == s).drop("scheme") for s in ("first", "whole", "fractional")},
        "countries_side_by_side": rankings.schemes_side_by_side(schemes, COUNTRIES),
        **institution_tables(ranked),
        "per_capita_min20": rankings.per_capita(counts, population, 20),
        "per_capita_min10": rankings.per_capita(counts, population, 10),
        "per_capita_no_population": rankings.without_population(counts, population),
        "two_countries": best.crossJoin(F.broadcast(unknown)).select("a", "b", "u", *stats.bounds(F.col("a"), F.col("b"), F.col("u"))),
        "year_means": means,
        "indicators_countries": indicators(records, "country"),
        "indicators_journals": indicators(keyed, "journal_key"),
        "indicators_authors": indicators(named, "author_id"),
        "identity_rule_off": rule_off_comparison(records),
        "paired_sources": stats.paired_sources(both, "citation_count", "citation_count_crossref"),
        "keyword_coverage_by_year": terms.coverage(records.withColumn("has", has), "has", ("year_int",)),
        "keyword_coverage_overall": terms.coverage(records.withColumn("has", has), "has"),
        "provenance": A.provenance(records, works),
    }
    if members:
        out["cluster_apart_and_merged"] = merged_names(ranked, *members)
    if home:
        first = resolved.where("pos = 0 and order = 0").select("rec_seq", (joins.at_level("cluster") == home[1]).alias("inside"))
        out["per_capita_without_cluster"] = rankings.without_cluster(records.join(first, "rec_seq", "left"), population, "country", home[0], "inside", f"{home[0]} excluding {home[1]} first-author records")
    if group is not None:
        out["rankings_without_group"] = without_group_report(records, authorship, group, resolved, population)
    if audit is not None:
        out["identity_audit"] = rankings.identity_audit(authorship, audit)
    if journal_totals is not None:
        out["journal_share"] = A.journal_share(records, journal_totals)
    if trials is not None:
        out["trial_share"] = A.trial_share(records, trials)
    return out


def write_all(records: DataFrame, folder: str, recent: tuple[int, int], **options) -> list[str]:
    """All tables as CSV, for all years and for a recent window; their names."""
    written = []
    for name, some in (("all", records), ("recent", inside(records, "year_int", *recent))):
        for table, df in tables(some, **options).items():
            flat(df).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}/{table}")
            written.append(f"{name}/{table}")
    return written
