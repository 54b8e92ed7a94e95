"""The catalogue of analyses over one or several year windows, from records with authors and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import places
from folio.functions.ranks import top
from folio.operators import graphs, joins, rankings, screening, terms, trends
from folio.operators.bradford import bradford_curve, bradford_zones
from folio.operators.identity import assign_author_ids
from folio.plans.windows import in_windows, window_rows
from folio.sources.records import with_year

#: Floors and limits of the reports.
MIN_AUTHOR_PUBS, KEYWORD_FLOOR, PAIR_FLOOR, CAPITA_FLOOR, TREND_FLOOR = 3, 20, 20, 20, 100
TOP_AUTHORS, TOP_COUNTRIES, TOP_JOURNALS, TOP_KEYWORDS, TOP_INSTITUTIONS = 100, 20, 20, 100, 50
#: Language codes as reports write them.
LANGUAGES = {"eng": "English", "chi": "Chinese", "ger": "German", "fre": "French", "rus": "Russian", "spa": "Spanish", "por": "Portuguese", "jpn": "Japanese", "pol": "Polish", "ita": "Italian", "hun": "Hungarian", "dut": "Dutch", "cze": "Czech", "tur": "Turkish", "kor": "Korean", "und": "Undetermined"}


def prepared(records: DataFrame, gazetteer: places.Gazetteer, safelist=None, impute_within: int | None = 2, works: DataFrame | None = None, citations: DataFrame | None = None, generic: tuple[str, ...] = ()) -> DataFrame:
    """Screened records with citations, author ids, imputed affiliations and countries.

    ``works`` (an external source) gives citation counts, author ids and countries, which the text of
    an affiliation overrules where it names another country outright; ``citations`` (doi, citations)
    stands beside it.  ``generic`` are words that tell no institution from another.
    """
    if citations is not None:
        records = joins.with_citations(records, citations)
    if works is not None:
        records = joins.with_works(records, works)
    named = with_year(assign_author_ids(records, safelist))
    if impute_within is not None:
        rows = rankings.authorships(named, "rec_seq")
        filled = joins.impute_affiliations(rows, impute_within).where("affil_source = 'imputed'")
        got = filled.groupBy("rec_seq").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("affils", "affil_imputed_from")))).alias("_got"))
        both = named.join(got, "rec_seq", "left")

        def fill(a: Column, i: Column) -> Column:
            donor = F.element_at("_got", i)
            done = a.withField("affils", donor["affils"]).withField("affil_source", F.lit("imputed")).withField("affil_imputed_from", donor["affil_imputed_from"])
            return F.when(donor.isNotNull(), done).otherwise(a)

        named = both.withColumn("authors", F.transform("authors", fill)).drop("_got")
    placed = places.enrich_countries(named, gazetteer)
    return places.prefer_external(placed, gazetteer, list(generic)) if works is not None else placed


def institutions_of(authorship: DataFrame, aliases: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(authorship columns, order, canonical, parent, cluster): the institutions of every author, resolved once a segment.

    ``corrections`` (pmid, author_id, institution) go before what the affiliation says.
    """
    surname = F.first_value("last").over(_first_author()) if "last" in authorship.columns else F.lit(None).cast("string")
    rows = authorship.withColumn("_surname", surname).withColumn("_segments", F.flatten(F.transform("affils", lambda a: places.attributed_segments(a, F.col("_surname")))))
    each = rows.select("*", F.posexplode("_segments").alias("order", "segment")).drop("_segments", "_surname")
    known = joins.resolve_by_pattern(each, "segment", aliases)
    both = each.join(known, "segment", "left")
    guess = places.fallback_institution(F.col("segment"))
    found = both.withColumns({"canonical": F.coalesce("canonical", guess), "matched_by": F.when(F.col("canonical").isNotNull(), "alias").when(guess.isNotNull(), "fallback").otherwise("unresolved")})
    return found if corrections is None else joins.correct_institutions(found, authorship, corrections)


def _first_author():
    from pyspark.sql import Window

    return Window.partitionBy("rec_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def run_analysis(records: DataFrame, population: DataFrame, aliases: DataFrame, excluded: list[str] = terms.EXCLUDED_TERMS, synonyms: DataFrame | None = None, corrections: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of one window, lazily: what isn't asked for isn't computed.

    Keywords are counted in their normal form, with ``synonyms`` (variant, canonical) if given.
    """
    if synonyms is None:
        synonyms = records.sparkSession.createDataFrame([], "variant string, canonical string")
    authorship = rankings.authorships(records, "rec_seq").withColumn("journal_key", F.coalesce(F.nullif("journal_abbr", F.lit("")), "journal"))
    named = authorship.where("author_id is not null and author_id <> '__collective__'")
    resolved = institutions_of(authorship, aliases, corrections)
    ranked = rankings.institution_rankings(resolved, {level: joins.at_level(level) for level in ("canonical", "parent", "cluster")}, "rec_seq", "pos", "order", "citation_count")
    keywords, dropped = terms.without_terms(terms.record_terms(records, "rec_seq", ("keywords",), synonyms), excluded)
    headings, _ = terms.without_terms(terms.record_terms(records, "rec_seq", ("mesh",)), excluded)
    has = F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0
    flagged = records.withColumn("has_keywords", has)
    journals = rankings.journal_stats(records, "journal", "citation_count", abbr="journal_abbr", seq="rec_seq")
    curve = bradford_curve(journals, "journal", "publications")
    country_rows = authorship.select("rec_seq", F.coalesce("oa_country_name", "country").alias("country")).where("country is not null and country not in ('', 'Unknown')")
    frequent, pairs = graphs.cooccurrence(keywords, "rec_seq", "term", KEYWORD_FLOOR)
    people, links = graphs.coauthor_network(named.select("rec_seq", "author_id"), "rec_seq", "author_id")
    counts = records.groupBy("country").agg(F.count("*").alias("publications")).where("country <> 'Unknown'")
    tables = {
        "temporal": trends.temporal_trends(records.where("year_int > 0"), "year_int"),
        "authors": rankings.author_stats(authorship, "rec_seq", "author_id", "year_int", "citation_count", "journal_key", minimum=MIN_AUTHOR_PUBS).join(rankings.sample_affiliations(named), "author_id", "left"),
        "journals": journals,
        "bradford_curve": curve,
        "bradford_zones": bradford_zones(curve, "publications"),
        "countries": rankings.country_stats(records, "country", "citation_count", population),
        "country_schemes": rankings.country_schemes(authorship.select("rec_seq", "pos", "country"), records.select("rec_seq"), "rec_seq", "country"),
        "per_capita": rankings.per_capita(counts, population, CAPITA_FLOOR),
        "per_capita_no_population": rankings.without_population(counts, population),
        "country_nodes": graphs.nodes(country_rows, "rec_seq", "country"),
        "country_edges": graphs.edges(country_rows, "rec_seq", "country"),
        "keywords": frequent,
        "keyword_edges": pairs,
        "keywords_excluded": dropped,
        "keyword_trends": terms.trends(keywords, flagged, "rec_seq", "year_int", "has_keywords", top(frequent, 10, F.desc("n"), F.asc("term"))),
        "keyword_coverage": terms.coverage(flagged, "has_keywords", ("year_int",)),
        "mesh": graphs.nodes(headings, "rec_seq", "term").where(F.col("n") >= KEYWORD_FLOOR),
        "institutions": rankings.institution_stats(ranked),
        "institution_schemes": ranked,
        "institution_meta": rankings.resolution_meta(records, authorship, resolved.where(joins.at_level("canonical").isNotNull()), "rec_seq"),
        "pub_types": rankings.value_counts(records, "pub_types", "publication_type", many=True),
        "languages": with_language_names(rankings.value_counts(records, "language", "code")),
        "author_nodes": people,
        "author_edges": links,
        "family_mix": screening.family_mix(screening.procedure_families(records), ("year_int",)),
        "year_means": rankings.year_means(records, "year_int", "citation_count"),
    }
    counted = {"Unique journals": journals, "Unique countries": tables["countries"].where("country <> 'Unknown'"), "Unique institutions (top)": tables["institutions"], "Unique authors (≥min pubs)": tables["authors"], "Unique keywords": frequent, "Unique MeSH terms": tables["mesh"]}
    return tables | {"summary": summary(records, counted, tables["institution_meta"])}


def run_all_windows(records: DataFrame, rows: list[tuple[str, int, int]] | None = None) -> dict[str, DataFrame]:
    """Tables that have all windows at once, from one pass over the records."""
    cut = in_windows(records, "year_int", rows)
    people = rankings.authorships(records, "rec_seq").where("author_id is not null and author_id <> '__collective__'").select("rec_seq", "author_id")
    distinct = {"unique_journals": "journal", "unique_countries": "country"}
    return {
        "comparison": trends.window_comparison(records, "year_int", "citation_count", distinct, rows or window_rows(), "country", people, "rec_seq", "author_id", MIN_AUTHOR_PUBS),
        "temporal": trends.temporal_trends(cut, "year_int", by=("window",)),
        "family_mix": screening.family_mix(screening.procedure_families(cut), ("window",)),
        "field_h_index": trends.field_h_index(cut, "citation_count", ("window",)),
    }


def long(row: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value) of a one-row table, values as text."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns])).alias("m")).select("m.*")


def summary(records: DataFrame, counted: dict[str, DataFrame], institutions: DataFrame | None = None, scheme: str = "all authors, whole", year: str = "year_int", cites: str = "citation_count", country: str = "country") -> DataFrame:
    """(metric, value): the report's key figures; ``counted`` are tables whose rows are counted."""
    y, c = F.when(F.col(year) > 0, F.col(year)), F.col(cites)
    unknown = F.coalesce(F.nullif(F.col(country), F.lit("")), F.lit("Unknown")) == "Unknown"
    base = records.agg(
        F.count("*").alias("Total publications"),
        F.concat(F.min(y).cast("string"), F.lit("–"), F.max(y).cast("string")).alias("Year range"),
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("Total citations"),
        F.count(c).alias("Records with citation count"),
        F.count_if(c.isNull()).alias("Records without citation count"),
        F.bround(F.avg(c), 1).alias("Mean citations per record (known)"),
        F.count_if(~unknown).alias("Records with resolved first-author country"),
        F.count_if(unknown).alias("Records with unresolved first-author country"),
    )
    out = long(base, base.columns)
    out = out.unionByName(long(trends.peak_year(records.where(F.col(year) > 0), year).withColumnRenamed("peak_year", "Peak publication year"), ["Peak publication year"]))
    if institutions is not None:
        name = "Records with institution resolved / unresolved / no affiliation"
        out = out.unionByName(long(institutions.select(F.concat_ws(" / ", "n_resolved", "n_unresolved", "n_no_affiliation").alias(name)), [name]))
        out = out.unionByName(long(institutions.select(F.lit(scheme).alias("Institution attribution scheme")), ["Institution attribution scheme"]))
    for name, table in counted.items():
        out = out.unionByName(long(table.agg(F.count("*").alias(name)), [name]))
    return out


#: What a snapshot tracks of each table: its prefix, the column of its names, its numbers.
TRACKED = {
    "temporal": ("year", "year_int", {"": "publications", ".citations": "total_citations"}),
    "journals": ("journal", "journal", {".n": "publications", ".pct": "percentage"}),
    "countries": ("country", "country", {".n": "publications", ".pct": "percentage", ".cites": "citation_total", ".per_million": "pubs_per_million"}),
    "authors": ("author", "author_id", {".n": "publications", ".first": "first_author", ".last": "last_author", ".cites": "citation_total"}),
    "institutions": ("institution", "institution", {".n": "publications"}),
    "keywords": ("keyword", "term", {".n": "n"}),
    "pub_types": ("pubtype", "publication_type", {".n": "n"}),
}


def plain_number(df: DataFrame, column: str) -> Column:
    """A number as text without an exponent or closing zeros."""
    if dict(df.dtypes)[column] != "double":
        return F.col(column).cast("string")
    return F.regexp_replace(F.col(column).cast("decimal(30, 6)").cast("string"), r"\.?0+$", "")


def snapshot(tables: dict[str, DataFrame], k: int = 20, windows: DataFrame | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """(metric, value) of a run: the summary, the numbers of each table's first ``k`` names (all years), its size, and what windows and provenance say."""
    out = tables["summary"].select(F.concat(F.lit("summary."), "metric").alias("metric"), "value")
    for name, (prefix, label, numbers) in TRACKED.items():
        if name not in tables:
            continue
        first = next(iter(numbers.values()))
        rows = tables[name] if name == "temporal" else tables[name].orderBy(F.desc(first), F.asc(label)).limit(k)
        each = F.array(*[F.struct(F.concat(F.lit(f"{prefix}."), F.col(label).cast("string"), F.lit(end)).alias("metric"), plain_number(rows, c).alias("value")) for end, c in numbers.items()])
        out = out.unionByName(rows.select(F.explode(each).alias("m")).select("m.*"))
        out = out.unionByName(long(tables[name].agg(F.count("*").alias(f"n_{name}")), [f"n_{name}"]))
    if windows is not None:
        numbers = [c for c in windows.columns if c != "window"]
        each = F.array(*[F.struct(F.concat(F.lit("period."), "window", F.lit(f".{c}")).alias("metric"), F.col(c).cast("string").alias("value")) for c in numbers])
        out = out.unionByName(windows.select(F.explode(each).alias("m")).select("m.*"))
    if provenance is not None:
        out = out.unionByName(provenance.select(F.concat(F.lit("provenance."), "metric").alias("metric"), F.col("value").cast("string").alias("value")))
    return out.where("value is not null")


def with_language_names(counts: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return counts.withColumn("language", F.coalesce(F.element_at(names, F.col("code")), F.col("code")))


def provenance(records: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """(metric, value): the corpus' size, and where citation counts and countries come from and when they were fetched."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = records.agg(
        F.count("*").alias("n_corpus"), F.count_if(flag("oa_matched")).alias("n_matched"), F.count_if(~flag("oa_matched")).alias("n_unmatched"), F.count_if(F.coalesce("doi", F.lit("")) == "").alias("n_no_doi"),
        F.count("citation_count").alias("n_citation_count_known"), F.count_if(F.col("citation_count").isNull()).alias("n_citation_count_null"),
    )
    by = lambda df, c, prefix: df.groupBy(c.alias("v")).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{prefix}="), "v").alias("metric"), F.col("n").cast("string").alias("value"))
    out = long(base, base.columns)
    for column in ("citation_source", "country_source"):
        out = out.unionByName(by(records, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("none")), column))
    if works is not None:
        out = out.unionByName(by(records.select("pmid").join(works.select("pmid", "fetched"), "pmid"), F.left(F.coalesce("fetched", F.lit("undated")), F.lit(7)), "fetched_month"))
    return out


def attribution(records: DataFrame) -> DataFrame:
    """The audit table: each record's year, country, their sources and its citations."""
    return records.select("pmid", "year", "country", "country_source", F.array_join("countries_all", "|").alias("countries_all"), "citation_count", "citation_source", "oa_matched")


def compare_with_external(records: DataFrame, works: DataFrame, gazetteer: places.Gazetteer, k: int = 12) -> dict[str, DataFrame]:
    """Matched records told both ways: authors, first authors' countries and journals side by side, and citation totals."""
    both = records.join(works.where("found").select("pmid", F.struct("cited_by", "journal", "authors").alias("w")), "pmid")
    people = both.select("rec_seq", F.posexplode("authors").alias("pos", "a")).where("a.author_id is not null and a.author_id <> '__collective__'")
    theirs = both.select("rec_seq", F.explode("w.authors").alias("a"))
    counts = lambda df, value: df.where(value.isNotNull() & (value != "")).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    ids = F.coalesce(F.col("a.id"), F.concat(F.lit("name:"), F.coalesce("a.name", F.lit("?"))))
    first = F.coalesce(F.get(F.filter("w.authors", lambda a: a["pos"] == "first"), F.lit(0)), F.get("w.authors", F.lit(0)))
    totals = both.agg(F.count("*").alias("matched"), F.sum("citation_count").alias("citations_ours"), F.sum("w.cited_by").alias("citations_theirs"))
    return {
        "authors": joins.ranked_side_by_side(counts(people, F.col("a.author_id")), counts(theirs, ids), k),
        "countries": joins.ranked_side_by_side(counts(both, F.col("country")), counts(both, gazetteer.display(F.get(first["countries"], F.lit(0)))), k),
        "journals": joins.ranked_side_by_side(counts(both, joins.comparable_journal(F.col("journal"))), counts(both, joins.comparable_journal(F.col("w.journal"))), k),
        "totals": totals,
    }


def external_counts(records: DataFrame, key: Column, external: DataFrame) -> DataFrame:
    """(key, parsed, external, difference) of distinct records for each key against counts from outside."""
    parsed = records.select(key.alias("key"), "pmid").where("key is not null and key <> ''").distinct().groupBy("key").agg(F.count("*").alias("parsed"))
    return external.join(parsed, "key", "left").fillna(0, ["parsed"]).withColumn("difference", F.col("parsed") - F.col("external"))


def within(counts: DataFrame, most: int = 2) -> DataFrame:
    return counts.agg(F.count("*").alias("n"), F.count_if(F.col("difference") == 0).alias("identical"), F.count_if(F.abs("difference") <= most).alias("within"))


def journal_share(records: DataFrame, totals: DataFrame) -> DataFrame:
    """What share of each journal's whole output the corpus is."""
    counts = records.groupBy(F.coalesce(F.nullif("journal_abbr", F.lit("")), "journal").alias("journal")).agg(F.count("*").alias("n"))
    return counts.join(totals, "journal").withColumn("pct", F.when(F.col("total") > 0, F.bround(100 * F.col("n") / F.col("total"), 2)))


def trial_share(records: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Share of randomised trials beside that of other topics (topic, n, trials)."""
    trials = F.exists(F.coalesce("pub_types", F.array().cast("array<string>")), lambda t: t == "Randomized Controlled Trial")
    own = records.agg(F.lit("corpus").alias("topic"), F.count("*").alias("n"), F.count_if(trials).alias("trials"))
    return own.unionByName(benchmarks.select("topic", "n", "trials")).withColumn("pct", F.when(F.col("n") > 0, F.bround(100 * F.col("trials") / F.col("n"), 2)))
