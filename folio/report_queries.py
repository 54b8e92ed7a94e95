"""Registered queries of whole reports: summaries, snapshots, comparisons with outside counts, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.ranks import null_as_zero
from folio.functions.sql import norm_last, resolve_affiliation
from folio.operators import graphs, joins, rankings, terms, trends
from folio.operators.bradford import bradford_curve
from folio.plans import analysis as A
from folio.plans import sensitivity as S
from folio.plans.facts import Facts
from folio.queries import WINDOWS, query
from folio.sources.records import missing_keys, organisation_works


def counted(f: Facts) -> dict[str, DataFrame]:
    """The tables that a summary counts and a snapshot tracks, over orders."""
    first = f.first_countries()
    people = f.lines().withColumn("author_id", F.col("author").cast("string")).join(f.journals(), "key")
    authors = rankings.author_stats(people, "key", "author_id", "year", "cites", "journal")
    return {
        "temporal": trends.temporal_trends(f.records(), "year", "cites").withColumnRenamed("year", "year_int"),
        "journals": rankings.journal_stats(f.journals(), "journal", "cites"),
        "countries": rankings.country_stats(first, "country", "cites", f.populations()),
        "authors": authors,
        "keywords": graphs.nodes(f.brands(), "key", "term"),
    }


def key_figures(f: Facts, tables: dict[str, DataFrame]) -> DataFrame:
    names = {"Unique journals": tables["journals"], "Unique countries": tables["countries"].where("country <> 'Unknown'"), "Unique authors (≥min pubs)": tables["authors"], "Unique keywords": tables["keywords"]}
    return A.summary(f.first_countries(), names, year="year", cites="cites")


@query
def summary_metrics(f: Facts) -> DataFrame:
    """The report's key figures."""
    return key_figures(f, counted(f))


@query
def snapshot_metrics(f: Facts) -> DataFrame:
    """The numbers of a run as (metric, value): the summary, years, the first five of each ranking."""
    tables = counted(f)
    return A.snapshot(tables | {"summary": key_figures(f, tables)}, 5)


@query
def window_columns(f: Facts) -> DataFrame:
    """Windows side by side with authors of three records or more and records without a country."""
    rows = f.first_countries().join(f.journals().select("key", "journal"), "key")
    return trends.window_comparison(rows, "year", "cites", {"unique_journals": "journal", "unique_countries": "country"}, WINDOWS, "country", f.lines().select("key", "author").distinct(), "key", "author")


@query
def per_capita_without_cluster(f: Facts) -> DataFrame:
    """One country's rate without the records whose first author is of a cluster: here suppliers with an even number."""
    first = f.lines().where("pos = 0").select("key", (F.col("author") % 2 == 0).alias("inside"))
    rows = f.first_countries().join(first, "key", "left")
    return rankings.without_cluster(rows, f.populations(), "country", "FRANCE", "inside", "FRANCE excluding even")


@query
def provenance_counts(f: Facts) -> DataFrame:
    """Where counts and countries come from, and when external rows were fetched."""
    o = f.table("orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("pmid"), (F.col("o_orderkey") % 3 == 0).alias("oa_matched"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("10.1/x")).alias("doi"),
        F.when(F.col("o_orderkey") % 7 != 0, 1).alias("citation_count"), F.when(F.col("o_orderkey") % 3 == 0, "works").alias("citation_source"), F.col("o_orderpriority").alias("country_source"),
    )
    works = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("pmid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fetched"))
    return A.provenance(rows, works)


@query
def journal_share(f: Facts) -> DataFrame:
    """What share of each journal's whole output the corpus is: orders of 1998 of all years'."""
    r = f.journals().withColumn("journal_abbr", F.lit(None).cast("string"))
    totals = r.groupBy("journal").agg(F.count("*").alias("total"))
    return A.journal_share(r.where("year = 1998"), totals)


@query
def trial_share(f: Facts) -> DataFrame:
    """The share of trials beside other topics': urgent orders as trials, statuses as topics."""
    o = f.table("orders")
    kinds = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "Randomized Controlled Trial").otherwise("Review"))
    topics = o.groupBy(F.col("o_orderstatus").alias("topic")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("trials"))
    return A.trial_share(o.select(kinds.alias("pub_types")), topics)


@query
def external_counts(f: Facts) -> DataFrame:
    """Counts by key against counts from outside: orders by customer, outside all but every tenth."""
    o = f.table("orders")
    outside = o.where("o_orderkey % 10 <> 0").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count("*").alias("external"))
    return A.external_counts(o.select(F.col("o_orderkey").alias("pmid"), "o_custkey"), F.col("o_custkey").cast("string"), outside)


@query
def external_within(f: Facts) -> DataFrame:
    """How many of those counts are identical, and how many within two."""
    o = f.table("orders")
    outside = o.where("o_orderkey % 10 <> 0").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count("*").alias("external"))
    return A.within(A.external_counts(o.select(F.col("o_orderkey").alias("pmid"), "o_custkey"), F.col("o_custkey").cast("string"), outside))


@query
def identity_audit(f: Facts) -> DataFrame:
    """What is known of listed authors: years, commonest affiliations, external ids."""
    rows = f.lines().join(f.nations(), "author").join(f.records(), "key")
    rows = rows.select(F.col("author").cast("string").alias("author_id"), F.col("year").alias("year_int"), F.array("country", "region").alias("affils"), F.concat(F.lit("W"), (F.col("part") % 3).cast("string")).alias("oa_id"), F.lit("0-1").alias("orcid"))
    names = f.table("supplier").where("s_suppkey % 10 = 1").select(F.col("s_suppkey").cast("string").alias("author_id"))
    out = rankings.identity_audit(rows, names)
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return out.select("author_id", "n", "year_first", "year_last", joined("orcids"), joined("affiliations"), joined("external_ids"), "n_external_ids")


@query
def works_by_position(f: Facts) -> DataFrame:
    """Records with an external source's counts, authors matched by position."""
    listed = f.lines().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "author"))).alias("l"))
    author = F.transform("l", lambda x: F.struct(x["author"].cast("string").alias("last"), F.lit(None).cast("string").alias("oa_id"), F.lit(None).cast("array<string>").alias("oa_countries")))
    rows = listed.select(F.col("key").cast("string").alias("pmid"), author.alias("authors"), F.lit(1).alias("citation_count_crossref"))
    insts = F.array(F.struct(F.lit("r").alias("ror"), F.lit("Uni").alias("name"), F.lit("CH").alias("cc")))
    theirs = F.transform(F.slice("l", 1, 2), lambda x: F.struct(F.concat(F.lit("A"), x["author"].cast("string")).alias("id"), F.array(F.lit("CH")).alias("countries"), insts.alias("insts")))
    works = listed.join(f.records(), "key").where("key % 3 <> 0").select(F.col("key").cast("string").alias("pmid"), F.lit(True).alias("found"), F.coalesce("cites", F.lit(0)).alias("cited_by"), theirs.alias("authors"))
    both = joins.with_works(rows, works, fill=True)
    return both.select("pmid", "citation_count", "citation_source", "oa_matched", F.size(F.filter("authors", lambda a: a["oa_id"].isNotNull())).alias("n_ids"), F.coalesce(F.get("authors", F.lit(0))["oa_id"], F.lit("")).alias("first_id"))


@query
def citations_by_doi(f: Facts) -> DataFrame:
    """Counts from a table by DOI, whatever the case; of several the greatest."""
    r = f.records().select(F.col("key"), F.when(F.col("key") % 4 != 0, F.concat(F.lit("10.1/A"), F.col("cust").cast("string"))).otherwise("").alias("doi"))
    counts = f.records().select(F.concat(F.lit("10.1/a"), F.col("cust").cast("string")).alias("doi"), F.col("cites").alias("citations")).unionByName(f.spark.createDataFrame([("", 99)], "doi string, citations int"))
    return joins.with_citations(r, counts, exact_case=False).select("key", "citation_count_crossref")


@query
def organisations_of_affiliations(f: Facts) -> DataFrame:
    """Works rows from a lookup of affiliations by their hash: places of authors, and how many institutions were found."""
    people = f.lines().join(f.nations(), "author")
    n = people.groupBy("key").agg(F.count("*").cast("int").alias("n_authors"))
    rows = people.join(n, "key").select(F.col("key").cast("string").alias("pmid"), "pos", "n_authors", F.concat(F.lit(" "), F.initcap("country")).alias("affil"))
    lookup = f.table("nation").where("n_nationkey % 2 = 0").select(F.sha1(F.encode(F.lower("n_name"), "UTF-8")).alias("key"), F.lit("r").alias("ror"), F.col("n_name").alias("name"), F.left("n_name", F.lit(2)).alias("cc"))
    out = organisation_works(rows, lookup)
    return out.select("pmid", F.size("authors").alias("n"), F.array_join("authors.place", ",").alias("places"), F.array_join(F.transform("authors", lambda a: a["insts"][0]["name"]), ",").alias("names"))


@query
def missing_work(f: Facts) -> DataFrame:
    """Keys that a cache doesn't have yet."""
    wanted = f.table("orders").select(F.col("o_custkey").cast("string").alias("doi"))
    return missing_keys(wanted, f.table("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("doi")), "doi")


@query
def curated_institutions(f: Facts) -> DataFrame:
    """Corrections go before what an affiliation says and supersede guesses; every hundredth author has one, every two hundredth two."""
    people = f.lines().join(f.nations(), "author").select(F.col("key").cast("string").alias("pmid"), F.col("author").cast("string").alias("author_id"), "pos", "country", "region")
    guess = people.select("pmid", "author_id", "pos", F.lit(0).alias("order"), F.col("country").alias("canonical"), F.when(F.col("pos") % 2 == 0, "alias").otherwise("fallback").alias("matched_by"))
    fixed = people.where("pos = 1").select("pmid", "author_id", F.explode(F.when(F.col("region") == "ASIA", F.array(F.lit("Curated A"), F.lit("Curated B"))).otherwise(F.array(F.lit("Curated A")))).alias("institution")).where("pmid % 10 = 0")
    out = joins.correct_institutions(guess, people.select("pmid", "author_id", "pos"), fixed)
    return out.groupBy("canonical", "order", "matched_by").agg(F.count("*").alias("n"))


@query
def runs_compared(f: Facts) -> DataFrame:
    """For each label of one run how many rows, and the commonest label of another run on them."""
    a = f.lines().select("key", "pos", F.col("author").cast("string").alias("author_id"))
    b = f.lines().select("key", "pos", (F.col("author") % 7 + F.col("pos") % 2).cast("string").alias("author_id"))
    return joins.modal_of_other_run(a, b, ("key", "pos"), "author_id")


@query
def unknown_as_zero(f: Facts) -> DataFrame:
    """Years by mean citations, unknown ones as 0, numbered."""
    per = f.records().groupBy("cust").agg(F.avg("cites").alias("m"))
    return per.orderBy(null_as_zero("m"), "cust").limit(200).select("cust", F.bround("m", 6).alias("m"))


@query
def comparable_journals(f: Facts) -> DataFrame:
    """Journal names as two sources may both write them."""
    name = F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, " (Brand ").otherwise("."), F.col("p_brand"), F.lit(")"))
    return f.table("part").select("p_partkey", joins.comparable_journal(name).alias("name"))


@query
def sources_side_by_side(f: Facts) -> DataFrame:
    """The first ten countries by lines and by orders, rank by rank."""
    ours = f.lines().join(f.nations(), "author").groupBy(F.col("country").alias("value")).agg(F.count("*").alias("n"))
    theirs = f.first_countries().where("country is not null").groupBy(F.col("country").alias("value")).agg(F.count("*").alias("n"))
    return joins.ranked_side_by_side(ours, theirs, 10)


@query
def countries_side_by_side(f: Facts) -> DataFrame:
    """The first ten countries by first author, with number and rank under each way of counting."""
    return rankings.schemes_side_by_side(rankings.country_schemes(f.lines().join(f.nations(), "author"), f.records(), "key", "country"), 10)


@query
def cluster_apart_and_merged(f: Facts) -> DataFrame:
    """A cluster's members apart, and the cluster as one: two nations and their region."""
    placed = f.lines().join(f.nations(), "author").join(f.records().select("key", "cites"), "key").withColumn("at", F.lit(0))
    ranked = rankings.institution_rankings(placed, {"canonical": F.col("country"), "cluster": F.col("region")}, key="key", pos="pos", order="at", cites="cites")
    return S.merged_names(ranked, ["FRANCE", "GERMANY"], "EUROPE")


@query
def trends_from_a_floor(f: Facts) -> DataFrame:
    """Keyword shares from the first year with enough records that have keywords."""
    has = f.records().join(f.terms().select("key").distinct().withColumn("has", F.lit(True)), "key", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    wanted = f.terms().select("term").distinct().orderBy("term").limit(10)
    trend = terms.trends(f.terms(), has, "key", "year", "has", wanted)
    cover = terms.coverage(has.where("year > 1992"), "has", ("year",))
    return terms.trend_start(trend, cover, "year", 100)


@query
def figure_components(f: Facts) -> DataFrame:
    """The drawn network: suppliers by their orders, edges of weight, components of more than two."""
    items = f.lines()
    people, links = graphs.coauthor_network(items, "key", "author", 30)
    nodes, _ = graphs.figure_graph(people, links, "author", 30, weight=3)
    return nodes.select("author", "n", "component")


@query
def chain_components(f: Facts) -> DataFrame:
    """Components of customers linked by equal balance and nation."""
    c = f.table("customer").select("c_custkey", "c_nationkey", F.floor("c_acctbal").alias("b"))
    links = c.join(c.select(F.col("c_custkey").alias("other"), "c_nationkey", (F.col("b") + 1).alias("b")), ["c_nationkey", "b"])
    return graphs.components(links.select(F.col("c_custkey").alias("a"), F.col("other").alias("b")))


@query
def surnames_in_sql(f: Facts) -> DataFrame:
    """The registered function on names with letters that are spelled out or lose their marks."""
    name = F.concat(F.lit("Mü-"), F.initcap("n_name"), F.lit(" É'Ø"))
    return f.table("nation").select("n_nationkey", norm_last(name).alias("surname"))


@query
def affiliations_in_sql(f: Facts) -> DataFrame:
    """The table function on segments: the best alias of each."""
    rows = [("urope", "0", "Europe", "", "World", "", 2, "", 0), ("^a(sia|frica)$", "1", "A continent", "", "", "", 1, "", 1), ("asia", "0", "Asia", "", "", "", 2, "", 2)]
    aliases = f.spark.createDataFrame(rows, "pattern string, is_regex string, canonical string, parent string, cluster string, country string, tier int, note string, seq int")
    return resolve_affiliation(f.table("region").select("r_name"), "r_name", aliases).select("r_name", "canonical", "cluster", "matched_by", "tier")


@query
def bradford_of_suppliers(f: Facts) -> DataFrame:
    """How many suppliers each of five zones has."""
    curve = bradford_curve(f.table("lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n")), "name", "n", zones=5)
    return curve.groupBy("zone").agg(F.count("*").alias("names"), F.max("cumulative").alias("cumulative"))


@query
def record_attribution(f: Facts) -> DataFrame:
    """The audit table: each record's year, country, their sources and its citations."""
    r = f.first_countries().select(
        F.col("key").cast("string").alias("pmid"), F.col("year").cast("string").alias("year"), "country", F.lit("affil").alias("country_source"), F.array(F.coalesce("country", F.lit("Unknown")), F.lit("X")).alias("countries_all"),
        F.col("cites").alias("citation_count"), F.lit("works").alias("citation_source"), (F.col("key") % 2 == 0).alias("oa_matched"),
    )
    return A.attribution(r)
