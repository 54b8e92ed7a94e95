"""Registered queries: the library's operators over whole tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import names as N
from folio.functions.citations import h_estimate
from folio.functions.places import segments
from folio.functions.ranks import first_of, modal, top, with_competition_rank, with_mid_rank
from folio.operators import graphs, joins, rankings, stats, terms, trends
from folio.operators.bradford import bradford_curve, bradford_zones
from folio.operators.screening import family_mix, first_rule, tally
from folio.plans.facts import Facts
from folio.plans.windows import in_windows, outside
from folio.streaming.incremental import event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Nested windows that end in the data's last year.
WINDOWS = [("all_time", 1992, 2001), ("last_5yr", 1997, 2001), ("last_3yr", 1999, 2001), ("last_1yr", 2001, 2001)]
#: Ordered rules, families and aliases for documents, in patterns that SQL engines share.
RULES = [("rule.reserved", "all rights reserved"), ("rule.licence", "licen[cs]e"), ("rule.mail", "[a-z0-9._-]+@[a-z0-9.-]+", "@"), ("rule.shout", "!!"), ("rule.table", " [|] ")]
FAMILIES = {"junk": "[*$%&#][*$%&#]", "notice": "rights reserved|licen[cs]e|released under", "function words": "(^| )(the|der|les|los) "}
ALIASES = [("general public license", "GPL", 1), ("mit license", "MIT", 1), ("apache license", "Apache", 1), ("license", "other", 2), ("rights reserved", "proprietary", 2)]


def query(run: Callable[[Facts], DataFrame]) -> Query:
    """Registers a query under its function's name."""

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Facts(spark, sf_dir))

    whole.__doc__ = run.__doc__
    QUERIES[run.__name__] = whole
    return whole


@query
def temporal_trends(f: Facts) -> DataFrame:
    """Yearly counts with running total, centred mean and citations."""
    return trends.temporal_trends(f.records(), "year", "cites")


@query
def nested_windows(f: Facts) -> DataFrame:
    """All windows in one pass: totals, known counts, distinct customers, field h-index."""
    return trends.window_comparison(f.records(), "year", "cites", {"unique_customers": "cust"}, WINDOWS)


@query
def outside_window(f: Facts) -> DataFrame:
    """Records outside a window, by year."""
    return outside(f.records(), "year", 1996, 1998).groupBy("year").agg(F.count("*").alias("n"))


@query
def field_h_index(f: Facts) -> DataFrame:
    """The field's h-index in each window."""
    return trends.field_h_index(in_windows(f.records(), "year", WINDOWS), "cites", ("window",))


@query
def peak_year(f: Facts) -> DataFrame:
    """The first year with the most records."""
    return trends.peak_year(f.records())


@query
def journal_stats(f: Facts) -> DataFrame:
    """Segments as journals: counts, shares, citation quantiles."""
    return rankings.journal_stats(f.journals(), "journal", "cites")


@query
def journals_top(f: Facts) -> DataFrame:
    """The three largest journals, numbered."""
    per = rankings.journal_stats(f.journals(), "journal", "cites").select("journal", "publications", "percentage")
    return top(per, 3, F.desc("publications"), F.asc("journal"))


@query
def author_stats(f: Facts) -> DataFrame:
    """Suppliers as authors: places, citations, years, journals, estimated h."""
    rows = f.lines().withColumn("author", F.col("author").cast("string")).join(f.journals(), "key")
    return rankings.author_stats(rows, "key", "author", "year", "cites", "journal")


@query
def h_estimate_by_author(f: Facts) -> DataFrame:
    """The estimate min(round(sqrt(citations / 2)), publications)."""
    per = f.lines().join(f.records(), "key").groupBy("author").agg(F.count("*").alias("n"), F.coalesce(F.sum("cites"), F.lit(0)).alias("c"))
    return per.select("author", "n", h_estimate(F.col("c"), F.col("n")).alias("h_index_estimate"))


@query
def country_stats(f: Facts) -> DataFrame:
    """Countries of first authors: shares, ranks with ties, per-capita rates."""
    return rankings.country_stats(f.first_countries(), "country", "cites", f.populations())


@query
def per_capita(f: Facts) -> DataFrame:
    """Countries with at least 20 records, by records for each million inhabitants."""
    counts = f.first_countries().where("country is not null").groupBy("country").agg(F.count("*").alias("publications"))
    return rankings.per_capita(counts, f.populations(), 20)


@query
def country_schemes(f: Facts) -> DataFrame:
    """First, whole and fractional counting of countries."""
    return rankings.country_schemes(f.lines().join(f.nations(), "author"), f.records(), "key", "country")


@query
def institution_schemes(f: Facts) -> DataFrame:
    """Institutions at three levels, three ways of counting, two scopes: a line's supplier, its nation and its region."""
    placed = f.lines().join(f.nations(), "author").join(f.records().select("key", "cites"), "key")
    second = placed.where("pos % 4 = 1").select("key", "pos", "cites", F.lit(1).alias("at"), F.lit("Shared laboratory").alias("supplier"), F.lit(None).cast("string").alias("country"), F.lit("Shared laboratory").alias("region"))
    both = placed.select("key", "pos", "cites", F.lit(0).alias("at"), "supplier", "country", "region").unionByName(second)
    levels = {"canonical": F.col("supplier"), "parent": F.col("country"), "cluster": F.col("region")}
    return rankings.institution_rankings(both, levels, key="key", pos="pos", order="at", cites="cites")


@query
def bradford_curve_of_parts(f: Facts) -> DataFrame:
    """Parts ranked by lines, cut into three zones."""
    return bradford_curve(f.table("lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("n")), "name", "n", digits=4)


@query
def bradford_zones_of_parts(f: Facts) -> DataFrame:
    """Zones of parts with their multipliers."""
    curve = bradford_curve(f.table("lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("n")), "name", "n")
    return bradford_zones(curve, "n")


@query
def keyword_frequency(f: Facts) -> DataFrame:
    """In how many orders each brand occurs, from a floor of 20."""
    return graphs.nodes(f.brands(), "key", "term").where("n >= 20")


@query
def keyword_cooccurrence(f: Facts) -> DataFrame:
    """Pairs of brands in 20 orders or more, both frequent."""
    return graphs.cooccurrence(f.brands(), "key", "term", 20)[1]


@query
def keyword_coverage(f: Facts) -> DataFrame:
    """Per year, how many orders have any part."""
    has = f.records().join(f.terms().select("key").distinct().withColumn("has", F.lit(True)), "key", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return terms.coverage(has, "has", ("year",))


@query
def keyword_trends(f: Facts) -> DataFrame:
    """Shares of part types by year, zeros included."""
    has = f.records().join(f.terms().select("key").distinct().withColumn("has", F.lit(True)), "key", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return terms.trends(f.terms(), has, "key", "year", "has", f.terms().select("term").distinct())


@query
def country_collaboration(f: Facts) -> DataFrame:
    """Pairs of countries that share orders."""
    return graphs.edges(f.lines().join(f.nations(), "author"), "key", "country")


@query
def coauthor_network(f: Facts) -> DataFrame:
    """Edges around the ten suppliers with the most orders."""
    return graphs.coauthor_network(f.lines(), "key", "author", 10)[1]


@query
def coauthor_nodes(f: Facts) -> DataFrame:
    """Nodes of that network."""
    return graphs.coauthor_network(f.lines(), "key", "author", 10)[0]


@query
def collaboration_matrix(f: Facts) -> DataFrame:
    """The matrix of the ten countries with the most orders."""
    items = f.lines().join(f.nations(), "author")
    return graphs.matrix(graphs.nodes(items, "key", "country"), graphs.edges(items, "key", "country"), "country", 10)


@query
def authors_by_country(f: Facts) -> DataFrame:
    """How many suppliers each country has, from its set of authors."""
    sets = rankings.authors_by_country(f.lines().join(f.nations(), "author"), "author", "country")
    return sets.groupBy("country").agg(F.count("*").alias("authors"))


@query
def year_means(f: Facts) -> DataFrame:
    """Mean citations of each year's known records."""
    return rankings.year_means(f.records(), "year", "cites").withColumn("year_mean", F.bround("year_mean", 6))


@query
def citation_indicators(f: Facts) -> DataFrame:
    """Year-normalised citations by country of the first author, and in a fixed window."""
    rows = f.first_countries().where("country is not null")
    return rankings.citation_indicators(rows, "country", "year", "cites", 20, (1995, 1997), rankings.year_means(f.records(), "year", "cites"))


@query
def competition_rank(f: Facts) -> DataFrame:
    """Brands by number of parts, ties marked."""
    return with_competition_rank(f.table("part").groupBy("p_brand").agg(F.count("*").alias("n")), "n")


@query
def mid_rank(f: Facts) -> DataFrame:
    """Average ranks of suppliers by lines."""
    return with_mid_rank(f.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), "n")


@query
def spearman(f: Facts) -> DataFrame:
    """Rank correlation of suppliers' lines and quantities."""
    per = f.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return stats.spearman(per, "n", "q")


@query
def modal_value(f: Facts) -> DataFrame:
    """Each segment's commonest nation, of equals the one whose first customer is first."""
    return modal(f.table("customer"), ("c_mktsegment",), "c_nationkey", "c_custkey")


@query
def impute_nearest(f: Facts) -> DataFrame:
    """Every tenth event takes its value from the same user's nearest other event within two days."""
    e = f.table("events").select("event_id", "user_id", "value", F.datediff("ts", F.lit("1970-01-01")).alias("day"))
    slots, known = e.where("event_id % 10 = 0").drop("value"), e.where("event_id % 10 <> 0")
    got = joins.impute_nearest(slots, known, "user_id", "day", ("event_id",), ("event_id",), 2)
    return got.select("event_id", "user_id", "day", F.col("donor.event_id").alias("donor"), F.col("donor.day").alias("donor_day"), F.bround("donor.value", 6).alias("value"))


@query
def manual_override(f: Facts) -> DataFrame:
    """Rules decide on documents, hand labels overrule them."""
    docs, hand = f.table("documents"), f.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    both = docs.join(hand, "doc_id", "left").withColumn("rule", first_rule(F.lower("text"), RULES))
    decision = F.when(F.col("quality").isNotNull(), F.concat(F.lit("manual."), F.when(F.col("quality") == 1, "include").otherwise("exclude"))).otherwise(F.coalesce("rule", F.lit("keep")))
    return both.select("doc_id", decision.alias("decision"))


@query
def rule_classifier(f: Facts) -> DataFrame:
    """The first of the ordered rules that a document meets."""
    return f.table("documents").select("doc_id", F.coalesce(first_rule(F.lower("text"), RULES), F.lit("keep")).alias("rule_id"))


@query
def rule_tally(f: Facts) -> DataFrame:
    """How many documents each rule decides."""
    ruled = f.table("documents").select(F.coalesce(first_rule(F.lower("text"), RULES), F.lit("keep")).alias("rule_id"))
    return tally(ruled.withColumns({"decision": F.when(F.col("rule_id") == "keep", "include").otherwise("exclude"), "stage": F.when(F.col("rule_id") == "keep", "keep").otherwise("screen")}))


@query
def procedure_families(f: Facts) -> DataFrame:
    """Pattern families of each document."""
    tags = [F.when(F.rlike(F.lower("text"), F.lit(p)), F.lit(n)) for n, p in FAMILIES.items()]
    return f.table("documents").select("doc_id", F.array_join(F.filter(F.array(*tags), lambda t: t.isNotNull()), "|").alias("families"))


@query
def family_mix_by_language(f: Facts) -> DataFrame:
    """Families by language, in number and percent."""
    tags = [F.when(F.rlike(F.lower("text"), F.lit(p)), F.lit(n)) for n, p in FAMILIES.items()]
    return family_mix(f.table("documents").select("lang", F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("families")), ("lang",), list(FAMILIES))


@query
def email_free_segments(f: Facts) -> DataFrame:
    """Segments of each document's text without e-mail addresses."""
    return f.table("documents").select("doc_id", F.size(segments(F.col("text"))).alias("n_segments"), F.coalesce(F.length(F.get(segments(F.col("text")), F.lit(0))), F.lit(0)).alias("first_chars"))


@query
def affiliation_jaccard(f: Facts) -> DataFrame:
    """Similarity of each document's words to those of the next id's document."""
    d = f.table("documents").select("doc_id", N.affiliation_words(F.array(F.coalesce("text", F.lit("")))).alias("words"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("other"))
    return d.join(after, "doc_id").select("doc_id", F.bround(N.jaccard(F.col("words"), F.col("other")), 6).alias("similarity"))


@query
def alias_resolution(f: Facts) -> DataFrame:
    """The best alias that a document's text contains: least tier, then longest."""
    rows = [(p, "0", c, c, "", "", t, "", i) for i, (p, c, t) in enumerate(ALIASES)]
    aliases = f.spark.createDataFrame(rows, "pattern string, is_regex string, canonical string, parent string, cluster string, country string, tier int, note string, seq int")
    best = joins.best_alias(F.col("text"), aliases)
    return f.table("documents").select("doc_id", best.alias("a")).where("a is not null").select("doc_id", "a.canonical", "a.tier")


@query
def html_titles(f: Facts) -> DataFrame:
    """Titles of pages, inline tags removed."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return f.table("pages").select("page_id", F.trim(F.regexp_replace(title, "<[^>]+>", "")).alias("title"))


@query
def dedupe_keep_first(f: Facts) -> DataFrame:
    """The first document of each text."""
    d = f.table("documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return first_of(d, ("digest",), F.col("doc_id")).select("doc_id", "digest")


@query
def anti_delta(f: Facts) -> DataFrame:
    """Customers with orders before 1998 against those with orders after."""
    early, late = f.records().where("year < 1998"), f.records().where("year >= 1998")
    return joins.delta(late, early, "cust").groupBy("status").agg(F.count("*").alias("n"))


@query
def recall_gate(f: Facts) -> DataFrame:
    """Good documents (by label): kept by the rules, or the rule that dropped them."""
    ruled = f.table("documents").select("doc_id", first_rule(F.lower("text"), RULES).alias("rule"))
    good = f.table("labels").where("quality = 1").select("doc_id").distinct()
    return joins.recall_gate(good, ruled.where("rule is null"), ruled.where("rule is not null"), "doc_id").groupBy("found", "reason").agg(F.count("*").alias("n"))


@query
def metric_diff(f: Facts) -> DataFrame:
    """Counts by status of early and late orders, side by side."""
    o = f.table("orders")
    snap = lambda df: df.groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").alias("value"))
    return joins.metric_diff(snap(o.where(F.year("o_orderdate") < 1998)), snap(o.where(F.year("o_orderdate") >= 1998)))


@query
def yearly_diff(f: Facts) -> DataFrame:
    """Orders by year against those with a known citation count."""
    r = f.records()
    return joins.yearly_diff(r.groupBy("year").agg(F.count("*").alias("ours")), r.where("cites is not null").groupBy("year").agg(F.count("*").alias("theirs")), "year")


@query
def exclude_group(f: Facts) -> DataFrame:
    """Orders by year without those that any of a group of suppliers has a line of."""
    members = f.table("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("author"))
    rows = f.table("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("author"))
    return rankings.without_group(f.records(), rows, members, "key", "author").groupBy("year").agg(F.count("*").alias("n"))


@query
def wilson_interval(f: Facts) -> DataFrame:
    """Share of good documents by language, with its interval."""
    d = f.table("documents").select("doc_id", "lang").join(f.table("labels"), "doc_id")
    return stats.precision(d, "quality", "lang")


@query
def confusion_counts(f: Facts) -> DataFrame:
    """Quality against toxicity by language."""
    d = f.table("documents").select("doc_id", "lang").join(f.table("labels"), "doc_id")
    return stats.confusion(d, F.col("quality") == 1, F.col("toxic") == 1, ("lang",))


@query
def agreement_by_language(f: Facts) -> DataFrame:
    """How often two labels agree, by language."""
    return stats.agreement(f.table("documents").select("doc_id", "lang").join(f.table("labels"), "doc_id"), "quality", "toxic", ("lang",))


@query
def paired_sources(f: Facts) -> DataFrame:
    """Citation counts of orders against those of their lines' prices.

    Prices are added as decimals: a sum of doubles depends on the order of its rows, and where it
    should be a whole thousand that decides what is cut off.
    """
    price = F.col("l_extendedprice").cast("decimal(28,6)")
    li = f.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg((F.sum(price) / 1000).cast("int").alias("other"))
    return stats.paired_sources(f.records().join(li, "key"), "cites", "other")


@query
def json_properties(f: Facts) -> DataFrame:
    """Events by the key of their JSON properties."""
    return f.table("events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query
def first_last_turn(f: Facts) -> DataFrame:
    """First and last turn of each conversation."""
    c = f.table("conversations")
    return c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"))


@query
def bounds_and_binomial(f: Facts) -> DataFrame:
    """The two largest first-author countries: bounds of their difference."""
    c = f.first_countries().groupBy(rankings.known_name("country").alias("country")).agg(F.count("*").alias("n"))
    best = c.where("country <> 'Unknown'").orderBy(F.desc("n"), "country").limit(2)
    row = best.agg(F.max("n").alias("a"), F.min("n").alias("b")).crossJoin(c.agg(F.coalesce(F.sum(F.when(F.col("country") == "Unknown", F.col("n"))), F.lit(0)).alias("u")))
    return row.select("a", "b", "u", *stats.bounds(F.col("a"), F.col("b"), F.col("u")))


@query
def multi_value_counts(f: Facts) -> DataFrame:
    """Event types by number."""
    return rankings.value_counts(f.table("events"), "event_type", "event_type")


@query
def union_of_rankings(f: Facts) -> DataFrame:
    """Two rankings one below the other, with the columns of both."""
    a = f.table("customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("customers")).withColumn("ranking", F.lit("segment"))
    b = f.table("supplier").groupBy(F.col("s_nationkey").cast("string").alias("name")).agg(F.count("*").alias("suppliers")).withColumn("ranking", F.lit("nation"))
    return joins.stacked([a, b])


@query
def share_of_field(f: Facts) -> DataFrame:
    """Urgent orders for each thousand of a year's orders, every year of a range."""
    o = f.table("orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    field = o.groupBy("year").agg(F.count("*").alias("total"))
    return trends.share_of_field(o.where("o_orderpriority = '1-URGENT'"), field, "year", 1990, 2002, 1000)


@query
def journal_blocks(f: Facts) -> DataFrame:
    """Five-year blocks: the share of two journals, and how many there are."""
    return trends.block_concentration(f.journals(), "year", "journal", ["BUILDING", "MACHINERY"])


@query
def positional_zip(f: Facts) -> DataFrame:
    """A customer's orders with the same user's events at the same place."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = f.table("events").select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).alias("pos"), "event_id")
    c = f.table("orders").select(F.col("o_custkey").alias("key"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("pos"), "o_orderkey")
    return joins.zipped(c, e, "key", "pos")


@query
def windowed_events(f: Facts) -> DataFrame:
    """Daily counts of events by type: the batch form of the streaming aggregate."""
    return event_counts(f.table("events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def bootstrap_interval(f: Facts) -> DataFrame:
    """Resampled difference of the two largest first-author countries."""
    c = f.first_countries().groupBy("country").agg(F.count("*").alias("n"))
    best = c.where("country is not null").orderBy(F.desc("n"), "country").limit(2).agg(F.max("n").alias("a"), F.min("n").alias("b"))
    return stats.bootstrap_difference(best.crossJoin(c.agg(F.sum("n").alias("t"))).select("a", "b", (F.col("t") - F.col("a") - F.col("b")).alias("o")))


@query
def binomial_test(f: Facts) -> DataFrame:
    """Exact two-sided p of good among labelled documents, by language."""
    d = f.table("documents").select("doc_id", "lang").join(f.table("labels"), "doc_id")
    per = d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return per.select("lang", "k", "n", stats.binomial_p(F.col("k"), F.col("n")).alias("p"))
