"""Rankings of authors, journals, countries and institutions under several ways of counting.

Long form throughout: an authorship is a row (record key, position, author), never a nested array
by the time it is counted.  Each ranking is one or two hash aggregations; ties are broken by name
(or first appearance), so results don't depend on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.citations import cite_summary, exact_quantile, h_estimate
from folio.functions.ranks import with_competition_rank

UNKNOWN = "Unknown"


def known_name(column: str):
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))


def authorships(records: DataFrame, key: str = "pmid") -> DataFrame:
    """One row for each author of each record: position, author's fields, year and citation count."""
    keep = [c for c in dict.fromkeys((key, "rec_seq", "pmid", "year_int", "journal", "journal_abbr", "citation_count")) if c in records.columns]
    return records.select(*keep, F.posexplode("authors").alias("pos", "author")).select(*keep, "pos", "author.*")


def with_places(authorship: DataFrame, key: str, pos: str = "pos", author: str = "author_id") -> DataFrame:
    """Marks the first author (first of all) and the last (last named one, of two or more named)."""
    per = Window.partitionBy(key)
    named = F.col(author).isNotNull() & (F.col(author) != "__collective__")
    last = F.max(F.when(named, F.col(pos))).over(per)
    return authorship.withColumns({"named": named, "is_first": F.col(pos) == 0, "is_last": named & (F.col(pos) == last) & (F.count_if(named).over(per) >= 2)})


def author_stats(authorship: DataFrame, key: str, author: str, year: str, cites: str, journal: str, pos: str = "pos", minimum: int = 3) -> DataFrame:
    """Per author with ``minimum`` authorships or more: counts by place, citations, years and journals."""
    placed = with_places(authorship, key, pos, author).where("named")
    c, known = F.col(cites), F.when(F.col(year) > 0, F.col(year))
    # Years and journals of one author are few, so sets of them spare passes of their own.
    both = placed.groupBy(author).agg(
        F.count("*").alias("publications"),
        F.count_if("is_first").alias("first_author"),
        F.count_if("is_last").alias("last_author"),
        *[x for x in cite_summary(c)],
        F.min(known).alias("year_first"),
        F.max(known).alias("year_last"),
        F.size(F.collect_set(known)).cast("long").alias("years_active"),
        F.size(F.collect_set(journal)).cast("long").alias("journal_count"),
    ).where(F.col("publications") >= minimum)
    return both.withColumn("h_index_estimate", h_estimate(F.col("citation_total"), F.col("publications")))


def sample_affiliations(authorship: DataFrame, author: str = "author_id", most: int = 3) -> DataFrame:
    """(author, sample): up to three different affiliations in the order met, of the first three that have any."""
    has = authorship.where(F.size("affils") > 0)
    nth = F.row_number().over(Window.partitionBy(author).orderBy("rec_seq", "pos"))
    early = has.withColumn("nth", nth).where(F.col("nth") <= most).select(author, "nth", F.slice("affils", 1, 2).alias("a"))
    lists = early.groupBy(author).agg(F.array_sort(F.collect_list(F.struct("nth", "a"))).alias("l"))
    return lists.select(author, F.slice(F.array_distinct(F.flatten("l.a")), 1, most).alias("sample_affiliations"))


def journal_stats(records: DataFrame, journal: str, cites: str, total: int | None = None, abbr: str | None = None, seq: str | None = None) -> DataFrame:
    """Per journal: count, share of all records in percent, citations; the abbreviation of its first record."""
    name = known_name(journal)
    extra = [F.min_by(abbr, seq).alias("abbreviation")] if abbr else []
    per = records.groupBy(name.alias("journal")).agg(F.count("*").alias("publications"), *extra, *cite_summary(F.col(cites)))
    return per.withColumn("percentage", F.bround(100 * F.col("publications") / F.sum("publications").over(Window.partitionBy()), 2))


def country_stats(records: DataFrame, country: str, cites: str, population: DataFrame | None = None) -> DataFrame:
    """Per country of the first author: count, shares of all and of resolved records, rank, citations, per-capita rates."""
    per = records.groupBy(known_name(country).alias("country")).agg(F.count("*").alias("publications"), *cite_summary(F.col(cites)))
    whole = Window.partitionBy()
    n, resolved = F.col("publications"), F.col("country") != UNKNOWN
    per = per.withColumns({
        "percentage": F.bround(100 * n / F.sum(n).over(whole), 2),
        "pct_of_resolved": F.when(resolved, F.bround(100 * n / F.sum(F.when(resolved, n)).over(whole), 2)),
    })
    ranked = with_competition_rank(per.where(resolved), "publications").unionByName(per.where(~resolved).withColumn("rank", F.lit(None).cast("string")))
    if population is None:
        return ranked
    rated = ranked.join(population.select("country", "population"), "country", "left")
    return rated.withColumns({
        "pubs_per_million": F.bround(n * 1e6 / F.col("population"), 2),
        "cites_per_million": F.bround(F.col("citation_total") * 1e6 / F.col("population"), 1),
    })


def country_schemes(authorship: DataFrame, records: DataFrame, key: str, country: str, pos: str = "pos") -> DataFrame:
    """(scheme, country, publications, pct): by first author, whole and fractional counting.

    First: one for each record, by its first author's country.  Whole: one for each different
    country of a record.  Fractional: each author who has a country brings 1 / their number.
    """
    has = authorship.where(F.coalesce(F.nullif(F.col(country), F.lit("")), F.lit(UNKNOWN)) != UNKNOWN)
    first = records.join(authorship.where(F.col(pos) == 0).select(key, country), key, "left").groupBy(known_name(country).alias("country")).agg(F.count("*").cast("double").alias("v"))
    first = first.where(F.col("country") != UNKNOWN)
    whole = has.select(key, F.col(country).alias("country")).distinct().groupBy("country").agg(F.count("*").cast("double").alias("v"))
    shares = has.groupBy(key, F.col(country).alias("country")).agg(F.count("*").alias("k"))
    shares = shares.withColumn("v", F.col("k") / F.sum("k").over(Window.partitionBy(key)))
    fractional = shares.groupBy("country").agg(F.sum("v").alias("v"))
    out = None
    for scheme, per in (("first", first), ("whole", whole), ("fractional", fractional)):
        one = per.select(F.lit(scheme).alias("scheme"), "country", F.col("v"))
        out = one if out is None else out.unionByName(one)
    share = F.bround(100 * F.col("v") / F.sum("v").over(Window.partitionBy("scheme")), 2)
    return out.select("scheme", "country", F.bround("v", 2).alias("publications"), share.alias("pct"))


def schemes_side_by_side(schemes: DataFrame, k: int = 30) -> DataFrame:
    """The first ``k`` countries by first author, with their number and rank under each scheme."""
    ranked = with_competition_rank(schemes, "publications", by=("scheme",))
    each = {s: ranked.where(F.col("scheme") == s).select("country", F.col("publications").alias(s), F.col("rank").alias(f"rank_{s}")) for s in ("first", "whole", "fractional")}
    return each["first"].orderBy(F.desc("first"), "country").limit(k).join(each["whole"], "country", "left").join(each["fractional"], "country", "left")


SCOPES, COUNTINGS = ("first", "all"), ("primary", "whole", "fractional")


def institution_rankings(resolved: DataFrame, levels: dict[str, Column], key: str, pos: str, order: str, cites: str, shortest: int = 4) -> DataFrame:
    """(level, institution, scope, counting, publications, citations, n_cited_known): every level, scope and way of counting at once.

    ``resolved`` has a row for each institution of each author of each record; a level is an expression
    for its name, null where it has none.  Scope: the first author or all.  Counting: an author's first
    institution, all of them, or each as 1 / their number, fixed before names shorter than ``shortest``
    are dropped.  A record's weight for a name is its authors' greatest.  All weights are aggregated
    side by side: one window and two aggregations, however many rankings.
    """
    names = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), name.alias("name")) for level, name in levels.items()]))
    rows = resolved.select(key, pos, order, F.col(cites).alias("c"), names.alias("_n")).select("*", "_n.level", "_n.name").where("name is not null")
    rows = rows.withColumn("share", 1.0 / F.count("*").over(Window.partitionBy(key, pos, "level"))).where(F.length("name") >= shortest)
    weight = {"primary": F.when(F.col(order) == 0, 1.0), "whole": F.lit(1.0), "fractional": F.col("share")}
    weights = {f"{s}_{c}": F.max(F.when(F.col(pos) == 0, weight[c]) if s == "first" else weight[c]).alias(f"{s}_{c}") for s in SCOPES for c in COUNTINGS}
    per_record = rows.groupBy("level", "name", key).agg(*weights.values(), F.max("c").alias("c"))
    sums = lambda w: F.struct(F.sum(w).alias("w"), F.sum(F.col(w) * F.col("c")).alias("wc"), F.count(F.when(F.col(w).isNotNull(), F.col("c"))).alias("known"))
    per_name = per_record.groupBy("level", "name").agg(*[sums(w).alias(w) for w in weights])
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(c).alias("counting"), F.col(f"{s}_{c}").alias("v")) for s in SCOPES for c in COUNTINGS]))
    each = per_name.select("level", F.col("name").alias("institution"), long.alias("r")).select("level", "institution", "r.scope", "r.counting", "r.v.*").where("w is not null")
    digits = F.when(F.col("counting") == "fractional", F.bround("w", 2)).otherwise(F.bround("w", 0))
    return each.select("level", "institution", "scope", "counting", digits.alias("publications"), F.bround(F.coalesce("wc", F.lit(0.0)), 0).cast("long").alias("citations"), F.col("known").alias("n_cited_known"))


def institution_stats(rankings: DataFrame, level: str = "canonical", scope: str = "all", counting: str = "whole") -> DataFrame:
    """One of the rankings: (institution, publications, citations, n_cited_known)."""
    return rankings.where((F.col("level") == level) & (F.col("scope") == scope) & (F.col("counting") == counting)).drop("level", "scope", "counting")


def resolution_meta(records: DataFrame, authorship: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """How many records have no affiliation, none that resolves, or a resolved one."""
    any_ = authorship.groupBy(key).agg(F.max(F.coalesce(F.size("affils") > 0, F.lit(False))).alias("has"))
    done = resolved.select(key).distinct().withColumn("done", F.lit(True))
    both = records.select(key).join(any_, key, "left").join(done, key, "left")
    has, ok = F.coalesce("has", F.lit(False)), F.coalesce("done", F.lit(False))
    return both.agg(F.count("*").alias("n_records"), F.count_if(~has).alias("n_no_affiliation"), F.count_if(has & ~ok).alias("n_unresolved"), F.count_if(has & ok).alias("n_resolved"))


def per_capita(counts: DataFrame, population: DataFrame, minimum: int) -> DataFrame:
    """(rank, country, publications, population, pubs_per_million) of countries with enough publications and a known population."""
    rated = counts.where(F.col("publications") >= minimum).join(population, "country").withColumn("pubs_per_million", F.bround(F.col("publications") * 1e6 / F.col("population"), 2))
    return with_competition_rank(rated, "pubs_per_million")


def without_cluster(records: DataFrame, population: DataFrame, country: str, of: str, cluster: str, label: str) -> DataFrame:
    """A row like those of ``per_capita``, unranked: one country's records without those whose first author is of a cluster.

    ``records`` has ``country`` and ``cluster`` (true for those that are) of the first author.
    """
    n = records.where(F.col(country) == of).agg(F.count_if(~F.coalesce(F.col(cluster), F.lit(False))).alias("publications"))
    both = n.withColumn("country", F.lit(of)).join(population, "country").withColumn("country", F.lit(label))
    return both.withColumn("pubs_per_million", F.bround(F.col("publications") * 1e6 / F.col("population"), 2)).withColumn("rank", F.lit(""))


def without_population(counts: DataFrame, population: DataFrame) -> DataFrame:
    return counts.join(population, "country", "left_anti")


def citation_indicators(rows: DataFrame, entity: str, year: str, cites: str, minimum: int, fixed: tuple[int, int], means: DataFrame) -> DataFrame:
    """Per entity with enough known counts: mean and median of citations over their year's mean, and in a fixed window.

    ``means`` has (year, year_mean), see ``year_means``.
    """
    known = rows.where(F.col(cites).isNotNull()).join(means.select(year, "year_mean"), year)
    ratio = F.when(F.col("year_mean") > 0, F.col(cites) / F.col("year_mean"))
    within = F.when(F.col(year).between(*fixed), F.col(cites))
    return known.groupBy(entity).agg(
        F.count("*").alias("n"),
        F.bround(F.avg(ratio), 3).alias("mncs"),
        F.bround(exact_quantile(ratio, 0.5), 3).alias("median_normalised"),
        F.count(within).alias("n_window"),
        F.bround(F.avg(within), 2).alias("window_mean"),
        F.bround(exact_quantile(within, 0.5), 1).alias("window_median"),
    ).where(F.col("n") >= minimum)


def year_means(records: DataFrame, year: str, cites: str) -> DataFrame:
    """(year, n, year_mean) over the records whose count is known."""
    return records.where(F.col(cites).isNotNull()).groupBy(year).agg(F.count("*").alias("n"), F.avg(cites).alias("year_mean"))


def value_counts(records: DataFrame, column: str, name: str, many: bool = False) -> DataFrame:
    """How many records have each value; ``many``: the column is an array, whose values all count."""
    each = records.select(F.explode(column).alias(name)) if many else records.select(known_name(column).alias(name))
    return each.groupBy(name).agg(F.count("*").alias("n"))


def authors_by_country(authorship: DataFrame, author: str, country: str) -> DataFrame:
    """(country, author), once each: the long form of the set of authors of every country."""
    return authorship.where(F.col(author).isNotNull()).select(known_name(country).alias("country"), author).distinct()


def without_group(records: DataFrame, authorship: DataFrame, members: DataFrame, key: str, author: str) -> DataFrame:
    """Records none of whose authors is a member."""
    theirs = authorship.join(members.select(author), author, "left_semi").select(key).distinct()
    return records.join(theirs, key, "left_anti")


def identity_audit(authorship: DataFrame, names: DataFrame, author: str = "author_id", k: int = 2) -> DataFrame:
    """For the named authors: authorships, years, commonest affiliations, external ids and ORCIDs."""
    rows = authorship.join(names.select(author), author, "left_semi")
    base = rows.groupBy(author).agg(F.count("*").alias("n"), F.min("year_int").alias("year_first"), F.max("year_int").alias("year_last"), F.array_sort(F.collect_set("orcid")).alias("orcids"))

    def commonest(values: DataFrame, value: str, most: int, name: str) -> DataFrame:
        counts = values.where(F.col(value).isNotNull()).groupBy(author, value).agg(F.count("*").alias("c"))
        nth = F.row_number().over(Window.partitionBy(author).orderBy(F.desc("c"), value))
        kept = counts.withColumn("nth", nth).where(F.col("nth") <= most)
        listed = F.array_sort(F.collect_list(F.struct("nth", value, "c")))
        return kept.groupBy(author).agg(F.transform(listed, lambda x: F.concat(x[value], F.lit(" ×"), x["c"].cast("string"))).alias(name))

    affils = commonest(rows.select(author, F.explode("affils").alias("a")).withColumn("a", F.left("a", F.lit(90))), "a", k, "affiliations")
    ids = commonest(rows, "oa_id", 4, "external_ids")
    distinct = rows.where("oa_id is not null").select(author, "oa_id").distinct().groupBy(author).agg(F.count("*").alias("n_external_ids"))
    return base.join(affils, author, "left").join(ids, author, "left").join(distinct, author, "left").fillna({"n_external_ids": 0})
