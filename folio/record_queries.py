"""Registered queries over records: sources, names, identity, places, keywords and screening, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import names as N
from folio.functions.keywords import normalised
from folio.functions.places import attributed_segments, enrich_countries, external_country, fallback_institution, text_overrides
from folio.operators import identity, screening
from folio.operators.rankings import authorships
from folio.plans import cases as C
from folio.plans.facts import Facts
from folio.queries import query
from folio.sources.records import parse_files, with_year

#: Articles in an XML file.
BATCH = 200


def tag(name: str, *content, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes}>"), *[F.lit(c) if isinstance(c, str) else c for c in content], F.lit(f"</{name}>"))


def each(column: str, one):
    return F.array_join(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), one), "")


def articles(f: Facts) -> DataFrame:
    """(file, value): orders as articles in XML, lines as authors; every third author has an affiliation, some years are free text."""
    people = f.lines().join(f.nations(), "author")
    affiliation = F.when((F.col("author") + F.col("pos")) % 3 == 0, tag("AffiliationInfo", tag("Affiliation", "Institute, ", F.col("country")))).otherwise("")
    xml = tag("Author", tag("LastName", F.col("supplier")), tag("ForeName", "Ann"), tag("Initials", "A"), affiliation)
    authors = people.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", xml.alias("x")))), lambda a: a["x"]), "").alias("authors"))
    words = f.brands().groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("brands"))
    headings = f.terms().groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("types"))
    o = f.table("orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority")
    r = f.journals().join(o, "key").join(authors, "key", "left").join(words, "key", "left").join(headings, "key", "left")
    key, year, journal = F.col("key"), F.col("year").cast("string"), F.coalesce("journal", F.lit(""))
    date = F.when(key % 3 == 0, tag("MedlineDate", year, " Jan-Feb")).otherwise(tag("Year", year))
    electronic = F.when(key % 5 == 0, tag("ArticleDate", tag("Year", (F.col("year") - 1).cast("string")), attributes=' DateType="Electronic"')).otherwise("")
    article = tag(
        "Article", tag("Journal", tag("JournalIssue", tag("PubDate", date)), tag("Title", journal), tag("ISOAbbreviation", F.left(journal, F.lit(4)))),
        tag("ArticleTitle", "Order <i>", F.col("o_orderstatus"), "</i> of ", journal),
        tag("Abstract", tag("AbstractText", F.col("o_orderpriority"), attributes=' Label="AIM"'), tag("AbstractText", "customer ", F.col("cust").cast("string"))),
        tag("AuthorList", F.coalesce("authors", F.lit(""))), tag("Language", "eng"), electronic,
    )
    mesh = tag("MeshHeadingList", each("types", lambda t: tag("MeshHeading", tag("DescriptorName", t))))
    keywords = tag("KeywordList", each("brands", lambda t: tag("Keyword", t)), attributes=' Owner="NOTNLM"')
    ids = tag("PubmedData", tag("ArticleIdList", tag("ArticleId", "10.1/", key.cast("string"), attributes=' IdType="doi"')))
    entry = tag("PubmedArticle", tag("MedlineCitation", tag("PMID", key.cast("string")), article, mesh, keywords), ids)
    batch = F.floor(key / BATCH).cast("string")
    files = r.select(F.lpad(batch, 12, "0").alias("file"), entry.alias("entry")).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("entry")), "").alias("entries"))
    return files.select("file", tag("PubmedArticleSet", F.col("entries")).alias("value"))


@query
def xml_records(f: Facts) -> DataFrame:
    """Articles read from XML: texts with inline markup, labelled abstracts, year rules, affiliations copied to those without."""
    r = parse_files(articles(f))
    own = F.filter("authors", lambda a: (F.size(a["affils"]) > 0) & a["affil_source"].isNull())
    copied = F.filter("authors", lambda a: a["affil_source"] == "propagated")
    first = F.get("authors", F.lit(0))
    return r.select(
        "pmid", "title", "abstract", "journal", "journal_abbr", "year", "year_issue", "year_epub", "doi", "language", F.size("authors").alias("n_authors"), F.coalesce(first["last"], F.lit("")).alias("first_author"),
        F.coalesce(F.get(first["affils"], F.lit(0)), F.lit("")).alias("first_affiliation"), F.size(own).alias("n_own"), F.size(copied).alias("n_copied"), F.array_join("keywords", "|").alias("keywords"), F.array_join("mesh", "|").alias("mesh"),
    )


@query
def screening_ladder(f: Facts) -> DataFrame:
    """The whole ladder of rules on records dealt to documents; every sixteenth has a manual decision, which goes first."""
    keys = f.table("documents").select("doc_id")
    manual = keys.where("doc_id % 16 = 6").select(F.col("doc_id").cast("string").alias("pmid"), F.lit("exclude").alias("decision"), F.lit("why").alias("reason"), F.lit("me").alias("screened_by"), F.lit("2020").alias("date"))
    done = screening.classify(C.records(keys, "doc_id", [c for c, *_ in C.SCREENING]), manual)
    log = screening.exclusion_log(done)
    return log.select(F.col("pmid").cast("long").alias("doc_id"), "decision", "rule_id", F.array_contains(F.split("flags", r"\|"), "screen").alias("queued"))


@query
def screening_summary(f: Facts) -> DataFrame:
    """How many records each rule of the ladder decides."""
    done = screening.classify(C.records(f.table("documents").select("doc_id"), "doc_id", [c for c, *_ in C.SCREENING]))
    return screening.tally(screening.exclusion_log(done)).groupBy("decision", "rule_id").agg(F.sum("n").alias("n"))


@query
def families_in_context(f: Facts) -> DataFrame:
    """The three procedure families, ambiguous words only in context."""
    rows = C.records(f.table("documents").select("doc_id"), "doc_id", [{"title": t, "abstract": a} for t, a, _ in C.FAMILY_CASES])
    return screening.procedure_families(rows).select(F.col("rec_seq").alias("doc_id"), F.array_join(F.array_sort("families"), "|").alias("families"))


@query
def query_arms(f: Facts) -> DataFrame:
    """The parts of the search that a record answers to."""
    rows = C.records(f.table("documents").select("doc_id"), "doc_id", [{"title": t, "mesh": m} for t, m, _ in C.ARM_CASES])
    return screening.query_arms(rows).select(F.col("rec_seq").alias("doc_id"), "arm")


@query
def affiliation_countries(f: Facts) -> DataFrame:
    """Country and source of authors from their affiliations, and of the record from its first author."""
    keys = f.table("customer").select("c_custkey")
    rows = C.dealt(keys, "c_custkey", C.COUNTRY_CASES, "affil string, country string, source string").withColumn("affils", F.array("affil"))
    got = C.GAZETTEER.resolve(F.col("affils"))
    return rows.select("c_custkey", got["country"].alias("country"), F.when(F.col("affil") == "", "no_affiliation").otherwise(got["source"]).alias("source"))


@query
def record_countries(f: Facts) -> DataFrame:
    """Countries of orders whose lines' affiliations name their nation: the first author's, and all of them, sorted."""
    people = f.lines().join(f.nations(), "author")
    affil = F.when(F.col("pos") % 2 == 0, F.array(F.concat(F.lit("Institute, "), F.initcap("country")))).otherwise(F.array().cast("array<string>"))
    one = F.struct("pos", F.col("supplier").alias("last"), affil.alias("affils"))
    lists = people.groupBy(F.col("key").alias("rec_seq")).agg(F.array_sort(F.collect_list(one)).alias("a"))
    authors = F.transform("a", lambda a: F.struct(a["last"].alias("last"), a["affils"].alias("affils"), F.lit(None).cast("string").alias("affil_source"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("country_source")))
    names = [r[0].title() for r in f.table("nation").select("n_name").orderBy("n_name").limit(1000).collect()]
    known = C.Gazetteer([(n[:2].upper() + str(i), n, n, None) for i, n in enumerate(names)])
    done = enrich_countries(lists.select("rec_seq", authors.alias("authors")), known)
    return done.select("rec_seq", "country", "country_source", F.array_join("countries_all", "|").alias("countries"))


@query
def display_countries(f: Facts) -> DataFrame:
    """Codes and spellings as display names."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.DISPLAY_CASES, "code string, name string")
    return rows.select("c_custkey", C.GAZETTEER.display(F.col("code")).alias("country"))


@query
def external_countries(f: Facts) -> DataFrame:
    """One country of several that an external source gives."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.EXTERNAL_CASES, "insts array<struct<name: string, cc: string>>, codes array<string>, affil string, code string")
    return rows.select("c_custkey", external_country(F.col("insts"), F.col("codes"), F.col("affil"), ["hospital"]).alias("code"))


@query
def country_overrides(f: Facts) -> DataFrame:
    """Where the affiliation's text overrules the external country."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.OVERRIDE_CASES, "country string, source string, other string, overruled boolean")
    return rows.select("c_custkey", text_overrides(F.col("country"), F.col("source"), F.col("other")).alias("overruled"))


@query
def affiliation_segments(f: Facts) -> DataFrame:
    """The segments of an affiliation that are an author's, and the institution that the first one names."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.SEGMENT_CASES, "affil string, surname string, joined string, institution string")
    own = attributed_segments(F.col("affil"), F.col("surname"))
    return rows.select("c_custkey", F.array_join(own, "|").alias("segments"), fallback_institution(F.get(own, F.lit(0))).alias("institution"))


@query
def keyword_forms(f: Facts) -> DataFrame:
    """Keywords in their normal form: rewrites, synonyms, singular, families."""
    synonyms = f.spark.createDataFrame(C.SYNONYMS, "variant string, canonical string")
    rows = C.dealt(f.table("part").select("p_partkey"), "p_partkey", C.KEYWORD_CASES, "term string, normal string").select("p_partkey", "term")
    return rows.join(normalised(rows, "term", synonyms), "term").select("p_partkey", "normal")


@query
def name_forms(f: Facts) -> DataFrame:
    """What names are compared and shown by."""
    c = F.col
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", [x[:3] for x in C.NAME_CASES], "l string, f string, i string")
    return rows.select("c_custkey", N.surname(c("l")).alias("surname"), N.initials(c("f"), c("i")).alias("initials"), N.name_form(c("f"), c("i")).alias("form"), N.first_forename(N.forename(c("f"))).alias("first"), N.display_name(c("l"), c("f"), c("i")).alias("shown"))


@query
def forename_agreement(f: Facts) -> DataFrame:
    """Whether forenames say the same."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.FORENAME_CASES, "a string, b string, same boolean")
    return rows.select("c_custkey", N.abbreviates(F.col("a"), F.col("b")).alias("same"), (N.outline(F.col("a")) == N.outline(F.col("b"))).alias("outline"))


@query
def institution_keys(f: Facts) -> DataFrame:
    """What tells institutions apart."""
    rows = C.dealt(f.table("customer").select("c_custkey"), "c_custkey", C.PLACE_CASES, "affil string, place string")
    return rows.select("c_custkey", N.institution_key(F.array("affil")).alias("place"))


#: One customer's papers: (surname, forename, initials, whether with the customer's ORCID) of each author.
PAPERS = [
    [("Meier", "Anna", "A", False), ("Huber", "Bo", "B", False), ("Koch", "Cy", "C", False)],
    [("Meier", "A", "A", False), ("Huber", "Bo", "B", False), ("Koch", "Cy", "C", False)],
    [("Meier", "Arno", "A", False)],
    [("Noll", "Eva", "E", True)],
    [("Frei-Noll", "Eva", "E", True)],
    [("Noor", "Ian", "I", False), ("Noor", "I", "I", False)],
    [("", "", "", False)],
]


def papers(f: Facts) -> DataFrame:
    """Records of seven papers for each customer, whose number in letters ends every surname."""
    code = F.concat(F.lit("q"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))

    def author(last: str, fore: str, initials: str, orcid: bool):
        name = F.concat(F.lit(last), code) if last else F.lit("")
        fields = {"last": name, "fore": F.lit(fore), "initials": F.lit(initials), "suffix": F.lit(""), "affils": F.array().cast("array<string>"), "orcid": F.col("c_custkey").cast("string") if orcid else F.lit(""), "oa_id": F.lit(None).cast("string"), "author_id": F.lit(None).cast("string")}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    one = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[author(*a) for a in paper]).alias("authors")) for i, paper in enumerate(PAPERS)])
    rows = f.table("customer").select("c_custkey", F.explode(one).alias("p"))
    seq = F.col("c_custkey") * 10 + F.col("p.i")
    return rows.select(seq.alias("rec_seq"), seq.cast("string").alias("pmid"), F.col("p.authors").alias("authors"))


@query
def identity_of_authors(f: Facts) -> DataFrame:
    """Author identity over papers of every customer: shared co-authors and ORCIDs link, names of one paper and other forenames don't."""
    named = identity.assign_author_ids(papers(f))
    return named.select(F.explode("authors").alias("a")).groupBy(F.col("a.author_id").alias("author_id")).agg(F.count("*").alias("authorships"))


@query
def identity_disagreements(f: Facts) -> DataFrame:
    """Identity against external ids: lines' suppliers as people, their nations or blocks of suppliers as ids."""
    rows = f.lines().join(f.nations(), "author").select(F.col("author").cast("string").alias("author_id"), F.when(F.col("author") % 3 == 0, F.col("author").cast("string")).when(F.col("author") % 3 == 1, F.concat(F.lit("b"), F.floor(F.col("author") / 10).cast("string"))).otherwise(F.concat(F.lit("p"), (F.col("pos") % 2).cast("string"), F.lit("-"), F.col("author").cast("string"))).alias("oa_id"))
    return identity.disagreements(rows).select("author_id", "oa_id", "n", "verdict")


@query
def authorships_of_orders(f: Facts) -> DataFrame:
    """Authors of parsed articles as rows: place, surname and year."""
    rows = authorships(with_year(parse_files(articles(f))), "pmid")
    return rows.groupBy("last", "year_int").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("n_first"))
