"""The library over small records of our own."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from folio import config, serve
from folio.functions import names as N
from folio.functions.keywords import normalised
from folio.functions.places import Gazetteer, attributed_segments, enrich_countries, external_country, fallback_institution, text_overrides
from folio.functions.ranks import top, with_competition_rank
from folio.operators import graphs, joins, rankings, screening, stats
from folio.operators.bradford import bradford_curve
from folio.operators.identity import Safelist, assign_author_ids, disagreements, first_fit, occurrences
from folio.operators.lineage import cut
from folio.plans import analysis, reports, sensitivity
from folio.plans.windows import in_windows, outside, window_rows
from folio.queries import QUERIES
from folio.schemas import RECORD, WORK
from folio.sources.dims import aliases, gazetteer_table
from folio.sources.records import missing_keys, organisation_works, read_ids, read_stage, read_xml, write_stage
from folio.sources.remote import query_between, register, slices
from folio.streaming.incremental import current, enrich, keep_first, stale

GAZETTEER = Gazetteer([
    ("CH", "Switzerland", "Switzerland; Schweiz; Suisse", "Zurich; Basel"),
    ("GB", "United Kingdom", "United Kingdom; UK; England", "London; Moorfields"),
    ("CN", "China", "China", "Beijing; Wenzhou"),
    ("TW", "Taiwan", "Taiwan", "Taipei"),
    ("AU", "Australia", "Australia", "Sydney"),
    ("KR", "Korea", "Korea; South Korea", "Seoul"),
])


def author(last, fore="", initials="", affils=(), orcid="", suffix="", oa_id=None):
    return {"last": last, "fore": fore, "initials": initials, "affils": list(affils), "orcid": orcid, "suffix": suffix, "oa_id": oa_id}


def records(spark, rows):
    """Records with the given fields; all others null."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(RECORD)
    names = [f.name for f in kind["authors"].dataType.elementType]
    full = []
    for i, row in enumerate(rows):
        row = {"rec_seq": i, "pmid": str(i), **row}
        row["authors"] = [tuple(a.get(n) for n in names) for a in row.get("authors", [])]
        full.append(tuple(row.get(n) for n in kind.names))
    return spark.createDataFrame(full, kind)


def ids(spark, rows, **options):
    got = assign_author_ids(records(spark, rows), **options).orderBy("rec_seq").collect()
    return [[a.author_id for a in r.authors] for r in got]


def test_names(spark):
    c = F.col
    rows = [("Spörl", "Theo Günter", "TG"), ("Spoerl", "D P S", "DP"), ("O'Brart", None, "AB"), ("Sinha-Roy", "", None), ("Łą", "anna-maria k.", ""), ("Zhang", "Lei Min", None), ("", "x", None), ("de Ño", "T", "TG")]
    columns = [N.surname(c("l")), N.initials(c("f"), c("i")), N.name_form(c("f"), c("i")), N.first_forename(N.forename(c("f"))), N.display_name(c("l"), c("f"), c("i"))]
    got = [tuple(r) for r in spark.createDataFrame(rows, "l string, f string, i string").select(*columns).collect()]
    assert got == [
        ("spoerl", "tg", "theo günter", "theo", "Spörl TG"), ("spoerl", "dps", ".dps", "", "Spoerl DPS"), ("obrart", "ab", ".ab", "", "O'Brart A"),
        ("sinharoy", "", ".", "", "Sinha-Roy"), ("a", "ak", "anna-maria k.", "annamaria", "Łą AK"), ("zhang", "lm", "lei min", "lei", "Zhang LM"),
        ("", "x", ".x", "", "Unknown"), ("deno", "tg", ".tg", "", "de Ño T"),
    ]
    pairs = [("theo g", "theo günter"), ("theo", "theo günter"), ("theo g.", "theo g"), ("anna b", "anna c"), ("li hua", "li h")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [tuple(r) for r in df.select(N.abbreviates(c("a"), c("b")), N.outline(c("a")) == N.outline(c("b"))).collect()] == [(True, True), (False, False), (True, True), (False, False), (True, True)]
    agree = spark.createDataFrame([("t", "tg"), ("tg", "t"), ("tg", "a")], "a string, b string").select(N.initials_agree(c("a"), c("b"))).collect()
    assert [r[0] for r in agree] == [True, True, False]
    affils = spark.createDataFrame([(["Dept, Wenzhou Medical University, China"],), (["nothing", "University of Bern"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in affils.select(N.institution_key(c("a"))).collect()] == ["wenzhou", "bern", None, None]
    both = spark.createDataFrame([("a", "b"), (None, "b"), ("bern", "of bern")], "a string, b string").select(N.institutions_conflict(c("a"), c("b"))).collect()
    assert [r[0] for r in both] == [True, False, False]
    suffix = spark.createDataFrame([("Jr.",), ("JÚNIOR",), ("Sr",), (None,)], "s string").select(N.says_junior(c("s"))).collect()
    assert [r[0] for r in suffix] == [True, True, False, False]


def test_identity(spark):
    paper = lambda *a: {"authors": list(a)}
    got = ids(spark, [
        paper(author("Meier", "Anna", "A"), author("Huber", "Bo", "B"), author("Koch", "Cy", "C")),
        paper(author("Meier", "A", "A"), author("Huber", "Bo", "B"), author("Koch", "Cy", "C")),
        paper(author("Meier", "Arno", "A")),
        paper(author("Noll", "Eva", "E", orcid="1")),
        paper(author("Frei-Noll", "Eva", "E", orcid="1")),
        paper(author("Zhang", "Lei", "L", ["Peking University"])),
        paper(author("Zhang", "Lei", "L", ["Fudan University"])),
        paper(author("Noor", "Ian", "I"), author("Noor", "I", "I")),
        paper(author("", "")),
    ])
    assert got[0][0] == got[1][0] == "Meier A" and got[2][0] != "Meier A"
    assert got[3] == got[4]
    assert got[5] == ["Zhang L (Peking)"] and got[6] == ["Zhang L (Fudan)"]
    assert got[7][0] != got[7][1] and got[8] == ["__collective__"]


def test_identity_refuses_links_in_order(spark):
    """An initials-only name can't hold two forenames together; one place of two conflicting ones takes what names none."""
    paper = lambda *a: {"authors": list(a)}
    others = (author("Huber", "Bo", "B"), author("Koch", "Cy", "C"))
    got = ids(spark, [
        paper(author("Noll", "Yan", "Y"), *others), paper(author("Noll", "Y", "Y"), *others), paper(author("Noll", "Yiran", "Y"), *others),
        paper(author("Chen", "Lu", "L", ["Fudan University"])), paper(author("Chen", "Lu", "L")), paper(author("Chen", "Lu", "L", ["Peking University"])), paper(author("Chen", "Lu", "L", ["Peking University"])),
        paper(author("Adam", "Eva", "E", orcid="7"), author("Ott", "Eva", "E", orcid="7")),
        paper(author("Zhou", "Lei", "L", ["Fudan University"], oa_id="9")), paper(author("Zhou", "Lei", "L", oa_id="9")), paper(author("Zhou", "Lei", "L", ["Peking University"], oa_id="9")),
    ])
    assert got[0][0] == got[1][0] != got[2][0]
    assert got[3] == got[4] != got[5] == got[6]
    assert got[7][0] != got[7][1]
    assert got[8] == got[9] != got[10]


def test_components_without_a_round_limit(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 2000), (5, 5)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 1000: 1000, 2000: 1000}


def test_identity_safelists(spark):
    rows = [{"authors": [author("Adler", "Paul", "P")]}, {"authors": [author("Adler", "Paul", "P", suffix="Jr")]}, {"authors": [author("Adler", "Paul", "P", suffix="Jr")]}]
    got = ids(spark, rows, safelist=Safelist(juniors=[("adler", "paul")]))
    assert got[0] != got[1] == got[2] and got[1][0].endswith("Jr")
    rows = [{"authors": [author("Roth", "Max", "M", ["Tehran University"])]}, {"authors": [author("Roth", "Max", "M", ["Basel"])]}]
    assert ids(spark, rows)[0] == ids(spark, rows)[1]
    apart = ids(spark, rows, safelist=Safelist(marked=[("roth", "max", "tehran")]))
    assert apart[0] != apart[1]


def test_countries(spark):
    cases = {
        "Univ. Hospital, Zurich, Switzerland": "Switzerland", "Moorfields; Univ, Basel, Switzerland": "Switzerland", "Sydney, New South Wales": "Australia",
        "Beijing, People's Republic of China": "China", "Taipei, Republic of China": "Taiwan", "LF UK, Seoul": "Korea", "London, UK": "United Kingdom",
        "Dept of Eye, x@y.uk": "Unknown", "": "Unknown", "Fukuoka": "Unknown",
    }
    df = spark.createDataFrame([([a],) for a in cases], "affils array<string>")
    got = {r.a: r.c for r in df.select(F.col("affils")[0].alias("a"), GAZETTEER.resolve(F.col("affils"))["country"].alias("c")).collect()}
    assert got == cases
    shown = spark.createDataFrame([("ch",), ("Schweiz",), ("Mars",)], "c string").select(GAZETTEER.display(F.col("c"))).collect()
    assert [r[0] for r in shown] == ["Switzerland", "Switzerland", "Mars"]


def test_record_countries(spark):
    rows = [{"authors": [author("A", affils=[]), author("B", affils=["Basel, Switzerland"])]}, {"authors": []}]
    got = enrich_countries(records(spark, rows), GAZETTEER).orderBy("rec_seq").collect()
    assert (got[0].country, got[0].country_source, got[0].countries_all) == ("Unknown", "no_affiliation", ["Switzerland"])
    assert (got[1].country, got[1].country_source) == ("Unknown", "no_authors")


def test_external_country(spark):
    df = spark.createDataFrame([([("Queen Hospital", "GB"), ("Sydney Eye Clinic", "AU")], ["AU", "GB"], "Queen hospital, then Sydney"), ([("X", "AU"), ("Y", "GB"), ("Z", "GB")], ["AU", "GB"], ""), ([], ["CH"], "")], "i array<struct<name: string, cc: string>>, c array<string>, t string")
    assert [r[0] for r in df.select(external_country(F.col("i"), F.col("c"), F.col("t"), ["hospital"])).collect()] == ["GB", "GB", "CH"]
    over = spark.createDataFrame([("China", "affil_country_name", "Taiwan"), ("Korea", "affil_country_name", "China"), ("Korea", "affil_city_hint", "China")], "a string, s string, e string")
    assert [r[0] for r in over.select(text_overrides(F.col("a"), F.col("s"), F.col("e"))).collect()] == [False, True, False]


def test_segments_and_institutions(spark):
    df = spark.createDataFrame([("Unit A (Roth), Bern; Unit B (Adler, Koch), Basel.", "Adler"), ("One, x@y.org; Two.", None), ("", None)], "a string, s string")
    assert [r[0] for r in df.select(attributed_segments(F.col("a"), F.col("s"))).collect()] == [["Unit B (Adler, Koch), Basel"], ["One,", "Two"], []]
    seg = spark.createDataFrame([("Department of Eyes, University of Bern, Switzerland",), ("Department of Ophthalmology",), ("a@b.c",)], "s string")
    assert [r[0] for r in seg.select(fallback_institution(F.col("s"))).collect()] == ["University of Bern", None, None]
    alias = spark.createDataFrame([("bern", "0", "Bern U", "Bern", "", "", 2, "", 0), ("university of bern", "0", "University of Bern", "", "Swiss", "", 2, "", 1), ("^uni.*bern", "1", "first tier", "", "", "", 1, "", 2)], "pattern string, is_regex string, canonical string, parent string, cluster string, country string, tier int, note string, seq int")
    texts = spark.createDataFrame([("Dept, University of Bern",), ("Univ Bern",), ("Rome",), (None,)], "t string")
    got = {r.t: r.canonical for r in joins.resolve_by_pattern(texts, "t", alias).collect()}
    assert got == {"Dept, University of Bern": "University of Bern", "Univ Bern": "first tier", "Rome": None}
    levels = alias.select("seq", *[joins.at_level(x).alias(x) for x in ("canonical", "parent", "cluster")]).orderBy("seq").collect()
    assert [r.parent if r.seq == 0 else None for r in levels][0] == "Bern"


def test_keywords(spark):
    synonyms = spark.createDataFrame([("kxl", "canon")], "variant string, canonical string")
    terms = ["  LASIK ", "Cross - linking", "Myopia", "KXL", "Dry Eyes", "uva uva", "Lenses", "queratocono", "", "naïve terms"]
    got = {r.t: r.normal for r in normalised(spark.createDataFrame([(t,) for t in terms], "t string"), "t", synonyms).collect()}
    assert got["KXL"] == "canon" and got["Myopia"] == "myopia" and got["Dry Eyes"] == "dry eye" and got["uva uva"] == "uva"
    assert got["queratocono"] == "keratoconus" and got[""] is None and got["naïve terms"] == "naive term" and got["Lenses"] == "lens"
    assert got["  LASIK "] == got["  LASIK "] and "LASIK" in got["  LASIK "]


def test_screening(spark):
    rows = [
        {"title": "LASIK in pilots", "abstract": "flight", "journal": "Aviation Medicine", "has_abstract": True},
        {"title": "Excimer of polymers", "abstract": "", "journal": "Polymer Letters"},
        {"title": "Something", "abstract": "nothing here", "journal": "Cornea"},
        {"title": "Excimer outcomes", "abstract": "visual acuity", "journal": "General Letters"},
        {"title": "Phototherapeutic keratectomy", "abstract": "excimer cornea", "journal": "Cornea"},
        {"title": "Erratum", "pub_types": ["Published Erratum"]},
        {"title": "LASIK", "abstract": "myopia", "journal": "Cornea"},
        {"title": "Wound", "abstract": "", "journal": "Letters", "mesh": ["Rhinoplasty"]},
    ]
    manual = spark.createDataFrame([("6", "exclude", "why", "me", "2020")], "pmid string, decision string, reason string, screened_by string, date string")
    done = screening.classify(records(spark, rows), manual)
    got = {r.pmid: (r.relevance.keep, r.relevance.rule) for r in done.collect()}
    assert got["0"] == (True, "keep") and got["1"] == (False, "screen.stoplist_journal.polymer") and got["2"] == (False, "content.no_procedure_signal")
    assert got["3"] == (True, "screen.non_ophth_journal_no_disease_term") and got["4"] == (False, "content.ptk_only") and got["5"] == (False, "content.notice_not_publication")
    assert got["6"] == (False, "manual.exclude") and got["7"] == (False, "screen.stoplist_mesh.rhinoplasty")
    log = screening.exclusion_log(done)
    assert {r.pmid for r in screening.screening_queue(log).collect()} == {"1", "3", "7"} and screening.tally(log).agg(F.sum("n")).first()[0] == 8 and screening.kept(done).count() == 2


def test_families_and_arms(spark):
    rows = [{"title": "a smile on the face"}, {"title": "SMILE outcomes"}, {"title": "smile", "abstract": "lenticule"}, {"title": "flex cars"}, {"title": "PRK and LASIK"}]
    got = {r.pmid: set(r.families) for r in screening.procedure_families(records(spark, rows)).collect()}
    assert got == {"0": set(), "1": {"Lenticule extraction"}, "2": {"Lenticule extraction"}, "3": set(), "4": {"LASIK", "Surface ablation"}}
    arms = screening.query_arms(records(spark, rows), [("prk", "prk"), ("any", "a|smile")], "any", ["prk"], None).orderBy("rec_seq").collect()
    assert [r.arm for r in arms][4] == "prk" and [r.arm for r in arms][0] == "any"


def test_windows(spark):
    df = spark.createDataFrame([(1990,), (2021,), (0,), (None,)], "y int")
    assert in_windows(df, "y").groupBy("window").count().where("window = 'all_time'").first()["count"] == 2
    assert in_windows(df, "y").count() == 7 and outside(df, "y", 2000, 2025).count() == 3 and window_rows()[1] == ("last_25yr", 2001, 2025)


def test_ranks_and_bradford(spark):
    df = spark.createDataFrame([("a", 30), ("b", 29), ("c", 29), ("d", 28)], "k string, v int")
    assert [r.rank for r in with_competition_rank(df, "v").orderBy(F.desc("v"), "k").collect()] == ["1", "=2", "=2", "4"]
    assert [r.k for r in top(df, 2, F.desc("v"), F.asc("k")).collect()] == ["a", "b"]
    # Running totals start again: 6 | 3 + 2 + 1 close at 6 of 18 / 3.
    zones = bradford_curve(spark.createDataFrame([("a", 6), ("b", 3), ("c", 2), ("d", 1), ("e", 1), ("f", 5)], "k string, v int"), "k", "v").orderBy("rank").collect()
    assert [(r.k, r.zone) for r in zones] == [("a", 1), ("f", 2), ("b", 2), ("c", 3), ("d", 3), ("e", 3)]
    assert {r.zone for r in bradford_curve(spark.createDataFrame([("a", 9)], "k string, v int"), "k", "v").collect()} == {1}


def test_imputation(spark):
    rows = [
        {"year": "2000", "authors": [author("A", affils=["old"])]}, {"year": "2004", "authors": [author("A", affils=["late"])]},
        {"year": "2002", "authors": [author("A")]}, {"year": "2010", "authors": [author("A")]},
    ]
    rows = records(spark, rows).withColumn("year_int", F.col("year").cast("int")).withColumn("authors", F.transform("authors", lambda a: a.withField("author_id", F.lit("A"))))
    before = rankings.authorships(rows, "rec_seq")
    after = joins.impute_affiliations(before)
    got = {r.rec_seq: (r.affils, r.affil_imputed_from) for r in after.collect()}
    assert got[2] == (["late"], 2004) and got[3][0] == []
    s = joins.imputation_summary(before, after).first()
    assert (s.author_slots_without_affiliation, s.author_slots_imputed, s.records_touched) == (2, 1, 1)


def test_joins(spark):
    rec = records(spark, [{"doi": "10.1/A", "authors": [author("A"), author("B")]}, {"doi": "10.1/b"}])
    works = spark.createDataFrame([("0", True, "W", 2000, 7, None, None, None, None, [("x", "n", None, "first", ["CH"], [("r", "Uni", "CH")])])], WORK)
    joined = {r.pmid: r for r in joins.with_works(rec, works).collect()}
    assert joined["0"].citation_count == 7 and joined["0"].authors[0].oa_id == "x" and joined["0"].authors[1].oa_id is None and joined["1"].citation_count is None
    counts = spark.createDataFrame([("10.1/a", 3)], "doi string, citations int")
    assert [r.citation_count_crossref for r in joins.with_citations(rec, counts).orderBy("pmid").collect()] == [None, None]
    assert [r.citation_count_crossref for r in joins.with_citations(rec, counts, exact_case=False).orderBy("pmid").collect()] == [3, None]
    fixed = spark.createDataFrame([("0", "A", "curated U")], "pmid string, author_id string, institution string")
    people = spark.createDataFrame([("0", "A", 0), ("1", "A", 0)], "pmid string, author_id string, pos int")
    guess = people.crossJoin(spark.createDataFrame([(0, "g", "fallback"), (1, "k", "alias")], "order int, canonical string, matched_by string")).where("pmid = '0' or order = 0")
    got = {(r.pmid, r.order): r.canonical for r in joins.correct_institutions(guess, people, fixed).collect()}
    assert got == {("0", 0): "curated U", ("0", 2): "k", ("1", 0): "g"}
    look = spark.createDataFrame([("0", 0, 2, " Uni X"), ("0", 1, 2, "Y")], "pmid string, pos int, n_authors int, affil string")
    table = spark.createDataFrame([("uni x",)], "t string").select(F.sha1(F.encode("t", "UTF-8")).alias("key"), F.lit("r").alias("ror"), F.lit("Uni X").alias("name"), F.lit("CH").alias("cc"))
    assert organisation_works(look, table).first().authors[0].place == "first"
    assert [r[0] for r in missing_keys(rec, counts.select(F.lit("10.1/A").alias("doi")), "doi").collect()] == ["10.1/b"]


def test_graphs(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "a"), (3, "d")], "k int, v string")
    assert {(r.a, r.b, r.weight) for r in graphs.edges(items, "k", "v").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    nodes, links = graphs.coauthor_network(items, "k", "v", 2)
    assert {r.v for r in nodes.collect()} == {"a", "b", "c"} and links.count() == 3
    path = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("x", "y", 2)], "a string, b string, weight int")
    assert {r.id: r.component for r in graphs.components(path).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    shown, kept = graphs.figure_graph(spark.createDataFrame([(x, 5) for x in "abcxy"], "v string, n int"), path, "v")
    assert {r.v for r in shown.collect()} == {"a", "b", "c"} and kept.count() == 2
    assert graphs.communities(path).count() == 5
    wide = graphs.wide(graphs.matrix(graphs.nodes(items, "k", "v"), graphs.edges(items, "k", "v"), "v", 2), ["a", "b"]).orderBy("name").collect()
    assert (wide[0]["b"], wide[1]["a"]) == (2, 2)


def test_statistics(spark):
    assert stats.binomial_two_sided(5, 10) == 1.0 and abs(stats.binomial_two_sided(9, 10) - 22 / 1024) < 1e-12 and stats.binomial_two_sided(0, 0) is None
    boot = stats.bootstrap_difference(spark.createDataFrame([(581, 276, 1312)], "a int, b int, o int"), 2000).first()
    assert boot.difference == 305 and 230 <= boot.ci_low <= 270 and 340 <= boot.ci_high <= 380 and boot.ahead == 1
    flat = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
    assert stats.spearman(flat, "a", "b").first().rho is None and stats.spearman(flat.limit(2), "a", "b").first().rho is None
    names = spark.createDataFrame([("Meier AB", 5), ("Huber C", 3), ("Koch D", 1)], "name string, n int")
    assert stats.rekeyed_correlation(names, names).first().rho == 1.0


def test_disagreements(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("d", "4")], "author_id string, oa_id string")
    got = {(r.author_id, r.oa_id): r.verdict for r in disagreements(df).collect()}
    assert got == {("a", "1"): "agree", ("b", "2"): "split", ("c", "2"): "split", ("d", "3"): "merged", ("d", "4"): "merged"}


XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><ISSN>1</ISSN><JournalIssue><Volume>2</Volume><PubDate><Year>2026</Year><Month>Jan</Month></PubDate></JournalIssue><Title>Eye J</Title><ISOAbbreviation>Eye</ISOAbbreviation></Journal>
<ArticleTitle>On <i>in vivo</i> H<sub>2</sub>O</ArticleTitle><ELocationID EIdType="doi">10.1/x</ELocationID>
<Abstract><AbstractText Label="AIM">Why <b>so</b>.</AbstractText><AbstractText>Then.</AbstractText></Abstract>
<AuthorList><Author><LastName>Roth</LastName><ForeName>Ada</ForeName><Initials>A</Initials><Identifier Source="ORCID">https://orcid.org/0-1</Identifier><AffiliationInfo><Affiliation>Uni <i>X</i></Affiliation></AffiliationInfo></Author><Author><LastName>Koch</LastName></Author></AuthorList>
<Language>eng</Language><GrantList><Grant><GrantID>g</GrantID></Grant></GrantList><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList>
<ArticleDate DateType="Electronic"><Year>2025</Year></ArticleDate></Article><OtherAbstract><AbstractText>Autre.</AbstractText></OtherAbstract>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">Cornea</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList Owner="NLM"><Keyword>nlm</Keyword></KeywordList><KeywordList Owner="NOTNLM"><Keyword>own <i>word</i></Keyword></KeywordList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2003 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>B</ArticleTitle><Affiliation>All of us</Affiliation><AuthorList><Author><LastName>Z</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_xml(spark, tmp_path):
    (tmp_path / "batch_1.xml").write_text(XML)
    (tmp_path / "batch_2.xml").write_text(XML.replace("<PMID>12", "<PMID>13").replace("Eye J", "Other"))
    (tmp_path / "batch_3.xml").write_text("<broken")
    got = {r.pmid: r for r in read_xml(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"11", "12", "13"}
    r = got["11"]
    assert (r.title, r.abstract, r.other_abstract, r.journal, r.doi) == ("On in vivo H2O", "AIM: Why so. Then.", "Autre.", "Eye J", "10.1/x")
    assert (r.year, r.year_issue, r.year_epub, r.month) == ("2025", "2026", "2025", "Jan") and (r.keywords, r.keywords_nlm, r.mesh_major) == (["own word"], ["nlm"], ["Cornea"])
    assert [(a.last, a.affils, a.orcid, a.affil_source) for a in r.authors] == [("Roth", ["Uni X"], "0-1", None), ("Koch", ["Uni X"], "", "propagated")]
    assert got["12"].year == "2003" and got["12"].authors[0].affil_source == "article_level" and got["11"].rec_seq < got["12"].rec_seq < got["13"].rec_seq
    assert read_xml(spark, f"file://{tmp_path}").columns == records(spark, []).columns


def test_files_and_stages(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("123\nabc\n 45 \n")
    assert sorted(r.pmid for r in read_ids(spark, f"file://{tmp_path}/ids.txt").collect()) == ["123", "45"]
    rec = records(spark, [{"title": "t"}])
    write_stage(rec, f"file://{tmp_path}/s", "raw")
    assert read_stage(spark, f"file://{tmp_path}/s", ["raw", "screened"]).first().title == "t"
    with pytest.raises(FileNotFoundError):
        read_stage(spark, f"file://{tmp_path}/s", ["other"])


def test_an_old_stage_doesnt_win(spark, tmp_path):
    """What was made from a table that was written again since is out of date."""
    at, rec = f"file://{tmp_path}/s", lambda t: records(spark, [{"title": t}])
    write_stage(rec("one"), at, "raw")
    write_stage(rec("one screened"), at, "screened", "raw")
    write_stage(rec("one enriched"), at, "enriched", "screened")
    stages = ["raw", "screened", "enriched"]
    assert read_stage(spark, at, stages).first().title == "one enriched"
    write_stage(rec("two"), at, "raw")
    assert read_stage(spark, at, stages).first().title == "two"
    write_stage(rec("two screened"), at, "screened", "raw")
    assert read_stage(spark, at, stages).first().title == "two screened"


def test_dimension_files(spark, tmp_path):
    (tmp_path / "aliases.csv").write_text('pattern,is_regex,canonical,parent,cluster,country,tier,note\n"b, c",0,Second,,,CH,2,\na,0,First,,,CH,1,"x"\n')
    got = aliases(spark, f"file://{tmp_path}/aliases.csv").orderBy("seq").collect()
    assert [(r.pattern, r.canonical, r.tier) for r in got] == [("b, c", "Second", 2), ("a", "First", 1)]
    table = gazetteer_table(spark, GAZETTEER)
    assert table.where("spelling = 'schweiz'").first().country == "Switzerland" and table.where("kind = 'hint'").count() == 9


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"end_year": 2020, "spans": [5], "recent": [2018, 2020]}')
    loaded = config.load(spark, f"file://{tmp_path}/c.json")
    assert loaded.windows() == [("all_time", 1988, 2020), ("last_5yr", 2016, 2020)] and loaded.recent == (2018, 2020) and config.load(spark, None) == config.Config()
    assert json.loads(loaded.with_values(seed=None).to_json())["seed"] == 1
    with pytest.raises(ValueError):
        loaded.with_values(colour=1)


def test_http(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "name string, n int").coalesce(1).write.option("header", True).csv(f"file://{tmp_path}/all_time/fig1")
    ran = threading.Event()
    service = serve.Service(spark, f"file://{tmp_path}", lambda argv: ran.set() or len(argv) - 1)
    httpd = serve.server(service, 0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    ask = lambda path, body=None: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", None if body is None else json.dumps(body).encode())))
    assert ask("/api/results") == {"tables": ["all_time/fig1"]} == ask("/api/figures") and ask("/api/download?name=all_time/fig1") == [{"name": "a", "n": "1"}]
    assert ask("/api/status") == {"state": "idle"} and ask("/api/run", {"argv": ["x"]}) == {"started": True} and ran.wait(10)
    assert ask("/api/validate_query", {"query": '("a" OR b)'}) == {"ok": True} and ask("/api/validate_query", {"query": "("}) == {"ok": False}
    with pytest.raises(urllib.error.HTTPError):
        ask("/api/download?name=../secret")
    httpd.shutdown()
    assert ask is not None and service.lines[0] == "start x"


def test_sensitivity_tables(spark):
    rows = [
        {"year": str(2018 + i % 4), "journal": "Cornea", "citation_count": i, "citation_count_crossref": i + 1, "keywords": ["myopia"], "pub_types": ["Review"], "pmid": str(i),
         "authors": [author("Roth", "Ada", "A", ["University of Basel, Basel, Switzerland"]), author("Koch", "Ben", "B", ["Moorfields, London, UK"])]}
        for i in range(24)
    ]
    ready = analysis.prepared(records(spark, rows), GAZETTEER, impute_within=None).persist()
    alias = spark.createDataFrame([("university of basel", "0", "University of Basel", "", "swiss", "", 1, "", 0)], "pattern string, is_regex string, canonical string, parent string, cluster string, country string, tier int, note string, seq int")
    population = spark.createDataFrame([("Switzerland", 9_000_000)], "country string, population long")
    one = spark.createDataFrame([("Koch B",)], "author_id string")
    got = sensitivity.tables(ready, alias, population, group=one, audit=one, members=(["University of Basel"], "swiss"), home=("Switzerland", "swiss"), journal_totals=spark.createDataFrame([("Cornea", 48)], "journal string, total long"), trials=spark.createDataFrame([("other", 10, 1)], "topic string, n long, trials long"))
    assert len([t for t in got if t.startswith("institutions_")]) == 18
    assert got["per_capita_without_cluster"].first().publications == 0 and got["per_capita_min20"].first().publications == 24
    assert {(r.table, r.name): r.publications for r in got["rankings_without_group"].collect()}[("records", "without author group")] == 0
    assert {(r.treatment, r.institution): r.publications for r in got["cluster_apart_and_merged"].where("scope = 'all' and counting = 'whole'").collect()} == {("separate", "University of Basel"): 24, ("merged", "swiss"): 24}
    assert got["journal_share"].first().pct == 50.0 and got["trial_share"].count() == 2 and got["identity_audit"].first().n == 24
    assert got["indicators_countries"].first().country == "Switzerland" and got["paired_sources"].first().n == 24
    ready.unpersist()


def test_modularity(spark):
    edges = [("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("x", "y", 5), ("y", "z", 5), ("x", "z", 5), ("c", "x", 1)]
    got = {r.id: r.community for r in graphs.communities(spark.createDataFrame(edges, "a string, b string, weight long")).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("xyz", "x")}
    with pytest.raises(ValueError):
        graphs.communities(spark.createDataFrame(edges, "a string, b string, weight long"), most=3)


def test_remote_stand_ins(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"doi": f"d{i}", "citations": i}) + "\n" for i in range(7)))
    register(spark)
    df = spark.read.format("citation_counts").option("path", f"{tmp_path}/c.jsonl").option("batch", 3).load()
    assert df.count() == 7 and df.agg(F.sum("citations")).first()[0] == 21
    (tmp_path / "i.jsonl").write_text("".join(json.dumps({"pmid": str(i), "year": 1988 + i % 40}) + "\n" for i in range(10_050)))
    found = spark.read.format("article_ids").option("path", f"file://{tmp_path}/i.jsonl").option("start", 1988).option("end", 2025).load()
    assert found.rdd.getNumPartitions() == 4 and found.count() == sum(i % 40 <= 37 for i in range(10_050)) and found.distinct().count() == found.count()
    assert slices(100, 1988, 2025) == [(1988, 2025)] and slices(20_000, 1988, 2025)[-1] == (2018, 2025)
    assert query_between(query_between("x", 1990, 1999), 2000, 2009) == 'x AND ("2000"[PDAT] : "2009"[PDAT])'


def test_streaming(spark, tmp_path):
    incoming, table, check = tmp_path / "in", f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    incoming.mkdir()
    put = lambda name, *rows: (incoming / name).write_text("".join(json.dumps(dict(zip(("pmid", "n", "fetched"), r, strict=True))) + "\n" for r in rows))
    run = lambda: enrich(spark, f"file://{incoming}", "pmid string, n int, fetched string", table, check).awaitTermination()
    put("a.json", ("1", 1, "2020-01-01"), ("2", 1, None))
    run()
    put("b.json", ("1", 2, "2021-01-01"), ("2", 2, "2019-01-01"))
    put("c.json", ("1", 0, "2019-01-01"))
    run()
    got = {r.pmid: r.n for r in current(spark, table).collect()}
    assert got == {"1": 2, "2": 2}
    assert [r.pmid for r in stale(current(spark, table), "pmid", "fetched", "2020-01-01").collect()] == ["2"]


def test_first_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"pmid": "1", "t": "2020-01-01T00:00:00"}\n{"pmid": "1", "t": "2020-01-01T01:00:00"}\n{"pmid": "2", "t": "2020-01-01T00:00:00"}\n')
    stream = spark.readStream.schema("pmid string, t timestamp").json(f"file://{tmp_path}/in")
    for name, first in (("plain", keep_first(stream, "pmid")), ("late", keep_first(stream, "pmid", "t"))):
        first.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.pmid for r in spark.table(name).collect()) == ["1", "2"]


def test_whole_analysis(spark, tmp_path):
    rows = [
        {"year": str(2018 + i % 4), "journal": "Cornea" if i % 2 else "Eye", "journal_abbr": "C" if i % 2 else "E", "citation_count": None if i % 5 == 0 else i, "language": "eng",
         "title": "LASIK", "keywords": ["Myopias", "KXL"], "pmid": str(i), "mesh": ["Cornea"], "pub_types": ["Review"], "has_abstract": True,
         "authors": [author("Roth", "Ada", "A", ["University of Basel, Basel, Switzerland"]), author("Koch", "Ben", "B", ["Moorfields, London, UK"] if i % 3 else [])]}
        for i in range(12)
    ]
    ready = analysis.prepared(records(spark, rows), GAZETTEER).persist()
    alias = spark.createDataFrame([("university of basel", "0", "University of Basel", "", "", "", 1, "", 0)], "pattern string, is_regex string, canonical string, parent string, cluster string, country string, tier int, note string, seq int")
    population = spark.createDataFrame([("Switzerland", 9_000_000)], "country string, population long")
    tables = analysis.run_analysis(ready, population, alias)
    authors = {r.author_id: r for r in tables["authors"].collect()}
    assert authors["Roth A"].publications == 12 and authors["Roth A"].first_author == 12 and authors["Koch B"].last_author == 12
    assert {r.institution: r.publications for r in tables["institutions"].collect()}["University of Basel"] == 12
    assert tables["institution_meta"].first().n_resolved == 12 and tables["countries"].where("country = 'Switzerland'").first().publications == 12
    assert {(r.a, r.b): r.weight for r in tables["country_edges"].collect()} == {("Switzerland", "United Kingdom"): 12}
    summary = {r.metric: r.value for r in tables["summary"].collect()}
    assert summary["Total publications"] == "12" and summary["Year range"] == "2018–2021" and summary["Unique journals"] == "2" and len(summary) == 17
    assert tables["languages"].first().language == "English"
    reports.write_reports(tables, f"file://{tmp_path}", ["temporal", "journals_top", "summary_stats", "languages"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/journals_top").count() == 2
    assert reports.markdown(reports.report(tables, "languages"), "Languages").count("|") > 5
    assert reports.figure(tables, "fig2").count() == 2 and analysis.snapshot(tables).where("metric = 'country.Switzerland.n' and value = 12").count() == 1
    windows = analysis.run_all_windows(ready)
    assert windows["comparison"].where("window = 'last_5yr'").first().total_publications == 3
    assert analysis.provenance(ready).count() > 2 and analysis.attribution(ready).count() == 12
    ready.unpersist()


def test_command_line(spark, tmp_path):
    from folio.__main__ import parser, run

    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "batch_1.xml").write_text(XML.replace("On <i>in vivo</i>", "LASIK for myopia, <i>in vivo</i>"))
    (tmp_path / "countries.csv").write_text("iso2,display_name,name_variants,city_institution_hints\nCH,Switzerland,Switzerland; Suisse,Basel\n")
    (tmp_path / "aliases.csv").write_text("pattern,is_regex,canonical,parent,cluster,country,tier,note\nuni x,0,University X,,,CH,1,\n")
    (tmp_path / "pop.csv").write_text("# comment\niso2,country,population\nCH,Switzerland,9000000\n")
    (tmp_path / "ids.txt").write_text("11\n99\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    do = lambda *argv: run(spark, parser().parse_args(argv))
    assert do("ingest", "--xml", at("xml"), "--stages", at("s")) == 0
    assert do("screen", "--stages", at("s"), "--out", at("out"), "--strict") == 0
    assert read_stage(spark, at("s"), ["screened"]).first().pmid == "11"
    assert do("enrich", "--stages", at("s"), "--countries", at("countries.csv")) == 0
    assert do("analyse", "--stages", at("s"), "--aliases", at("aliases.csv"), "--populations", at("pop.csv"), "--out", at("tables"), "--period", "last_5yr") == 0
    assert spark.read.option("header", True).csv(at("tables/last_5yr/institutions_top")).first().institution == "University X"
    assert do("delta", "--stages", at("s"), "--reference", at("ids.txt"), "--out", at("delta")) == 0
    assert {tuple(r) for r in spark.read.option("header", True).csv(at("delta")).collect()} == {("11", "unchanged"), ("99", "removed")}


def test_sums_of_prices_are_exact(spark, tmp_path):
    # As doubles the prices of each order add up to 1000 one way and to a little less the other way.
    prices = [498.09, 349.78, 152.13]
    a, b, c = prices
    assert a + b + c < 1000 == c + b + a
    lines = [(key, p) for key, order in ((1, prices), (2, prices[::-1])) for p in order]
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(k, 1, 1000.0) for k in (1, 2)], "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderdate", F.lit("1995-01-01").cast("date"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["paired_sources"](spark, str(tmp_path)).first()
    assert (got.n, got.total_a, got.total_b, got.n_a_greater) == (2, 2, 2, 0)


def test_exploded_tables_arent_broadcast(spark):
    # By its plan the table has the size of its four rows before they were exploded, which any join would broadcast.
    many = cut(spark.range(4).select(F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("id")))
    plan = many.join(many.select(F.col("id").alias("other")), F.col("id") == F.col("other"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and many.count() == 400_000


def test_groups_of_spellings_go_to_python_many_at_once(spark):
    # Group i has spellings ab, b and c (in this order of nodes): b joins ab, c stays alone.  A call for each group takes milliseconds.
    part = lambda at, name: F.struct((F.col("id") * 10 + at).alias("node"), F.lit(name).alias("last_norm"))
    rows = spark.range(3000).select(F.col("id").alias("orcid"), F.explode(F.array(part(2, "b"), part(1, "ab"), part(3, "c"))).alias("p")).select("orcid", "p.*")
    flags = {"junior": F.lit(False), "marked": F.lit(False), "place": F.lit(None).cast("string"), "common": F.lit(False), "known": F.array().cast("array<int>")}
    links = first_fit(rows.withColumns(flags), ("orcid",), "id")
    assert "FlatMapGroupsInPandas" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == [(10 * i + 2, 10 * i + 1) for i in range(3000)]


def test_names_of_one_small_file_arent_taken_apart_in_one_task(spark):
    records = spark.range(0, 4, 1, 1).select(F.col("id").alias("rec_seq"), F.lit("p").alias("pmid"), F.from_json(F.lit('[{"last": "Meier", "fore": "Anna", "initials": "A"}]'), "array<struct<last: string, fore: string, initials: string, suffix: string, affils: array<string>, orcid: string, oa_id: string>>").alias("authors"))
    plan = occurrences(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(rec_seq") == 1 and "REPARTITION_BY_COL" in plan
    assert occurrences(records).count() == 4
