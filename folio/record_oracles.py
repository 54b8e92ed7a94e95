"""DuckDB SQL for the record queries."""

from __future__ import annotations

from folio.oracles import BRANDS, JOURNALS, LINES, ORACLE, PLACES, REC, TERMS
from folio.plans import cases as C
from folio.plans.cases import outcome


def column(cases: list[tuple], at: int) -> list:
    return [c[at] for c in cases]


CODE = "'q' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"
PEOPLE = PLACES.replace("n_name AS country", "s_name AS supplier, n_name AS country")
DATED = """dated AS (
  SELECT r.*, journal, o_orderstatus, o_orderpriority, CAST(r.year AS VARCHAR) AS issue, CASE WHEN r.key % 5 = 0 THEN CAST(r.year - 1 AS VARCHAR) ELSE '' END AS epub
  FROM rec r JOIN journals j USING (key) JOIN orders ON o_orderkey = r.key)"""

ORACLE |= {
    "xml_records": f"""WITH {REC}, {LINES}, {PEOPLE}, {JOURNALS}, {BRANDS}, {TERMS}, {DATED},
a AS (SELECT key, pos, supplier, CASE WHEN (author + pos) % 3 = 0 THEN 'Institute, ' || country END AS affil FROM lines JOIN places USING (author)),
p AS (SELECT key, count(*) AS n, count(affil) AS own, arg_min(supplier, pos) AS first, coalesce(any_value(affil) FILTER (pos = 0), arg_min(affil, pos) FILTER (affil IS NOT NULL)) AS given FROM a GROUP BY key),
b AS (SELECT key, string_agg(term, '|' ORDER BY term) AS brands FROM brands GROUP BY key), t AS (SELECT key, string_agg(term, '|' ORDER BY term) AS types FROM terms GROUP BY key)
SELECT CAST(d.key AS VARCHAR) AS pmid, 'Order ' || o_orderstatus || ' of ' || coalesce(journal, '') AS title, 'AIM: ' || o_orderpriority || ' customer ' || CAST(cust AS VARCHAR) AS abstract,
  coalesce(journal, '') AS journal, left(coalesce(journal, ''), 4) AS journal_abbr, CASE WHEN epub <> '' THEN epub ELSE issue END AS year, issue AS year_issue, epub AS year_epub, '10.1/' || CAST(d.key AS VARCHAR) AS doi, 'eng' AS language,
  CAST(coalesce(n, 0) AS INT) AS n_authors, coalesce(first, '') AS first_author, coalesce(given, '') AS first_affiliation, CAST(coalesce(own, 0) AS INT) AS n_own, CAST(CASE WHEN own > 0 THEN n - own ELSE 0 END AS INT) AS n_copied,
  coalesce(brands, '') AS keywords, coalesce(types, '') AS mesh
FROM dated d LEFT JOIN p ON p.key = d.key LEFT JOIN b ON b.key = d.key LEFT JOIN t ON t.key = d.key""",
    "authorships_of_orders": f"""WITH {REC}, {LINES}, {PEOPLE}
SELECT supplier AS last, CAST(CASE WHEN key % 5 = 0 THEN year - 1 ELSE year END AS INT) AS year_int, count(*) AS n, count(*) FILTER (pos = 0) AS n_first FROM lines JOIN places USING (author) JOIN rec USING (key) GROUP BY ALL""",
    "screening_ladder": f"""SELECT doc_id, CASE WHEN doc_id % 16 = 6 THEN 'exclude' WHEN {outcome('doc_id', column(C.SCREENING, 1))} THEN 'include' ELSE 'exclude' END AS decision,
  CASE WHEN doc_id % 16 = 6 THEN 'manual.exclude' ELSE {outcome('doc_id', column(C.SCREENING, 2))} END AS rule_id, doc_id % 8 IN (1, 3, 7) AS queued FROM documents""",
    "screening_summary": f"""SELECT CASE WHEN {outcome('doc_id', column(C.SCREENING, 1))} THEN 'include' ELSE 'exclude' END AS decision, {outcome('doc_id', column(C.SCREENING, 2))} AS rule_id, count(*) AS n FROM documents GROUP BY ALL""",
    "families_in_context": f"SELECT doc_id, {outcome('doc_id', column(C.FAMILY_CASES, 2))} AS families FROM documents",
    "query_arms": f"SELECT doc_id, {outcome('doc_id', column(C.ARM_CASES, 2))} AS arm FROM documents",
    "affiliation_countries": f"SELECT c_custkey, {outcome('c_custkey', column(C.COUNTRY_CASES, 1))} AS country, {outcome('c_custkey', column(C.COUNTRY_CASES, 2))} AS source FROM customer",
    "record_countries": f"""WITH {LINES}, {PEOPLE}, a AS (SELECT key, pos, CASE WHEN pos % 2 = 0 THEN array_to_string(list_transform(string_split(lower(country), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS c FROM lines JOIN places USING (author))
SELECT key AS rec_seq, any_value(c) FILTER (pos = 0) AS country, 'affil_country_name' AS country_source, array_to_string(list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))), '|') AS countries FROM a GROUP BY key""",
    "display_countries": f"SELECT c_custkey, {outcome('c_custkey', column(C.DISPLAY_CASES, 1))} AS country FROM customer",
    "external_countries": f"SELECT c_custkey, {outcome('c_custkey', column(C.EXTERNAL_CASES, 3))} AS code FROM customer",
    "country_overrides": f"SELECT c_custkey, {outcome('c_custkey', column(C.OVERRIDE_CASES, 3))} AS overruled FROM customer",
    "affiliation_segments": f"SELECT c_custkey, {outcome('c_custkey', column(C.SEGMENT_CASES, 2))} AS segments, {outcome('c_custkey', column(C.SEGMENT_CASES, 3))} AS institution FROM customer",
    "keyword_forms": f"SELECT p_partkey, {outcome('p_partkey', column(C.KEYWORD_CASES, 1))} AS normal FROM part",
    "name_forms": "SELECT c_custkey, " + ", ".join(f"{outcome('c_custkey', column(C.NAME_CASES, k))} AS {n}" for k, n in enumerate(("surname", "initials", "form", "first", "shown"), 3)) + " FROM customer",
    "forename_agreement": f"SELECT c_custkey, {outcome('c_custkey', column(C.FORENAME_CASES, 2))} AS same, {outcome('c_custkey', column(C.FORENAME_CASES, 2))} AS outline FROM customer",
    "institution_keys": f"SELECT c_custkey, {outcome('c_custkey', column(C.PLACE_CASES, 1))} AS place FROM customer",
    "identity_of_authors": f"""SELECT name AS author_id, n AS authorships FROM (
  SELECT unnest(['Meier' || code || ' A', 'Meier' || code || ' A (#2)', 'Huber' || code || ' B', 'Koch' || code || ' C', 'Noll' || code || ' E', 'Noor' || code || ' I', 'Noor' || code || ' I (#2)']) AS name,
    unnest([2, 1, 2, 2, 2, 1, 1]) AS n FROM (SELECT {CODE} AS code FROM customer))
UNION ALL SELECT '__collective__', count(*) FROM customer""",
    "identity_disagreements": f"""WITH {LINES}, {PEOPLE}, r AS (
  SELECT CAST(author AS VARCHAR) AS author_id, CASE author % 3 WHEN 0 THEN CAST(author AS VARCHAR) WHEN 1 THEN 'b' || CAST(author // 10 AS VARCHAR) ELSE 'p' || CAST(pos % 2 AS VARCHAR) || '-' || CAST(author AS VARCHAR) END AS oa_id FROM lines JOIN places USING (author)),
g AS (SELECT author_id, oa_id, count(*) AS n FROM r GROUP BY ALL)
SELECT author_id, oa_id, n, CASE WHEN count(*) OVER (PARTITION BY author_id) = 1 AND count(*) OVER (PARTITION BY oa_id) = 1 THEN 'agree' WHEN count(*) OVER (PARTITION BY oa_id) > 1 THEN 'split' ELSE 'merged' END AS verdict FROM g""",
}
