"""DuckDB SQL for the report queries."""

from __future__ import annotations

from folio.oracles import BRANDS, COAUTH, FIRST, JOURNALS, LINES, ORACLE, PLACES, POP, REC, SCHEMES, TERMS, WIN, tied

PEOPLE = PLACES.replace("n_name AS country", "s_name AS supplier, n_name AS country")
FIGURES = f"""yr AS (SELECT year, count(*) AS n, coalesce(sum(cites), 0) AS c FROM rec GROUP BY 1),
jr AS (SELECT coalesce(nullif(journal, ''), 'Unknown') AS name, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM journals GROUP BY 1),
co AS (SELECT coalesce(country, 'Unknown') AS name, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, CAST(coalesce(sum(cites), 0) AS BIGINT) AS c FROM firsts GROUP BY 1),
cp AS (SELECT co.*, round_even(n * 1e6 / population, 2) AS rate FROM co LEFT JOIN pop ON pop.country = co.name),
pl AS (SELECT l.author, pos, cites, pos = max(pos) OVER (PARTITION BY key) AND count(*) OVER (PARTITION BY key) >= 2 AS is_last FROM lines l JOIN rec USING (key)),
au AS (SELECT CAST(author AS VARCHAR) AS name, count(*) AS n, count(*) FILTER (pos = 0) AS f, count(*) FILTER (is_last) AS l, CAST(coalesce(sum(cites), 0) AS BIGINT) AS c FROM pl GROUP BY 1 HAVING count(*) >= 3),
kw AS (SELECT term AS name, count(*) AS n FROM brands GROUP BY 1),
figures AS (
  SELECT 'Total publications' AS metric, CAST(count(*) AS VARCHAR) AS value FROM firsts
  UNION ALL SELECT 'Year range', CAST(min(year) AS VARCHAR) || '–' || CAST(max(year) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Total citations', CAST(CAST(coalesce(sum(cites), 0) AS BIGINT) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Records with citation count', CAST(count(cites) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Records without citation count', CAST(count(*) - count(cites) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Mean citations per record (known)', CAST(round_even(avg(cites), 1) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Records with resolved first-author country', CAST(count(country) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Records with unresolved first-author country', CAST(count(*) - count(country) AS VARCHAR) FROM firsts
  UNION ALL SELECT 'Peak publication year', CAST(arg_min(year, (-n, year)) AS VARCHAR) FROM yr
  UNION ALL SELECT 'Unique journals', CAST(count(*) AS VARCHAR) FROM jr
  UNION ALL SELECT 'Unique countries', CAST(count(*) AS VARCHAR) FROM co WHERE name <> 'Unknown'
  UNION ALL SELECT 'Unique authors (≥min pubs)', CAST(count(*) AS VARCHAR) FROM au
  UNION ALL SELECT 'Unique keywords', CAST(count(*) AS VARCHAR) FROM kw)"""
BASES = f"WITH {REC}, {LINES}, {PLACES}, {FIRST}, {JOURNALS}, {BRANDS}, {POP}, {FIGURES}"


def numbers(table: str, prefix: str, columns: dict[str, str], k: int = 5) -> str:
    first = "n DESC, name"
    return " UNION ALL ".join(f"SELECT '{prefix}.' || name || '{end}', regexp_replace(CAST(CAST({c} AS DECIMAL(30, 6)) AS VARCHAR), '[.]?0+$', '') FROM (SELECT * FROM {table} ORDER BY {first} LIMIT {k}) WHERE {c} IS NOT NULL" for end, c in columns.items())


SHARE = "SELECT {0}, n, total, CASE WHEN total > 0 THEN round_even(100.0 * n / total, 2) END AS pct"
OUTSIDE = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS parsed, count(*) FILTER (o_orderkey % 10 <> 0) AS external FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 10 <> 0) > 0)"""
CHAIN = """WITH RECURSIVE c AS (SELECT c_custkey, c_nationkey, floor(c_acctbal) AS b FROM customer),
e AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM c x JOIN c y ON x.c_nationkey = y.c_nationkey AND x.b = y.b + 1),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS other FROM both_ UNION SELECT r.id, both_.b FROM reach r JOIN both_ ON both_.a = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY id"""

ORACLE |= {
    "summary_metrics": f"{BASES} SELECT metric, value FROM figures",
    "snapshot_metrics": f"""{BASES} SELECT 'summary.' || metric AS metric, value FROM figures
UNION ALL SELECT 'year.' || CAST(year AS VARCHAR), CAST(n AS VARCHAR) FROM yr UNION ALL SELECT 'year.' || CAST(year AS VARCHAR) || '.citations', CAST(CAST(c AS BIGINT) AS VARCHAR) FROM yr
UNION ALL {numbers('jr', 'journal', {'.n': 'n', '.pct': 'pct'})}
UNION ALL {numbers('cp', 'country', {'.n': 'n', '.pct': 'pct', '.cites': 'c', '.per_million': 'rate'})}
UNION ALL {numbers('au', 'author', {'.n': 'n', '.first': 'f', '.last': 'l', '.cites': 'c'})}
UNION ALL {numbers('kw', 'keyword', {'.n': 'n'})}
UNION ALL SELECT 'n_temporal', CAST(count(*) AS VARCHAR) FROM yr UNION ALL SELECT 'n_journals', CAST(count(*) AS VARCHAR) FROM jr UNION ALL SELECT 'n_countries', CAST(count(*) AS VARCHAR) FROM co
UNION ALL SELECT 'n_authors', CAST(count(*) AS VARCHAR) FROM au UNION ALL SELECT 'n_keywords', CAST(count(*) AS VARCHAR) FROM kw""",
    "window_columns": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, {JOURNALS}, {WIN.replace('FROM rec JOIN', 'FROM (SELECT firsts.*, journal FROM firsts JOIN journals USING (key)) JOIN')},
h AS (SELECT "window", max(least(cites, r)) AS h FROM (SELECT "window", cites, row_number() OVER (PARTITION BY "window" ORDER BY cites DESC) AS r FROM cut WHERE cites > 0) GROUP BY 1),
p AS (SELECT "window", count(*) AS people FROM (SELECT "window", author FROM cut JOIN (SELECT DISTINCT key, author FROM lines) USING (key) GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1)
SELECT "window", win_start, win_end, count(*) AS total_publications, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total_citations, count(cites) AS records_with_citation_count, count(*) FILTER (cites IS NULL) AS records_without_citation_count,
  round_even(avg(cites), 1) AS mean_cites_per_pub, count(*) FILTER (country IS NULL) AS records_country_unresolved, count(DISTINCT journal) AS unique_journals, count(DISTINCT country) AS unique_countries,
  CAST(coalesce(any_value(people), 0) AS BIGINT) AS unique_authors, CAST(coalesce(any_value(h), 0) AS BIGINT) AS h_index_field
FROM cut LEFT JOIN h USING ("window") LEFT JOIN p USING ("window") GROUP BY 1, 2, 3""",
    "per_capita_without_cluster": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, {POP}, n AS (SELECT count(*) AS n FROM firsts f LEFT JOIN lines l ON l.key = f.key AND l.pos = 0 WHERE f.country = 'FRANCE' AND l.author % 2 <> 0)
SELECT n AS publications, 'FRANCE excluding even' AS country, population, round_even(n * 1e6 / population, 2) AS pubs_per_million, '' AS rank FROM n, pop WHERE country = 'FRANCE'""",
    "provenance_counts": """SELECT 'n_corpus' AS metric, CAST(count(*) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'n_matched', CAST(count(*) FILTER (o_orderkey % 3 = 0) AS VARCHAR) FROM orders UNION ALL SELECT 'n_unmatched', CAST(count(*) FILTER (o_orderkey % 3 <> 0) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_no_doi', CAST(count(*) FILTER (o_orderkey % 5 = 0) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_citation_count_known', CAST(count(*) FILTER (o_orderkey % 7 <> 0) AS VARCHAR) FROM orders UNION ALL SELECT 'n_citation_count_null', CAST(count(*) FILTER (o_orderkey % 7 = 0) AS VARCHAR) FROM orders
UNION ALL SELECT 'citation_source=' || CASE WHEN o_orderkey % 3 = 0 THEN 'works' ELSE 'none' END, CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1
UNION ALL SELECT 'country_source=' || o_orderpriority, CAST(count(*) AS VARCHAR) FROM orders GROUP BY 1
UNION ALL SELECT 'fetched_month=' || strftime(o_orderdate, '%Y-%m'), CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1""",
    "journal_share": f"WITH {REC}, {JOURNALS}, t AS (SELECT journal, count(*) AS total, count(*) FILTER (year = 1998) AS n FROM journals GROUP BY 1) {SHARE.format('journal')} FROM t WHERE n > 0 AND journal IS NOT NULL",
    "trial_share": """WITH t AS (SELECT o_orderstatus AS topic, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS trials FROM orders GROUP BY 1), a AS (SELECT 'corpus' AS topic, CAST(sum(n) AS BIGINT) AS n, CAST(sum(trials) AS BIGINT) AS trials FROM t UNION ALL FROM t)
SELECT *, CASE WHEN n > 0 THEN round_even(100.0 * trials / n, 2) END AS pct FROM a""",
    "external_counts": f"WITH {OUTSIDE} SELECT key, external, parsed, parsed - external AS difference FROM o",
    "external_within": f"WITH {OUTSIDE} SELECT count(*) AS n, count(*) FILTER (parsed = external) AS identical, count(*) FILTER (abs(parsed - external) <= 2) AS within FROM o",
    "identity_audit": f"""WITH {REC}, {LINES}, {PLACES}, r AS (SELECT CAST(author AS VARCHAR) AS author_id, year, country, region, 'W' || CAST(part % 3 AS VARCHAR) AS oa FROM lines JOIN places USING (author) JOIN rec USING (key) WHERE author % 10 = 1),
b AS (SELECT author_id, count(*) AS n, min(year) AS year_first, max(year) AS year_last, least(country, region) AS lo, greatest(country, region) AS hi FROM r GROUP BY author_id, country, region),
i AS (SELECT author_id, oa, count(*) AS c FROM r GROUP BY 1, 2), j AS (SELECT author_id, string_agg(oa || ' ×' || CAST(c AS VARCHAR), '; ' ORDER BY c DESC, oa) AS ids, count(*) AS k FROM i GROUP BY 1)
SELECT b.author_id, n, year_first, year_last, '0-1' AS orcids, lo || ' ×' || CAST(n AS VARCHAR) || '; ' || hi || ' ×' || CAST(n AS VARCHAR) AS affiliations, ids AS external_ids, k AS n_external_ids FROM b JOIN j USING (author_id)""",
    "works_by_position": f"""WITH {REC}, {LINES}, p AS (SELECT key, count(*) AS n, min(author) FILTER (pos = 0) AS first FROM lines GROUP BY key)
SELECT CAST(key AS VARCHAR) AS pmid, CAST(CASE WHEN key % 3 <> 0 THEN coalesce(cites, 0) ELSE 1 END AS INT) AS citation_count, CASE WHEN key % 3 <> 0 THEN 'works' ELSE 'crossref' END AS citation_source, key % 3 <> 0 AS oa_matched,
  CAST(CASE WHEN key % 3 <> 0 THEN least(n, 2) ELSE 0 END AS INT) AS n_ids, CASE WHEN key % 3 <> 0 THEN 'A' || CAST(first AS VARCHAR) ELSE '' END AS first_id FROM p JOIN rec USING (key)""",
    "citations_by_doi": f"WITH {REC}, m AS (SELECT cust, max(cites) AS m FROM rec GROUP BY 1) SELECT key, CASE WHEN key % 4 <> 0 THEN m END AS citation_count_crossref FROM rec JOIN m USING (cust)",
    "organisations_of_affiliations": f"""WITH {LINES}, {PLACES}, a AS (SELECT key, pos, country, count(*) OVER (PARTITION BY key) AS n FROM lines JOIN places USING (author))
SELECT CAST(key AS VARCHAR) AS pmid, CAST(count(*) AS INT) AS n, string_agg(CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' ELSE 'middle' END, ',' ORDER BY pos) AS places, string_agg(country, ',' ORDER BY pos) AS names
FROM a JOIN nation ON n_name = country WHERE n_nationkey % 2 = 0 GROUP BY key""",
    "missing_work": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doi FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
    "curated_institutions": f"""WITH {LINES}, {PLACES}, p AS (SELECT key, pos, author, country, region FROM lines JOIN places USING (author)),
f AS (SELECT DISTINCT key, author, region FROM p WHERE pos = 1 AND key % 10 = 0), j AS (SELECT p.*, f.region IS NOT NULL AS fixed, CASE WHEN f.region = 'ASIA' THEN 2 ELSE 1 END AS k FROM p LEFT JOIN f ON f.key = p.key AND f.author = p.author),
u AS (SELECT country AS canonical, CASE WHEN fixed THEN k ELSE 0 END AS "order", CASE WHEN pos % 2 = 0 THEN 'alias' ELSE 'fallback' END AS matched_by FROM j WHERE NOT fixed OR pos % 2 = 0
  UNION ALL SELECT 'Curated A', 0, 'curated' FROM j WHERE fixed UNION ALL SELECT 'Curated B', 1, 'curated' FROM j WHERE fixed AND k = 2)
SELECT canonical, CAST("order" AS INT) AS "order", matched_by, count(*) AS n FROM u GROUP BY ALL""",
    "runs_compared": f"""WITH {LINES}, c AS (SELECT CAST(author AS VARCHAR) AS label, CAST(author % 7 + pos % 2 AS VARCHAR) AS other, count(*) AS shared FROM lines GROUP BY 1, 2)
SELECT label, CAST(sum(shared) OVER (PARTITION BY label) AS BIGINT) AS n, other, shared FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY shared DESC, other) = 1""",
    "unknown_as_zero": f"WITH {REC} SELECT cust, round_even(avg(cites), 6) AS m FROM rec GROUP BY cust ORDER BY coalesce(avg(cites), 0) DESC, cust LIMIT 200",
    "comparable_journals": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim(lower(p_name)) ELSE lower(p_name || '.' || p_brand || ')') END AS name FROM part",
    "sources_side_by_side": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, a AS (SELECT country AS ours, count(*) AS n_ours, row_number() OVER (ORDER BY count(*) DESC, country) AS rank FROM lines JOIN places USING (author) GROUP BY 1),
b AS (SELECT country AS theirs, count(*) AS n_theirs, row_number() OVER (ORDER BY count(*) DESC, country) AS rank FROM firsts WHERE country IS NOT NULL GROUP BY 1)
SELECT CAST(coalesce(a.rank, b.rank) AS INT) AS rank, ours, n_ours, theirs, n_theirs FROM (FROM a WHERE rank <= 10) a FULL JOIN (FROM b WHERE rank <= 10) b ON a.rank = b.rank""",
    "countries_side_by_side": f"""WITH s AS ({SCHEMES}), r AS (SELECT scheme, country, publications, {tied('publications', 'scheme, ')} AS rank FROM s), f AS (SELECT * FROM r WHERE scheme = 'first' ORDER BY publications DESC, country LIMIT 10)
SELECT f.country, f.publications AS "first", f.rank AS rank_first, w.publications AS whole, w.rank AS rank_whole, x.publications AS fractional, x.rank AS rank_fractional
FROM f LEFT JOIN (SELECT * FROM r WHERE scheme = 'whole') w USING (country) LEFT JOIN (SELECT * FROM r WHERE scheme = 'fractional') x USING (country)""",
    "cluster_apart_and_merged": f"""WITH {LINES}, {PLACES}, p AS (SELECT key, pos, country, region FROM lines JOIN places USING (author)),
u AS (SELECT 'separate' AS treatment, country AS institution, key, pos FROM p WHERE country IN ('FRANCE', 'GERMANY') UNION ALL SELECT 'merged', region, key, pos FROM p WHERE region = 'EUROPE'),
v AS (SELECT treatment, institution, count(DISTINCT key) AS a, count(DISTINCT key) FILTER (pos = 0) AS f FROM u GROUP BY 1, 2)
SELECT scope, counting, treatment, institution, CAST(CASE WHEN scope = 'first' THEN f ELSE a END AS DOUBLE) AS publications FROM v, (VALUES ('first'), ('all')) s(scope), (VALUES ('primary'), ('whole')) c(counting) WHERE scope = 'all' OR f > 0""",
    "trends_from_a_floor": f"""WITH {REC}, {TERMS}, d AS (SELECT year, count(t.key) AS d FROM rec LEFT JOIN (SELECT DISTINCT key FROM terms) t USING (key) GROUP BY year), h AS (SELECT year, term, count(*) AS n FROM terms JOIN rec USING (key) GROUP BY ALL)
SELECT d.year, w.term, coalesce(n, 0) AS n, CASE WHEN d > 0 THEN round_even(coalesce(n, 0) / d, 4) END AS share FROM d CROSS JOIN (SELECT DISTINCT term FROM terms ORDER BY term LIMIT 10) w LEFT JOIN h ON h.year = d.year AND h.term = w.term
WHERE d.year >= (SELECT min(year) FROM d WHERE year > 1992 AND d >= 100)""",
    "chain_components": CHAIN,
    "figure_components": COAUTH.replace("WITH ", "WITH RECURSIVE ", 1).replace("LIMIT 10", "LIMIT 30").replace("count(*) >= 10", "count(*) >= 30") + """, inner_ AS (SELECT * FROM kept WHERE weight >= 3 AND a IN (SELECT author FROM best) AND b IN (SELECT author FROM best)),
both_ AS (SELECT a, b FROM inner_ UNION SELECT b, a FROM inner_), reach AS (SELECT a AS id, a AS other FROM both_ UNION SELECT r.id, both_.b FROM reach r JOIN both_ ON both_.a = r.other),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT author, n, component FROM best JOIN c ON id = author WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 2)""",
    "surnames_in_sql": "SELECT n_nationkey, 'mue' || replace(lower(n_name), ' ', '') || 'eo' AS surname FROM nation",
    "affiliations_in_sql": """SELECT r_name, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'A continent' WHEN r_name = 'EUROPE' THEN 'Europe' END AS canonical, CASE WHEN r_name = 'EUROPE' THEN 'World' WHEN r_name IN ('ASIA', 'AFRICA') THEN '' END AS cluster,
  CASE WHEN r_name IN ('ASIA', 'AFRICA', 'EUROPE') THEN 'alias' ELSE 'unresolved' END AS matched_by, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 1 WHEN r_name = 'EUROPE' THEN 2 END AS tier FROM region""",
    "bradford_of_suppliers": """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank, count(*) AS n FROM lineitem GROUP BY l_suppkey), t AS (SELECT max(rank) AS last, sum(n) AS total FROM r),
w AS (SELECT rank, n, n AS cum, 1 AS zone, CASE WHEN n >= total / 5.0 AND rank < last THEN 0 ELSE n END AS run, CASE WHEN n >= total / 5.0 AND rank < last THEN 1 ELSE 0 END AS closed FROM r, t WHERE rank = 1
  UNION ALL SELECT r.rank, r.n, w.cum + r.n, w.zone + w.closed, CASE WHEN w.run + r.n >= total / 5.0 AND r.rank < last AND w.zone + w.closed < 5 THEN 0 ELSE w.run + r.n END, CASE WHEN w.run + r.n >= total / 5.0 AND r.rank < last AND w.zone + w.closed < 5 THEN 1 ELSE 0 END
  FROM w JOIN r ON r.rank = w.rank + 1, t)
SELECT CAST(zone AS INT) AS zone, count(*) AS names, CAST(max(cum) AS BIGINT) AS cumulative FROM w GROUP BY zone""",
    "record_attribution": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST} SELECT CAST(key AS VARCHAR) AS pmid, CAST(year AS VARCHAR) AS year, country, 'affil' AS country_source, coalesce(country, 'Unknown') || '|X' AS countries_all, cites AS citation_count, 'works' AS citation_source, key % 2 = 0 AS oa_matched FROM firsts""",
}
