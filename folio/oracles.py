"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from folio.queries import ALIASES, FAMILIES, RULES, WINDOWS

REC = """rec AS (
  SELECT o_orderkey AS key, o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS year,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(trunc(o_totalprice / 1000) AS INT) END AS cites FROM orders)"""
LINES = """lines AS (
  SELECT l_orderkey AS key, l_suppkey AS author, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) - 1 AS pos
  FROM lineitem)"""
PLACES = """places AS (
  SELECT s_suppkey AS author, n_name AS country, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FIRST = """firsts AS (
  SELECT r.*, p.country FROM rec r LEFT JOIN lines l ON l.key = r.key AND l.pos = 0 LEFT JOIN places p ON p.author = l.author)"""
TERMS = """terms AS (SELECT DISTINCT l_orderkey AS key, p_type AS term FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BRANDS = """brands AS (SELECT DISTINCT l_orderkey AS key, p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey)"""
JOURNALS = """journals AS (SELECT r.*, c_mktsegment AS journal FROM rec r LEFT JOIN customer ON cust = c_custkey)"""
POP = """pop AS (SELECT n_name AS country, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""
WIN = "win AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in WINDOWS) + ") t(\"window\", win_start, win_end)), cut AS (SELECT * FROM rec JOIN win ON year BETWEEN win_start AND win_end)"
PARTS = """ranked AS (
  SELECT l_partkey AS name, count(*) AS n FROM lineitem GROUP BY 1),
curve AS (
  SELECT row_number() OVER w AS rank, name, n, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM ranked WINDOW w AS (ORDER BY n DESC, name)),
whole AS (SELECT max(rank) AS last, max(cumulative) AS total FROM curve),
cut1 AS (SELECT min(rank) AS r, min(cumulative) AS s FROM curve, whole WHERE cumulative >= total / 3.0 AND rank < last),
cut2 AS (SELECT min(rank) AS r FROM curve, whole, cut1 WHERE cumulative - s >= total / 3.0 AND rank < last),
zoned AS (
  SELECT curve.*, round_even(100.0 * cumulative / total, 4) AS cumulative_pct, CAST(1 + coalesce(CAST(rank > cut1.r AS INT), 0) + coalesce(CAST(rank > cut2.r AS INT), 0) AS INT) AS zone
  FROM curve, whole, cut1, cut2)"""
SUMMARY = """count(cites) AS n_cited_known, count(*) FILTER (cites IS NULL) AS n_cite_null, CAST(coalesce(sum(cites), 0) AS BIGINT) AS citation_total,
    round_even(avg(cites), 1) AS citations_mean, round_even(quantile_cont(cites, 0.5), 1) AS citations_median, round_even(quantile_cont(cites, 0.25), 1) AS citations_q1, round_even(quantile_cont(cites, 0.75), 1) AS citations_q3"""


def tied(value: str, over: str = "") -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY {over}{value}) > 1 THEN '=' ELSE '' END || CAST(rank() OVER ({'PARTITION BY ' + over.rstrip(', ') + ' ' if over else ''}ORDER BY {value} DESC) AS VARCHAR)"


RULE = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}', 'i') THEN '{r}'" for r, p, *_ in RULES) + " END"
FAMILY = {n: f"regexp_matches(lower(text), '{p}')" for n, p in FAMILIES.items()}
TOKENS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '([a-z]{{4,}})', 1))"
COLLAB = "SELECT a.country AS a, b.country AS b, count(*) AS weight FROM pc a JOIN pc b ON a.key = b.key AND a.country < b.country GROUP BY 1, 2"
PC = "pc AS (SELECT DISTINCT key, country FROM lines JOIN places USING (author))"
COAUTH = f"""WITH {LINES}, pa AS (SELECT DISTINCT key, author FROM lines), n AS (SELECT author, count(*) AS n FROM pa GROUP BY 1),
best AS (SELECT * FROM n ORDER BY n DESC, author LIMIT 10),
floor_ AS (SELECT CASE WHEN count(*) >= 10 THEN greatest(1, min(n) // 3) ELSE 1 END AS f FROM best),
e AS (SELECT a.author AS a, b.author AS b, count(*) AS weight FROM pa a JOIN pa b ON a.key = b.key AND a.author < b.author GROUP BY 1, 2),
kept AS (SELECT e.* FROM e JOIN n x ON x.author = e.a JOIN n y ON y.author = e.b, floor_ WHERE x.n >= f AND y.n >= f AND (a IN (SELECT author FROM best) OR b IN (SELECT author FROM best)))
"""
SCHEMES = f"""WITH {REC}, {LINES}, {PLACES}, pl AS (SELECT key, pos, country FROM lines JOIN places USING (author)),
v AS (
  SELECT 'first' AS scheme, country, CAST(count(*) AS DOUBLE) AS v FROM pl WHERE pos = 0 GROUP BY ALL
  UNION ALL SELECT 'whole', country, CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT key, country FROM pl) GROUP BY ALL
  UNION ALL SELECT 'fractional', country, sum(w) FROM (SELECT country, count(*) / sum(count(*)) OVER (PARTITION BY key) AS w FROM pl GROUP BY key, country) GROUP BY ALL)
SELECT scheme, country, round_even(v, 2) AS publications, round_even(100 * v / sum(v) OVER (PARTITION BY scheme), 2) AS pct FROM v"""
_INST = []
for _level, _column in (("canonical", "supplier"), ("parent", "country"), ("cluster", "region")):
    for _scope in ("first", "all"):
        for _counting in ("primary", "whole", "fractional"):
            _w = "1.0 / count(*) OVER (PARTITION BY key, pos)" if _counting == "fractional" else "1.0"
            _where = " AND ".join([f"{_column} IS NOT NULL", *(["pos = 0"] if _scope == "first" else []), *(["ord = 0"] if _counting == "primary" else [])])
            _digits = 2 if _counting == "fractional" else 0
            _INST.append(f"""SELECT '{_level}' AS level, name AS institution, '{_scope}' AS scope, '{_counting}' AS counting, round_even(sum(w), {_digits}) AS publications,
  CAST(round_even(coalesce(sum(w * c), 0), 0) AS BIGINT) AS citations, count(c) AS n_cited_known
FROM (SELECT key, name, max(w) AS w, max(cites) AS c FROM (SELECT *, {_column} AS name, CAST({_w} AS DOUBLE) AS w FROM two WHERE {_where}) WHERE length(name) >= 4 GROUP BY key, name) GROUP BY name""")
INSTITUTIONS = f"""WITH {REC}, {LINES}, {PLACES.replace('n_name AS country', 's_name AS supplier, n_name AS country')}, pl AS (SELECT key, pos, cites, 0 AS ord, supplier, country, region FROM lines JOIN places USING (author) JOIN rec USING (key)),
two AS (SELECT * FROM pl UNION ALL SELECT key, pos, cites, 1, 'Shared laboratory', NULL, 'Shared laboratory' FROM pl WHERE pos % 4 = 1) """ + " UNION ALL ".join(_INST)
MIDRANKS = """rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"""
WILSON = "round_even((k / n + 3.8416 / (2 * n) {0} 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 4)"

ORACLE: dict[str, str] = {
    "temporal_trends": f"""WITH {REC}, per AS (
  SELECT year, count(*) AS publications, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total_citations, count(*) FILTER (cites IS NULL) AS n_cite_null,
    round_even(avg(cites), 1) AS citations_mean, round_even(quantile_cont(cites, 0.5), 1) AS citations_median FROM rec WHERE year IS NOT NULL GROUP BY year)
SELECT *, CAST(sum(publications) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative,
  round_even(avg(publications) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 1) AS moving_avg_3yr FROM per""",
    "nested_windows": f"""WITH {REC}, {WIN}, h AS (
  SELECT "window", max(least(cites, r)) AS h FROM (SELECT "window", cites, row_number() OVER (PARTITION BY "window" ORDER BY cites DESC) AS r FROM cut WHERE cites > 0) GROUP BY 1)
SELECT "window", win_start, win_end, count(*) AS total_publications, CAST(coalesce(sum(cites), 0) AS BIGINT) AS total_citations, count(cites) AS records_with_citation_count,
  count(*) FILTER (cites IS NULL) AS records_without_citation_count, round_even(avg(cites), 1) AS mean_cites_per_pub, count(DISTINCT cust) AS unique_customers, CAST(coalesce(any_value(h), 0) AS BIGINT) AS h_index_field
FROM cut LEFT JOIN h USING ("window") GROUP BY 1, 2, 3""",
    "outside_window": f"WITH {REC} SELECT year, count(*) AS n FROM rec WHERE NOT coalesce(year BETWEEN 1996 AND 1998, false) GROUP BY year",
    "field_h_index": f"""WITH {REC}, {WIN}
SELECT "window", CAST(max(least(cites, r)) AS BIGINT) AS h_index FROM (SELECT "window", cites, row_number() OVER (PARTITION BY "window" ORDER BY cites DESC) AS r FROM cut WHERE cites > 0) GROUP BY 1""",
    "peak_year": f"WITH {REC} SELECT year AS peak_year, count(*) AS publications FROM rec GROUP BY year ORDER BY 2 DESC, 1 LIMIT 1",
    "journal_stats": f"""WITH {REC}, {JOURNALS}
SELECT coalesce(nullif(journal, ''), 'Unknown') AS journal, count(*) AS publications, {SUMMARY}, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM journals GROUP BY 1""",
    "journals_top": f"""WITH {REC}, {JOURNALS}, per AS (SELECT journal, count(*) AS publications, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM journals GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY publications DESC, journal) AS INT) AS rank FROM per ORDER BY publications DESC, journal LIMIT 3""",
    "author_stats": f"""WITH {REC}, {LINES}, {JOURNALS}, placed AS (
  SELECT l.author, pos, year, cites, journal, pos = max(pos) OVER (PARTITION BY key) AND count(*) OVER (PARTITION BY key) >= 2 AS is_last FROM lines l JOIN journals USING (key))
SELECT CAST(author AS VARCHAR) AS author, count(*) AS publications, count(*) FILTER (pos = 0) AS first_author, count(*) FILTER (is_last) AS last_author, {SUMMARY},
  min(year) AS year_first, max(year) AS year_last, count(DISTINCT year) AS years_active, count(DISTINCT journal) AS journal_count,
  least(CAST(round_even(sqrt(coalesce(sum(cites), 0) * 0.5), 0) AS BIGINT), count(*)) AS h_index_estimate
FROM placed GROUP BY placed.author HAVING count(*) >= 3""",
    "h_estimate_by_author": f"WITH {REC}, {LINES} SELECT author, count(*) AS n, least(CAST(round_even(sqrt(coalesce(sum(cites), 0) * 0.5), 0) AS BIGINT), count(*)) AS h_index_estimate FROM lines JOIN rec USING (key) GROUP BY author",
    "country_stats": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, {POP}, per AS (SELECT coalesce(country, 'Unknown') AS country, count(*) AS publications, {SUMMARY} FROM firsts GROUP BY 1),
r AS (SELECT country, {tied('publications')} AS rank, round_even(100.0 * publications / sum(publications) OVER (), 2) AS pct_of_resolved FROM per WHERE country <> 'Unknown')
SELECT per.*, round_even(100.0 * publications / sum(publications) OVER (), 2) AS percentage, pct_of_resolved, rank, population, round_even(publications * 1e6 / population, 2) AS pubs_per_million, round_even(citation_total * 1e6 / population, 1) AS cites_per_million
FROM per LEFT JOIN r USING (country) LEFT JOIN pop USING (country)""",
    "per_capita": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, {POP}, rated AS (
  SELECT country, count(*) AS publications, any_value(population) AS population, round_even(count(*) * 1e6 / any_value(population), 2) AS pubs_per_million FROM firsts JOIN pop USING (country) GROUP BY country HAVING count(*) >= 20)
SELECT *, {tied('pubs_per_million')} AS rank FROM rated""",
    "country_schemes": SCHEMES,
    "institution_schemes": INSTITUTIONS,
    "bradford_curve_of_parts": f"WITH {PARTS} SELECT CAST(rank AS INT) AS rank, name, n, cumulative, cumulative_pct, zone FROM zoned",
    "bradford_zones_of_parts": f"""WITH {PARTS}, per AS (SELECT zone, count(*) AS names, CAST(sum(n) AS BIGINT) AS publications FROM zoned GROUP BY 1)
SELECT *, round_even(100.0 * publications / sum(publications) OVER (), 2) AS publication_pct, round_even(names / lag(names) OVER (ORDER BY zone), 2) AS multiplier FROM per""",
    "keyword_frequency": f"WITH {BRANDS} SELECT term, count(*) AS n FROM brands GROUP BY term HAVING count(*) >= 20",
    "keyword_cooccurrence": f"""WITH {BRANDS}, f AS (SELECT term FROM brands GROUP BY term HAVING count(*) >= 20), b AS (SELECT * FROM brands WHERE term IN (FROM f))
SELECT x.term AS a, y.term AS b, count(*) AS weight FROM b x JOIN b y ON x.key = y.key AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 20""",
    "keyword_coverage": f"""WITH {REC}, {TERMS} SELECT year, count(*) AS n_records, count(t.key) AS n_with_keywords, round_even(100.0 * count(t.key) / count(*), 1) AS pct
FROM rec LEFT JOIN (SELECT DISTINCT key FROM terms) t USING (key) GROUP BY year""",
    "keyword_trends": f"""WITH {REC}, {TERMS}, d AS (SELECT year, count(t.key) AS d FROM rec LEFT JOIN (SELECT DISTINCT key FROM terms) t USING (key) GROUP BY year),
h AS (SELECT year, term, count(*) AS n FROM terms JOIN rec USING (key) GROUP BY ALL)
SELECT d.year, w.term, coalesce(n, 0) AS n, CASE WHEN d > 0 THEN round_even(coalesce(n, 0) / d, 4) END AS share FROM d CROSS JOIN (SELECT DISTINCT term FROM terms) w LEFT JOIN h ON h.year = d.year AND h.term = w.term""",
    "country_collaboration": f"WITH {LINES}, {PLACES}, {PC} {COLLAB}",
    "coauthor_network": f"{COAUTH} SELECT * FROM kept",
    "coauthor_nodes": f"{COAUTH} SELECT author, n FROM n WHERE author IN (SELECT a FROM kept UNION SELECT b FROM kept UNION SELECT author FROM best)",
    "collaboration_matrix": f"""WITH {LINES}, {PLACES}, {PC}, best AS (SELECT country FROM pc GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 10), e AS ({COLLAB})
SELECT a, b, weight FROM e WHERE a IN (FROM best) AND b IN (FROM best) UNION ALL SELECT b, a, weight FROM e WHERE a IN (FROM best) AND b IN (FROM best)""",
    "authors_by_country": f"WITH {LINES}, {PLACES} SELECT country, count(DISTINCT author) AS authors FROM lines JOIN places USING (author) GROUP BY 1",
    "year_means": f"WITH {REC} SELECT year, count(*) AS n, round_even(avg(cites), 6) AS year_mean FROM rec WHERE cites IS NOT NULL GROUP BY year",
    "citation_indicators": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, m AS (SELECT year, avg(cites) AS year_mean FROM rec WHERE cites IS NOT NULL GROUP BY year),
k AS (SELECT country, year, cites, CASE WHEN year_mean > 0 THEN cites / year_mean END AS ratio, CASE WHEN year BETWEEN 1995 AND 1997 THEN cites END AS w FROM firsts JOIN m USING (year) WHERE country IS NOT NULL AND cites IS NOT NULL)
SELECT country, count(*) AS n, round_even(avg(ratio), 3) AS mncs, round_even(quantile_cont(ratio, 0.5), 3) AS median_normalised, count(w) AS n_window, round_even(avg(w), 2) AS window_mean, round_even(quantile_cont(w, 0.5), 1) AS window_median
FROM k GROUP BY country HAVING count(*) >= 20""",
    "competition_rank": f"WITH per AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT *, {tied('n')} AS rank FROM per",
    "mid_rank": f"WITH per AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT *, CAST({MIDRANKS.format('n')} AS DOUBLE) AS mid_rank FROM per",
    "spearman": f"""WITH per AS (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey), r AS (SELECT {MIDRANKS.format('n')} AS a, {MIDRANKS.format('q')} AS b FROM per)
SELECT count(*) AS n, round_even(corr(a, b), 4) AS rho FROM r""",
    "modal_value": """WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey FROM c QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, f) = 1""",
    "impute_nearest": """WITH e AS (SELECT event_id, user_id, value, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS day FROM events),
s AS (SELECT * FROM e WHERE event_id % 10 = 0), k AS (SELECT * FROM e WHERE event_id % 10 <> 0),
b AS (SELECT s.event_id, k.event_id AS donor, k.day AS donor_day, k.value FROM s JOIN k ON k.user_id = s.user_id AND abs(k.day - s.day) <= 2
  QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY abs(k.day - s.day), k.day DESC, k.event_id) = 1)
SELECT s.event_id, user_id, day, donor, donor_day, round_even(b.value, 6) AS value FROM s LEFT JOIN b ON b.event_id = s.event_id""",
    "manual_override": f"""WITH h AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT d.doc_id, CASE WHEN q IS NOT NULL THEN 'manual.' || CASE WHEN q = 1 THEN 'include' ELSE 'exclude' END ELSE coalesce({RULE}, 'keep') END AS decision FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""",
    "rule_classifier": f"SELECT doc_id, coalesce({RULE}, 'keep') AS rule_id FROM documents",
    "rule_tally": f"""SELECT CASE WHEN rule_id = 'keep' THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN rule_id = 'keep' THEN 'keep' ELSE 'screen' END AS stage, rule_id, count(*) AS n
FROM (SELECT coalesce({RULE}, 'keep') AS rule_id FROM documents) GROUP BY ALL""",
    "procedure_families": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FAMILY.items()) + "], lambda x: x IS NOT NULL), '|') AS families FROM documents",
    "family_mix_by_language": "SELECT lang, count(*) AS records, " + ", ".join(f"count(*) FILTER ({c}) AS \"n_{n}\", round_even(100.0 * count(*) FILTER ({c}) / count(*), 1) AS \"pct_{n}\"" for n, c in FAMILY.items()) + ", count(*) FILTER (NOT (" + " OR ".join(FAMILY.values()) + ")) AS \"none\" FROM documents GROUP BY lang",
    "email_free_segments": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(trim(rtrim(trim(regexp_replace(text, '\b[\w.+-]+@[\w.-]+\.\w+\.?', '', 'g')), '.')), ';'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n_segments, CAST(coalesce(length(s[1]), 0) AS INT) AS first_chars FROM s""",
    "affiliation_jaccard": f"""WITH t AS (SELECT doc_id, {TOKENS('text')} AS w FROM documents)
SELECT a.doc_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round_even(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""",
    "alias_resolution": "WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {t}, {i})" for i, (p, c, t) in enumerate(ALIASES)) + """) v(pattern, canonical, tier, seq))
SELECT doc_id, canonical, CAST(tier AS INT) AS tier FROM documents JOIN a ON contains(lower(text), pattern) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, length(pattern) DESC, seq) = 1""",
    "html_titles": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]+>', '', 'g')) AS title FROM pages",
    "dedupe_keep_first": "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)",
    "anti_delta": f"""WITH {REC}, a AS (SELECT DISTINCT cust FROM rec WHERE year >= 1998), b AS (SELECT DISTINCT cust FROM rec WHERE year < 1998)
SELECT CASE WHEN b.cust IS NULL THEN 'added' WHEN a.cust IS NULL THEN 'removed' ELSE 'unchanged' END AS status, count(*) AS n FROM a FULL JOIN b ON a.cust = b.cust GROUP BY 1""",
    "recall_gate": f"SELECT rule IS NULL AS found, rule AS reason, count(*) AS n FROM (SELECT {RULE} AS rule FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY ALL",
    "metric_diff": """WITH a AS (SELECT o_orderstatus AS metric, count(*) AS old FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1), b AS (SELECT o_orderstatus AS metric, count(*) AS new FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1)
SELECT metric, old, new, CAST(new - old AS DOUBLE) AS delta FROM a FULL JOIN b USING (metric)""",
    "yearly_diff": f"""WITH {REC} SELECT year, count(*) AS ours, count(cites) AS theirs, count(*) - count(cites) AS difference, abs(count(*) - count(cites)) >= 20 AS large FROM rec GROUP BY year""",
    "exclude_group": f"""WITH {REC} SELECT year, count(*) AS n FROM rec WHERE key NOT IN (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0) GROUP BY year""",
    "wilson_interval": f"""WITH p AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang)
SELECT lang, n, k AS relevant, round_even(k / n, 4) AS precision, {WILSON.format('-')} AS ci_low, {WILSON.format('+')} AS ci_high FROM p""",
    "confusion_counts": "SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "agreement_by_language": "SELECT lang, count(*) AS n, count(*) FILTER (quality = toxic) AS agree, round_even(avg(CAST(quality = toxic AS INT)), 4) AS share FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang",
    "paired_sources": f"""WITH {REC}, li AS (SELECT l_orderkey AS key, CAST(trunc(sum(l_extendedprice) / 1000) AS INT) AS other FROM lineitem GROUP BY 1),
p AS (SELECT cites AS x, other AS y FROM rec JOIN li USING (key) WHERE cites IS NOT NULL AND other IS NOT NULL), r AS (SELECT {MIDRANKS.format('x')} AS a, {MIDRANKS.format('y')} AS b FROM p)
SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS total_a, CAST(sum(y) AS BIGINT) AS total_b, round_even(sum(x) / sum(y), 4) AS ratio, round_even(quantile_cont(x / y, 0.5) FILTER (y > 0), 4) AS median_ratio,
  count(*) FILTER (x > y) AS n_a_greater, count(*) FILTER (x < y) AS n_b_greater, count(*) FILTER (abs(x - y) > 0.2 * greatest(x, y)) AS n_differ_20pct, (SELECT round_even(corr(a, b), 4) FROM r) AS rho FROM p""",
    "json_properties": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "first_last_turn": "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id",
    "bounds_and_binomial": f"""WITH {REC}, {LINES}, {PLACES}, {FIRST}, c AS (SELECT coalesce(country, 'Unknown') AS country, count(*) AS n FROM firsts GROUP BY 1),
t AS (SELECT max(n) AS a, min(n) AS b FROM (SELECT n FROM c WHERE country <> 'Unknown' ORDER BY n DESC, country LIMIT 2)), x AS (SELECT a, b, CAST(coalesce((SELECT n FROM c WHERE country = 'Unknown'), 0) AS BIGINT) AS u FROM t)
SELECT a, b, u, a - b - u AS worst, a - b AS difference, a - b + u AS best FROM x""",
    "multi_value_counts": "SELECT coalesce(nullif(event_type, ''), 'Unknown') AS event_type, count(*) AS n FROM events GROUP BY 1",
    "union_of_rankings": "SELECT c_mktsegment AS name, count(*) AS customers, NULL::BIGINT AS suppliers, 'segment' AS ranking FROM customer GROUP BY 1 UNION ALL SELECT CAST(s_nationkey AS VARCHAR), NULL, count(*), 'nation' FROM supplier GROUP BY 1",
    "share_of_field": """WITH y AS (SELECT CAST(range AS INT) AS year FROM range(1990, 2003)), c AS (SELECT year(o_orderdate) AS year, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1)
SELECT y.year, coalesce(n, 0) AS n, total, CASE WHEN total > 0 THEN round_even(coalesce(n, 0) * 1000 / total, 3) END AS rate FROM y LEFT JOIN c ON c.year = y.year""",
    "journal_blocks": f"""WITH {REC}, {JOURNALS} SELECT CAST(year // 5 * 5 AS INT) AS block, count(*) AS n, round_even(100.0 * count(*) FILTER (journal IN ('BUILDING', 'MACHINERY')) / count(*), 2) AS named_pct, count(DISTINCT journal) AS journals FROM journals GROUP BY 1""",
    "positional_zip": """WITH e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id FROM events),
c AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey FROM orders)
SELECT key, CAST(pos AS INT) AS pos, o_orderkey, event_id FROM c LEFT JOIN e USING (key, pos)""",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
