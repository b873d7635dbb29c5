"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from coppice.functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

INCIDENTS = """incidents AS (SELECT doc_id AS row_index, 'INC' || doc_id AS number, text AS description,
  lang AS category, source AS service FROM documents)"""
RECORDS = f"records AS (SELECT row_index, {TRIM.format('description')} AS analysis_text, category, service FROM incidents)"
WORDS = rf"""words AS (SELECT row_index, list_filter(string_split(trim(regexp_replace(lower(analysis_text),
  '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: strlen(x) > 1 AND NOT list_contains({STOP}, x)) AS w FROM records)"""
BIGRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
GRAMS = """flatten(list_transform(list_filter(w, lambda t: length(t) > 4),
  lambda t: list_transform(range(1, length(t) - 2), lambda i: 'char:' || substring(t, i, 4))))"""
LISTS = f"lists AS (SELECT row_index, list_concat(list_concat(w, {BIGRAMS}), {GRAMS}) AS l FROM words)"
OCCURRENCES = "occurrences AS (SELECT row_index, unnest(l) AS term FROM lists)"
TERMS = "terms AS (SELECT DISTINCT row_index, term FROM occurrences)"
FREQUENCY = "frequency AS (SELECT term, count(*) AS df FROM terms GROUP BY term)"
KEPT = "kept AS (SELECT row_index, term FROM terms JOIN frequency USING (term) WHERE df BETWEEN 2 AND 2000)"
SIZES = "sizes AS (SELECT row_index, count(*) AS n FROM kept GROUP BY row_index)"
BASE = [INCIDENTS, RECORDS, WORDS, LISTS, OCCURRENCES, TERMS, FREQUENCY]
EDGES = """edges AS (SELECT src, dst, shared, x.n AS n_src, y.n AS n_dst FROM
  (SELECT a.row_index AS src, b.row_index AS dst, count(*) AS shared FROM kept a JOIN kept b
   ON a.term = b.term AND a.row_index < b.row_index GROUP BY ALL) p
  JOIN sizes x ON x.row_index = src JOIN sizes y ON y.row_index = dst
  WHERE 100 * shared >= 42 * (x.n + y.n - shared))"""
GRAPH = [*BASE, KEPT, SIZES, EDGES]


def reach(name: str, edges: str) -> list[str]:
    """Components of an edge list as (node, component)."""
    return [
        f"{name}_both AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges})",
        f"{name}_reach AS (SELECT src AS node, dst AS other FROM {name}_both UNION "
        f"SELECT r.node, e.dst FROM {name}_reach r JOIN {name}_both e ON r.other = e.src)",
        f"{name} AS (SELECT node, least(node, min(other)) AS component FROM {name}_reach GROUP BY node)",
    ]


CLUSTERS = [
    *GRAPH,
    *reach("comp", "edges"),
    "placed AS (SELECT row_index, coalesce(component, row_index) AS component FROM records LEFT JOIN comp ON node = row_index)",
    """grouped AS (SELECT component, count(*) AS size FROM placed GROUP BY component HAVING count(*) >= 2)""",
    "found AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS cluster_id FROM grouped)",
    "members AS (SELECT cluster_id, row_index, size FROM placed JOIN found USING (component))",
]
SPELLED = "spelled AS (SELECT row_index, k FROM (SELECT row_index, unnest(w) AS k FROM words) WHERE strlen(k) >= 3)"


def keyword_rank(name: str, members: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, k AS keyword, count(*) AS occurrences,
      row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, k) AS rank
      FROM {members} JOIN spelled USING (row_index) GROUP BY {keys}, k)"""


def labels(name: str, groups: str, ranked: str, keys: str) -> list[str]:
    """(keys, label, size) of groups from their ranked keywords."""
    raw = """CASE WHEN w1 IS NULL THEN 'Similar incidents in cluster ' || cluster_id WHEN w2 IS NULL THEN w1
      WHEN w3 IS NULL THEN w1 || ' related to ' || w2 ELSE w1 || ' issues involving ' || w2 || ' and ' || w3 END"""
    picks = ", ".join(f"max(CASE WHEN rank = {i} THEN keyword END) AS w{i}" for i in (1, 2, 3))
    return [
        f"{name}_words AS (SELECT {keys}, {picks} FROM {ranked} GROUP BY {keys})",
        f"{name}_raw AS (SELECT {keys}, size, {raw} AS r FROM {groups} LEFT JOIN {name}_words USING ({keys}))",
        f"{name} AS (SELECT {keys}, upper(substring(r, 1, 1)) || substring(r, 2) AS label, size FROM {name}_raw)",
    ]


LABELS = [*CLUSTERS, SPELLED, keyword_rank("ranked", "members", "cluster_id"), *labels("labelled", "found", "ranked", "cluster_id")]
THEME_ROWS = [
    "inner_terms AS (SELECT cluster_id, row_index, term FROM members JOIN terms USING (row_index) WHERE size > 2 AND size <= 5000)",
    "inner_df AS (SELECT cluster_id, term FROM inner_terms GROUP BY ALL HAVING count(*) BETWEEN 2 AND 2000)",
    "inner_kept AS (SELECT * FROM inner_terms SEMI JOIN inner_df USING (cluster_id, term))",
    "inner_sizes AS (SELECT row_index, count(*) AS n FROM inner_kept GROUP BY row_index)",
    """inner_edges AS (SELECT src, dst FROM (SELECT a.row_index AS src, b.row_index AS dst, count(*) AS shared
      FROM inner_kept a JOIN inner_kept b ON a.cluster_id = b.cluster_id AND a.term = b.term AND a.row_index < b.row_index
      GROUP BY ALL) p JOIN inner_sizes x ON x.row_index = src JOIN inner_sizes y ON y.row_index = dst
      WHERE 100 * shared >= 58 * (x.n + y.n - shared))""",
    *reach("inner_comp", "inner_edges"),
    """inner_placed AS (SELECT cluster_id, row_index, coalesce(component, row_index) AS component
      FROM members LEFT JOIN inner_comp ON node = row_index WHERE size > 2 AND size <= 5000)""",
    "inner_grouped AS (SELECT cluster_id, component, count(*) AS size FROM inner_placed GROUP BY ALL)",
    """inner_top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY size DESC, component) AS theme_id
      FROM inner_grouped QUALIFY theme_id <= 10)""",
    """theme_rows AS (SELECT cluster_id, theme_id, row_index, t.size FROM inner_placed JOIN inner_top t USING (cluster_id, component)
      UNION ALL SELECT cluster_id, 1, row_index, size FROM members WHERE NOT (size > 2 AND size <= 5000))""",
    "theme_groups AS (SELECT cluster_id, theme_id, any_value(size) AS size FROM theme_rows GROUP BY ALL)",
    keyword_rank("theme_ranked", "theme_rows", "cluster_id, theme_id"),
    *labels("themes", "theme_groups", "theme_ranked", "cluster_id, theme_id"),
]
THEMES = [*LABELS, *THEME_ROWS]
#: No theme is left out: neither those after the tenth nor those of clusters above 5000.
ALL_THEMES = [part.replace(" AND size <= 5000", "").replace(" QUALIFY theme_id <= 10", "") for part in THEMES]
LABELLED_INCIDENTS = """incidents AS (SELECT d.doc_id AS row_index, 'INC' || toxic || '-' || d.doc_id AS number,
  chr(9) || ' ' || text || ' ' AS description, lang AS category, source AS service
  FROM documents d LEFT JOIN labels USING (doc_id))"""
IGNORED = f"""ignored AS (SELECT row_index, coalesce(number, '') = '' AS missing_incident_number,
  {TRIM.format('description')} = '' AS missing_short_description FROM incidents
  WHERE coalesce(number, '') = '' OR {TRIM.format('description')} = '')"""
PARSED = " UNION ALL ".join(
    f"SELECT o_orderkey, {way} AS way, strftime(o_orderdate, '{form}') AS cell, {parsed} AS parsed FROM orders"
    for way, (form, parsed) in enumerate(
        (
            ("%Y-%m-%d", "CAST(o_orderdate AS DATE)"),
            ("%-d.%-m.%Y", "CAST(o_orderdate AS DATE)"),
            ("%d/%m/%Y", "CAST(o_orderdate AS DATE)"),
            # day first wins where both readings are dates
            (
                "%m/%d/%Y",
                "CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) "
                "ELSE CAST(o_orderdate AS DATE) END",
            ),
            ("%Y-%m-%d %H:%M", "CAST(NULL AS DATE)"),
        )
    )
)
FACETS = """facets AS (SELECT DISTINCT 'category' AS "column", category AS value FROM incidents
  UNION SELECT DISTINCT 'service', service FROM incidents)"""


def sql(parts: list[str], query: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {query}"


def counted(expression: str, name: str) -> str:
    return sql([INCIDENTS, RECORDS, WORDS], f"SELECT row_index, {name}, count(*) AS n FROM (SELECT row_index, unnest({expression}) AS {name} FROM words) GROUP BY ALL")


LOOKUP = """SELECT i.row_index, number, description, category, service,
  CASE WHEN m.cluster_id IS NULL THEN 'Unclustered' ELSE format('C{:04d}', m.cluster_id) END AS cluster_code,
  coalesce(c.label, 'Unclustered') AS cluster_label, coalesce(c.size, 0) AS cluster_size,
  coalesce(CAST(t.theme_id AS VARCHAR), '') AS theme_code, coalesce(n.label, '') AS theme_label, coalesce(n.size, 0) AS theme_size
  FROM incidents i LEFT JOIN members m USING (row_index) LEFT JOIN labelled c USING (cluster_id)
  LEFT JOIN theme_rows t ON t.row_index = i.row_index LEFT JOIN themes n ON n.cluster_id = t.cluster_id AND n.theme_id = t.theme_id"""
SHORT_TEXTS = "records AS (SELECT p_partkey AS row_index, p_name || ' ' || p_type AS analysis_text FROM part)"

SUPPLIERS = """incidents AS (SELECT s_suppkey AS row_index, s_name AS number, 'aaa bbb ccc ddd eee x' || s_suppkey % 12 || ' y' || s_suppkey % 12
  || ' z' || s_suppkey % 12 AS description, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS category, '' AS service FROM supplier)"""
ORDER_TEXTS = "records AS (SELECT o_orderkey AS row_index, o_orderpriority || ' c' || o_custkey AS analysis_text FROM orders)"
MILLIS = "millis AS (SELECT o_orderkey, CAST(floor(o_totalprice / pow(10.0, o_orderkey % 7) * 1000) AS BIGINT) AS m FROM orders)"

SHOWN = "shown AS (SELECT row_index FROM incidents WHERE category IN ('de', 'fr') AND CAST(substring(service, 4) AS INT) % 2 = 0)"
THRESHOLDS = (42, 58, 70)
AT_THRESHOLDS = [part for t in THRESHOLDS for part in (f"edges{t} AS (SELECT src, dst FROM edges WHERE 100 * shared >= {t} * (n_src + n_dst - shared))", *reach(f"comp{t}", f"edges{t}"))]

ORACLES: dict[str, str] = {
    "supplier_themes": sql([SUPPLIERS, *THEMES[1:]], "SELECT cluster_id, theme_id, label, size FROM themes"),
    "supplier_theme_rows": sql([SUPPLIERS, *THEMES[1:]], "SELECT cluster_id, theme_id, row_index FROM theme_rows"),
    "blank_facets": sql([SUPPLIERS, FACETS], """SELECT "column", value, CASE WHEN value = '' THEN '(blank)' ELSE value END AS display FROM facets"""),
    "composed_texts": "SELECT p_partkey AS row_index, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END AS analysis_text FROM part",
    "sparse_vectors": sql([SHORT_TEXTS, *BASE[2:]], "SELECT row_index, string_agg(term || '=' || CAST(round(round(CAST(CAST(tf * ln(1 + (SELECT count(*) FROM records) / df) AS FLOAT) AS DOUBLE), 2) * 100) AS BIGINT), '|' ORDER BY term) AS terms FROM (SELECT row_index, term, count(*) AS tf FROM occurrences GROUP BY ALL) JOIN frequency USING (term) GROUP BY row_index"),
    "valid_terms": sql(BASE, "SELECT term, df FROM frequency WHERE df BETWEEN 2 AND 2000"),
    "capped_terms": sql([ORDER_TEXTS, *BASE[2:]], "SELECT term, df FROM frequency WHERE df BETWEEN 2 AND 2000"),
    "numbered_rows": "SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS row_index, c_custkey, c_name FROM customer",
    "csv_import": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, CAST(doc_id AS VARCHAR) AS doc_id, concat_ws(chr(10), lang, '\"quoted\", ', text) AS text, source FROM documents",
    "source_counts": "SELECT count(*) AS row_count, 4::BIGINT AS column_count FROM documents",
    "durations": f"WITH {MILLIS} SELECT o_orderkey, CASE WHEN m >= 60000 THEN printf('%dm %02ds', m // 60000, m // 1000 % 60) WHEN m >= 1000 THEN printf('%d.%03ds', m // 1000, m % 1000) ELSE printf('%dms', m) END AS duration FROM millis",
    "selected_values": sql([INCIDENTS, FACETS], """SELECT "column", value, CASE WHEN "column" = 'category' THEN value <> (SELECT DISTINCT lang FROM documents ORDER BY lang LIMIT 1 OFFSET 1) ELSE value = 'src1' END AS selected FROM facets"""),
    "records": sql([LABELLED_INCIDENTS], f"SELECT row_index, number AS incident_number, {TRIM.format('description')} AS analysis_text, category, service FROM incidents WHERE number <> '' AND {TRIM.format('description')} <> ''"),
    "ignored_rows": sql([LABELLED_INCIDENTS, IGNORED], "SELECT * FROM ignored"),
    "ignored_reasons": sql([LABELLED_INCIDENTS, IGNORED], "SELECT missing_incident_number, missing_short_description, count(*) AS n FROM ignored GROUP BY ALL"),
    "parsed_dates": PARSED,
    "date_range_filter": "SELECT o_orderkey AS row_index, CAST(o_orderdate AS DATE) AS parsed_date FROM orders WHERE o_orderpriority <> '1-URGENT' AND year(o_orderdate) = 1995",
    "unparsed_date_count": "SELECT count(*) AS unparsed FROM orders WHERE o_orderpriority = '1-URGENT'",
    "normalize_text": sql([INCIDENTS, RECORDS], r"SELECT row_index, trim(regexp_replace(lower(analysis_text), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized FROM records"),
    "tokens": counted("w", "token"),
    "bigrams": counted(BIGRAMS, "bigram"),
    "char_ngrams": counted(GRAMS, "gram"),
    "term_dictionary": sql([INCIDENTS, RECORDS, WORDS, LISTS], "SELECT term, row_number() OVER (ORDER BY min((row_index, place))) - 1 AS term_id FROM (SELECT row_index, unnest(l) AS term, generate_subscripts(l, 1) AS place FROM lists) GROUP BY term"),
    "document_frequency": sql(BASE, "SELECT term, df FROM frequency"),
    "tf_idf": sql(BASE, "SELECT row_index, term, tf, df, round(CAST(CAST(tf * ln(1 + (SELECT count(*) FROM records) / df) AS FLOAT) AS DOUBLE), 2) AS weight FROM (SELECT row_index, term, count(*) AS tf FROM occurrences GROUP BY ALL) JOIN frequency USING (term)"),
    "inverted_index": sql(BASE, "SELECT term, df, string_agg(CAST(row_index AS VARCHAR), ',' ORDER BY row_index) AS rows FROM terms JOIN frequency USING (term) WHERE df BETWEEN 2 AND 2000 GROUP BY ALL"),
    "term_set_sizes": sql([*BASE, KEPT, SIZES], "SELECT row_index, coalesce(n, 0) AS n FROM records LEFT JOIN sizes USING (row_index)"),
    "similarity_edges": sql(GRAPH, "SELECT * FROM edges"),
    "similarity_edges_prefix": sql(GRAPH, "SELECT * FROM edges"),
    "components": sql([*GRAPH, *reach("comp", "edges")], "SELECT node AS row_index, component FROM comp"),
    "threshold_groups": sql([*GRAPH, *AT_THRESHOLDS], " UNION ALL ".join(f"SELECT {t} AS threshold, row_index, coalesce(component, row_index) AS component FROM records LEFT JOIN comp{t} ON node = row_index" for t in THRESHOLDS)),
    "clusters": sql(LABELS, "SELECT cluster_id, label, size FROM labelled"),
    "cluster_members": sql(CLUSTERS, "SELECT cluster_id, row_index FROM members"),
    "unclustered": sql(CLUSTERS, "SELECT row_index FROM records ANTI JOIN members USING (row_index)"),
    "cluster_keywords": sql(LABELS, "SELECT cluster_id, rank, keyword, occurrences FROM ranked WHERE rank <= 4"),
    "themes": sql(ALL_THEMES, "SELECT cluster_id, theme_id, label, size FROM themes"),
    "theme_details": sql(ALL_THEMES, "SELECT cluster_id, theme_id, row_index, row_number() OVER (PARTITION BY cluster_id, theme_id ORDER BY row_index) AS place FROM theme_rows QUALIFY place <= 250"),
    "export_rows": sql(ALL_THEMES, LOOKUP),
    "result_tree": sql(ALL_THEMES, "SELECT cluster_id, 0::BIGINT AS theme_id, -1::BIGINT AS row_index, label, size, 0 AS level FROM labelled UNION ALL SELECT cluster_id, theme_id, -1, label, size, 1 FROM themes UNION ALL SELECT cluster_id, theme_id, row_index, '', 1, 2 FROM theme_rows"),
    "filtered_clusters": sql(CLUSTERS, "SELECT cluster_id, count(*) AS visible FROM members JOIN incidents USING (row_index) WHERE category IN ('de', 'fr') GROUP BY cluster_id"),
    "visible_records": sql([INCIDENTS, SHOWN], "SELECT count(*) AS visible FROM shown"),
    "visible_members": sql([*CLUSTERS, SHOWN], "SELECT cluster_id, row_index FROM members SEMI JOIN shown USING (row_index)"),
    "visible_groups": sql([*CLUSTERS, SHOWN], "SELECT cluster_id, count(*) AS visible FROM members SEMI JOIN shown USING (row_index) GROUP BY cluster_id"),
    "visible_themes": sql([*ALL_THEMES, SHOWN], "SELECT cluster_id, theme_id, count(*) AS visible FROM theme_rows SEMI JOIN shown USING (row_index) GROUP BY ALL"),
    "facet_values": sql([INCIDENTS, FACETS], """SELECT "column", value, CASE WHEN value = '' THEN '(blank)' ELSE value END AS display FROM facets"""),
    "facet_search": sql([INCIDENTS, FACETS], """SELECT "column", value FROM facets WHERE contains(lower(value), 'rc1')"""),
    "facet_filter": sql([INCIDENTS], "SELECT row_index, category, service FROM incidents WHERE category IN ('de', 'fr')"),
    "run_summary": sql(CLUSTERS, "SELECT (SELECT count(*) FROM records) AS processed, (SELECT count(*) FROM incidents WHERE category IN ('de', 'fr')) AS visible, 0::BIGINT AS ignored, (SELECT count(*) FROM found) AS clusters, (SELECT count(*) FROM records ANTI JOIN members USING (row_index)) AS unclustered"),
    "source_preview": sql([INCIDENTS], "SELECT row_index, number, description, category, service FROM incidents ORDER BY row_index LIMIT 25"),
}
