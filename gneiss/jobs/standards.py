"""Queries over markdown documents, one for each order, and what is parsed from them, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import browse as B
from gneiss.operators import graph as G
from gneiss.operators import parsing as P
from gneiss.operators import promotion as N
from gneiss.operators import suggest as U
from gneiss.session import checkpointed, table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a document: a paragraph, formulas with their conditions, its lines as a table, and a table below stacked headers."""
    lines = table(spark, sf, "lineitem")
    sort = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    rows = F.array_join(F.transform(sort, lambda x: F.concat(F.lit("| "), x["l_linenumber"], F.lit(" | "), x["l_partkey"], F.lit(" | "), x["l_returnflag"], F.lit(" |"))), "\n")
    orders = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("rows")).selectExpr("*", "doc_id % 40 + 1 as a", "doc_id % 30 + 50 as b")
    text = F.expr(r"""concat('# Order ', doc_id, '\nDropped, A-1.\n## A-', a, ' Shells\nValues shall be obtained from Table B-', b, '.\n### A-', a, '(c) **Thickness**\n```\nt = (P × R) / (S × E − 0.6 × P)\n```\n',
        'This formula applies when: t ≤ R/2 AND P ≤ 0.385 × S × E. More text.\n', case when doc_id % 3 = 0 then '```\nnote\n E = x + 1\n```\n' else '' end,
        '## B-', b, ' Lines\n| Line | Part | Flag |\n|---|:---|---|\n', rows, '\n## Table M-1 Stress Contd\n', case when doc_id % 2 = 0 then 'Limits are applicable per A-' else 'It is taken from A-' end, a,
        '.\n| | | Group |\n|---|---|---|\n| Spec | Grade | 100 °C |\n| SM | x | ', doc_id, ' |\n', case when doc_id % 5 = 0 then '## Table M-1\n| h |\n|---|\n| v |\n' else '' end)""")
    return orders.select("doc_id", text.alias("text"))


#: What a listing reads of an element; pages, parents, variables and conditions are not parsed for it.
LISTED = ["paragraph_ref", "title", "content", "table_id", "caption", "headers", "rows"]


def _references(elements: DataFrame) -> DataFrame:
    return P.cross_references(elements.select("doc_id", "element_id", "content"), P.reference_index(elements))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    # Cells, captions, titles and conditions are no part of an edge.
    e = checkpointed(P.elements(documents(spark, sf), ["paragraph_ref", "parent_id", "content", "table_id", "variables"]))
    return G.document_edges(e, _references(e), P.SYMBOL_TABLES)


def doc_elements(spark: SparkSession, sf: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return P.elements(documents(spark, sf)).select(
        "doc_id", "ord", "element_id", "element_type", "paragraph_ref", "title", "parent_id", "table_id", "caption", joined("headers"),
        F.size("rows").alias("n_rows"), joined("variables"), joined("conditions"),
    ).withColumn("n_rows", F.when(F.col("table_id").isNotNull(), F.col("n_rows")))


def doc_formulas(spark: SparkSession, sf: str) -> DataFrame:
    return P.formulas(P.sections(documents(spark, sf))).select("doc_id", "formula_id", "symbol", "expression", "latex", F.size("conditions").alias("n_conditions"))


def doc_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("doc_id", "src", "dst", "kind", "weight", "text")


def doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = G.document_nodes(P.elements(documents(spark, sf)))
    return n.groupBy("kind", "paragraph_ref").agg(F.count("*").alias("n"), F.countDistinct("summary").alias("summaries"))


def doc_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n = G.neighbours(checkpointed(_edges(spark, sf)))
    targets = F.array_join(F.transform("out", lambda x: x["target"]), " ")
    return n.select("doc_id", "id", F.coalesce(targets, F.lit("")).alias("targets"), F.coalesce(F.array_join("predecessors", " "), F.lit("")).alias("predecessors"))


def listing_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = checkpointed(P.elements(documents(spark, sf), LISTED))
    return B.quality(e, _references(e)).select("doc_id", "element_id", "topic", "quality")


def corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    return B.audit(P.elements(documents(spark, sf)))


def corpus_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    e = checkpointed(P.elements(documents(spark, sf), LISTED))
    return U.suggestions(e, _references(e), "What is the weather today?")


def element_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable text of the formulas, and whether they cover a reference."""
    return B.of_types(P.elements(documents(spark, sf)), ["formula"]).select("doc_id", "element_id", B.element_text().alias("text"), B.covers("a-1").alias("covers"))


def graph_browse(spark: SparkSession, sf: str) -> DataFrame:
    """A report: the first edges of one listing."""
    return B.graph_listing(_edges(spark, sf).withColumn("src", F.concat_ws("/", "doc_id", "src"))).select("src", "dst", "kind")


def reference_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each document, which gives references in several spellings, or none; its formula, a section and a table are ranked before."""
    # Contents, titles, cells and conditions say nothing of what is named.
    e = checkpointed(P.elements(documents(spark, sf), ["paragraph_ref", "table_id"]))
    said = """case doc_id % 3 when 0 then concat('What does Table M-1 say of A-', doc_id % 40 + 1, '?') when 1 then concat('see table b-', doc_id % 30 + 50, ' and a-', doc_id % 40 + 1, '(c)') else 'No reference.' end"""
    asked = e.filter("ord = 1").selectExpr("doc_id as query_id", "doc_id as corpus", f"{said} as text")
    score = """case when element_type = 'formula' and element_id like '%-f0' then 0.9D when element_type = 'section' and paragraph_ref like 'B-%' then 0.3D
        when element_id = 'tbl-m-1' then if(doc_id % 2 = 0, 1.5D, 0.4D) end"""
    ranked = e.selectExpr("doc_id as query_id", "element_id as doc_id", f"{score} as score").filter("score is not null")
    named = N.by_reference(asked, e.withColumnRenamed("doc_id", "corpus"), "corpus").drop("corpus")
    return N.promote(ranked, named).select("query_id", F.col("doc_id").alias("element_id"), "origin", "rank", "score")


def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    """Countries, their customers and suppliers, joined within a region: a region's countries are one component."""
    t = lambda n: table(spark, sf, n)
    edges = (
        t("nation").selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst")
        .unionByName(t("customer").selectExpr("concat('n', c_nationkey) as src", "concat('c', c_custkey) as dst"))
        .unionByName(t("orders").selectExpr("concat('o', o_orderkey) as src", "concat('c', o_custkey) as dst"))
    )
    nodes = edges.selectExpr("src as id").union(edges.selectExpr("dst as id")).distinct()
    return G.weak_components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (doc_elements, doc_formulas, doc_edges, doc_nodes, doc_neighbours, listing_quality, corpus_suggestions, corpus_audit, element_search, graph_browse, reference_promotion, weak_components)}

_O = """o AS (SELECT l_orderkey AS d, count(*) AS n, l_orderkey % 40 + 1 AS a, l_orderkey % 30 + 50 AS b FROM lineitem GROUP BY l_orderkey)"""
_ELEMENTS = _O + """, e AS (
    SELECT d AS doc_id, 1 AS k, 'sec-a-' || a AS element_id, 'section' AS element_type, 'A-' || a AS paragraph_ref, 'A-' || a || ' Shells' AS title, NULL AS parent_id,
           NULL AS table_id, NULL AS caption, NULL AS headers, NULL::INT AS n_rows, NULL AS variables, NULL AS conditions FROM o
    UNION ALL SELECT d, 2, 'sec-a-' || a || '-2', 'section', 'A-' || a, 'A-' || a || '(c) **Thickness**', 'sec-a-' || a, NULL, NULL, NULL, NULL, NULL, NULL FROM o
    UNION ALL SELECT d, 3, 'fml-a-' || a || '-f0', 'formula', 'A-' || a, 'A-' || a || '-f0', 'sec-a-' || a || '-2', NULL, NULL, NULL, NULL, 'P; R; S; E; t', 't ≤ R/2; P ≤ 0.385 × S × E' FROM o
    UNION ALL SELECT d, 4, 'fml-a-' || a || '-f1', 'formula', 'A-' || a, 'A-' || a || '-f1', 'sec-a-' || a || '-2', NULL, NULL, NULL, NULL, 'E', '' FROM o WHERE d % 3 = 0
    UNION ALL SELECT d, 5, 'sec-b-' || b, 'section', 'B-' || b, 'B-' || b || ' Lines', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o
    UNION ALL SELECT d, 6, 'tbl-b-' || b, 'table', 'B-' || b, 'Table B-' || b, 'sec-b-' || b, 'B-' || b, 'Lines', 'Line; Part; Flag', n::INT, NULL, NULL FROM o
    UNION ALL SELECT d, 7, 'sec-table-m-1-stress-contd', 'section', NULL, 'Table M-1 Stress Contd', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o
    UNION ALL SELECT d, 8, 'tbl-m-1', 'table', 'M-1', 'Table M-1', 'sec-table-m-1-stress-contd', 'M-1', 'Stress', 'Spec; Grade; Group 100 °C', 1, NULL, NULL FROM o
    UNION ALL SELECT d, 9, 'sec-table-m-1', 'section', NULL, 'Table M-1', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE d % 5 = 0
    UNION ALL SELECT d, 10, 'tbl-m-1-2', 'table', 'M-1', 'Table M-1', 'sec-table-m-1', 'M-1', NULL, 'h v', 0, NULL, NULL FROM o WHERE d % 5 = 0)"""
_EDGES = _ELEMENTS + """, x AS (
    SELECT doc_id, parent_id AS src, element_id AS dst, 'contains' AS kind, 0.5::DOUBLE AS weight, 'contains' AS text FROM e WHERE parent_id IS NOT NULL
    UNION ALL SELECT d, 'sec-a-' || a, 'tbl-b-' || b, 'requires', 1, 'shall be obtained from Table B-' || b FROM o
    UNION ALL SELECT d, 'sec-table-m-1-stress-contd', 'fml-a-' || a || CASE WHEN d % 3 = 0 THEN '-f1' ELSE '-f0' END, 'references', 0.8, CASE WHEN d % 2 = 0 THEN 'per A-' ELSE 'from A-' END || a FROM o
    UNION ALL SELECT d, 'fml-a-' || a || '-f0', CASE WHEN d % 5 = 0 THEN 'tbl-m-1-2' ELSE 'tbl-m-1' END, 'requires', 1, 'formula requires values from Table M-1' FROM o)"""
ORACLES = {
    "doc_elements": f"WITH {_ELEMENTS} SELECT * EXCLUDE k, row_number() OVER (PARTITION BY doc_id ORDER BY k)::INT AS ord FROM e",
    "doc_formulas": f"""WITH {_O} SELECT d AS doc_id, 'A-' || a || '-f0' AS formula_id, 't' AS symbol, '(P × R) / (S × E − 0.6 × P)' AS expression,
        't = ' || chr(92) || 'frac{{P ' || chr(92) || 'times  R}}{{S ' || chr(92) || 'times  E - 0.6 ' || chr(92) || 'times  P}}' AS latex, 2 AS n_conditions FROM o
        UNION ALL SELECT d, 'A-' || a || '-f1', 'E', 'x + 1', 'E = x + 1', 0 FROM o WHERE d % 3 = 0""",
    "doc_edges": f"WITH {_EDGES} SELECT * FROM x",
    "doc_nodes": f"""WITH {_ELEMENTS}, s AS (SELECT element_type AS kind, paragraph_ref, CASE k WHEN 3 THEN 't' WHEN 4 THEN 'E' WHEN 1 THEN 'B-' || (doc_id % 30 + 50) WHEN 2 THEN (doc_id % 3 = 0)::VARCHAR
            WHEN 7 THEN doc_id::VARCHAR WHEN 8 THEN doc_id::VARCHAR WHEN 6 THEN (SELECT string_agg(l_linenumber || ' ' || l_partkey || l_returnflag, '|' ORDER BY l_linenumber, l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey = doc_id)
            WHEN 5 THEN (SELECT string_agg(l_linenumber || ' ' || l_partkey || l_returnflag, '|' ORDER BY l_linenumber, l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey = doc_id) ELSE 'one' END || CASE WHEN k IN (1, 2) THEN k::VARCHAR ELSE '' END AS summary FROM e)
        SELECT kind, paragraph_ref, count(*) AS n, count(DISTINCT summary) AS summaries FROM s GROUP BY ALL""",
    "doc_neighbours": f"""WITH {_EDGES}, ou AS (SELECT doc_id, src AS id, string_agg(dst, ' ' ORDER BY dst) AS targets FROM x GROUP BY ALL), pr AS (SELECT doc_id, dst AS id, string_agg(src, ' ' ORDER BY src) AS predecessors FROM x GROUP BY ALL)
        SELECT doc_id, id, coalesce(targets, '') AS targets, coalesce(predecessors, '') AS predecessors FROM ou FULL JOIN pr USING (doc_id, id)""",
    "listing_quality": f"""WITH {_ELEMENTS} SELECT doc_id, element_id,
            CASE k WHEN 1 THEN 'Shells' WHEN 2 THEN '(c) Thickness' WHEN 3 THEN 'f0' WHEN 4 THEN 'f1' WHEN 5 THEN 'Lines' WHEN 6 THEN 'Lines' WHEN 7 THEN title WHEN 8 THEN 'Stress' WHEN 9 THEN 'Table M-1' ELSE 'Table M-1' END AS topic,
            (CASE k WHEN 1 THEN 41 WHEN 2 THEN 120 WHEN 5 THEN 40 WHEN 6 THEN 95 + n_rows WHEN 8 THEN 96 WHEN 10 THEN 75 ELSE -1 END)::INT AS quality FROM e""",
    "corpus_suggestions": f"""WITH {_ELEMENTS}, c AS (
            SELECT doc_id, 0 AS stage, CASE WHEN k = 6 THEN -(95 + n_rows) WHEN k = 8 THEN -96 ELSE -75 END AS q, k, 'What information is contained in Table ' || table_id || ' about ' || CASE k WHEN 6 THEN 'Lines' WHEN 8 THEN 'Stress' ELSE 'Table M-1' END || '?' AS query, element_id, paragraph_ref FROM e WHERE k IN (6, 8, 10)
            UNION ALL SELECT doc_id, 1, -120, k, 'What does ' || paragraph_ref || ' specify about (c) Thickness?', element_id, paragraph_ref FROM e WHERE k = 2
            UNION ALL SELECT doc_id, 4, 0, 0, 'What is the weather today?', '', '' FROM (SELECT DISTINCT doc_id FROM e)),
        sg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, q, k) AS n FROM c WHERE stage < 4)
        SELECT doc_id, n::INT AS place, query, element_id, paragraph_ref, stage FROM sg WHERE n <= 3
        UNION ALL SELECT doc_id, 4, query, element_id, paragraph_ref, stage FROM c WHERE stage = 4""",
    "corpus_audit": f"""WITH {_ELEMENTS} SELECT element_type, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN paragraph_ref IS NOT NULL THEN doc_id || ' ' || paragraph_ref END) AS n_refs, 0::BIGINT AS duplicate_ids FROM e GROUP BY element_type""",
    "element_search": f"""WITH {_ELEMENTS}, f AS (SELECT doc_id, element_id, title || ' ' || paragraph_ref || ' ' || CASE k WHEN 3 THEN 't = (P × R) / (S × E − 0.6 × P)' ELSE 'E = x + 1' END AS text, contains(paragraph_ref, 'A-1') AS covers FROM e WHERE k IN (3, 4))
        SELECT * FROM f""",
    "reference_promotion": f"""WITH {_ELEMENTS}, h AS (SELECT doc_id AS query_id, element_id, CASE WHEN k = 3 THEN 0.9 WHEN k = 5 THEN 0.3 WHEN doc_id % 2 = 0 THEN 1.5 ELSE 0.4 END::DOUBLE AS score FROM e WHERE k IN (3, 5, 8)),
        n AS (SELECT doc_id AS query_id, element_id, k, CASE WHEN k IN (6, 8, 10) THEN 0 ELSE 1 END AS priority FROM e WHERE (doc_id % 3 = 0 AND k IN (1, 2, 8, 10)) OR (doc_id % 3 = 1 AND k IN (1, 2, 5, 6))),
        p AS (SELECT query_id, element_id, 'exact_ref' AS origin, CASE WHEN query_id % 2 = 0 THEN 1.5 ELSE 1 END::DOUBLE AS score, priority, k FROM n
            UNION ALL SELECT query_id, element_id, 'hybrid', score, 99, 0 FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.query_id = h.query_id AND n.element_id = h.element_id))
        SELECT query_id, element_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY priority, k, score DESC, element_id)::INT AS rank, score FROM p""",
    "graph_browse": f"WITH {_EDGES} SELECT doc_id || '/' || src AS src, dst, kind FROM x ORDER BY 1, 2, 3 LIMIT 200",
    "weak_components": """WITH x AS (SELECT n_regionkey AS r, 'r' || n_regionkey AS id FROM nation UNION SELECT n_regionkey, 'n' || n_nationkey FROM nation
            UNION SELECT n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
            UNION SELECT n_regionkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        SELECT min(id) AS component, count(*) AS n FROM x GROUP BY r""",
}
