"""Queries of the answering family, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import pinned
from gneiss.jobs import calculations
from gneiss.jobs import retrieval as J
from gneiss.operators import answers as A
from gneiss.operators import calculation as C
from gneiss.operators import provenance as V
from gneiss.operators import respond as R
from gneiss.session import table


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return J.bm25_topk(spark, sf).join(table(spark, sf, "documents").selectExpr("doc_id", "text", "lang as kind", "source as ref"), "doc_id")


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    out = A.prompts(_hits(spark, sf), ["en", "de"])
    return out.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("digest"))


def cited_answers(spark: SparkSession, sf: str) -> DataFrame:
    return A.summaries(_hits(spark, sf))


def evidence_check(spark: SparkSession, sf: str) -> DataFrame:
    return A.covered(_hits(spark, sf), {"english": "kind = 'en'", "long_text": "length(text) > 3000", "early_source": "ref in ('src0', 'src1', 'src2')"})


def citation_ladder(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    cited = lines.selectExpr("l_orderkey", "l_linenumber", "concat('A-', l_partkey % 30, '(c)(', l_linenumber, ')') as ref")
    index = lines.selectExpr("l_partkey % 30 as n").distinct().selectExpr("explode(case when n < 10 then array(concat('A-', n), concat('A-', n, '(c)')) when n < 20 then array(concat('A-', n)) end) as ref")
    return A.resolve(cited, index)


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A calculation for every order line, some without inputs, and every fourth a plain question; hits lack evidence for some, relevance for others."""
    lines = calculations.requests(spark, sf).join(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("supp")), "l_orderkey").filter("l_linenumber = 1")
    # Lines of one number that repeat in an order are one question.
    lines = lines.groupBy("l_orderkey", "supp").agg(F.min(F.struct("p_mpa", "component", "diameter_mm", "temp_c", "material", "joint_type", "rt_level", "ca_mm")).alias("r")).select("l_orderkey", "supp", "r.*")
    asked = lines.selectExpr("l_orderkey as query_id", """case when l_orderkey % 4 = 3 then 'What do joints of this kind need?' else
        concat('Compute the thickness: P = ', p_mpa, ' MPa, ', case when component = 'cylinder_outside' then 'OD ' else 'ID ' end, coalesce(cast(diameter_mm as string), 'unknown'), ' mm, T=', temp_c, '°C, ', material,
               ', Type ', joint_type, ', ', replace(rt_level, 'RT', 'radiography'), case when component = 'sphere' then ', spherical' else '' end, ', CA ', ca_mm, ' mm.') end as query""")
    refs = "case when supp % 5 = 0 then array('A-2', 'Table M-1') else array('A-27(c)(1)', 'table M-1', 'B-12') end"
    hits = lines.selectExpr("l_orderkey as query_id", "if(l_orderkey % 7 = 0, 0.01D, 0.9D) as score", f"posexplode({refs}) as (at, ref)").selectExpr("query_id", "score", "at + 1 as rank", "ref", "concat('\n Text of ', ref, '\nmore') as text")
    return asked, hits


def answer_flow(spark: SparkSession, sf: str) -> DataFrame:
    out = R.respond(*_questions(spark, sf))
    return out.groupBy("kind", "confidence", "refusal_reason").agg(F.count("*").alias("n"), F.sum("query_id").alias("queries"), F.countDistinct("answer").alias("answers"))


def _standard(spark: SparkSession) -> DataFrame:
    """The corpus that answers cite: two paragraphs, and the trusted tables as they would be printed."""
    table_text = lambda head, rows: "\n".join([head, *("| " + " | ".join(map(str, r)) + " |" for r in rows)])
    elements = [
        ("sec-a-25", "section", "A-25", "Corrosion allowance shall be added to the thickness; it is given by the user.", 1),
        ("sec-a-27", "section", "A-27", "Shells under internal pressure shall have this thickness. Formulas follow.", 2),
        ("tbl-m-1", "table", "M-1", table_text("Allowable stresses by material", [(m[0], m[1], *m[2]) for m in pinned.MATERIALS]), 3),
        ("tbl-b-12", "table", "B-12", table_text("Joint efficiencies by type", [(j, *e) for j, e in pinned.JOINT_EFFICIENCY if j < 6]), 4),
    ]
    return spark.createDataFrame(elements, "element_id string, element_type string, ref string, content string, ord int")


def _cited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The questions of ``answer_flow`` with hits from the corpus; every other query's hits do not hold what is cited.  Joint type 6 has no row."""
    asked, old = _questions(spark, sf)
    corpus = _standard(spark)
    ids = {"A-27(c)(1)": "sec-a-27", "A-2": "sec-a-2", "table M-1": "tbl-m-1", "Table M-1": "tbl-m-1", "B-12": "tbl-b-12"}
    named = old.withColumn("element_id", F.expr("case ref " + " ".join(f"when '{k}' then '{v}'" for k, v in ids.items()) + " end"))
    named = named.withColumn("ref", F.expr("case element_id when 'sec-a-27' then 'A-27' when 'tbl-m-1' then 'M-1' else ref end"))
    full = corpus.select("element_id", "content")
    hits = named.join(full, "element_id", "left").withColumn("text", F.when(F.col("query_id") % 2 == 0, F.coalesce("content", "text")).otherwise(F.col("text"))).drop("content")
    return R.respond_with_citations(asked, hits, corpus)


def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    responses, checked = _cited(spark, sf)
    counts = checked.groupBy("query_id").agg(F.count("*").alias("n_citations"), F.count("issue").alias("n_issues"), F.count("input").alias("n_inputs"))
    both = responses.join(counts, "query_id", "left").fillna(0, ["n_citations", "n_issues", "n_inputs"])
    return both.select("query_id", "kind", "confidence", "refusal_reason", "n_citations", "n_issues", "n_inputs", F.col("answer").isNotNull().alias("answered"))


def calc_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs of every step of every calculation, with what trusted data cites."""
    done = V.steps(C.calculate(calculations.requests(spark, sf)), calculations.KEYS)
    each = done.select(*calculations.KEYS, "step", "step_key", "unit", F.col("cite.ref").alias("cited"), F.explode("inputs").alias("symbol", "i"))
    return each.select(*calculations.KEYS, "step", "step_key", "unit", "cited", "symbol", F.round("i.value", 6).alias("value"), F.col("i.source").alias("source"), F.col("i.cite.ref").alias("input_cited"), F.col("i.cite.needle").alias("needle"))


QUERIES = {f.__name__: f for f in (prompt_build, cited_answers, evidence_check, citation_ladder, answer_flow, answer_citations, calc_provenance)}

_HITS = f"WITH {J.bm25_sql(10)}, h AS (SELECT bm.*, d.text, d.lang AS kind, d.source AS ref FROM bm JOIN documents d USING (doc_id))"
_FLOW = calculations.CALC + """, uq AS (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey),
        wq AS (SELECT * FROM (SELECT h.*, supp, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, component, dia NULLS FIRST, temp_c, material, joint_type, rt_level, ca10) AS first FROM h JOIN uq USING (l_orderkey) WHERE l_linenumber = 1) WHERE first = 1),
        gq AS (SELECT l_orderkey AS q, component, p, dia, temp_c, material, joint_type, rt_level, ca10, CASE WHEN q % 7 = 0 THEN 'relevance' WHEN q % 4 = 3 THEN NULL WHEN material <> 'unknown' AND temp_c > max_temp THEN 'temperature'
            WHEN dia IS NULL OR material = 'unknown' THEN 'missing: ' || concat_ws(', ', CASE WHEN dia IS NULL THEN 'inside or outside diameter' END, CASE WHEN material = 'unknown' THEN 'supported SM material' END)
            WHEN supp % 5 = 0 THEN 'evidence: A-27, B-12' WHEN error_code IS NOT NULL THEN 'calculation: ' || error_code END AS reason, q % 4 = 3 AS plain, supp,
            concat_ws(' ', component, p, dia, sn::DOUBLE / qd, e, t100, td100, plate) AS sum FROM wq)"""
ORACLES = {
    "prompt_build": _HITS + """, p AS (SELECT query_id, string_agg('[' || doc_id || '] ' || CASE WHEN len(text) > 1200 THEN text[:1200] || '…' ELSE coalesce(text, '') END, chr(10)
            ORDER BY CASE kind WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, rank) AS prompt FROM h GROUP BY query_id)
        SELECT query_id, len(prompt) AS n_chars, sha256(prompt) AS digest FROM p""",
    "cited_answers": _HITS + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ref ORDER BY rank) AS n FROM h) WHERE n = 1),
        q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM o)
        SELECT query_id, place::INT AS place, ref, trim(regexp_extract(text, '(?:^|\\n)[ \\t]*([^ \\t\\n][^\\n]*)', 1))[:240] AS line FROM q WHERE place <= 4""",
    "evidence_check": _HITS + """, c AS (SELECT query_id, bool_or(kind = 'en') AS english, bool_or(len(text) > 3000) AS long_text, bool_or(ref IN ('src0', 'src1', 'src2')) AS early_source FROM h GROUP BY query_id)
        SELECT *, english AND long_text AND early_source AS complete FROM c""",
    "citation_ladder": """SELECT l_orderkey, l_linenumber, 'A-' || n || '(c)(' || l_linenumber || ')' AS ref, CASE WHEN n < 10 THEN 'A-' || n || '(c)' WHEN n < 20 THEN 'A-' || n END AS resolved,
        CASE WHEN n < 10 THEN 1 WHEN n < 20 THEN 2 END::INT AS depth FROM (SELECT *, l_partkey % 30 AS n FROM lineitem)""",
    "answer_flow": _FLOW + """
        SELECT CASE WHEN reason IS NOT NULL THEN 'refusal' WHEN plain THEN 'summary' ELSE 'calculation' END AS kind, CASE WHEN reason IS NOT NULL THEN 'insufficient' WHEN plain THEN 'medium' ELSE 'high' END AS confidence,
            reason AS refusal_reason, count(*) AS n, sum(q)::BIGINT AS queries, count(DISTINCT CASE WHEN reason IS NULL THEN CASE WHEN plain THEN (supp % 5 = 0)::VARCHAR ELSE sum END END) AS answers FROM gq GROUP BY ALL""",
    "answer_citations": _FLOW + """, hc AS (SELECT q, CASE WHEN reason IS NULL AND NOT plain AND joint_type = 6 THEN 'calculation: citation' ELSE reason END AS reason, plain, supp FROM gq)
        SELECT q AS query_id, CASE WHEN reason IS NOT NULL THEN 'refusal' WHEN plain THEN 'summary' ELSE 'calculation' END AS kind,
            CASE WHEN reason IS NOT NULL THEN 'insufficient' WHEN plain OR q % 2 = 1 THEN 'medium' ELSE 'high' END AS confidence, reason AS refusal_reason,
            CASE WHEN reason IS NOT NULL THEN 0 WHEN plain THEN CASE WHEN supp % 5 = 0 THEN 2 ELSE 3 END ELSE 13 END::BIGINT AS n_citations,
            CASE WHEN reason IS NULL AND NOT plain AND q % 2 = 1 THEN 12 ELSE 0 END::BIGINT AS n_issues, CASE WHEN reason IS NULL AND NOT plain THEN 6 ELSE 0 END::BIGINT AS n_inputs, reason IS NULL AS answered FROM hc""",
    "calc_provenance": calculations.CALC + """, w AS (SELECT l_orderkey, l_linenumber, component, temp_c, material, joint_type, p / 1000.0::DOUBLE AS p, dia, ca10 / 10.0::DOUBLE AS ca, sn::DOUBLE / qd AS s, e / 100.0::DOUBLE AS e, t100 / 100.0::DOUBLE AS t,
            td100 / 100.0::DOUBLE AS td, plate, CASE component WHEN 'cylinder_inside' THEN 'A-27(c)(1)' WHEN 'cylinder_outside' THEN 'A-27(c)(2)' ELSE 'A-27(d)' END AS f, 'Table M-1' AS m, 'Table B-12' AS b, '| ' || joint_type || ' |' AS j FROM h WHERE error_code IS NULL),
        x AS (SELECT l_orderkey, l_linenumber, unnest([
            {'step': 1, 'step_key': 'allowable_stress', 'unit': 'MPa', 'cited': m, 'symbol': 'T', 'value': temp_c::DOUBLE, 'source': 'user_input', 'input_cited': NULL::VARCHAR, 'needle': NULL::VARCHAR},
            {'step': 2, 'step_key': 'joint_efficiency', 'unit': '', 'cited': b, 'symbol': 'joint_type', 'value': joint_type::DOUBLE, 'source': 'user_input', 'input_cited': NULL, 'needle': NULL},
            {'step': 3, 'step_key': 'applicability_check', 'unit': 'MPa', 'cited': f, 'symbol': 'P', 'value': p, 'source': 'user_input', 'input_cited': NULL, 'needle': NULL},
            {'step': 3, 'step_key': 'applicability_check', 'unit': 'MPa', 'cited': f, 'symbol': 'S', 'value': s, 'source': 'pinned_data', 'input_cited': m, 'needle': material},
            {'step': 3, 'step_key': 'applicability_check', 'unit': 'MPa', 'cited': f, 'symbol': 'E', 'value': e, 'source': 'pinned_data', 'input_cited': b, 'needle': j},
            {'step': 4, 'step_key': 'min_thickness', 'unit': 'mm', 'cited': f, 'symbol': 'P', 'value': p, 'source': 'user_input', 'input_cited': NULL, 'needle': NULL},
            {'step': 4, 'step_key': 'min_thickness', 'unit': 'mm', 'cited': f, 'symbol': 'R', 'value': dia / 2.0::DOUBLE, 'source': 'calculated', 'input_cited': NULL, 'needle': NULL},
            {'step': 4, 'step_key': 'min_thickness', 'unit': 'mm', 'cited': f, 'symbol': 'S', 'value': s, 'source': 'pinned_data', 'input_cited': m, 'needle': material},
            {'step': 4, 'step_key': 'min_thickness', 'unit': 'mm', 'cited': f, 'symbol': 'E', 'value': e, 'source': 'pinned_data', 'input_cited': b, 'needle': j},
            {'step': 5, 'step_key': 'design_thickness', 'unit': 'mm', 'cited': 'A-25', 'symbol': 't_min', 'value': t, 'source': 'calculated', 'input_cited': NULL, 'needle': NULL},
            {'step': 5, 'step_key': 'design_thickness', 'unit': 'mm', 'cited': 'A-25', 'symbol': 'CA', 'value': ca, 'source': 'user_input', 'input_cited': NULL, 'needle': NULL},
            {'step': 6, 'step_key': 'nominal_plate', 'unit': 'mm', 'cited': f, 'symbol': 't_design', 'value': td, 'source': 'calculated', 'input_cited': NULL, 'needle': NULL},
            {'step': 7, 'step_key': 'mawp', 'unit': 'MPa', 'cited': f, 'symbol': 'S', 'value': s, 'source': 'pinned_data', 'input_cited': m, 'needle': material},
            {'step': 7, 'step_key': 'mawp', 'unit': 'MPa', 'cited': f, 'symbol': 'E', 'value': e, 'source': 'pinned_data', 'input_cited': b, 'needle': j},
            {'step': 7, 'step_key': 'mawp', 'unit': 'MPa', 'cited': f, 'symbol': 't_corr', 'value': plate - ca, 'source': 'calculated', 'input_cited': NULL, 'needle': NULL},
            {'step': 7, 'step_key': 'mawp', 'unit': 'MPa', 'cited': f, 'symbol': 'R', 'value': dia / 2.0::DOUBLE, 'source': 'calculated', 'input_cited': NULL, 'needle': NULL}]) AS r FROM w)
        SELECT l_orderkey, l_linenumber, r.step::INT AS step, r.step_key, r.unit, r.cited, r.symbol, round(r.value, 6) AS value, r.source, r.input_cited, r.needle FROM x""",
}
