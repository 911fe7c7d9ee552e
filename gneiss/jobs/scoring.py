"""Queries of citation checks, example metrics and parser metrics, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.jobs import evaluation, standards
from gneiss.operators import citations as C
from gneiss.operators import evidence as E
from gneiss.operators import metrics as M
from gneiss.operators import parsing as P
from gneiss.operators import reports as Y
from gneiss.session import checkpointed, table

# --- Citations ---------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as elements: a section each, and for some an earlier table of the same reference."""
    part = table(spark, sf, "part")
    text = "concat(p_name, ' is made by ', p_brand, ' of type ', p_type)"
    sections = part.selectExpr("concat('sec-p-', p_partkey) as element_id", "'section' as element_type", "concat('P-', p_partkey) as ref", f"{text} as content", "2 as ord")
    return sections.unionByName(part.filter("p_partkey % 3 = 0").selectExpr("concat('tbl-p-', p_partkey)", "'table'", "concat('P-', p_partkey)", "'| nothing | here |'", "1").toDF(*sections.columns))


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    """Each order line cites its part in one of six ways; only the first three lines of an order were retrieved."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.selectExpr(
        "l_orderkey as query_id", "l_linenumber as cite_no", "l_partkey as part", "(l_orderkey + l_linenumber) % 6 as way",
        "case (l_orderkey + l_linenumber) % 6 when 0 then concat('sec-p-', l_partkey) when 1 then concat('p-', l_partkey) when 4 then concat('sec-p-', l_partkey) else 'none' end as source_id",
        """case (l_orderkey + l_linenumber) % 6 when 1 then concat('P-', l_partkey, '(a)') when 2 then concat('Table P-', l_partkey) when 3 then concat('P-', l_partkey, '(a)(1)') when 4 then concat('Q-', l_partkey)
                when 5 then 'no reference' else concat('P-', l_partkey) end as ref""",
        "case (l_orderkey + l_linenumber) % 6 when 1 then upper(concat(p_name, '  is made by ', p_brand)) when 3 then 'entirely other words stand here' else p_name end as quote",
    )


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "lineitem").filter("l_linenumber <= 3").selectExpr("l_orderkey as query_id", "concat('sec-p-', l_partkey) as element_id", "l_linenumber as rank")
    return seen.join(_corpus(spark, sf).filter("element_type = 'section'").drop("ord", "element_type"), "element_id")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return C.validate(_citations(spark, sf), _chunks(spark, sf), _corpus(spark, sf))


def citation_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("query_id", "cite_no", "part", "resolved_id", "issue")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as query_id", "case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'insufficient' end as confidence",
        "case when o_orderkey % 5 = 0 then 'not covered' end as refusal_reason", "o_orderkey % 4 = 0 as expected_refusal",
    )


def citation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return C.accuracy(_responses(spark, sf), _checked(spark, sf))


def confidence_downgrade(spark: SparkSession, sf: str) -> DataFrame:
    return C.downgraded(_responses(spark, sf), _checked(spark, sf)).select("query_id", "confidence")


def response_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.violations(_responses(spark, sf), _citations(spark, sf))


def quote_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a citation would quote of each document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(C.first_sentence(F.col("text")), 256).alias("sentence"), F.sha2(C.line_with(F.col("text"), F.lit("License")), 256).alias("line"))


# --- Metrics of examples -------------------------------------------------------------------------------


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey as query_id", "l_linenumber as rank", "concat('A-', l_partkey % 20, case when l_suppkey % 2 = 0 then '(c)(1)' else '' end) as ref")


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey as query_id", "explode(filter(array(concat('Table a-', o_custkey % 20), concat('A-', o_orderkey % 20, '(c)'), concat('A-', o_custkey % 2)), (r, i) -> i < o_orderkey % 4)) as ref")


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.retrieval(_ranked(spark, sf), _expected(spark, sf), 4)


def structural_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return M.structural(_expected(spark, sf), _ranked(spark, sf).select("query_id", "ref"))


def refusal_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return M.refusal(_responses(spark, sf))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as query_id", "concat('See A-', l_partkey % 9, '(c) and Table Z-', l_suppkey % 7, ' for SM-', l_linenumber, ' Gr 70.') as answer",
        "concat('table z-', l_suppkey % 3, ' lists sm-', l_linenumber % 4, ' gr 70') as context",
    )


def entity_grounding(spark: SparkSession, sf: str) -> DataFrame:
    return M.grounding(_answers(spark, sf))


def example_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of all examples, by metric."""
    # Both metrics of a query come from its one row, which is not worked out again for the second.
    r = M.retrieval(_ranked(spark, sf), _expected(spark, sf), 4)
    r = r.selectExpr("query_id", "inline(array(struct('precision' as metric, precision as value, precision_passed as passed), struct('recall' as metric, recall as value, recall_passed as passed)))")
    parts = {
        "refusal_calibration": M.refusal(_responses(spark, sf)), "structural_completeness": M.structural(_expected(spark, sf), _ranked(spark, sf).select("query_id", "ref")),
        "retrieval": r,
    }
    s = M.scored(parts, _responses(spark, sf))
    return s.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if("passed").alias("passed"))


def refusal_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").selectExpr("quality = 0 as expected_refusal", "least(1D, n_chars / 20000D) as score")
    return M.refusal_sweep(s, [0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3])


def agent_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts of agents, by who ended them."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last"), F.count("*").alias("n_calls"), F.count_if(F.expr("length(coalesce(text, '')) < 200")).alias("n_errors"))
    return M.agent_aggregate(t.selectExpr(
        "concat('run-', conv_id % 3) as run_id", "last = 'assistant' as passed", "n_calls", "n_errors", "case when last = 'assistant' then 'finalized' when n_calls > 4 then 'budget_steps_exhausted' else 'error' end as termination"))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return M.report(E.run_aggregate(evaluation._scores(spark, sf)))


def _report_scores(spark: SparkSession, sf: str) -> DataFrame:
    categories = F.expr("element_at(array('lookup', 'calculation', 'reference'), cast(example_id % 3 as int) + 1)")
    return evaluation._scores(spark, sf).withColumns({"category": categories, "threshold": F.lit(0.1)})


def run_report_full(spark: SparkSession, sf: str) -> DataFrame:
    scores = _report_scores(spark, sf)
    manifest = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(F.count("*").alias("lines"), F.max("l_orderkey").alias("last"))
    manifest = manifest.selectExpr("run_id", "stack(2, 'n_lines', cast(lines as string), 'last_example', cast(last as string)) as (field, value)").filter("run_id <> 'R'")
    out = Y.run_reports(scores, manifest)
    return out.select("run_id", F.length("report").cast("long").alias("n_chars"), F.sha2("report", 256).alias("digest"))


def run_pivot_any(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by priority and status of their orders: as many as the data has."""
    lines = table(spark, sf, "orders").selectExpr("concat(o_orderpriority, ' ', o_orderstatus) as run_id", "stack(2, 'price', o_totalprice / 1000, 'customer', o_custkey + 0D) as (metric, value)")
    wide = Y.by_run(lines.groupBy("run_id", "metric").agg(F.round(F.avg("value"), 4).alias("mean")))
    return wide.select("metric", F.size("means").cast("long").alias("n_runs"), F.explode("means").alias("run_id", "mean"))


def ablation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """What each configuration does with each order: which would be refused, calculated, and checked."""
    m = M.ablations(table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus = 'F' as foreign", "o_totalprice > 150000 as priced"))
    return m.groupBy("config", "mode").agg(F.count_if(F.expr("gate and foreign")).alias("refused"), F.count_if(F.expr("pinned and priced and not (gate and foreign)")).alias("calculated"), F.count_if("enforcer").alias("checked"))


# --- Metrics of parsers --------------------------------------------------------------------------------


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of the orders' documents as they should be: the second has another id, and cells of every third order differ."""
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("l"))
    rows = "transform(l, x -> array(cast(x.l_linenumber as string), if(doc_id % 3 = 0, '?', cast(x.l_partkey as string)), x.l_returnflag))"
    first = o.selectExpr("doc_id", "1 as ord", "concat('b-', doc_id % 30 + 50) as table_id", "cast(null as string) as caption", "1 as page", "array('Line', 'Part', 'Flag') as headers", f"{rows} as rows")
    second = o.selectExpr("doc_id", "2", "'X-9'", "'stress values'", "1", "array('Spec', 'Grade', 'Group 100 °C')", "array(array('SM', 'x', cast(doc_id as string)))").toDF(*first.columns)
    third = o.filter("doc_id % 2 = 0").selectExpr("doc_id", "3", "'Y-9'", "cast(null as string)", "9", "array('none')", "cast(array() as array<array<string>>)").toDF(*first.columns)
    return first.unionByName(second).unionByName(third)


def table_recovery(spark: SparkSession, sf: str) -> DataFrame:
    found = P.elements(standards.documents(spark, sf)).filter("element_type = 'table'").select("doc_id", "ord", "table_id", "caption", "page", "headers", "rows")
    return M.table_f1(checkpointed(found), _truth(spark, sf)).groupBy("n_tables", "f1").agg(F.count("*").alias("n"), F.sum("doc_id").alias("docs"))


def parser_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas, references and headings of the orders' documents against what they should have."""
    e = P.elements(standards.documents(spark, sf), ["paragraph_ref", "title", "content"])
    # Only formulas are compared by what they hold.
    e = checkpointed(e.withColumn("content", F.when(F.col("element_type") == "formula", F.col("content"))))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).join(e.select("doc_id").distinct(), "doc_id", "left_semi")
    formulas = o.selectExpr("doc_id", "explode(array('t=(P×R)/(S×E−0.6×P)', 'E = x+1')) as plain")
    refs = o.selectExpr("doc_id", "explode(array(concat('a-', doc_id % 40 + 1), 'M-1', 'Z-1')) as ref")
    heads = o.selectExpr("doc_id", "explode(array('LINES', 'table  m-1', 'elsewhere')) as heading")
    predicted = e.filter("element_type = 'formula'").select("doc_id", F.col("content").alias("plain"))
    parts = {"formulas": M.formula_fidelity(predicted, formulas), "references": M.reference_recall(e.filter("paragraph_ref is not null"), refs), "sections": M.section_recall(e.filter("element_type = 'section'"), heads)}
    out = None
    for name, part in parts.items():
        one = part.groupBy(F.lit(name).alias("metric"), "value").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def per_page(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "documents").selectExpr("doc_id", "n_chars * 0.25D as ms", "n_chars * 0.0001D as cost", "cast(n_chars div 1800 as int) as pages")
    return M.per_page(runs).select("doc_id", "ms_per_page", "cost_per_page")


QUERIES = {f.__name__: f for f in (
    citation_validate, citation_accuracy, confidence_downgrade, response_violations, quote_lines, retrieval_metrics, structural_completeness, refusal_calibration, entity_grounding,
    example_scores, refusal_sweep, agent_aggregate, run_report, run_report_full, run_pivot_any, ablation_matrix, table_recovery, parser_recall, per_page,
)}

_CITED = """c AS (SELECT l_orderkey AS q, l_linenumber AS cite_no, l_partkey AS part, (l_orderkey + l_linenumber) % 6 AS way FROM lineitem),
    s AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS part FROM lineitem WHERE l_linenumber <= 3),
    v AS (SELECT c.*, CASE WHEN way = 3 THEN 'quote' WHEN way = 4 THEN CASE WHEN s.q IS NULL THEN 'unresolved' ELSE 'reference' END WHEN way = 5 THEN 'not canonical' END AS issue,
             CASE WHEN way = 5 OR (way = 4 AND s.q IS NULL) THEN NULL ELSE 'sec-p-' || c.part END AS resolved_id FROM c LEFT JOIN s USING (q, part))"""
_CONFIDENCE = "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'insufficient' END"
_REFS = """r AS (SELECT l_orderkey AS q, l_linenumber AS rank, 'A-' || (l_partkey % 20) || CASE WHEN l_suppkey % 2 = 0 THEN '(C)(1)' ELSE '' END AS a FROM lineitem),
    x0 AS (SELECT o_orderkey AS q, unnest(['Table a-' || (o_custkey % 20), 'A-' || (o_orderkey % 20) || '(c)', 'A-' || (o_custkey % 2)][:(o_orderkey % 4)::INT]) AS ref FROM orders),
    x AS (SELECT q, ref, regexp_replace(upper(ref), '^TABLE ', '') AS e FROM x0),
    h AS (SELECT r.q, rank, a, ref, e FROM r JOIN x ON r.q = x.q AND (a = e OR starts_with(a, e || '(') OR starts_with(e, a || '(')))"""
_METRICS = _REFS + """, p AS (SELECT r.q, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM h WHERE h.q = r.q AND h.a = r.a)) AS rel FROM r WHERE rank <= 4 GROUP BY r.q),
    ne AS (SELECT q, count(*) AS ne FROM x GROUP BY q), f AS (SELECT q, count(DISTINCT upper(ref)) AS f FROM h WHERE rank <= 4 GROUP BY q),
    m AS (SELECT q AS query_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN rel / n::DOUBLE ELSE 0 END AS pr, coalesce(ne, 0) AS ne, CASE WHEN coalesce(ne, 0) > 0 THEN coalesce(f, 0) / ne::DOUBLE ELSE 1 END AS rc
          FROM p FULL JOIN ne USING (q) LEFT JOIN f USING (q)),
    rm AS (SELECT query_id, round(pr, 6) AS precision, n > 0 AND pr >= least(0.3, greatest(0.08, 0.8 * ne / 4)) AS precision_passed, round(rc, 6) AS recall, rc >= 0.99 AS recall_passed FROM m),
    st AS (SELECT q AS query_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM h WHERE h.q = x.q AND h.ref = x.ref)) AS covered, count(*) AS total FROM x GROUP BY q)"""
ORACLES = {
    "citation_validate": f"WITH {_CITED} SELECT q AS query_id, cite_no, part, resolved_id, issue FROM v",
    "citation_accuracy": f"""WITH {_CITED}, a AS (SELECT q AS query_id, count(*) AS total, count(*) FILTER (WHERE issue IS NULL) AS valid FROM v GROUP BY q)
        SELECT o_orderkey AS query_id, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, round(coalesce(valid / total::DOUBLE, 1), 6) AS value, coalesce(valid / total::DOUBLE, 1) >= 0.8 AS passed FROM orders LEFT JOIN a ON query_id = o_orderkey""",
    "confidence_downgrade": f"""WITH {_CITED}, b AS (SELECT DISTINCT q FROM v WHERE issue IS NOT NULL)
        SELECT o_orderkey AS query_id, CASE WHEN {_CONFIDENCE} = 'high' AND q IS NOT NULL THEN 'medium' ELSE {_CONFIDENCE} END AS confidence FROM orders LEFT JOIN b ON q = o_orderkey""",
    "response_violations": f"""SELECT * FROM (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 > 0 THEN 'refusal without reason' WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 = 0 THEN 'reason without refusal'
        WHEN o_orderkey % 3 < 2 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no citation' END AS violation FROM orders) WHERE violation IS NOT NULL""",
    "quote_lines": r"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s)) AS l, string_split(text, chr(10)) AS w FROM documents), f AS (SELECT doc_id, list_filter(l, lambda s: len(s) >= 20)[1] AS s, list_filter(w, lambda s: contains(lower(s), 'license'))[1] AS n FROM d)
        SELECT doc_id, CASE WHEN s IS NOT NULL THEN sha256(CASE WHEN regexp_extract(s, '^(.*?[.;])(?:\s|$)', 1) <> '' THEN trim(regexp_extract(s, '^(.*?[.;])(?:\s|$)', 1)) ELSE s[:240] END) END AS sentence, sha256(trim(n)) AS line FROM f""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM rm",
    "structural_completeness": f"WITH {_METRICS} SELECT *, round(covered / total::DOUBLE, 6) AS value, covered = total AS passed FROM st",
    "refusal_calibration": f"SELECT o_orderkey AS query_id, (({_CONFIDENCE} = 'insufficient') = (o_orderkey % 4 = 0))::INT::DOUBLE AS value, ({_CONFIDENCE} = 'insufficient') = (o_orderkey % 4 = 0) AS passed FROM orders",
    "entity_grounding": """WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, 1 + (l_suppkey % 7 = l_suppkey % 3)::INT + (l_linenumber < 4)::INT AS grounded FROM lineitem)
        SELECT query_id, grounded::BIGINT AS grounded, 3::BIGINT AS total, round(grounded / 3.0::DOUBLE, 6) AS value, grounded = 3 AS passed FROM g""",
    "example_scores": f"""WITH {_METRICS}, a AS (SELECT o_orderkey AS query_id, 'refusal_calibration' AS metric, (({_CONFIDENCE} = 'insufficient') = (o_orderkey % 4 = 0))::INT::DOUBLE AS value, ({_CONFIDENCE} = 'insufficient') = (o_orderkey % 4 = 0) AS passed FROM orders
            UNION ALL SELECT query_id, 'structural_completeness', round(covered / total::DOUBLE, 6), covered = total FROM st UNION ALL SELECT query_id, 'precision', precision, precision_passed FROM rm UNION ALL SELECT query_id, 'recall', recall, recall_passed FROM rm)
        SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (WHERE passed) AS passed FROM a JOIN orders ON o_orderkey = query_id WHERE metric = 'refusal_calibration' OR o_orderkey % 4 > 0 GROUP BY metric""",
    "refusal_sweep": """WITH s AS (SELECT quality = 0 AS y, least(1, n_chars / 20000.0::DOUBLE) AS score, threshold::DOUBLE AS threshold FROM documents JOIN labels USING (doc_id), unnest([0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3]) u(threshold)),
        c AS (SELECT threshold, count(*) FILTER (WHERE y AND score < threshold) AS tp, count(*) FILTER (WHERE NOT y AND score < threshold) AS fp, count(*) FILTER (WHERE NOT y AND score >= threshold) AS tn, count(*) FILTER (WHERE y AND score >= threshold) AS fn FROM s GROUP BY threshold)
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 1 END AS recall, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp)::DOUBLE, 6) ELSE 1 END AS coverage FROM c""",
    "agent_aggregate": """WITH t AS (SELECT conv_id, max_by(role, turn) AS last, count(*) AS n, count(*) FILTER (WHERE len(coalesce(text, '')) < 200) AS e FROM conversations GROUP BY conv_id)
        SELECT 'run-' || (conv_id % 3) AS run_id, count(*) AS n, round(avg((last = 'assistant')::INT), 6) AS pass_rate, round(avg(n), 6) AS avg_calls, round(avg(e), 6) AS avg_errors, round(avg((last = 'assistant')::INT), 6) AS finalize_rate,
            round(avg((last <> 'assistant' AND n > 4)::INT), 6) AS budget_rate FROM t GROUP BY ALL""",
    "run_report": f"""WITH {evaluation._SC}, ex AS (SELECT run_id, example_id, bool_and(passed) AS p FROM sc GROUP BY ALL), pr AS (SELECT run_id, round(avg(p::INT), 6) AS pass_rate FROM ex GROUP BY run_id)
        SELECT run_id, '# ' || run_id || chr(10) || chr(10) || 'Pass rate: ' || printf('%.3f', any_value(pass_rate)) || chr(10) || chr(10) || '| metric | mean | n |' || chr(10) || '|---|---|---|' || chr(10)
            || string_agg('| ' || metric || ' | ' || printf('%.3f', mean) || ' | ' || n || ' |', chr(10) ORDER BY metric) AS report FROM ra JOIN pr USING (run_id) GROUP BY run_id""",
    "run_report_full": f"""WITH {evaluation._SC}, e AS (SELECT run_id, example_id, metric, ['lookup', 'calculation', 'reference'][example_id % 3 + 1] AS category, round(avg(value), 6) AS value, bool_and(passed) AS passed FROM sc GROUP BY ALL),
        x AS (SELECT run_id, example_id, category, bool_and(passed) AS ok, round(avg(value), 6) AS mean FROM e GROUP BY ALL), hd AS (SELECT run_id, count(*) FILTER (WHERE ok) AS k, count(*) AS n FROM x GROUP BY run_id),
        me AS (SELECT run_id, string_agg(l, '' ORDER BY metric) AS t FROM (SELECT run_id, metric, '| ' || metric || ' | ' || printf('%.6f', round(avg(value), 6)) || ' | 0.100000 | ' || count(*) FILTER (WHERE passed) || '/' || count(*) || ' |' || chr(10) AS l FROM e GROUP BY run_id, metric) GROUP BY run_id),
        ca AS (SELECT run_id, string_agg(l, '' ORDER BY category, metric) AS t FROM (SELECT run_id, category, metric, '| ' || category || ' | ' || metric || ' | ' || printf('%.6f', round(avg(value), 6)) || ' | ' || count(*) FILTER (WHERE passed) || '/' || count(*) || ' |' || chr(10) AS l FROM e GROUP BY run_id, category, metric) GROUP BY run_id),
        wo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mean, example_id) AS place FROM x WHERE NOT ok) WHERE place <= 10),
        fa AS (SELECT run_id, string_agg(l, '' ORDER BY place) AS t FROM (SELECT run_id, place, '### ' || example_id || ' (' || any_value(wo.category) || ')' || chr(10) || '| metric | value | threshold | passed |' || chr(10) || '|---|---|---|---|' || chr(10)
            || string_agg('| ' || metric || ' | ' || printf('%.6f', value) || ' | 0.100000 | ' || CASE WHEN passed THEN 'yes' ELSE 'no' END || ' |' || chr(10), '' ORDER BY metric) AS l FROM wo JOIN e USING (run_id, example_id) GROUP BY run_id, place, example_id) GROUP BY run_id),
        mf AS (SELECT l_returnflag AS run_id, '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| last_example | ' || max(l_orderkey) || ' |' || chr(10) || '| n_lines | ' || count(*) || ' |' || chr(10) AS t FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
        rp AS (SELECT run_id, '# Run ' || run_id || chr(10) || chr(10) || 'Passed: ' || k || ' of ' || n || ' examples' || chr(10) || chr(10) || '## Configuration' || chr(10) || coalesce(mf.t, '') || chr(10) || '## Metrics' || chr(10) || '| metric | mean | threshold | passed |' || chr(10) || '|---|---|---|---|' || chr(10)
            || me.t || chr(10) || '## Categories' || chr(10) || '| category | metric | mean | passed |' || chr(10) || '|---|---|---|---|' || chr(10) || ca.t || chr(10) || '## Failing examples' || chr(10) || coalesce(fa.t, 'None' || chr(10)) AS report
            FROM hd JOIN me USING (run_id) JOIN ca USING (run_id) LEFT JOIN fa USING (run_id) LEFT JOIN mf USING (run_id))
        SELECT run_id, len(report) AS n_chars, sha256(report) AS digest FROM rp""",
    "run_pivot_any": """WITH s AS (SELECT o_orderpriority || ' ' || o_orderstatus AS run_id, o_totalprice / 1000 AS price, o_custkey::DOUBLE AS customer FROM orders),
        m AS (SELECT run_id, 'price' AS metric, round(avg(price), 4) AS mean FROM s GROUP BY 1 UNION ALL SELECT run_id, 'customer', round(avg(customer), 4) FROM s GROUP BY 1)
        SELECT metric, count(*) OVER (PARTITION BY metric) AS n_runs, run_id, mean FROM m""",
    "ablation_matrix": """WITH g(config, mode, pinned, gate, enforcer) AS (VALUES ('baseline', 'hybrid', true, true, true), ('bm25-only', 'bm25_only', true, true, true), ('vector-only', 'vector_only', true, true, true), ('no-graph', 'hybrid_no_graph', true, true, true),
            ('no-pinned', 'hybrid', false, true, true), ('no-refusal', 'hybrid', true, false, true), ('no-citation-enforcer', 'hybrid', true, true, false))
        SELECT config, mode, count(*) FILTER (WHERE gate AND o_orderstatus = 'F') AS refused, count(*) FILTER (WHERE pinned AND o_totalprice > 150000 AND NOT (gate AND o_orderstatus = 'F')) AS calculated, count(*) FILTER (WHERE enforcer) AS checked FROM orders, g GROUP BY ALL""",
    "table_recovery": """WITH o AS (SELECT l_orderkey AS d, count(*) AS n FROM lineitem GROUP BY 1),
        f AS (SELECT d, CASE WHEN d % 2 = 0 THEN 3 ELSE 2 END AS n_tables, CASE WHEN d % 3 = 0 THEN (3 + 2 * n) / (3 + 3 * n)::DOUBLE ELSE 1 END AS f1a FROM o)
        SELECT n_tables, round((f1a + 1) / n_tables, 6) AS f1, count(*) AS n, sum(d)::BIGINT AS docs FROM f GROUP BY ALL""",
    "parser_recall": """WITH o AS (SELECT DISTINCT l_orderkey AS d FROM lineitem),
        v AS (SELECT 'formulas' AS metric, CASE WHEN d % 3 = 0 THEN 1 ELSE 0.5 END AS value FROM o UNION ALL SELECT 'references', round(2 / 3.0::DOUBLE, 6) FROM o UNION ALL SELECT 'sections', round(2 / 3.0::DOUBLE, 6) FROM o)
        SELECT metric, value, count(*) AS n FROM v GROUP BY ALL""",
    "per_page": "SELECT doc_id, round(n_chars * 0.25::DOUBLE / greatest(n_chars // 1800, 1), 4) AS ms_per_page, round(n_chars * 0.0001::DOUBLE / greatest(n_chars // 1800, 1), 6) AS cost_per_page FROM documents",
}
