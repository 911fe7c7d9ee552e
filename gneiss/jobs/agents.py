"""Queries of scripted runs, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.jobs import retrieval as J
from gneiss.operators import agent as A
from gneiss.session import table

STRESS, OTHER = "What is the allowable stress of the material in the table?", "Describe the part and how it is made"
_ARGS = (
    "to_json(named_struct('query', item, 'top_k', 3))", "to_json(named_struct('paragraph_ref', lower(region), 'max_hops', 2))", """'{"paragraph_ref": "nowhere"}'""",
    """'{"kind": "allowable_stress", "key": "SM-516 Gr 70", "temp_c": 350}'""",
    """'{"component": "sphere", "P_mpa": 1, "design_temp_c": 900, "inside_diameter_mm": 900, "material": "SM-105", "joint_type": "1", "rt_level": "full"}'""",
    """concat('{"component": "shell", ', if(conv_id % 4 = 0, '"P_mpa": 1.5, ', ''), '"design_temp_c": 350, "inside_diameter_mm": 1800, "material": "SM-516 Gr 70", "joint_type": 1, "rt_level": "full"}')""",
    "'{}'", """'{"query": "  "}'""", """'{"response": {"answer": "no source", "confidence": "medium"}}'""", """'{"response": {"answer": "done", "confidence": "medium", "citations": ["A-1"]}}'""",
)
_TOOLS = "array('retrieve_context', 'graph_lookup', 'graph_lookup', 'pinned_lookup', 'calculate', 'calculate', 'dance', 'retrieve_context', 'finalize', 'finalize')"


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each turn of a conversation decides; benchmark items are looked for, regions are looked up with their countries."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "cast((conv_id * 5 + turn * 3 + coalesce(length(text), 0)) % 10 as int) as k", "conv_id % 40 as item_id", "conv_id % 5 as r_regionkey")
    items = table(spark, sf, "benchmark").selectExpr("item_id", "text as item")
    region = table(spark, sf, "region").selectExpr("r_regionkey", "r_name as region")
    said = turns.join(items, "item_id", "left").join(region, "r_regionkey", "left")
    args = F.expr("case k " + " ".join(f"when {i} then {a}" for i, a in enumerate(_ARGS)) + " end")
    scripts = said.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.expr(f"element_at({_TOOLS}, k + 1)").alias("tool"), args.alias("args"))
    queries = turns.select(F.col("conv_id").alias("query_id")).distinct().withColumn("query", F.when(F.col("query_id") % 3 == 0, STRESS).otherwise(OTHER))
    nations = table(spark, sf, "nation").selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst")
    nodes = region.selectExpr("concat('r', r_regionkey) as id", "region as ref")
    chunks = table(spark, sf, "documents").selectExpr("doc_id", "source as ref", "text")
    return A.run(queries, scripts, A.Tools(J.index(spark, sf).search, chunks, nodes, nations))


def agent_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)[0].select("query_id", "kind", "by", "n_steps", "n_errors", "n_chunks", "confidence", "refusal_reason", F.col("answer").isNotNull().alias("answered"))


def agent_steps(spark: SparkSession, sf: str) -> DataFrame:
    """How often each tool is called at each step, and fails."""
    steps = _runs(spark, sf)[1]
    return steps.groupBy("step", "tool", "auto").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.sum("query_id").alias("queries"))


QUERIES = {f.__name__: f for f in (agent_outcomes, agent_steps)}

_RUNS = f"""WITH {J.bm25_sql(20, f"SELECT item_id::VARCHAR AS query_id, text FROM benchmark UNION ALL SELECT 'stress', '{STRESS}' UNION ALL SELECT 'other', '{OTHER}'")},
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, (conv_id * 5 + turn * 3 + coalesce(length(text), 0)) % 10 AS k FROM conversations),
    u AS (SELECT * FROM (SELECT * FROM t UNION ALL SELECT conv_id, count(*), NULL FROM t GROUP BY conv_id) WHERE pos <= 8),
    hits AS (SELECT query_id, count(*) AS n FROM bm GROUP BY query_id),
    a AS (SELECT u.*, CASE WHEN conv_id % 3 = 0 THEN 'stress' ELSE 'other' END AS q, coalesce(k IN (3, 4, 5), false)
            AND coalesce(max((k IN (0, 3, 4, 5, 7))::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS auto FROM u),
    b AS (SELECT a.*, coalesce(k IN (6, 7) OR (k = 5 AND conv_id % 4 <> 0), false) AS failed, coalesce(k = 8, false) AS refused, coalesce(k = 9, false) AS answered,
            coalesce(k <= 4 OR (k = 5 AND conv_id % 4 = 0), false) AS good, auto::INT + coalesce(k <= 8, false)::INT AS steps, coalesce(hi.n, 0) > 0 AND k = 0 AS hit, coalesce(hq.n, 0) > 0 AND auto AS auto_hit
          FROM a LEFT JOIN hits hi ON hi.query_id = (conv_id % 40)::VARCHAR LEFT JOIN hits hq ON hq.query_id = q),
    c AS (SELECT *, sum(steps) OVER w AS s_steps, sum((failed OR refused)::INT) OVER w AS s_errors, sum((good AND k <= 2)::INT + auto::INT) OVER w AS s_retr, sum((good AND k BETWEEN 3 AND 5)::INT) OVER w AS s_trust,
            sum(coalesce(hit, false)::INT + auto_hit::INT) OVER w AS s_chunks FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
    d AS (SELECT *, CASE WHEN answered THEN 'script' WHEN good AND k = 3 AND q = 'stress' THEN 'pinned_lookup' WHEN good AND k = 5 THEN 'calculate'
            WHEN good AND k <= 2 AND s_retr >= 2 AND s_trust = 0 AND s_chunks > 0 THEN 'synthesis' END AS by_ FROM c),
    f AS (SELECT *, CASE WHEN s_steps - steps >= 8 THEN 'budget_steps_exhausted' WHEN k IS NULL THEN 'decider_error' WHEN by_ IS NOT NULL THEN 'finalized' WHEN (failed OR refused) AND s_errors > 3 THEN 'tool_error_limit' END AS kind FROM d),
    z AS (SELECT conv_id, min(pos) AS last FROM f WHERE kind IS NOT NULL GROUP BY conv_id),
    g AS (SELECT f.*, last, last = pos AND kind IN ('budget_steps_exhausted', 'decider_error') AS idle FROM f JOIN z USING (conv_id) WHERE pos <= last),
    ch AS (SELECT conv_id, count(DISTINCT doc_id) AS n_chunks FROM (
        SELECT conv_id, doc_id FROM g JOIN bm ON bm.query_id = (conv_id % 40)::VARCHAR AND k = 0 AND NOT coalesce(idle, false) AND rank <= 3
        UNION ALL SELECT conv_id, doc_id FROM g JOIN bm ON bm.query_id = q AND auto AND NOT coalesce(idle, false) AND rank <= 10) GROUP BY conv_id)"""
ORACLES = {
    "agent_outcomes": _RUNS + """, o AS (SELECT conv_id AS query_id, kind, CASE WHEN kind = 'finalized' THEN by_ END AS who, CASE WHEN idle THEN s_steps - steps ELSE s_steps END::BIGINT AS n_steps,
            CASE WHEN idle THEN s_errors - (failed OR refused)::INT ELSE s_errors END::BIGINT AS n_errors, coalesce(n_chunks, 0) AS n_chunks FROM g LEFT JOIN ch USING (conv_id) WHERE pos = last)
        SELECT * EXCLUDE who, who AS "by", CASE WHEN who IS NULL THEN 'insufficient' WHEN who IN ('script', 'synthesis') THEN 'medium' ELSE 'high' END AS confidence,
            CASE WHEN who IS NOT NULL THEN NULL WHEN kind = 'budget_steps_exhausted' THEN 'no answer after ' || n_steps || ' steps' WHEN kind = 'tool_error_limit' THEN n_errors || ' tool errors' ELSE 'the script ended without an answer' END AS refusal_reason,
            who IS NOT NULL AS answered FROM o""",
    "agent_steps": _RUNS + """, s AS (SELECT conv_id, pos, 0 AS part, 'retrieve_context' AS tool, true AS auto, false AS failed FROM g WHERE auto AND NOT coalesce(idle, false)
            UNION ALL SELECT conv_id, pos, 1, ['retrieve_context', 'graph_lookup', 'graph_lookup', 'pinned_lookup', 'calculate', 'calculate', 'dance', 'retrieve_context', 'finalize'][k + 1], false, failed OR refused FROM g WHERE k <= 8 AND NOT coalesce(idle, false)),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos, part) - 1 AS step FROM s)
        SELECT step::INT AS step, tool, auto, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, sum(conv_id)::BIGINT AS queries FROM n GROUP BY ALL""",
}
