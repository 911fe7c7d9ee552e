"""Queries of the parsing, evidence, evaluation and browsing families, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.jobs import calculations
from gneiss.jobs.retrieval import CONTENT, bm25_sql, documents, index, items
from gneiss.operators import audit as A
from gneiss.operators import browse as B
from gneiss.operators import evidence as E
from gneiss.operators import parsing as P
from gneiss.operators import retrieval as R
from gneiss.session import table
from gneiss.sources.payloads import payload_text
from gneiss.streaming import windows

# --- Parsing ---------------------------------------------------------------------------------------


def _dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a markdown document: a heading per turn, nested three deep, and a reference to the turn before."""
    turns = table(spark, sf, "conversations")
    md = F.expr("concat(repeat('#', cast(2 + turn % 3 as int)), ' **A-', turn, '** ', role, '\\n', coalesce(text, ''), '\\nSee A-', turn - 1, ' for what came before.')")
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", md.alias("md")))).alias("t")).select("doc_id", F.array_join("t.md", "\n").alias("text"))


def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return P.sections(_dialogues(spark, sf)).select("doc_id", "section", "line", "level", "title", "page", "paragraph_ref", "element_id", "parent_id", F.length("content").alias("n_chars"))


def xref_extract(spark: SparkSession, sf: str) -> DataFrame:
    s = P.sections(_dialogues(spark, sf)).withColumn("ord", F.col("line"))
    return P.cross_references(s.select("doc_id", "element_id", "content"), P.reference_index(s))


def table_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines written as one pipe table per order, and read back cell by cell."""
    lines = table(spark, sf, "lineitem")
    row = F.expr("concat('| ', l_linenumber, ' | ', l_partkey, ' | ', l_returnflag, ' |')")
    text = F.concat(F.lit("## B-1 Lines\n\n| Line | Part | Flag |\n|---|:---|---|\n"), F.array_join("r.md", "\n"), F.lit("\n\nEnd of table."))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", row.alias("md")))).alias("r")).select("doc_id", text.alias("text"))
    return P.table_cells(P.sections(docs)).select("doc_id", "row", "col", "text")


def table_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a fused cell in every row and every second row wrapped, repaired and read back."""
    lines = table(spark, sf, "lineitem")
    row = F.expr("""concat('| ', l_linenumber, ' | Flag ', l_returnflag, l_partkey, ' |  | a | b | c | d | e |',
                           case when l_linenumber % 2 = 0 then '\\n|  | more- |  |  |  |  |  |  |\\n|  | text | |  |  |  |  |  |' else '' end)""")
    text = F.concat(F.lit("## B-1 Lines\n| Line | Kind | Part | A | B | C | D | E |\n|---|---|---|---|---|---|---|---|\n"), F.array_join("r.md", "\n"))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", row.alias("md")))).alias("r")).select("doc_id", text.alias("text"))
    return P.repaired_tables(P.sections(docs)).filter("row > 0").select("doc_id", "row", F.array_join("cells", "|").alias("cells"))


# --- Gate, citations, metrics ------------------------------------------------------------------------


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Calculation questions with parts left out, and other materials."""
    return (
        table(spark, sf, "lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_tax + 0.02D as max_score",
            """concat('Compute the wall thickness: ', case when l_partkey % 5 = 0 then '' else 'P = 1.5 MPa, ' end, case when l_partkey % 7 = 0 then '' else 'ID=1800 mm, ' end,
                      'T=', 20 + l_orderkey % 600, '°C, ', element_at(array('SM-516 Gr 70', 'SM-240 Type 304', 'SM-999 Gr 1', 'Inconel 625', 'Titanium Grade 5', 'steel'), cast(l_suppkey % 6 as int) + 1),
                      case when l_linenumber = 3 then '' else ', joint Type 1' end, case when l_returnflag = 'R' then '' else ', full RT' end) as query""",
        )
    )


def refusal_gate(spark: SparkSession, sf: str) -> DataFrame:
    out = E.gate(_sentences(spark, sf))
    return out.groupBy("is_calculation", F.coalesce("refusal", F.lit("answered")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the turn before."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("context", before).filter("role = 'assistant'").select(F.expr("conv_id * 1000 + turn").alias("id"), F.col("text").alias("answer"), "context")


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    return _exchanges(spark, sf).select("id", E.quote_match(F.col("answer"), F.col("context"), 0.3).alias("verbatim"), E.quote_match(F.col("context"), F.concat_ws(" ", "context", "answer")).alias("contained"))


def ref_compatible(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").selectExpr("concat('Table A-', l_linenumber) as cited", "concat('a-', l_partkey % 30, case when l_suppkey % 2 = 0 then '(c)(1)' else '' end) as source").distinct()
    return refs.select("cited", "source", F.expr(E.compatible("cited", "source")).alias("ok"))


def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return E.faithfulness(_exchanges(spark, sf))


def cell_f1(spark: SparkSession, sf: str) -> DataFrame:
    both = _exchanges(spark, sf).select("id", E.words(F.col("answer")).alias("a"), E.words(F.col("context")).alias("b"))
    return both.select("id", F.round(F.when(F.size("a") + F.size("b") > 0, 2 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))).otherwise(1.0), 6).alias("f1"))


def precision_recall_k(spark: SparkSession, sf: str) -> DataFrame:
    found, asked = index(spark, sf), items(spark, sf)
    return E.precision_recall(found.search(asked, 10).select("query_id", "doc_id"), found.sharing(asked, 0.8))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").selectExpr("quality as label", "least(1D, n_chars / 2000D) as score")
    return E.sweep(scored, [0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3])


def calc_correctness(spark: SparkSession, sf: str) -> DataFrame:
    """Computed values against expected ones that are off by up to 3 %, under a tolerance of 2 %."""
    done = calculations.calc_thickness(spark, sf).filter("error_code is null")
    values = done.select(
        "l_orderkey", "l_linenumber", F.expr("stack(3, 't_min', t_min_mm, 't_design', t_design_mm, 'mawp', mawp_mpa) as (name, actual)")
    ).withColumn("expected", F.round(F.expr("actual * (1 + (l_linenumber % 4) * 0.01D)"), 6))
    good = F.expr("abs(actual - expected) <= greatest(0.02D, abs(expected) * 0.02D)")
    return values.groupBy("name", (F.col("l_linenumber") % 4).cast("int").alias("shift")).agg(F.count("*").alias("n"), F.count_if(good).alias("correct"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows of three runs."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_returnflag as run_id", "l_orderkey as example_id", "stack(3, 'recall', l_quantity / 50, 'citation', l_discount * 10 + 0D, 'faithfulness', l_tax * 12.5D) as (metric, value)"
    ).selectExpr("run_id", "example_id", "metric", "round(value, 6) as value", "round(value, 6) >= 0.1D as passed")


def run_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return E.run_aggregate(_scores(spark, sf))


def regression_diff(spark: SparkSession, sf: str) -> DataFrame:
    return E.regression(E.run_aggregate(_scores(spark, sf)), "A", "N", 0.001)


def run_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = _scores(spark, sf).groupBy("metric").pivot("run_id", ["A", "N", "R"]).agg(F.round(F.avg("value"), 6))
    return wide.select("metric", F.col("A").alias("run_a"), F.col("N").alias("run_n"), F.col("R").alias("run_r"))


def worst_failing(spark: SparkSession, sf: str) -> DataFrame:
    """The five failed examples with the lowest mean: a report, so it has a limit."""
    per = _scores(spark, sf).groupBy("run_id", "example_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.bool_and("passed").alias("passed"))
    return per.filter("not passed").orderBy("mean", "run_id", "example_id").limit(5).select("run_id", "example_id", "mean")


# --- Browsing, audit, transcripts ----------------------------------------------------------------------


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


def browse(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty matches of a filtered listing, by id."""
    found = table(spark, sf, "documents").filter((F.col("lang") == "en") & F.contains(F.lower("text"), F.lit("license")))
    return found.orderBy("doc_id").limit(50).select("doc_id", "source", "n_chars")


def domain_weight(spark: SparkSession, sf: str) -> DataFrame:
    """The largest weight of the topic words in each whole page; four plainer words are added, as the topic words are rare there."""
    return table(spark, sf, "pages").select("page_id", B.domain_weight(F.col("html"), B.DOMAIN | {"license": 20, "script": 15, "href": 10, "tion": 5}).alias("weight"))


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Per language three documents of different sources: first by topic words, then by length."""
    d = table(spark, sf, "documents").withColumn("stage", F.when(F.contains(F.lower("text"), F.lit("license")), 0).otherwise(1))
    one = d.withColumn("n", F.row_number().over(W.partitionBy("lang", "source").orderBy("stage", F.desc("n_chars"), "doc_id"))).filter("n = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("stage", F.desc("n_chars"), "doc_id"))).filter("rank <= 3").select("lang", "rank", "doc_id", "source")


def redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.when(F.coalesce("url", F.lit("")) == "", "<unset>").otherwise(F.concat(F.lit("<redacted:"), F.substring(F.sha2("url", 256), 1, 8), F.lit(">"))).alias("token"))


def path_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that a path breaks."""
    path = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_replace("url", r"^[a-z]+://[^/]*/?", "")).alias("path"))
    reason = F.expr("case when startswith(path, 'en/') then 'private prefix' when startswith(path, 'de/') and contains(path, 'ref') then 'private run' when path rlike '[?]page=1' then 'raw file' end")
    return path.withColumn("reason", reason).filter("reason is not null")


def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of a checkout: which must not be published."""
    where = """element_at(array('./data/private/', 'data/runs/x-asme-private/', 'data/runs/', 'logs/private/', 'data/parser_benchmark/asme/', 'docs/', 'DATA/Private_Runs/'), cast(page_id % 7 as int) + 1)"""
    name = "element_at(array('prompts.jsonl', 'output.json', 'page.html', 'request_log.jsonl'), cast(page_id % 4 as int) + 1)"
    return A.audit_paths(table(spark, sf, "pages").selectExpr("page_id", f"concat({where}, {name}) as path"), A.default_rules(spark)).select("page_id", "normalised", "rule", "reason")


def payload_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shapes in which services answer, some of them without text."""
    one = "to_json(named_struct('content', text))"
    shapes = ["to_json(named_struct('markdown', text, 'content', 'other'))", "to_json(named_struct('markdown', ' ', 'content', text))", "to_json(named_struct('result', named_struct('markdown', 5, 'content', text)))",
              f"concat('{{\"result\": {{\"chunks\": [', {one}, ', {{\"content\": \"\"}}, ', {one}, ']}}}}')", f"concat('{{\"result\": null, \"chunks\": [', {one}, ']}}')", "concat('[', doc_id, ']')", "text"]
    raw = table(spark, sf, "documents").selectExpr("doc_id", f"case doc_id % {len(shapes)} " + " ".join(f"when {i} then {s}" for i, s in enumerate(shapes)) + " end as payload")
    return payload_text(raw).select("doc_id", F.sha2("text", 256).alias("digest"), "error")


def first_seen_union(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(R.content_terms(F.col("text"))).alias("pos", "term"))
    return E.first_seen(t, "conv_id", "term", ["turn", "pos"]).groupBy("conv_id", "turn").agg(F.count("*").alias("new_terms"))


def saturation(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts with at least two successful retrieval steps, no deterministic one, and something found."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.expr("role = 'assistant' and length(text) > 0")).alias("calls"), F.count_if(F.expr("role = 'system'")).alias("deterministic"), F.max(F.length("text")).alias("found"))
    return c.select("conv_id", F.expr("calls >= 2 and deterministic = 0 and found > 0").alias("saturated"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.counts(table(spark, sf, "events"), "1 hour")


QUERIES = {f.__name__: f for f in (
    markdown_sections, xref_extract, table_parse, table_repair, refusal_gate, citation_check, ref_compatible, faithfulness, cell_f1, precision_recall_k, threshold_sweep,
    calc_correctness, run_aggregate, regression_diff, run_pivot, worst_failing, corpus_stats, browse, domain_weight, suggestions, redact, path_audit, path_rules, payload_shapes,
    first_seen_union, saturation, event_windows,
)}

_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
_FLAT = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
_EX = """x AS (SELECT conv_id * 1000 + turn AS id, text AS answer, context FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations) WHERE role = 'assistant')"""
_SC = """sc AS (SELECT run_id, example_id, metric, round(value, 6) AS value, round(value, 6) >= 0.1 AS passed FROM (
    SELECT l_returnflag AS run_id, l_orderkey AS example_id, unnest(['recall', 'citation', 'faithfulness']) AS metric, unnest([l_quantity / 50, l_discount * 10 + 0, l_tax * 12.5]) AS value FROM lineitem)),
    ra AS (SELECT run_id, metric, round(avg(value), 6) AS mean, count(*) AS n FROM sc GROUP BY ALL)"""
_TURNS = """c AS (SELECT conv_id AS doc_id, turn, role, coalesce(text, '') || chr(10) || 'See A-' || (turn - 1) || ' for what came before.' AS body FROM conversations),
    l AS (SELECT *, len(body) - len(replace(body, chr(10), '')) + 2 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS section FROM c)"""


def _match_sql(quote: str, content: str, least: float) -> str:
    q, c, f, g = _WORDS.format(quote), _WORDS.format(content), _FLAT.format(quote), _FLAT.format(content)
    return f"CASE WHEN {f} = '' THEN false ELSE contains({g}, {f}) OR len(list_intersect({q}, {c})) / len({q})::DOUBLE >= {least} END"


_MISS = ["CASE WHEN l_partkey % 5 = 0 THEN 'design pressure' END", "CASE WHEN l_partkey % 7 = 0 THEN 'inside or outside diameter' END",
         "CASE WHEN l_suppkey % 6 > 2 THEN 'supported SM material' END", "CASE WHEN l_linenumber = 3 THEN 'joint type' END", "CASE WHEN l_returnflag = 'R' THEN 'radiography extent' END"]

ORACLES = {
    "markdown_sections": f"""WITH {_TURNS} SELECT doc_id, section, line, (2 + turn % 3)::INT AS level, '**A-' || turn || '** ' || role AS title, (line // 40 + 1)::INT AS page,
        'A-' || turn AS paragraph_ref, 'sec-a-' || turn AS element_id, CASE WHEN turn % 3 > 0 THEN 'sec-a-' || (turn - 1) END AS parent_id, len(body)::INT AS n_chars
        FROM (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY turn) - n)::INT AS line FROM l)""",
    "xref_extract": "SELECT conv_id AS doc_id, 'sec-a-' || turn AS source_id, 'sec-a-' || (turn - 1) AS target_id, 'See A-' || (turn - 1) AS reference_text FROM conversations WHERE turn > 0",
    "table_parse": """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS row, [l_linenumber::VARCHAR, l_partkey::VARCHAR, l_returnflag] AS c FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey, 0, ['Line', 'Part', 'Flag'] FROM lineitem)
        SELECT doc_id, row::INT AS row, col::INT AS col, c[col + 1] AS text FROM r, range(3) t(col)""",
    "table_repair": """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag)::INT AS row,
        l_linenumber || '|Flag ' || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN ' more-text' ELSE '' END || '|' || l_partkey || '|a|b|c|d|e' AS cells FROM lineitem""",
    "refusal_gate": f"""WITH q AS (SELECT *, l_suppkey % 6 AS m, 20 + l_orderkey % 600 AS t, concat_ws(', ', {", ".join(_MISS)}) AS missing FROM lineitem),
        g AS (SELECT l_orderkey, CASE WHEN l_tax + 0.02 < 0.05 THEN 'relevance' WHEN m = 3 THEN 'unsupported material' WHEN m = 4 THEN 'generic material' WHEN m = 2 THEN 'unknown material'
            WHEN m = 0 AND t > 500 OR m = 1 AND t > 600 THEN 'temperature' WHEN missing <> '' THEN 'missing: ' || missing ELSE 'answered' END AS outcome FROM q)
        SELECT true AS is_calculation, outcome, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM g GROUP BY outcome""",
    "citation_check": f"WITH {_EX} SELECT id, {_match_sql('answer', 'context', 0.3)} AS verbatim, {_match_sql('context', chr(34) + 'both' + chr(34), 0.6)} AS contained FROM (SELECT *, concat_ws(' ', context, answer) AS both FROM x)",
    "ref_compatible": """SELECT DISTINCT cited, source, a = b OR starts_with(a, b || '(') OR starts_with(b, a || '(') AS ok FROM (
        SELECT 'Table A-' || l_linenumber AS cited, 'a-' || (l_partkey % 30) || CASE WHEN l_suppkey % 2 = 0 THEN '(c)(1)' ELSE '' END AS source,
               'A-' || l_linenumber AS a, upper('a-' || (l_partkey % 30) || CASE WHEN l_suppkey % 2 = 0 THEN '(c)(1)' ELSE '' END) AS b FROM lineitem)""",
    "faithfulness": f"""WITH {_EX}, s AS (SELECT id, lower(coalesce(context, '')) AS c, unnest(string_split(regexp_replace(answer, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM x),
        n AS (SELECT *, regexp_extract_all(s, '\\d+(?:\\.\\d+)?') AS num, list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9-]+'), lambda w: len(w) > 3)) AS need, regexp_extract_all(c, '[a-z0-9-]+') AS have FROM s WHERE trim(s) <> '')
        SELECT id, count(*) AS claims, count(*) FILTER (WHERE CASE WHEN len(num) > 0 THEN len(list_filter(num, lambda v: contains(c, v))) > 0 WHEN len(need) = 0 THEN true
            ELSE len(list_intersect(need, have)) / len(need)::DOUBLE >= 0.4 END) AS supported FROM n GROUP BY id""",
    "cell_f1": f"WITH {_EX}, w AS (SELECT id, {_WORDS.format('answer')} AS a, {_WORDS.format('context')} AS b FROM x) SELECT id, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * len(list_intersect(a, b)) / (len(a) + len(b))::DOUBLE ELSE 1 END, 6) AS f1 FROM w",
    "precision_recall_k": f"""WITH {bm25_sql(10)}, dc AS (SELECT doc_id, unnest({CONTENT}) AS term FROM documents), q0 AS (SELECT item_id AS query_id, {CONTENT} AS t FROM benchmark),
        qq AS (SELECT query_id, len(t) AS size, unnest(t) AS term FROM q0), rel AS (SELECT query_id, doc_id FROM dc JOIN qq USING (term) GROUP BY query_id, doc_id, size HAVING count(*) >= 0.8 * size),
        h AS (SELECT query_id, count(*) AS n_ranked, count(rel.doc_id) AS n_found FROM bm LEFT JOIN rel USING (query_id, doc_id) GROUP BY query_id), z AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id)
        SELECT query_id, coalesce(n_ranked, 0) AS n_ranked, coalesce(n_found, 0) AS n_found, coalesce(n_relevant, 0) AS n_relevant,
            round(CASE WHEN n_ranked > 0 THEN n_found / n_ranked::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN n_relevant > 0 THEN coalesce(n_found, 0) / n_relevant::DOUBLE ELSE 1 END, 6) AS recall FROM h FULL JOIN z USING (query_id)""",
    "threshold_sweep": """WITH s AS (SELECT quality AS label, least(1, n_chars / 2000.0::DOUBLE) AS score, threshold::DOUBLE AS threshold FROM documents JOIN labels USING (doc_id), unnest([0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3]) u(threshold)),
        c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
            count(*) FILTER (WHERE score < threshold AND label = 0) AS tn, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM s GROUP BY threshold)
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 1 END AS recall FROM c""",
    "calc_correctness": calculations.CALC + """, v AS (SELECT l_linenumber % 4 AS shift, unnest(['t_min', 't_design', 'mawp']) AS name, unnest([t_min_mm, t_design_mm, mawp_mpa]) AS actual FROM r WHERE error_code IS NULL),
        w AS (SELECT *, round(actual * (1 + shift * 0.01::DOUBLE), 6) AS expected FROM v)
        SELECT name, shift::INT AS shift, count(*) AS n, count(*) FILTER (WHERE abs(actual - expected) <= greatest(0.02::DOUBLE, abs(expected) * 0.02::DOUBLE)) AS correct FROM w GROUP BY ALL""",
    "run_aggregate": f"WITH {_SC}, ex AS (SELECT run_id, example_id, bool_and(passed) AS p FROM sc GROUP BY ALL), pr AS (SELECT run_id, round(avg(p::INT), 6) AS pass_rate FROM ex GROUP BY run_id) SELECT run_id, metric, mean, n, pass_rate FROM ra JOIN pr USING (run_id)",
    "regression_diff": f"""WITH {_SC}, d AS (SELECT b.metric, round(coalesce(c.mean, 0) - b.mean, 6) AS delta FROM ra b LEFT JOIN ra c ON c.metric = b.metric AND c.run_id = 'N' WHERE b.run_id = 'A')
        SELECT metric, delta, CASE WHEN delta < -0.001 THEN 'regressed' WHEN delta > 0.001 THEN 'improved' ELSE 'same' END AS verdict FROM d""",
    "run_pivot": f"WITH {_SC} SELECT metric, max(mean) FILTER (WHERE run_id = 'A') AS run_a, max(mean) FILTER (WHERE run_id = 'N') AS run_n, max(mean) FILTER (WHERE run_id = 'R') AS run_r FROM ra GROUP BY metric",
    "worst_failing": f"WITH {_SC} SELECT run_id, example_id, mean FROM (SELECT run_id, example_id, round(avg(value), 6) AS mean, bool_and(passed) AS p FROM sc GROUP BY ALL) WHERE NOT p ORDER BY mean, run_id, example_id LIMIT 5",
    "corpus_stats": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(DISTINCT text) AS texts FROM documents GROUP BY ALL",
    "browse": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'license') ORDER BY doc_id LIMIT 50",
    "domain_weight": "SELECT page_id, greatest(0, " + ", ".join(f"CASE WHEN contains(lower(html), '{w}') THEN {v} ELSE 0 END" for w, v in (B.DOMAIN | {"license": 20, "script": 15, "href": 10, "tion": 5}).items()) + ")::INT AS weight FROM pages",
    "suggestions": """WITH d AS (SELECT *, CASE WHEN contains(lower(text), 'license') THEN 0 ELSE 1 END AS stage FROM documents),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY stage, n_chars DESC, doc_id) AS n FROM d) WHERE n = 1)
        SELECT lang, rank::INT AS rank, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY stage, n_chars DESC, doc_id) AS rank FROM o) WHERE rank <= 3""",
    "redact": "SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '<unset>' ELSE '<redacted:' || sha256(url)[:8] || '>' END AS token FROM pages",
    "path_audit": """SELECT * FROM (SELECT page_id, path, CASE WHEN starts_with(path, 'en/') THEN 'private prefix' WHEN starts_with(path, 'de/') AND contains(path, 'ref') THEN 'private run' WHEN contains(path, '?page=1') THEN 'raw file' END AS reason
        FROM (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://[^/]*/?', '')) AS path FROM pages)) WHERE reason IS NOT NULL""",
    "path_rules": """WITH p AS (SELECT page_id, ['data/private/', 'data/runs/x-asme-private/', 'data/runs/', 'logs/private/', 'data/parser_benchmark/asme/', 'docs/', 'DATA/Private_Runs/'][page_id % 7 + 1] AS d,
            ['prompts.jsonl', 'output.json', 'page.html', 'request_log.jsonl'][page_id % 4 + 1] AS f, page_id % 7 AS w FROM pages),
        r AS (SELECT page_id, d || f AS normalised, CASE WHEN w IN (0, 6) THEN 1 WHEN w = 1 THEN 2 WHEN w IN (3, 4) AND f IN ('prompts.jsonl', 'request_log.jsonl') THEN 3 WHEN w = 4 AND f = 'output.json' THEN 4 END AS rule FROM p)
        SELECT page_id, normalised, rule::INT AS rule, ['private path', 'private run', 'raw private file', 'private parser output'][rule] AS reason FROM r WHERE rule IS NOT NULL""",
    "payload_shapes": """SELECT doc_id, sha256(CASE WHEN doc_id % 7 IN (5, 6) OR trim(text, ' ') = '' THEN NULL WHEN doc_id % 7 = 3 THEN text || chr(10) || chr(10) || text ELSE text END) AS digest,
        CASE WHEN doc_id % 7 = 5 THEN 'not an object' WHEN doc_id % 7 = 6 THEN 'not JSON' WHEN trim(text, ' ') = '' THEN 'no text' END AS error FROM documents""",
    "first_seen_union": f"WITH t AS (SELECT conv_id, turn, unnest({CONTENT}) AS term FROM conversations), f AS (SELECT conv_id, term, min(turn) AS turn FROM t GROUP BY ALL) SELECT conv_id, turn, count(*) AS new_terms FROM f GROUP BY ALL",
    "saturation": "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant' AND len(text) > 0) >= 2 AND count(*) FILTER (WHERE role = 'system') = 0 AND max(len(text)) > 0 AS saturated FROM conversations GROUP BY conv_id",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
