"""Metrics of retrieval, answers and parsers as set joins; ``value`` is between 0 and 1 and ``passed`` follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern of what an answer names: references, tables, materials.
ENTITY = r"\b(?:Table\s+[A-Z]-\d+[A-Za-z]?|[A-Z]-\d+(?:\([a-z]\)(?:\(\d+\))?)?|SM-\d+(?:\s+(?:Gr|Type)\s+\w+)?)\b"
KNOWN_ENTITY = r"(?i)^(?:Table\s+)?[A-M]-\d+(?:\([a-z]\)(?:\(\d+\))?)?$"


def plain(ref: Column) -> Column:
    """A reference for comparison: upper case, without "Table" and spaces."""
    return F.replace(F.regexp_replace(F.upper(F.trim(ref)), "^TABLE ", ""), F.lit(" "), F.lit(""))


def _rungs(ref: str) -> Column:
    """The reference and its parents: what stands before each parenthesis."""
    return F.expr(f"array_distinct(transform(sequence(1, size(split({ref}, '[(]'))), i -> substring_index({ref}, '(', i)))")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, left_ref, right_ref``: pairs of different references of a key that are equal, or one of which is a parent of the other (A-2 is no parent of A-27).

    Two equi-joins on parents instead of a comparison of all pairs.
    """
    a = left.select(key, F.col("ref").alias("left_ref"), plain(F.col("ref")).alias("a")).filter("a <> ''").distinct()
    b = right.select(key, F.col("ref").alias("right_ref"), plain(F.col("ref")).alias("b")).filter("b <> ''").distinct()
    up = a.withColumn("at", F.explode(_rungs("a"))).join(b.withColumn("at", F.col("b")), [key, "at"])
    down = a.withColumn("at", F.col("a")).join(b.withColumn("at", F.explode(_rungs("b"))), [key, "at"])
    return up.select(key, "left_ref", "right_ref").union(down.select(key, "left_ref", "right_ref")).distinct()


def _alike(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ``alike``: the references of either list that match one of the other, as ``matched`` has it; a null list is empty.

    The lists hold plain references of one query, as many as it was given, so each side is brought together in one shuffle.
    """
    rungs = lambda r: f"if(contains({r}, '('), transform(sequence(1, size(split({r}, '[(]'))), i -> substring_index({r}, '(', i)), array({r}))"
    some = lambda a, b: f"filter({a}, r -> array_contains({b}_up, r) or arrays_overlap({rungs('r')}, {b}))"
    rows = rows.withColumns({n: F.expr(f"filter(array_distinct(coalesce({c}, array())), r -> r <> '')") for n, c in (("_a", left), ("_b", right))})
    rows = rows.withColumns({f"{n}_up": F.expr(f"array_distinct(flatten(transform({n}, r -> {rungs('r')})))") for n in ("_a", "_b")})
    return rows.withColumn("alike", F.expr(f"array_union({some('_a', '_b')}, {some('_b', '_a')})")).drop("_a", "_b", "_a_up", "_b_up")


def retrieval(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``query_id, precision, precision_passed, recall, recall_passed``.

    ``ranked``: query_id, rank, ref; ``expected``: query_id, ref (as often as it is listed).  Precision passes at 0.8 of what the
    expected references could reach, within 0.08 and 0.3; recall at 0.99.  Without expected references recall is 1.
    """
    top = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.collect_list(plain(F.col("ref"))).alias("refs"))
    e = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"), F.collect_list(F.struct(plain(F.col("ref")).alias("p"), F.upper("ref").alias("u"))).alias("wanted"))
    both = _alike(top.join(e, "query_id", "full"), "refs", "wanted.p")
    relevant, found = F.expr("size(filter(refs, r -> array_contains(alike, r)))"), F.expr("size(array_distinct(filter(wanted, w -> array_contains(alike, w.p)).u))")
    both = both.withColumns({"relevant": relevant, "found": found}).fillna(0, ["n", "relevant", "n_expected", "found"])
    precision = F.when(F.col("n") > 0, F.col("relevant") / F.col("n")).otherwise(0.0)
    least = F.least(F.lit(0.3), F.greatest(F.lit(0.08), 0.8 * F.col("n_expected") / k))
    recall = F.when(F.col("n_expected") > 0, F.col("found") / F.col("n_expected")).otherwise(1.0)
    return both.select(
        "query_id", F.round(precision, 6).alias("precision"), ((F.col("n") > 0) & (precision >= least)).alias("precision_passed"),
        F.round(recall, 6).alias("recall"), (recall >= 0.99).alias("recall_passed"),
    )


def structural(expected: DataFrame, present: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """``query_id, covered, total, value, passed``: the share of expected references that any present one matches; all must be.

    With ``queries`` (query_id), each of them has a row: one that expects nothing has all of it.
    """
    refs = present.groupBy("query_id").agg(F.collect_set(plain(F.col("ref"))).alias("refs"))
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("total"), F.collect_list(plain(F.col("ref"))).alias("wanted"))
    counts = _alike(wanted.join(refs, "query_id", "left"), "refs", "wanted").selectExpr("query_id", "cast(size(filter(wanted, w -> array_contains(alike, w))) as long) as covered", "total")
    if queries is not None:
        counts = queries.select("query_id").distinct().join(counts, "query_id", "left").fillna(0, ["covered", "total"])
    value = F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 6)).otherwise(1.0)
    return counts.withColumn("value", value).withColumn("passed", F.col("covered") == F.col("total"))


def refusal(responses: DataFrame) -> DataFrame:
    """``query_id, value, passed`` of responses (query_id, confidence, expected_refusal): 1 if it refuses where it should and nowhere else."""
    right = (F.col("confidence") == "insufficient").eqNullSafe(F.col("expected_refusal"))
    return responses.select("query_id", right.cast("double").alias("value"), right.alias("passed"))


def grounding(answers: DataFrame, least: float = 0.9, strict: bool = False) -> DataFrame:
    """``query_id, grounded, total, value, passed`` of answers (query_id, answer, context): entities of the answer that the context holds.

    A reference of the standard's own form counts as grounded wherever it is, unless ``strict``.
    """
    named = F.regexp_extract_all("answer", F.lit(ENTITY), F.lit(0))
    context = F.upper(F.coalesce("context", F.lit("")))
    known = F.lit(False) if strict else None
    ok = F.filter(named, lambda e: F.contains(context, F.upper(e)) | (e.rlike(KNOWN_ENTITY) if known is None else known))
    counted = answers.select("query_id", F.size(ok).cast("long").alias("grounded"), F.size(named).cast("long").alias("total"))
    value = F.when(F.col("total") > 0, F.col("grounded") / F.col("total")).otherwise(1.0)
    return counted.withColumn("value", F.round(value, 6)).withColumn("passed", value >= least)


def scored(parts: dict[str, DataFrame], golden: DataFrame) -> DataFrame:
    """``query_id, metric, value, passed``: all metrics of each example as rows; one that should be refused is judged by that alone.

    ``parts``: query_id, value, passed for each name, or with a column ``metric`` several metrics at once; ``golden``: query_id, expected_refusal.
    """
    out = None
    for name, part in parts.items():
        one = part.select("query_id", "metric" if "metric" in part.columns else F.lit(name).alias("metric"), "value", "passed")
        out = one if out is None else out.unionByName(one)
    judged = out.join(golden.select("query_id", "expected_refusal"), "query_id")
    return judged.filter((F.col("metric") == "refusal_calibration") | ~F.col("expected_refusal")).drop("expected_refusal")


def refusal_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts of refusing below each threshold, with precision, recall and the share of answerable questions that are answered.

    ``scores``: expected_refusal, score.  Each row counts itself under all thresholds in one scan.
    """
    t = scores.select("expected_refusal", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    refused, should = F.col("score") < F.col("threshold"), F.col("expected_refusal")
    c = t.groupBy("threshold").agg(
        F.count_if(should & refused).alias("tp"), F.count_if(~should & refused).alias("fp"), F.count_if(~should & ~refused).alias("tn"), F.count_if(should & ~refused).alias("fn")
    )
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6)).otherwise(1.0)
    return c.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "coverage": share("tn", "fp")})


def agent_aggregate(runs: DataFrame) -> DataFrame:
    """Per run of transcripts (run_id, passed, n_calls, n_errors, termination): pass rate, mean calls and errors, and how many finalised or ran out of steps."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return runs.groupBy("run_id").agg(
        F.count("*").alias("n"), share(F.col("passed")).alias("pass_rate"), F.round(F.avg("n_calls"), 6).alias("avg_calls"), F.round(F.avg("n_errors"), 6).alias("avg_errors"),
        share(F.col("termination") == "finalized").alias("finalize_rate"), share(F.col("termination") == "budget_steps_exhausted").alias("budget_rate"),
    )


# The configurations of an ablation, each the baseline but for one part.
ABLATIONS = (
    ("baseline", "hybrid", True, True, True), ("bm25-only", "bm25_only", True, True, True), ("vector-only", "vector_only", True, True, True), ("no-graph", "hybrid_no_graph", True, True, True),
    ("no-pinned", "hybrid", False, True, True), ("no-refusal", "hybrid", True, False, True), ("no-citation-enforcer", "hybrid", True, True, False),
)


def ablations(examples: DataFrame) -> DataFrame:
    """Every example under every configuration: ``config, mode, pinned, gate, enforcer`` beside its columns; seven rows each, made without a join."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, ("config", "mode", "pinned", "gate", "enforcer"), strict=True))) for c in ABLATIONS))
    return examples.select("*", F.inline(rows))


def table_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, n_tables, f1``: how well the cells of true tables are recovered, averaged over a document's tables.

    Both: doc_id, ord, table_id, caption, page, headers, rows.  In order, each true table takes the free predicted table that is likest (id
    10, page 2, a caption word in common 1, up to 3 for headers; the first of equals; none without likeness); cells are compared by place
    and text.  Pairs are made within a document only; the greedy choice is a fold over its true tables.
    """
    word = lambda c: f"array_distinct(filter(split(lower(coalesce({c}, '')), '\\\\s+'), w -> w <> ''))"
    norm = lambda c: rf"trim(regexp_replace({c}, '\\s+', ' '))"
    heads = lambda c: f"array_distinct(transform(coalesce({c}, array()), h -> lower(trim(h))))"
    cells = f"array_distinct(concat(transform(headers, (h, j) -> concat('-1 ', j, ' ', {norm('h')})), flatten(transform(rows, (r, i) -> transform(r, (c, j) -> concat(i, ' ', j, ' ', {norm('c')}))))))"
    side = lambda d, p: d.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("ord", "table_id", "caption", "page", "headers")), F.expr(cells).alias(f"{p}_cells"))
    pairs = side(truth, "t").join(side(predicted, "p"), "doc_id")
    overlap = f"size(array_intersect({heads('p_headers')}, {heads('t_headers')})) / greatest(size({heads('t_headers')}), 1)"
    likeness = F.expr(f"""case when upper(p_table_id) = upper(t_table_id) then 10D else 0D end + case when p_page <=> t_page then 2D else 0D end
        + case when size(array_intersect({word('p_caption')}, {word('t_caption')})) > 0 then 1D else 0D end + 3D * {overlap}""")
    both = F.expr("size(array_intersect(t_cells, p_cells))")
    f1 = F.when((F.size("t_cells") + F.size("p_cells")) > 0, 2 * both / (F.size("t_cells") + F.size("p_cells"))).otherwise(1.0)
    choice = F.struct(likeness.alias("like"), (-F.col("p_ord")).alias("early"), f1.alias("f1"))
    offered = pairs.groupBy("doc_id", "t_ord").agg(F.collect_list(choice).alias("choices"))
    every = truth.select("doc_id", F.col("ord").alias("t_ord")).join(offered, ["doc_id", "t_ord"], "left")
    listed = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t_ord", "choices"))).alias("tables"))
    fold = """aggregate(tables, named_struct('used', cast(array() as array<int>), 'sum', 0D), (s, t) -> named_struct(
          'used', concat(s.used, transform(filter(array(array_max(filter(t.choices, c -> c.like > 0 and not array_contains(s.used, c.early)))), c -> c is not null), c -> c.early)),
          'sum', s.sum + coalesce(array_max(filter(t.choices, c -> c.like > 0 and not array_contains(s.used, c.early))).f1, 0D)), s -> s.sum)"""
    return listed.select("doc_id", F.size("tables").alias("n_tables"), F.round(F.expr(fold) / F.size("tables"), 6).alias("f1"))


def _share(truth: DataFrame, hit: DataFrame, key: list[str]) -> DataFrame:
    met = truth.join(hit.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return met.groupBy("doc_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("value"))


def formula_fidelity(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, value``: the share of true formulas (doc_id, plain) that were extracted, white space aside."""
    flat = F.regexp_replace("plain", r"\s+", "").alias("flat")
    return _share(truth.select("doc_id", flat), predicted.select("doc_id", flat), ["doc_id", "flat"])


def reference_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, value``: the share of true references (doc_id, ref) that some element has, case aside."""
    flat = lambda c: F.upper(c).alias("flat")
    return _share(truth.select("doc_id", flat("ref")), predicted.select("doc_id", flat("paragraph_ref")), ["doc_id", "flat"])


def section_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``doc_id, value``: the share of true headings (doc_id, heading) that some title of the document (doc_id, title) holds, case and white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    wanted = truth.select("doc_id", flat("heading").alias("h"))
    titles = predicted.filter("title is not null").select("doc_id", flat("title").alias("t"))
    # Titles meet the headings of their own document only.
    hit = wanted.distinct().join(titles, "doc_id").filter(F.contains("t", "h")).select("doc_id", "h")
    return _share(wanted, hit, ["doc_id", "h"])


def per_page(runs: DataFrame) -> DataFrame:
    """Add ``ms_per_page, cost_per_page`` to runs (ms, cost, pages); a document without pages counts as one."""
    pages = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    return runs.withColumns({"ms_per_page": F.round(F.col("ms") / pages, 4), "cost_per_page": F.round(F.col("cost") / pages, 6)})


def report(aggregate: DataFrame) -> DataFrame:
    """``run_id, report``: a run's metrics (run_id, metric, mean, n, pass_rate) as a short Markdown text."""
    line = F.format_string("| %s | %.3f | %d |", "metric", "mean", "n")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))), lambda x: x["line"]), "\n")
    text = F.concat(F.lit("# "), "run_id", F.format_string("\n\nPass rate: %.3f\n\n| metric | mean | n |\n|---|---|---|\n", F.max("pass_rate")), body)
    return aggregate.groupBy("run_id").agg(text.alias("report"))
