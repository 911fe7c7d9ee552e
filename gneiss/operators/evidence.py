"""Gates, citation checks and metrics as columns and set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import pinned

# Fixed patterns of the gate.
CALC_VERB = r"(?i)\b(calculate|compute|determine|find|back-?calculate)\b"
CALC_NOUN = r"(?i)\b(thickness|mawp|(?:design\s+)?pressure|wall|plate)\b"
NUMERIC = r"(?i)\b(?:P|T|R|ID|OD|CA)\s*=?\s*[\d.]+|\b[\d.]+\s*(?:MPa|mm|°C)\b"
MATERIAL = r"(?i)SM-\d+(?:\s+(?:Gr(?:ade)?|Type)\s+\w+)?"
UNSUPPORTED = r"(?i)\b(?:SA-\d+|Inconel\s+\d+)"
GENERIC = r"(?i)\b[A-Z][a-z]+\s+Grade\s+\w+"
TEMPERATURE = r"(?i)(\d+(?:\.\d+)?)\s*°?\s*C"
INPUTS = {
    "design pressure": r"(?i)(?:\bP\s*=?\s*|design\s+pressure(?:\s*=)?\s*)[\d.]+\s*MPa",
    "inside or outside diameter": r"(?i)(?:inside\s+diameter|outside\s+diameter|ID|OD)\s*=?\s*[\d.]+",
    "supported SM material": MATERIAL,
    "joint type": r"(?i)\bType\s+\d\b",
    "radiography extent": r"(?i)\b(full\s+(?:RT|radiography)|spot\s+(?:RT|radiography)|no\s+(?:RT|radiography))\b",
}
THRESHOLD = 0.05


def gate(queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``refusal``: the first rule that a query (``query, max_score``) breaks, or null.

    In order: too little relevance, a foreign or generic material, an SM material that is not tabulated, a
    temperature above its limit, and a calculation that lacks inputs.  The material table is broadcast.
    """
    spark = queries.sparkSession
    limits = spark.createDataFrame([(m, top) for m, top, _ in pinned.MATERIALS], "norm string, limit_c int")
    q = F.col("query")
    material = F.regexp_extract(q, MATERIAL.replace("(?i)", "(?i)(", 1) + ")", 1)
    norm = F.trim(F.regexp_replace(F.regexp_replace(material, "(?i)Grade", "Gr"), r"\s+", " "))
    known = queries.withColumn("norm", norm).join(F.broadcast(limits), "norm", "left")
    has = F.col("norm") != ""
    temp = F.nullif(F.regexp_extract(q, TEMPERATURE, 1), F.lit("")).cast("double")
    missing = F.array_compact(F.array(*(F.when(~q.rlike(p), F.lit(name)) for name, p in INPUTS.items())))
    calc = q.rlike(CALC_VERB) & (q.rlike(CALC_NOUN) | q.rlike(NUMERIC))
    refusal = (
        F.when(F.coalesce(F.col("max_score"), F.lit(0.0)) < threshold, "relevance").when(~has & q.rlike(UNSUPPORTED), "unsupported material")
        .when(~has & q.rlike(GENERIC), "generic material").when(has & F.col("limit_c").isNull(), "unknown material")
        .when(has & (temp > F.col("limit_c")), "temperature").when(calc & (F.size(missing) > 0), F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    return known.withColumn("is_calculation", calc).withColumn("refusal", refusal).select(*queries.columns, "is_calculation", "refusal")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " "), lambda w: w != ""))


def quote_match(quote: Column, content: Column, least: float = 0.6) -> Column:
    """A quote is in the content word for word (white space and case aside), or shares at least 60 % of its distinct words."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    shared = F.size(F.array_intersect(words(quote), words(content))) / F.size(words(quote))
    return F.when(flat(quote) == "", False).otherwise(F.contains(flat(content), flat(quote)) | (shared >= least))


def compatible(a: str, b: str) -> str:
    """SQL: references are equal, or one continues the other at a parenthesis (A-2 is not A-27)."""
    n = lambda c: f"replace(regexp_replace(upper(trim({c})), '^TABLE\\\\s+', ''), ' ', '')"
    return f"({n(a)} = {n(b)} or startswith({n(a)}, concat({n(b)}, '(')) or startswith({n(b)}, concat({n(a)}, '(')))"


def faithfulness(answers: DataFrame) -> DataFrame:
    """``id, claims, supported``: sentences of ``answer`` that ``context`` supports.

    With numbers: any of them is in the context.  Without: at least 40 % of the words of over three letters are, or there are none.
    """
    context = F.lower(F.coalesce("context", F.lit("")))
    have = F.array_distinct(F.regexp_extract_all(context, F.lit("[a-z0-9-]+"), F.lit(0)))
    s = answers.select("id", context.alias("c"), have.alias("have"), F.explode(F.split("answer", r"(?<=[.!?;])\s+")).alias("s")).filter("trim(s) <> ''")
    numbers = F.regexp_extract_all("s", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    need = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9-]+"), F.lit(0)), lambda w: F.length(w) > 3))
    ok = F.when(F.size(numbers) > 0, F.exists(numbers, lambda n: F.contains(F.col("c"), n))).when(F.size(need) == 0, True).otherwise(F.size(F.array_intersect(need, F.col("have"))) / F.size(need) >= 0.4)
    return s.withColumn("ok", ok).groupBy("id").agg(F.count("*").alias("claims"), F.count_if("ok").alias("supported"))


def precision_recall(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``query_id, n_ranked, n_relevant, n_found, precision, recall`` of rankings against relevant pairs; recall is 1 where nothing is relevant."""
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_ranked"), F.count("hit").alias("n_found"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    both = hits.join(sizes, "query_id", "full").fillna(0, ["n_ranked", "n_found", "n_relevant"])
    ratio = lambda a, b, empty: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(empty)
    return both.withColumn("precision", ratio("n_found", "n_ranked", 0.0)).withColumn("recall", ratio("n_found", "n_relevant", 1.0))


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts of ``score >= t`` against ``label`` for every threshold, from one scan: each row counts itself under all of them."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    counts = {
        "tp": "score >= threshold and label = 1", "fp": "score >= threshold and label = 0",
        "tn": "score < threshold and label = 0", "fn": "score < threshold and label = 1",
    }
    c = scored.select("label", "score", t).groupBy("threshold").agg(*(F.count_if(F.expr(x)).alias(n) for n, x in counts.items()))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round(F.col(a) / (F.col(a) + F.col(b)), 6)).otherwise(1.0)
    return c.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def run_aggregate(scores: DataFrame) -> DataFrame:
    """Per run and metric the mean, with the run's share of examples that pass every metric."""
    example = scores.groupBy("run_id", "example_id").agg(F.bool_and("passed").alias("all_passed"))
    rates = example.groupBy("run_id").agg(F.round(F.avg(F.col("all_passed").cast("int")), 6).alias("pass_rate"))
    return scores.groupBy("run_id", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n")).join(rates, "run_id")


def regression(aggregate: DataFrame, baseline: str, current: str, tolerance: float = 0.01) -> DataFrame:
    """Metrics of the baseline run with the other's change; a metric it lacks counts as 0."""
    base = aggregate.filter(F.col("run_id") == baseline).select("metric", F.col("mean").alias("base"))
    other = aggregate.filter(F.col("run_id") == current).select("metric", F.col("mean").alias("now"))
    delta = F.round(F.coalesce("now", F.lit(0.0)) - F.col("base"), 6)
    return base.join(other, "metric", "left").select("metric", delta.alias("delta"), F.when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("same").alias("verdict"))


def first_seen(steps: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """The first row of each item of a key, by ``order``."""
    w = W.partitionBy(key, item).orderBy(*order)
    return steps.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
