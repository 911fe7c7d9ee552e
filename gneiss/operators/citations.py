"""Citations against what was retrieved and against the whole corpus.

``citations``: query_id, cite_no, source_id, ref, quote.  ``chunks``: query_id, element_id, ref, content, rank, what each query
was answered from.  ``elements``: element_id, element_type, ref, content, ord, the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.answers import resolve
from gneiss.operators.evidence import compatible, quote_match
from gneiss.session import checkpointed

# Fixed pattern of a canonical reference.
CANONICAL = r"(?i)^(?:Table\s+)?(?:[A-Z]{1,5}-\d+(?:\.\d+)?(?:-\d+)?|\d{1,2}-\d+(?:\.\d+)?)(?:\([a-z0-9]+\)(?:\(\d+\))?)?$"


def bare(ref: Column) -> Column:
    """A reference in upper case without "Table" before it."""
    return F.trim(F.regexp_replace(F.upper(F.trim(ref)), r"^TABLE ", ""))


def by_reference(elements: DataFrame, *keys: str) -> DataFrame:
    """One element for each reference (in upper case) within ``keys``: a section before others, of these the first by ``ord``."""
    first = F.struct(F.col("element_type") != "section", "ord")
    best = F.min_by(F.struct("element_id", "content"), first)
    found = elements.filter("coalesce(ref, '') <> ''").groupBy(*keys, F.upper("ref").alias("ref")).agg(best.alias("e"))
    return found.select(*keys, "ref", "e.element_id", "e.content")


def validate(citations: DataFrame, chunks: DataFrame, elements: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """``citations`` with ``resolved_id, issue``; a citation without an issue is valid.

    A source is looked for among the query's chunks: by id, by the id as a reference, by the reference, and by that without
    its last ``(x)``.  Otherwise a canonical reference is looked up in the corpus, climbing to its parents; without a corpus it fails.  Then
    the references must be compatible (for a chunk) and the source must hold the quote.  A query's chunks meet its citations as
    one list (as many as it was answered from), in one equi-join; what is then known is written, and only what no chunk has meets the corpus.
    """
    hits = chunks.filter("rank is not null").groupBy("query_id").agg(F.collect_list(F.struct("rank", "element_id", "ref", "content")).alias("hits"))
    by_ref = lambda key: f"array_min(filter(hits, h -> h.ref <> '' and upper(h.ref) = {key}))"
    keys = citations.withColumns({"k_as_ref": F.upper("source_id"), "k_ref": bare(F.col("ref")), "k_parent": F.trim(F.regexp_replace(bare(F.col("ref")), r"\([A-Z0-9]+\)\s*$", ""))})
    met = keys.join(hits, "query_id", "left").withColumn("hit", F.expr(f"coalesce(array_max(filter(hits, h -> h.element_id = source_id)), {', '.join(map(by_ref, ('k_as_ref', 'k_ref', 'k_parent')))})"))
    near, canonical = F.col("hit").isNotNull(), F.coalesce(F.trim("ref").rlike(CANONICAL), F.lit(False))
    issue = (
        F.when(~near & ~canonical, "not canonical").when(~near, "no corpus" if elements is None else "unresolved")
        .when((F.coalesce(F.col("hit.ref"), F.lit("")) != "") & ~F.coalesce(F.expr(compatible("ref", "hit.ref")), F.lit(False)), "reference")
        .when(~quote_match(F.col("quote"), F.col("hit.content"), least), "quote")
    )
    told = met.select(*citations.columns, F.col("hit.element_id").alias("resolved_id"), issue.alias("issue"), F.when(~near & canonical, F.col("k_ref")).alias("k_ref"))
    if elements is None:
        return told.drop("k_ref")
    told, index = checkpointed(told), by_reference(elements)
    climbed = resolve(told.filter("k_ref is not null").select(F.col("k_ref").alias("ref")).distinct(), index.select("ref")).filter("resolved is not null").join(index.withColumnRenamed("ref", "resolved"), "resolved")
    climbed = climbed.select(F.col("ref").alias("k_ref"), F.col("element_id").alias("far_id"), "content")
    far = told.filter("k_ref is not null").drop("resolved_id", "issue").join(climbed, "k_ref", "left")
    lost = F.when(F.col("far_id").isNull(), "unresolved").when(~quote_match(F.col("quote"), F.col("content"), least), "quote")
    return told.filter("k_ref is null").drop("k_ref").unionByName(far.select(*citations.columns, F.col("far_id").alias("resolved_id"), lost.alias("issue")))


def build(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """``wanted`` (kind, ref, needle) with ``source_id, quote``: citations that quote what the corpus says, null where it does not.

    ``kind`` ``paragraph`` quotes the first sentence of the reference's element, or the reference itself where it has none; ``row`` the first line
    that holds the needle, ``material`` that or else the first line that holds its first word.  A reference without an element of its own is looked up by its parents.  Each different citation is built once.
    """
    index = by_reference(elements)
    each = wanted.select("kind", F.col("ref").alias("said"), "needle").distinct().withColumn("ref", bare(F.col("said")))
    met = resolve(each, index.select("ref")).join(index.withColumnRenamed("ref", "resolved"), "resolved", "left")
    row, word = line_with(F.col("content"), F.col("needle")), line_with(F.col("content"), F.split_part("needle", F.lit(" "), F.lit(1)))
    quote = F.when(F.col("kind") == "row", row).when(F.col("kind") == "material", F.coalesce(row, word)).when(F.col("content").isNotNull(), F.coalesce(first_sentence(F.col("content")), F.col("said")))
    known = met.select(F.col("kind").alias("k"), "said", F.col("needle").alias("n"), F.when(quote.isNotNull(), F.col("element_id")).alias("source_id"), quote.alias("quote"))
    same = (F.col("kind") == F.col("k")) & (F.col("ref") == F.col("said")) & F.col("needle").eqNullSafe(F.col("n"))
    return wanted.join(known, same, "left").select(*wanted.columns, "source_id", "quote")


def accuracy(responses: DataFrame, checked: DataFrame, least: float = 0.8) -> DataFrame:
    """``query_id, total, valid, value, passed``: the share of valid citations of each response; 1 without citations."""
    counts = checked.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if(F.col("issue").isNull()).alias("valid"))
    both = responses.select("query_id").join(counts, "query_id", "left").fillna(0, ["total", "valid"])
    value = F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(1.0)
    return both.withColumn("value", F.round(value, 6)).withColumn("passed", value >= least)


def downgraded(responses: DataFrame, checked: DataFrame) -> DataFrame:
    """``responses`` (query_id, confidence) with high confidence lowered to medium where a citation has an issue."""
    bad = checked.filter("issue is not null").select("query_id").distinct().withColumn("bad", F.lit(True))
    lowered = F.when((F.col("confidence") == "high") & F.col("bad"), "medium").otherwise(F.col("confidence"))
    return responses.join(bad, "query_id", "left").withColumn("confidence", lowered).drop("bad")


def violations(responses: DataFrame, citations: DataFrame) -> DataFrame:
    """``query_id, violation`` of responses (query_id, confidence, refusal_reason): a refusal has a reason and only a refusal has one; anything else cites something."""
    cited = citations.select("query_id").distinct().withColumn("cited", F.lit(True))
    refused = F.col("confidence") == "insufficient"
    reason = F.coalesce("refusal_reason", F.lit("")) != ""
    rule = F.when(refused & ~reason, "refusal without reason").when(~refused & reason, "reason without refusal").when(~refused & F.col("cited").isNull(), "no citation")
    return responses.join(cited, "query_id", "left").select("query_id", rule.alias("violation")).filter("violation is not null")


def first_sentence(content: Column) -> Column:
    """The first line of twenty characters or more, up to its first full stop or semicolon, else 240 characters of it."""
    # A function of two arguments would be given the line's number as the characters to trim.
    line = F.get(F.filter(F.transform(F.split(content, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20), 0)
    whole = F.regexp_extract(line, r"^(.*?[.;])(?:\s|$)", 1)
    return F.when(whole != "", F.trim(whole)).otherwise(F.substring(line, 1, 240))


def line_with(content: Column, needle: Column) -> Column:
    """The first line that holds the needle, case aside; null without one."""
    hits = F.filter(F.split(content, "\n"), lambda s: F.contains(F.lower(s), F.lower(needle)))
    return F.when((F.size(hits) > 0) & (needle != ""), F.trim(F.get(hits, 0)))
