"""Questions to answers: gate, inputs, evidence, calculation, summary, each a table joined to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.operators import answers as A
from gneiss.operators import calculation as C
from gneiss.operators import citations as K
from gneiss.operators import evidence as E
from gneiss.operators import metrics as M
from gneiss.operators import provenance as V
from gneiss.session import checkpointed

#: References that a calculation must have among its hits, and the numbers of a request as decimals.
REQUIRED = ("A-27", "M-1", "B-12")
DECIMALS = {"p_mpa": "decimal(7,3)", "diameter_mm": "decimal(8,3)", "ca_mm": "decimal(6,2)"}


def evidence(queries: DataFrame, hits: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``query_id, missing``: required references that no hit of a query covers (itself, a part or a parent of it), in order."""
    wanted = queries.select("query_id", F.explode(F.array(*map(F.lit, required))).alias("ref"))
    met = M.matched(hits.select("query_id", "ref"), wanted, "query_id").select("query_id", F.col("right_ref").alias("ref")).distinct()
    left = wanted.join(met, ["query_id", "ref"], "left_anti")
    place = F.array_position(F.array(*map(F.lit, required)), F.col("ref"))
    return left.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "ref"))).alias("m")).select("query_id", F.array_join("m.ref", ", ").alias("missing"))


def summary(hits: DataFrame) -> DataFrame:
    """``query_id, answer``: a line with its reference for each of the best four sources."""
    lines = A.summaries(hits).filter("line <> ''")
    text = F.concat(F.lit("["), F.coalesce("ref", F.lit("")), F.lit("] "), "line")
    return lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("l")).select("query_id", F.array_join("l.t", "\n").alias("answer"))


def _worked(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """All that is known of each query: its gate, request, calculation, evidence and summary, and the reason of its refusal."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("max_score"))
    asked = C.parse_requests(E.gate(queries.join(best, "query_id", "left")))
    typed = asked.withColumns({c: F.col(c).cast(t) for c, t in DECIMALS.items()})
    done = C.summaries(C.calculate(typed))
    known = done.join(evidence(queries, hits), "query_id", "left").join(summary(hits), "query_id", "left")
    calculates = F.col("component").isNotNull()
    reason = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(calculates & F.col("missing").isNotNull(), F.concat(F.lit("evidence: "), "missing"))
        .when(calculates & F.col("error_code").isNotNull(), F.concat(F.lit("calculation: "), "error_code")).when(~calculates & F.col("answer").isNull(), "no context")
    )
    return known.withColumn("refusal_reason", reason)


def _responses(worked: DataFrame) -> DataFrame:
    refused, calculates = F.col("refusal_reason").isNotNull(), F.col("component").isNotNull()
    return worked.select(
        "query_id", F.when(refused, "refusal").when(calculates, "calculation").otherwise("summary").alias("kind"),
        F.when(refused, "insufficient").when(calculates, "high").otherwise("medium").alias("confidence"), "refusal_reason",
        F.when(~refused, F.when(calculates, F.col("summary")).otherwise(F.col("answer"))).alias("answer"),
    )


def respond(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, kind, confidence, refusal_reason, answer``: one row per query, whatever is wrong with it.

    ``queries``: query_id, query; ``hits``: query_id, ref, text, rank, score.  In order: the gate; a question that gives all inputs of a
    calculation needs its evidence and is calculated, its first error being the reason of a refusal; any other is
    answered from its hits, and refused if they say nothing.
    """
    return _responses(_worked(queries, hits))


def respond_with_citations(queries: DataFrame, hits: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``respond`` to its end: responses, and their citations with ``resolved_id, issue``.

    ``hits`` have an element_id too; ``elements``: element_id, element_type, ref, content, ord, the corpus.  A calculation cites what each of its steps
    and inputs is taken from, a summary the line of each of its sources.  A calculation that cannot be cited is refused.  Every
    citation is checked against the query's hits and the corpus; high confidence is lowered to medium where one does not hold.
    Citations: query_id, cite_no, step, input (null for a step's own, and both for a summary's), ref, source_id, quote.
    """
    worked = checkpointed(_worked(queries, hits))
    computed = worked.filter("refusal_reason is null and component is not null")
    cited = checkpointed(K.build(V.citations_of(V.steps(computed, ["query_id"]), ["query_id"]), elements))
    lost = cited.filter("quote is null").select("query_id").distinct().withColumn("lost", F.lit(True))
    reason = F.when(F.col("lost"), "calculation: citation").otherwise(F.col("refusal_reason"))
    worked = worked.join(lost, "query_id", "left").withColumn("refusal_reason", reason)
    responses = checkpointed(_responses(worked))
    own = cited.join(lost, "query_id", "left_anti").select("query_id", "step", "input", "ref", "source_id", "quote", F.col("place"))
    told = A.summaries(hits).filter("line <> ''").join(responses.filter("kind = 'summary'").select("query_id"), "query_id", "left_semi")
    first = hits.groupBy("query_id", "ref").agg(F.min_by("element_id", "rank").alias("source_id"))
    said = told.join(first, ["query_id", "ref"]).select("query_id", F.lit(None).cast("int").alias("step"), F.lit(None).cast("string").alias("input"), "ref", "source_id", F.col("line").alias("quote"), "place")
    number = F.row_number().over(W.partitionBy("query_id").orderBy("step", "place", "ref"))
    every = own.unionByName(said).withColumn("cite_no", number).drop("place")
    chunks = hits.select("query_id", "element_id", "ref", F.col("text").alias("content"), "rank")
    checked = checkpointed(K.validate(every, chunks, elements))
    return K.downgraded(responses, checked), checked
