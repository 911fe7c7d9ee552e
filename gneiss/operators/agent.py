"""Scripted tool-calling runs: many conversations at once, as tables.

``queries``: query_id, query.  ``scripts``: query_id, pos, tool, args, the decisions of each conversation in order; ``args`` is JSON.  A
decision is a call of one of the tools below, ``finalize`` (a call whose ``response`` is checked), or ``final`` (an answer).

Tools are functions of their arguments, so the calls of all conversations meet each tool in one join.  What follows from the results is
a state machine with few states per conversation: steps and errors so far, what was retrieved, whether a trusted tool has answered.  Each is a running
sum over at most ``max_steps`` decisions, and the first decision at which a run ends is its outcome.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.operators import calculation as C
from gneiss.operators import graph as G
from gneiss.operators import respond as R
from gneiss.session import checkpointed

#: Steps of a run, errors that it survives, and retrievals after which an answer is put together from what was found.
MAX_STEPS, MAX_ERRORS, SATURATED = 8, 3, 2
#: Chunks of a retrieval: by default, at most, and of the retrieval before a trusted tool; hops of a graph look-up at most.
TOP_K, MOST_K, FIRST_K, MOST_HOPS = 5, 20, 10, 3
RETRIEVAL, TRUSTED = ("retrieve_context", "graph_lookup"), ("pinned_lookup", "calculate")
KEYS = ["query_id", "pos", "part"]


@dataclass
class Tools:
    """What the tools work on: a search (queries, k) -> query_id, doc_id, rank, score; chunks doc_id, ref, text; a graph's nodes id, ref and edges src, dst."""

    search: Callable[[DataFrame, int], DataFrame]
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _arg(name: str) -> Column:
    return F.coalesce(F.trim(F.get_json_object("args", f"$.{name}")), F.lit(""))


def _number(name: str) -> Column:
    return F.expr(f"try_cast(nullif(get_json_object(args, '$.{name}'), '') as double)")


def _whole(name: str, default: int, most: int) -> tuple[Column, Column]:
    """A whole number from 1 to ``most``, zero and nothing being the default; and whether it is no number."""
    n = F.expr(f"try_cast(nullif(get_json_object(args, '$.{name}'), '') as int)")
    value = F.least(F.lit(most), F.greatest(F.lit(1), F.when(F.coalesce(n, F.lit(0)) == 0, default).otherwise(n)))
    return value, n.isNull() & (_arg(name) != "")


def retrieve_context(calls: DataFrame, tools: Tools) -> tuple[DataFrame, DataFrame]:
    """Results of the calls, and their chunks: keys, doc_id, rank, score.  Equal texts are searched once.

    A text's hits are one value, of which each call takes the first; chunks are rows only where they are asked for.
    """
    k, bad = _whole("top_k", TOP_K, MOST_K)
    asked = calls.filter("tool = 'retrieve_context'").select(*KEYS, "tool", _arg("query").alias("text"), k.alias("k"), bad.alias("bad"))
    error = F.when(F.col("text") == "", "retrieve_context: query is required").when(F.col("bad"), "retrieve_context: top_k is no number")
    asked = asked.withColumn("error", error)
    good = asked.filter("error is null")
    hits = tools.search(good.select(F.col("text").alias("query_id"), "text").distinct(), MOST_K)
    hits = checkpointed(hits.groupBy(F.col("query_id").alias("text")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits")))
    own = F.filter("hits", lambda h: h["rank"] <= F.col("k"))
    # A text with an error, which is none that was searched or one of another call, meets no hits.
    met = asked.withColumn("text", F.when(F.col("error").isNull(), F.col("text"))).join(hits, "text", "left").withColumn("hits", own)
    out = met.withColumn("n", F.coalesce(F.size("hits"), F.lit(0)))
    output = F.when(F.col("error").isNull(), F.to_json(F.struct("n", F.coalesce(F.col("hits")["doc_id"], F.array().cast("array<long>")).alias("chunks"))))
    chunks = met.select(*KEYS, F.explode("hits").alias("h")).select(*KEYS, "h.doc_id", "h.rank", "h.score")
    return out.select(*KEYS, "error", (F.col("n") > 0).alias("found"), output.alias("output")), chunks


def find_by_reference(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` (with a column ref) joined with the ids of the nodes of that reference, whatever its case."""
    index = nodes.filter("coalesce(ref, '') <> ''").select(F.upper("ref").alias("key"), "id")
    return refs.withColumn("key", F.upper("ref")).join(index, "key").drop("key")


def graph_lookup(calls: DataFrame, tools: Tools) -> DataFrame:
    """Seeds of a reference, how many nodes are within the hops asked for, in either direction, and how many edges leave the seeds."""
    hops, bad = _whole("max_hops", 1, MOST_HOPS)
    asked = calls.filter("tool = 'graph_lookup'").select(*KEYS, _arg("paragraph_ref").alias("ref"), hops.alias("hops"), bad.alias("bad"))
    error = F.when(F.col("ref") == "", "graph_lookup: paragraph_ref is required").when(F.col("bad"), "graph_lookup: max_hops is no number")
    asked = asked.withColumn("error", error)
    seeds = checkpointed(find_by_reference(tools.nodes, asked.filter("error is null").select("ref", "hops").distinct()))
    sizes = None
    for depth in range(1, MOST_HOPS + 1):
        start = seeds.filter(F.col("hops") == depth).select(F.col("ref").alias("query_id"), "id", F.lit(1.0).alias("score"))
        one = G.expand(start, tools.edges, depth).groupBy(F.col("query_id").alias("ref")).agg(F.countDistinct("id").alias("n")).withColumn("hops", F.lit(depth))
        sizes = one if sizes is None else sizes.unionByName(one)
    out = tools.edges.select("src", "dst").join(seeds.withColumnRenamed("id", "src"), "src").groupBy("ref", "hops").agg(F.count("*").alias("edges"))
    ids = seeds.groupBy("ref", "hops").agg(F.array_sort(F.collect_set("id")).alias("seeds"))
    told = asked.join(ids, ["ref", "hops"], "left").join(sizes, ["ref", "hops"], "left").join(out, ["ref", "hops"], "left").fillna(0, ["n", "edges"])
    output = F.when(F.col("error").isNull(), F.to_json(F.struct(F.coalesce("seeds", F.array().cast("array<string>")).alias("seeds"), F.col("n").alias("expanded"), "edges")))
    return told.select(*KEYS, "error", (F.col("n") > 0).alias("found"), output.alias("output"))


def pinned_lookup(calls: DataFrame) -> DataFrame:
    """A row of the trusted tables: a material, its stress at a temperature, or a joint efficiency; results with ``answer`` and ``kind``."""
    temp = F.coalesce(_number("temp_c"), F.lit(0.0))
    a = calls.filter("tool = 'pinned_lookup'").select(*KEYS, F.lower(_arg("kind")).alias("kind"), _arg("key").alias("key"), temp.alias("temp_c"), _number("temp_c").isNull().alias("_none"), _arg("temp_c").alias("_temp"), _arg("rt_level").alias("rt"))
    a = a.withColumns({"material": F.col("key"), "joint_type": F.expr(C.coerced_joint("key")), "rt_level": F.expr(C.normalise_rt("rt"))})
    t = C.with_efficiency(C.with_stress(a))
    joint = F.col("kind") == "joint_efficiency"
    error = (
        F.when(F.col("key") == "", "pinned_lookup: key is required").when(~F.col("kind").isin("material", "allowable_stress", "joint_efficiency"), "pinned_lookup: unknown kind")
        .when((F.col("kind") == "allowable_stress") & F.col("_none") & (F.col("_temp") != ""), "pinned_lookup: temp_c is no number")
        .when(joint & (F.col("rt") == ""), "pinned_lookup: rt_level is required").when(joint & F.col("joint_type").isNull(), "pinned_lookup: no joint type")
    )
    found = F.when(F.col("kind") == "material", F.col("known_material")).when(joint, F.col("e").isNotNull()).otherwise(F.col("s_mpa").isNotNull())
    s, e = F.col("s_mpa").cast("double").cast("string"), F.col("e").cast("double").cast("string")
    answer = (
        F.when(F.col("kind") == "material", F.concat("key", F.lit(" is in Table M-1, up to "), F.col("max_temp").cast("string"), F.lit(" °C.")))
        .when(joint, F.concat(F.lit("Joint type "), F.col("joint_type").cast("string"), F.lit(" with "), "rt_level", F.lit(": E = "), e, F.lit(" (Table B-12).")))
        .otherwise(F.concat(F.lit("Allowable stress of "), "key", F.lit(" at "), F.col("temp_c").cast("string"), F.lit(" °C: "), s, F.lit(" MPa (Table M-1).")))
    )
    output = F.to_json(F.struct("kind", "key", found.alias("found"), F.when(joint, F.col("e").cast("double")).otherwise(F.col("s_mpa").cast("double")).alias("value")))
    ok = error.isNull()
    return t.select(*KEYS, error.alias("error"), (ok & found).alias("found"), F.when(ok, output).alias("output"), F.when(ok & found, answer).alias("answer"), "kind")


def calculate(calls: DataFrame) -> DataFrame:
    """The thickness calculation of each call; arguments that are missing or mean nothing are errors, a request that cannot be computed is an answer that says so."""
    numbers = {"p_mpa": "P_mpa", "temp_c": "design_temp_c", "inside": "inside_diameter_mm", "outside": "outside_diameter_mm", "ca_mm": "corrosion_allowance_mm"}
    a = calls.filter("tool = 'calculate'").select(
        *KEYS, *(_arg(n).alias(f"_{n}") for n in ("component", "material", "joint_type", "rt_level")), *(_number(v).alias(k) for k, v in numbers.items()),
        *(((_arg(v) != "") & _number(v).isNull()).alias(f"bad_{k}") for k, v in numbers.items()),
    )
    a = a.withColumns({"component": F.expr(C.coerced_component("_component")), "joint_type": F.expr(C.coerced_joint("_joint_type")), "rt_level": F.expr(C.coerced_rt("_rt_level"))})
    lacking = {"component": F.col("_component") == "", "P_mpa": F.col("p_mpa").isNull(), "design_temp_c": F.col("temp_c").isNull(), "material": F.col("_material") == "", "joint_type": F.col("_joint_type") == "", "rt_level": F.col("_rt_level") == ""}
    error = F.lit(None).cast("string")
    for name in ("component", "joint_type", "rt_level"):
        error = F.when(F.col(name).isNull(), f"calculate: {name} means nothing").otherwise(error)
    for name, missing in reversed(lacking.items()):
        error = F.when(missing, f"calculate: {name} is required").otherwise(error)
    for k, v in numbers.items():
        error = F.when(F.col(f"bad_{k}"), f"calculate: {v} is no number").otherwise(error)
    a = a.withColumn("error", error).withColumn("diameter_mm", F.when(F.col("component") == "cylinder_outside", F.col("outside")).otherwise(F.col("inside")))
    a = a.withColumns({"material": F.col("_material"), "ca_mm": F.coalesce("ca_mm", F.lit(0.0))})
    typed = a.withColumns({c: F.expr(f"try_cast({c} as {t})") for c, t in R.DECIMALS.items()})
    done = C.summaries(C.calculate(typed))
    ok = F.col("error").isNull()
    output = F.to_json(F.struct(F.col("error_code").isNull().alias("ok"), F.col("error_code").alias("code"), "t_min_mm", "t_design_mm", "plate_mm", "mawp_mpa"))
    return done.select(*KEYS, "error", (ok & F.col("error_code").isNull()).alias("found"), F.when(ok, output).alias("output"), F.when(ok, F.col("summary")).alias("answer"))


def _response(path: str) -> dict[str, Column]:
    """An answer out of JSON, and whether it is one: a refusal has a reason and only a refusal has one, any other answer cites something."""
    part = {c: F.get_json_object("args", f"{path}.{c}") for c in ("answer", "confidence", "refusal_reason")}
    cited = F.coalesce(F.json_array_length(F.get_json_object("args", f"{path}.citations")), F.lit(0))
    reason = F.coalesce(part["refusal_reason"], F.lit("")) != ""
    refusal = part["confidence"] == "insufficient"
    valid = part["answer"].isNotNull() & part["confidence"].isin("high", "medium", "insufficient") & (refusal == reason) & (refusal | (cited > 0))
    return part | {"valid": F.coalesce(valid, F.lit(False))}


def run(queries: DataFrame, scripts: DataFrame, tools: Tools, synthesis: bool = True, max_steps: int = MAX_STEPS, max_errors: int = MAX_ERRORS) -> tuple[DataFrame, DataFrame]:
    """Outcomes and steps of all conversations.

    Outcomes: query_id, kind, by, n_steps, n_errors, n_chunks, answer, confidence, refusal_reason, one row for each query.  ``kind`` is ``finalized``
    (``by`` script, pinned_lookup, calculate or synthesis), ``budget_steps_exhausted``, ``tool_error_limit`` or ``decider_error`` (the script ended, or its
    answer is none).  A run without an answer is a refusal with its reason.
    Steps: query_id, step, tool, args, auto, error, output.

    The first call of a trusted tool without a retrieval before it is preceded by a retrieval of the query.  A look-up that answers its
    query, and a calculation that succeeds, end the run; so do, with ``synthesis``, ``SATURATED`` successful retrievals or graph look-ups that found some chunk, while no
    trusted tool has succeeded.  More than ``max_errors`` errors end it too; the budget is looked at before each decision.

    A query without a script has an empty one.  Decisions of unknown queries are left out.  Decisions of one conversation are few; nothing else is grouped.
    """
    own = scripts.join(queries.select("query_id"), "query_id", "left_semi")
    numbered = own.select("query_id", (F.row_number().over(W.partitionBy("query_id").orderBy("pos")) - 1).alias("pos"), "tool", "args")
    ends = queries.select("query_id").join(own.groupBy("query_id").agg(F.count("*").cast("int").alias("pos")), "query_id", "left").fillna(0, ["pos"])
    each = numbered.unionByName(ends.select("query_id", "pos", F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("args")))
    each = each.filter(F.col("pos") <= max_steps).join(queries, "query_id")
    before = W.partitionBy("query_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    trusted = F.coalesce(F.col("tool").isin(*TRUSTED), F.lit(False))
    opened = F.coalesce(F.max(trusted | F.coalesce(F.col("tool") == "retrieve_context", F.lit(False))).over(before), F.lit(False))
    each = checkpointed(each.withColumn("auto", trusted & ~opened))

    first = each.filter("auto").select("query_id", "pos", F.lit(0).alias("part"), F.lit("retrieve_context").alias("tool"), F.to_json(F.struct("query", F.lit(FIRST_K).alias("top_k"))).alias("args"))
    calls = checkpointed(each.filter("tool is not null").select("query_id", "pos", F.lit(1).alias("part"), "tool", "args").unionByName(first))
    retrieved, chunks = retrieve_context(calls, tools)
    known = [*RETRIEVAL, *TRUSTED, "finalize", "final"]
    strange = calls.filter(~F.col("tool").isin(*known)).select(*KEYS, F.concat(F.lit("unknown tool "), "tool").alias("error"), F.lit(False).alias("found"), F.lit(None).cast("string").alias("output"))
    results = retrieved.unionByName(graph_lookup(calls, tools)).unionByName(strange).withColumns({"answer": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")})
    results = checkpointed(results.unionByName(pinned_lookup(calls)).unionByName(calculate(calls), allowMissingColumns=True))

    tool = lambda *names: F.coalesce(F.col("tool").isin(*names), F.lit(False))
    asked = each.join(results.filter("part = 1").drop("part").withColumnRenamed("kind", "of_kind"), ["query_id", "pos"], "left")
    early = results.filter("part = 0").select("query_id", "pos", F.col("error").alias("auto_error"), F.col("found").alias("auto_found"))
    s = asked.join(early, ["query_id", "pos"], "left")
    for name, path in (("finalize", "$.response"), ("final", "$")):
        s = s.withColumns({f"{name}_{c}": F.when(tool(name), v) for c, v in _response(path).items()})
    answered = tool("final") & F.col("final_valid") | tool("finalize") & F.col("finalize_valid")
    refused = tool("finalize") & ~F.col("finalize_valid")
    called = tool(*RETRIEVAL, *TRUSTED) | F.coalesce(~F.col("tool").isin(*known), F.lit(False))
    failed = called & F.col("error").isNotNull()
    good = called & F.col("error").isNull()
    auto_failed = F.col("auto") & F.col("auto_error").isNotNull()
    auto_good = F.col("auto") & F.col("auto_error").isNull()
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    s = s.withColumns({
        "_answered": F.coalesce(answered, F.lit(False)), "_refused": F.coalesce(refused, F.lit(False)), "_good": good, "_failed": failed, "_auto_failed": auto_failed,
        "_steps": as_int(F.col("auto")) + as_int(called) + as_int(refused), "_errors": as_int(auto_failed) + as_int(failed) + as_int(refused),
        "_retrievals": as_int(auto_good) + as_int(good & tool(*RETRIEVAL)), "_trusted": as_int(good & tool(*TRUSTED)),
        "_chunks": as_int(auto_good & F.col("auto_found")) + as_int(good & tool("retrieve_context") & F.col("found")),
    })
    so_far = W.partitionBy("query_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumns({f"sum{c}": F.sum(c).over(so_far) for c in ("_steps", "_errors", "_retrievals", "_trusted", "_chunks")})
    steps_before = F.col("sum_steps") - F.col("_steps")
    over = F.col("sum_errors") > max_errors
    # An inserted retrieval may be the last error; its call is then not made.
    early_over = F.col("_auto_failed") & (F.col("sum_errors") - as_int(F.col("_failed")) > max_errors)
    looked_up = tool("pinned_lookup") & F.col("_good") & F.col("found") & F.coalesce(F.expr(C.is_lookup("query", "of_kind")), F.lit(False))
    saturated = F.lit(synthesis) & tool(*RETRIEVAL) & F.col("_good") & (F.col("sum_retrievals") >= SATURATED) & (F.col("sum_trusted") == 0) & (F.col("sum_chunks") > 0)
    by = (
        F.when(F.col("_answered"), "script").when(early_over, F.lit(None)).when(looked_up, "pinned_lookup").when(tool("calculate") & F.col("_good") & F.col("found"), "calculate").when(saturated, "synthesis")
    )
    ending = (
        F.when(steps_before >= max_steps, "budget_steps_exhausted").when(F.col("tool").isNull() | tool("final") & ~F.col("_answered"), "decider_error").when(by.isNotNull(), "finalized")
        .when(over & (F.col("_failed") | F.col("_refused") | F.col("_auto_failed")), "tool_error_limit")
    )
    s = checkpointed(s.withColumns({"by": by, "ending": ending, "steps_before": steps_before, "early_over": early_over}))

    last = s.filter("ending is not null").groupBy("query_id").agg(F.min("pos").alias("last"))
    s = s.join(last, "query_id")
    # A decision that ends the run before it is acted on adds no step.
    idle = (F.col("pos") == F.col("last")) & F.col("ending").isin("budget_steps_exhausted", "decider_error")
    stopped = (F.col("pos") == F.col("last")) & F.col("early_over")
    end = s.filter("pos = last").withColumns({
        "n_steps": F.when(idle, F.col("steps_before")).when(stopped, F.col("steps_before") + 1).otherwise(F.col("sum_steps")).cast("long"),
        "n_errors": F.when(idle, F.col("sum_errors") - F.col("_errors")).when(stopped, F.col("sum_errors") - as_int(F.col("_failed"))).otherwise(F.col("sum_errors")).cast("long"),
    }).withColumn("by", F.when(F.col("ending") == "finalized", F.col("by")))

    # What a run retrieved: each chunk once, at its first place.
    reached = chunks.join(last, "query_id").join(end.select("query_id", "early_over", "ending"), "query_id")
    reached = reached.filter((F.col("pos") < F.col("last")) | (F.col("pos") == F.col("last")) & ~F.col("ending").isin("budget_steps_exhausted", "decider_error"))
    seen = reached.groupBy("query_id", "doc_id").agg(F.min(F.struct("pos", "part", "rank")).alias("at"))
    placed = seen.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at")))
    sizes = placed.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    put_together = R.summary(placed.join(end.filter("by = 'synthesis'").select("query_id"), "query_id", "left_semi").join(tools.chunks, "doc_id").select("query_id", "ref", "text", "rank"))
    e = end.join(sizes, "query_id", "left").fillna(0, ["n_chunks"]).join(put_together.withColumnRenamed("answer", "lines"), "query_id", "left")
    script = lambda c: F.coalesce(F.when(tool("finalize"), F.col(f"finalize_{c}")), F.col(f"final_{c}"))
    # Chunks without a line say nothing to put together.
    silent = (F.col("by") == "synthesis") & F.col("lines").isNull()
    reason = (
        F.when(F.col("by") == "script", script("refusal_reason")).when(silent, "no context").when(F.col("by").isNotNull(), F.lit(None))
        .when(F.col("ending") == "budget_steps_exhausted", F.concat(F.lit("no answer after "), F.col("n_steps").cast("string"), F.lit(" steps")))
        .when(F.col("ending") == "tool_error_limit", F.concat(F.col("n_errors").cast("string"), F.lit(" tool errors"))).otherwise("the script ended without an answer")
    )
    confidence = F.when(F.col("by") == "script", script("confidence")).when(silent | F.col("by").isNull(), "insufficient").when(F.col("by") == "synthesis", "medium").otherwise("high")
    answer = F.when(F.col("by") == "script", script("answer")).when(F.col("by") == "synthesis", F.col("lines")).when(F.col("by").isNotNull(), F.col("answer"))
    outcomes = e.select("query_id", F.col("ending").alias("kind"), "by", "n_steps", "n_errors", "n_chunks", answer.alias("answer"), confidence.alias("confidence"), reason.alias("refusal_reason"))

    done = s.filter((F.col("pos") < F.col("last")) | (F.col("pos") == F.col("last")) & ~idle).withColumn("stopped", stopped)
    acted = done.select("query_id", "pos", "stopped", "_refused")
    every = calls.join(results.select(*KEYS, "error", "output"), KEYS, "left").join(acted, ["query_id", "pos"]).filter(
        (F.col("part") == 0) | ~F.col("stopped") & (~F.col("tool").isin("final", "finalize") | F.col("_refused"))
    )
    step = F.row_number().over(W.partitionBy("query_id").orderBy("pos", "part")) - 1
    error = F.when(F.col("_refused") & (F.col("part") == 1), "finalize: not a response").otherwise(F.col("error"))
    return outcomes, every.select("query_id", step.alias("step"), "tool", "args", (F.col("part") == 0).alias("auto"), error.alias("error"), "output")
