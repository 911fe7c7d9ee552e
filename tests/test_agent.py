"""Scripted runs through the real tools, against a loop over one conversation at a time."""

import json
import random

import pytest

from gneiss.operators import agent
from gneiss.operators.ranked_index import RankedIndex

DOCS = [(1, "A-1", "\nshell thickness rules\nmore"), (2, "A-2", "weld joint efficiency table"), (3, "A-3", "stress of shell material"), (4, None, " \n "), (5, "A-1", "shell again")]
NODES = [("n1", "A-1"), ("n2", "a-1"), ("n3", "B-2"), ("n4", None), ("n5", "C-3")]
EDGES = [("n1", "n3"), ("n3", "n4"), ("n4", "n5")]
GOOD = {"component": "cylindrical shell", "P_mpa": 1.5, "design_temp_c": 350, "inside_diameter_mm": 1800, "material": "SM-516 Gr 70", "joint_type": "Type 1", "rt_level": "full radiography", "corrosion_allowance_mm": 3}
ANSWER = {"answer": "42", "confidence": "high", "citations": [{"ref": "A-1"}]}
CALLS = {
    "find": ("retrieve_context", {"query": "shell thickness", "top_k": 2}), "find2": ("retrieve_context", {"query": "weld joint"}), "miss": ("retrieve_context", {"query": "zebra"}), "blank": ("retrieve_context", {"query": " "}),
    "graph": ("graph_lookup", {"paragraph_ref": "a-1"}), "far": ("graph_lookup", {"paragraph_ref": "B-2", "max_hops": 9}), "nowhere": ("graph_lookup", {"paragraph_ref": "Z-9"}), "noref": ("graph_lookup", {}),
    "stress": ("pinned_lookup", {"kind": "allowable_stress", "key": "SM-516 Gr 70", "temp_c": 350}), "joint": ("pinned_lookup", {"kind": "joint_efficiency", "key": "Type 2", "rt_level": "spot"}),
    "lost": ("pinned_lookup", {"kind": "material", "key": "SM-999"}), "kind": ("pinned_lookup", {"kind": "colour", "key": "x"}),
    "calc": ("calculate", GOOD), "hot": ("calculate", GOOD | {"design_temp_c": 900}), "short": ("calculate", {k: v for k, v in GOOD.items() if k != "P_mpa"}), "vague": ("calculate", GOOD | {"rt_level": "partly"}),
    "end": ("finalize", {"response": ANSWER}), "bad": ("finalize", {"response": {"answer": "no citation", "confidence": "high"}}), "said": ("final", ANSWER), "mumbled": ("final", {"answer": "x"}),
    "what": ("dance", {}),
}
#: Whether a call succeeds, and whether it finds something.
TELLS = {"find": (1, 1), "find2": (1, 1), "miss": (1, 0), "blank": (0, 0), "graph": (1, 1), "far": (1, 1), "nowhere": (1, 0), "noref": (0, 0), "stress": (1, 1), "joint": (1, 1), "lost": (1, 0), "kind": (0, 0), "calc": (1, 1), "hot": (1, 0), "short": (0, 0), "vague": (0, 0), "what": (0, 0)}


def loop(query, names, synthesis):
    """kind, by, steps (tool, failed), errors of one conversation."""
    steps, errors, at = [], 0, 0
    trusted = lambda n: CALLS[n][0] in agent.TRUSTED
    while True:
        if len(steps) >= 8:
            return "budget_steps_exhausted", None, steps, errors
        if at == len(names) or names[at] == "mumbled":
            return "decider_error", None, steps, errors
        name, at = names[at], at + 1
        tool = CALLS[name][0]
        if name in ("end", "said"):
            return "finalized", "script", steps, errors
        if name == "bad":
            steps.append((name, "finalize", True))
            errors += 1
            if errors > 3:
                return "tool_error_limit", None, steps, errors
            continue
        if trusted(name) and not any(t == "retrieve_context" for _, t, _ in steps):
            ok = bool(query.strip())
            steps.append(("auto", "retrieve_context", not ok))
            errors += not ok
            if errors > 3:
                return "tool_error_limit", None, steps, errors
        ok, found = TELLS[name]
        steps.append((name, tool, not ok))
        if tool == "pinned_lookup" and ok and found and "calculate" not in query and (name == "stress" and "stress" in query or name == "joint" and "efficiency" in query):
            return "finalized", "pinned_lookup", steps, errors
        if tool == "calculate" and found:
            return "finalized", "calculate", steps, errors
        if synthesis and tool in agent.RETRIEVAL and ok:
            retrievals = [n for n, t, bad in steps if t in agent.RETRIEVAL and not bad]
            chunks = any(n in ("find", "find2") or n == "auto" and ("shell" in query or "stress" in query or "joint" in query) for n in retrievals)
            if len(retrievals) >= 2 and chunks and not any(t in agent.TRUSTED and not bad for _, t, bad in steps):
                return "finalized", "synthesis", steps, errors
        if not ok:
            errors += 1
            if errors > 3:
                return "tool_error_limit", None, steps, errors


@pytest.fixture(scope="module")
def tools(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, ref string, text string")
    index = RankedIndex.build(docs)
    return agent.Tools(index.search, docs, spark.createDataFrame(NODES, "id string, ref string"), spark.createDataFrame(EDGES, "src string, dst string"))


def played(spark, tools, talks, synthesis=True):
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(talks)], "query_id long, query string")
    rows = [(i, 10 * p + 3, CALLS[n][0], json.dumps(CALLS[n][1])) for i, (_, names) in enumerate(talks) for p, n in enumerate(names)]
    scripts = spark.createDataFrame(rows or [(99, 0, "x", "{}")], "query_id long, pos int, tool string, args string")
    outcomes, steps = agent.run(queries, scripts, tools, synthesis)
    told = {r.query_id: r for r in outcomes.collect()}
    taken = {i: [] for i in told}
    for r in sorted(steps.collect(), key=lambda r: (r.query_id, r.step)):
        assert r.step == len(taken[r.query_id])
        taken[r.query_id].append(r)
    assert len(told) == len(talks)
    return told, taken


@pytest.mark.parametrize("synthesis", [True, False])
def test_any_script(spark, tools, synthesis):
    rng = random.Random(7)
    asks = ["shell stress of it", "calculate the stress", "joint efficiency?", "other things", " "]
    talks = [(rng.choice(asks), rng.choices(list(CALLS), k=rng.randint(0, 14))) for _ in range(300)]
    talks += [(rng.choice(asks), rng.choices(["blank", "noref", "miss", "kind", "bad", "what", "lost", "hot"], k=12)) for _ in range(100)]
    told, taken = played(spark, tools, talks, synthesis)
    for i, (query, names) in enumerate(talks):
        kind, by, steps, errors = loop(query, names, synthesis)
        r = told[i]
        assert (r.kind, r.by, r.n_steps, r.n_errors) == (kind, by, len(steps), errors), (query, names)
        assert [(s.tool, s.error is not None, s.auto) for s in taken[i]] == [(t, bad, n == "auto") for n, t, bad in steps], (query, names)
        assert (r.confidence == "insufficient") == (r.refusal_reason is not None) and (r.answer is None) == (r.confidence == "insufficient")


def test_answers(spark, tools):
    talks = [("What stress at 350?", ["stress"]), ("shell", ["calc"]), ("x", ["find", "graph"]), ("joint efficiency", ["find", "joint"]), ("x", ["said"]), ("x", []), ("x", ["find", "miss"])]
    told, taken = played(spark, tools, talks)
    assert told[0].answer == "Allowable stress of SM-516 Gr 70 at 350.0 °C: 114.0 MPa (Table M-1)." and told[0].confidence == "high" and [s.auto for s in taken[0]] == [True, False]
    assert "t_min = 11.94 mm" in told[1].answer and json.loads(taken[1][1].output)["plate_mm"] == 16
    assert told[2].answer == "[A-1] shell thickness rules" and told[2].confidence == "medium" and told[2].n_chunks == 2
    assert json.loads(taken[2][1].output) == {"seeds": ["n1", "n2"], "expanded": 3, "edges": 1}
    assert "E = 0.8 (Table B-12)" in told[3].answer and told[4].answer == "42"
    assert told[5].refusal_reason == "the script ended without an answer" and told[6].by == "synthesis"


def test_no_conversations(spark, tools):
    queries = spark.createDataFrame([], "query_id long, query string")
    scripts = spark.createDataFrame([(1, 0, "calculate", None)], "query_id long, pos int, tool string, args string")
    outcomes, steps = agent.run(queries, scripts, tools)
    assert outcomes.count() == 0 and steps.count() == 0
