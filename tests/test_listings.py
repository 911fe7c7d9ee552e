"""Suggestions against a loop, paths and payloads by hand."""

import json
import random

from gneiss.operators import audit, browse, suggest
from gneiss.sources import payloads

SHAPE = "doc_id int, element_id string, element_type string, paragraph_ref string, title string, caption string, table_id string, headers array<string>, rows array<array<string>>, content string, ord int"


def loop(elements, topics, worth, refers):
    """The choice one by one."""
    out = []

    def offer(query, source, ref, stage):
        if not any(o[0] == query or o[1] == source for o in out):
            out.append((query, source, ref or "", stage))

    tables = sorted((e for e in elements if e["element_type"] == "table"), key=lambda e: -worth[e["element_id"]])
    sections = sorted((e for e in elements if e["element_type"] == "section"), key=lambda e: -worth[e["element_id"]])
    used = set()
    for e in tables:
        if len(out) >= 3 or worth[e["element_id"]] <= 0:
            break
        topic = topics[e["element_id"]]
        if not topic or topic.split(" for ")[0] in used:
            continue
        used.add(topic.split(" for ")[0])
        offer(f"What information is contained in Table {e['table_id']} about {topic}?", e["element_id"], e["paragraph_ref"], 0)
    for e in sections:
        if len(out) >= 3 or worth[e["element_id"]] <= 0:
            break
        offer(f"What does {e['paragraph_ref'] or ''} specify about {topics[e['element_id']] or 'its requirements'}?", e["element_id"], e["paragraph_ref"], 1)
    for e in sections:
        if len(out) < 3 and e["element_id"] in refers:
            offer(f"Which sections or tables does {e['paragraph_ref'] or e['title']} refer to?", e["element_id"], e["paragraph_ref"], 2)
    for e in elements:
        if len(out) < 3 and e["element_type"] == "section" and e["paragraph_ref"]:
            offer(f"What are the requirements specified in {e['paragraph_ref']}?", e["element_id"], e["paragraph_ref"], 3)
    return [*out, ("off?", "", "", 4)]


def test_suggestions(spark):
    rng = random.Random(4)
    rows, refs = [], []
    for d in range(120):
        for i in range(rng.choice([0, 1, 2, 5, 12])):
            table, ref = rng.random() < 0.25, rng.choice(["A-1", "A-2", "B-1", None])
            title = rng.choice(["Welds", "Nozzle rules for ends", "Nozzle rules for shells", "Plain"]) if table or rng.random() < 0.4 else ""
            rows.append((d, f"e{i}", "table" if table else "section", ref, title or "", title if table else None, rng.choice(["T-1", "TBL-0"]) if table else None, ["h"] if table else None, [["1"]] if table else None, "x", i))
            refs += [(d, f"e{i}")] if rng.random() < 0.6 else []
        rows.append((d, "p", "paragraph", None, None, None, None, None, None, "x", 99))
    elements, references = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(refs, "doc_id int, source_id string")
    told = {(r.doc_id, r.element_id): r for r in browse.quality(elements, references).collect()}
    names = [c.split()[0] for c in SHAPE.split(", ")]
    got = {}
    for r in sorted(suggest.suggestions(elements, references, "off?").collect(), key=lambda r: (r.doc_id, r.place)):
        got.setdefault(r.doc_id, []).append((r.query, r.element_id, r.paragraph_ref, r.stage))
    stages = set()
    for d in range(120):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == d]
        worth = {e["element_id"]: told[d, e["element_id"]].quality for e in own}
        want = loop(own, {e["element_id"]: told[d, e["element_id"]].topic for e in own}, worth, {s for x, s in refs if x == d})
        assert got[d] == want, d
        stages |= {s for *_, s in want}
    assert stages == {0, 1, 2, 3, 4}


def test_paths(spark):
    said = {
        "./data/private/x.md": 1, "DATA/Private_Runs/a/b.json": 1, "data/private": None, "data//private/./y": 1, "data/runs/2024-asme-private/summary.json": 2, "data/runs/ok/summary.json": None,
        "logs/private/prompts.jsonl": 3, "logs/prompts.jsonl": None, "data/parser_benchmark/asme/output.json": 4, "data/parser_benchmark/asme/other.json": None, "data/parser_benchmark/asme_private/output.json": 1, "": None, "x": None,
    }
    rows = [(p, 1) for p in said] + [(None, 1), ("./data/private/x.md", 1)]
    got = sorted((r.path, r.rule) for r in audit.audit_paths(spark.createDataFrame(rows, "path string, other int"), audit.default_rules(spark)).collect())
    assert got == sorted([(p, r) for p, r in said.items() if r] + [("./data/private/x.md", 1)])


def test_payloads(spark):
    chunks = [{"content": "a"}, {"content": " "}, {"content": 5}, "b", {"content": "c"}]
    said = [
        ({"markdown": "m", "content": "c"}, "m"), ({"markdown": " ", "content": "c"}, "c"), ({"markdown": 5, "result": {"content": "rc"}}, "rc"), ({"result": {"chunks": chunks}, "chunks": [{"content": "top"}]}, "a\n\nc"),
        ({"result": {"chunks": []}, "chunks": chunks}, "a\n\nc"), ({"result": "text", "chunks": "text"}, None), ({}, None), ([1], None), ("text", None), (None, None),
    ]
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(said)] + [(90, None), (91, "{bad"), (92, "")]
    got = {r.i: (r.text, r.error) for r in payloads.payload_text(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert [got[i][0] for i in range(len(said))] == [t for _, t in said]
    assert [got[i][1] for i in (0, 5, 6, 7, 8, 90, 91, 92)] == [None, "no text", "no text", "not an object", "not an object", "not JSON", "not JSON", "not JSON"]


def test_a_long_section_is_worth_ten_more(spark):
    rows = [(i, "s", "section", "A-1", "Plain", None, None, None, None, " " + "x" * n + " ", i) for i, n in enumerate((300, 301))]
    got = {r.doc_id: r.quality for r in browse.quality(spark.createDataFrame(rows, SHAPE), spark.createDataFrame([], "doc_id int, source_id string")).collect()}
    assert got == {0: 40, 1: 50}


def test_plain_texts_are_left_as_they_are(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["".join(rng.choices("aZ0()./% -", weights=[4, 4, 2, 1, 1, 1, 1, 1, 3, 1], k=rng.randint(0, 9))) for _ in range(400)]
    texts += ["".join(rng.choices("aB1 -*_`°é<br/>\n\t", k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", "-", "a\n", "A-1 b", "a<br />b"]
    slow = F.col("text")
    for pattern, to in ((r"<br\s*/?>", " "), (r"[*_`]+", ""), (r"(?U)[^\w()./%° -]+", " "), (r"(?U)\s+", " "), (r"^[ -]+|[ -]+$", "")):
        slow = F.regexp_replace(slow, pattern, to)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(browse.clean(F.col("text")), F.coalesce(slow, F.lit("")), F.col("text").rlike(browse.BARE)).collect()
    assert all(a == b for a, b, _ in rows) and {c for *_, c in rows} == {True, False, None}


def test_candidates_meet_once(spark):
    elements = spark.createDataFrame([(1, "e", "section", "A-1", "x", None, None, None, None, "x", 1)], SHAPE)
    out = suggest.suggestions(elements, spark.createDataFrame([(1, "e")], "doc_id int, source_id string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The only join is with the counts of references, and what words are weighed in is put together once.
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1 and plan.count("concat_ws") == 1 and "Window" not in plan
    assert [(r.place, r.query, r.stage) for r in out.orderBy("place").collect()] == [(1, "What does A-1 specify about x?", 1)]


def test_contents_do_not_travel(spark, tmp_path):
    rows = [(1, "a", "section", "A-1", "x", None, None, None, None, "x", 1), (1, "b", "section", None, "x", None, None, None, None, "x", 2), (1, "c", "table", "A-1", "T", "weld", "A-1", ["h"], [["1"]], "x", 3)]
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "e"))
    out = browse.quality(spark.read.parquet(str(tmp_path / "e")), spark.createDataFrame([(1, i) for i in "aaabbc"], "doc_id int, source_id string"))
    assert {r.element_id: r.quality for r in out.collect()} == {"a": 43, "b": -1, "c": 126}
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    left = plan.children().head().output()
    assert not {left.apply(i).name() for i in range(left.size())} & {"content", "rows", "headers", "caption"}
