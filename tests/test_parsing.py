"""The parser: documents are parsed where they lie, and sections do not mix."""

from gneiss.operators import parsing

TEXT = "## A-1 x\n| a | b |\n|---|---|\n| 1 | 2 |\n## A-1 y\n| c | d |\n|---|---|\n| 3 | 4 |\n## A-1-2 z\n| e | f |\n|---|---|\n| 5 | 6 |\n"


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id int, text string")
    s = parsing.sections(docs)
    for df in (s, parsing.table_rows(s), parsing.repaired_tables(s), parsing.tables(s), parsing.formulas(s), parsing.elements(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_sections_whose_ids_clash_keep_their_own_tables(spark):
    e = parsing.elements(spark.createDataFrame([(1, TEXT)], "doc_id int, text string")).orderBy("ord").collect()
    assert [r.element_id for r in e if r.element_type == "section"] == ["sec-a-1", "sec-a-1-2", "sec-a-1-2"]
    assert [(r.headers, r.rows) for r in e if r.element_type == "table"] == [(["a", "b"], [["1", "2"]]), (["c", "d"], [["3", "4"]]), (["e", "f"], [["5", "6"]])]


def test_repair_in_place_is_repair_of_rows(spark):
    text = "## A-1 x\n| k | v | w | x | y |\n|---|---|---|---|---|\n| Flag 7 |  | a | b | c |\n|  | more- |  |  |  |\n|  | text |  |  |  |\n| p | q | r | s | t |\n\n| one |\n|---|\n| a |\n| b |\n| c |\n"
    s = parsing.sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    rows = [sorted((r.block, r.row, r.cells) for r in df.collect()) for df in (parsing.repaired_tables(s), parsing.repaired_rows(parsing.table_rows(s)))]
    assert rows[0] == rows[1] == [
        (0, 0, ["k", "v", "w", "x", "y"]), (0, 1, ["Flag", "7 more-text", "a", "b", "c"]), (0, 2, ["p", "q", "r", "s", "t"]), (1, 0, ["one a"]), (1, 1, ["b c"]),
    ]


def test_elements_are_parsed_once_and_become_rows_before_they_are_numbered(spark):
    docs = spark.createDataFrame([(1, "## A-1 x\n### A-1(a) y\n| h |\n|---|\n| v |\n## M\n| h |\n|---|"), (2, "no heading"), (3, None)], "doc_id long, text string")
    out = parsing.elements(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # What finds headings stands once in the plan, and the generator below it is given the parsed array, not the numbering.
    assert plan.count("StartsWith(lambda c#") == 1 and "posexplode(ev" in plan
    assert [(r.doc_id, r.ord, r.element_id) for r in out.orderBy("doc_id", "ord").collect()] == [
        (1, 1, "sec-a-1"), (1, 2, "sec-a-1-2"), (1, 3, "tbl-a-1"), (1, 4, "sec-m"), (1, 5, "tbl-tbl-0")]
