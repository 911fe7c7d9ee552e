"""Markdown to typed elements: headings, pages, parents, tables, formulas, cross-references.

``docs``: doc_id, text.  A document is parsed where it lies, by array functions over its lines: nothing is shuffled, and no
line, cell or fence is a row before it is asked for.  What parses is SQL text, so that its parts nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES_PER_PAGE = 40
# Fixed pattern of paragraph references.
REFERENCE = r"(?:[A-Z]{1,5}-\d+(?:\.\d+)?(?:-\d+)?(?:\([a-z0-9]+\))?|[0-9]{1,2}-[0-9]+(?:\.\d+)?(?:\([a-z]\))?)"
LEAD = r"(?:see|per|as\s+specified\s+in|in\s+accordance\s+with|refer\s+to|from|obtained\s+from|consult|shall\s+be\s+(?:obtained|taken)\s+from)"
HEADING, PIPED, RULE = r"^(#{2,4})\s+(.+?)\s*$", r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"


def quoted(text: str) -> str:
    """``text`` as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for a value that is computed once.

    What a fold over nothing begins with is handed to its end as it is; a transform would copy the value and all of the body's result.
    """
    return f"aggregate(array(), {value}, (a_, e_) -> a_, {name} -> {body})"


def slug(col: str) -> str:
    return rf"trim(BOTH '-' FROM regexp_replace(lower(trim({col})), '[^a-z0-9.]+', '-'))"


#: SQL pattern of what ``stripped`` leaves as it is.
BARE = r"^[A-Za-z0-9.()-]+( [A-Za-z0-9.()-]+)*\z"


def stripped(col: str) -> str:
    """SQL: markdown markers and stray characters out, white space collapsed."""
    given = col
    for pattern, to in ((r"<br/?>", " "), (r"\\*{1,2}([^*]+)\\*{1,2}", "$1"), (r"_{1,2}([^_]+)_{1,2}", "$1"), (r"(?U)[^\\w().\\-\\s]", " "), (r"\\s+", " ")):
        col = f"regexp_replace({col}, '{pattern}', '{to}')"
    return f"if({given} rlike {quoted(BARE)}, {given}, trim({col}))"


def repeats(ids: str) -> str:
    """SQL: for each string of an array, how often it has occurred up to there; equal ones are neighbours once sorted, and few are compared one by one."""
    few = "transform(sn, (b, i) -> size(filter(slice(sn, 1, i + 1), x -> x = b)))"
    nth = "transform(sort_array(transform(st, (x, k) -> named_struct('i', x.i, 'n', cast(k + 2 - array_position(sb, x.b) as int)))), x -> x.n)"
    many = let("st", "sort_array(transform(sn, (b, i) -> named_struct('b', b, 'i', i)))", let("sb", "transform(st, x -> x.b)", nth))
    return let("sn", ids, f"case when size(array_distinct(sn)) = size(sn) then array_repeat(1, size(sn)) when size(sn) <= 16 then {few} else {many} end")


def _runs(rows: str, starts: str, item: str = "x") -> str:
    """SQL: an array cut at each index of ``starts``."""
    return f"transform({starts}, (b, k) -> transform(slice({rows}, b + 1, coalesce(get({starts}, k + 1), size({rows})) - b), x -> {item}))"


def _sections(text: str, parented: bool = True) -> str:
    """SQL: the sections of a text, an array of structs; see ``sections``.  Their parents are looked for if they are ``parented``."""
    # What a line begins with is compared before any pattern runs.
    found = "filter(transform(ln, (c, i) -> if(startswith(c, '##'), named_struct('line', i, 'c', c), null)), h -> h is not null)"
    # A title is never empty, so an empty one tells that there is no heading.
    level = "case when startswith(h.c, '####') then 4 when startswith(h.c, '###') then 3 else 2 end"
    found = f"filter(transform({found}, h -> named_struct('line', h.line, 'level', {level}, 'title', regexp_extract(h.c, {quoted(HEADING)}, 2))), h -> h.title <> '')"
    ref = f"if(not contains(cl, '-') or startswith(lower(cl), 'table '), null, nullif(upper(regexp_extract(cl, {quoted(rf'(?i)\b({REFERENCE})\b')}, 1)), ''))"
    head = f"named_struct('line', h.line, 'level', h.level, 'title', h.title, 'ref', ref, 'base', concat('sec-', {slug('coalesce(ref, h.title)')}))"
    head = let("ref", let("cl", stripped("h.title"), ref), head)
    named = "transform(hb, (h, i) -> named_struct('level', h.level, 'id', if(rp[i] > 1, concat_ws('-', h.base, rp[i]), h.base)))"
    # The last heading of each level so far; one of level two ends what is below it.
    parents = """aggregate(hi, named_struct('two', cast(null as string), 'three', cast(null as string), 'p', cast(array() as array<string>)), (s, h) -> named_struct(
        'two', if(h.level = 2, h.id, s.two), 'three', case h.level when 2 then null when 3 then h.id else s.three end,
        'p', array_append(s.p, case h.level when 2 then null when 3 then s.two else coalesce(s.three, s.two) end))).p"""
    # Line feeds at both ends go; the end may be before a last line terminator of another kind.
    ends = " or ".join(f"endswith(bd, '\\n{end}')" for end in ("", "\\r", "\\u0085", "\\u2028", "\\u2029"))
    body = f"if(startswith(bd, '\\n') or {ends}, regexp_replace(bd, {quoted(r'^\n+|\n+$')}, ''), bd)"
    body = let("bd", "array_join(slice(ln, h.line + 2, coalesce(get(hb, i + 1).line, size(ln)) - h.line - 1), '\\n')", body)
    out = f"""transform(hb, (h, i) -> named_struct('section', cast(i + 1 as bigint), 'line', h.line, 'level', h.level, 'title', h.title, 'page', cast(h.line div {LINES_PER_PAGE} + 1 as int),
        'paragraph_ref', h.ref, 'element_id', hi[i].id, 'parent_id', pa[i], 'content', {body}))"""
    out = let("pa", parents, out) if parented else out.replace("pa[i]", "cast(null as string)")
    named_out = let("hi", let("rp", repeats("transform(hb, h -> h.base)"), named), out)
    return let("ln", f"split({text}, '\\n')", let("hb", f"transform({found}, h -> {head})", named_out))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, line, level, title, page, paragraph_ref, element_id, parent_id, content``.

    A section starts at a heading of two to four marks and ends before the next; what precedes the
    first is dropped; null texts have none.  The parent is the nearest earlier heading of a lower level with no
    shallower one between.  The n-th repeat of an id gets ``-n``.
    """
    return docs.selectExpr("doc_id", f"inline({_sections('text')})")


#: SQL: a row of labels, not of values: all but one of its cells at most have letters or units, and hardly any is a number.
HEADER_LIKE = r"""(size(filter({0}, c -> c <> '')) > 0
    and size(filter({0}, c -> c <> '' and c rlike '[A-Za-z°%/()]')) >= greatest(1, size(filter({0}, c -> c <> '')) - 1)
    and size(filter({0}, c -> c rlike '^[-+]?\\d+(\\.\\d+)?$')) <= size(filter({0}, c -> c <> '')) div 3)"""
#: SQL: labels of two rows as one; a label that repeats above numbers says nothing.
STACKED = r"""zip_with({0}, {1}, (t, l) -> case when t = '' then l when l = '' then t when lower(t) = lower(l) then l
    when size(filter({0}, x -> x = t)) > 1 and l rlike '\\d' then l else concat(t, ' ', l) end)"""


def _blocks(content: str) -> str:
    """SQL: lines between pipes, in runs of neighbouring lines, an array of arrays of lines."""
    piped = f"filter(transform(split(if(contains({content}, '|'), {content}, ''), '\\n'), (c, i) -> named_struct('line', i, 'content', c)), x -> x.content rlike {quoted(PIPED)})"
    starts = "filter(transform(pl, (x, i) -> i), i -> i = 0 or pl[i].line <> get(pl, i - 1).line + 1)"
    return let("pl", piped, let("sa", starts, _runs("pl", "sa", "x.content")))


def _grid(lines: str) -> str:
    """SQL: the cells of a run of lines, header first; null for one that is no table.  See ``table_rows``."""
    cells = r"transform(split(regexp_replace(trim(x), '^\\||\\|$', ''), '\\|'), c -> trim(c))"
    raw = f"transform(concat(array(rl[mk - 1]), slice(rl, mk + 2, size(rl))), x -> {cells})"
    padded = "transform(rw, r -> if(size(r) = wd, r, slice(concat(r, array_repeat('', wd)), 1, wd)))"
    stack = f"size(pd) > 1 and size(filter(pd[0], c -> c <> '')) <= greatest(1, size(pd[0]) div 3) and {HEADER_LIKE.format('pd[1]')}"
    grid = f"if({stack}, concat(array({STACKED.format('pd[0]', 'pd[1]')}), slice(pd, 3, size(pd))), pd)"
    grid = let("rw", raw, let("pd", let("wd", "size(rw[0])", padded), grid))
    return let("rl", lines, let("mk", f"cast(array_position(transform(rl, x -> x rlike {quoted(RULE)}), true) - 1 as int)", f"case when mk >= 1 then {grid} end"))


def _is_table(lines: str) -> str:
    """SQL: whether a run of lines is a table: a row before a separator row, as in ``_grid``."""
    return f"array_position(transform({lines}, x -> x rlike {quoted(RULE)}), true) > 1"


def table_rows(sections: DataFrame) -> DataFrame:
    """``doc_id, element_id, block, row, cells``: rows of pipe tables; row 0 is the header.

    The header is the row before the first separator row; a run without both is no table.  A sparse header is joined with
    a next row of labels, which goes into it.  Rows are cut or padded to the width of the header.
    """
    blocks = sections.selectExpr("doc_id", "element_id", f"posexplode({_blocks('content')}) as (block, lines)")
    return blocks.selectExpr("doc_id", "element_id", "block", f"posexplode({_grid('lines')}) as (row, cells)")


def table_cells(sections: DataFrame) -> DataFrame:
    """``doc_id, element_id, block, row, col, text``."""
    return table_rows(sections).select("doc_id", "element_id", "block", "row", F.posexplode("cells").alias("col", "text"))


# Fixed pattern of a text cell that has swallowed the number of the blank cell after it.
FUSED = r"^([A-Za-z][A-Za-z /().-]*?)([-+]?\d+(?:\.\d+)?)$"


def _repaired(grid: str) -> str:
    """SQL: a table's cells with fused ones split and wrapped rows joined; see ``repaired_rows``."""
    fused = lambda i: f"(coalesce(get(cells, {i} + 1), 'x') = '' and cells[{i}] rlike {quoted(FUSED)})"
    part = lambda i, n: f"trim(regexp_extract(cells[{i}], {quoted(FUSED)}, {n}))"
    split = f"transform(cells, (c, i) -> case when {fused('i')} then {part('i', 1)} when i > 0 and {fused('(i - 1)')} then {part('(i - 1)', 2)} else c end)"
    few = """(k > 1 and exists(sp[k], c -> c <> '') and size(filter(sp[k], c -> c <> '')) <= greatest(1, least(2, size(sp[k]) div 4))
             and array_max(transform(sp[k], (c, i) -> if(c <> '', i, -1))) <= least(2, size(sp[k]) - 1))"""
    join = """if(size(r) = 1, r[0], transform(r[0], (u, i) -> aggregate(r, '', (a, x) -> case when a = '' then x[i] when x[i] = '' then a
              when endswith(a, '-') then concat(a, x[i]) else concat(a, ' ', x[i]) end)))"""
    starts = f"filter(transform(sp, (x, i) -> i), k -> not {few})"
    mended = let("sp", f"transform(gd, (cells, k) -> if(k > 0, {split}, cells))", let("sa", starts, f"transform({_runs('sp', 'sa')}, r -> {join})"))
    # Without a blank cell nothing is fused, and only rows of one cell are short.
    return let("gd", grid, f"if(size(gd[0]) = 1 or exists(gd, r -> array_contains(r, '')), {mended}, gd)")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``table_rows`` with fused cells split and wrapped rows joined to the row that they continue; rows are numbered anew.

    A cell is split only if the next is blank, so no split depends on another.  A row continues the one
    before if it has few cells, all far left; runs of such rows are islands.  A hyphen at the end of a part is kept
    and joined without a space.
    """
    grids = rows.groupBy("doc_id", "element_id", "block").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("r"))
    return grids.selectExpr("doc_id", "element_id", "block", f"posexplode({_repaired('r.cells')}) as (row, cells)")


def repaired_tables(sections: DataFrame) -> DataFrame:
    """``repaired_rows`` of all tables of ``sections``, each repaired where it lies."""
    blocks = sections.selectExpr("doc_id", "element_id", f"posexplode({_blocks('content')}) as (block, lines)")
    return blocks.selectExpr("doc_id", "element_id", "block", f"posexplode({_repaired(_grid('lines'))}) as (row, cells)")


# Symbols of formulas, longer ones first, and the tables that their values come from.
SYMBOLS = ("Ro", "P", "R", "S", "E", "t", "D")
SYMBOL_TABLES = {"S": "M-1", "E": "B-12"}
FENCE = r"(?s)```[^\n]*\n(.*?)```"
# Fixed pattern of what a formula says it applies to.
APPLIES = r"(?is)(?:this\s+formula\s+applies\s+when|applies\s+when|applicable\s+when)\s*[:\-]?\s*(.+?)(?=\.\s|\.$|\n\n|\z)"


def _formulas(ref: str, content: str, only: set[str] | None = None) -> str:
    """SQL: the formulas of a section, an array of structs, or null; see ``formulas``.  With ``only``, fields of other names may be left out."""
    wanted = lambda name: only is None or name in only
    line = quoted(r"(?m)^[ \t]*(([A-Za-z]\w*)[ \t]*=[ \t]*(\S.*?))[ \t]*$")
    each = ", ".join(f"'{name}', regexp_extract(body, {line}, {i})" for i, name in ((1, "plain"), (2, "symbol"), (3, "expression")) if name == "plain" or wanted(name))
    after = ", 'after', get(bt, i)" if wanted("conditions") else ""
    # With a symbol there is a line.
    found = f"filter(transform(regexp_extract_all({content}, {quoted(FENCE)}, 1), (body, i) -> named_struct('fence', i, {each}{after})), x -> x.plain <> '')"
    if after:
        found = let("bt", f"slice(split({content}, {quoted(FENCE)}), 2, {1 << 30})", found)
    latex = rf"regexp_replace(replace(replace(x.plain, '×', '\\times '), '−', '-'), {quoted(r'^(\w+)\s*=\s*\(([^)]+)\)\s*/\s*\(([^)]+)\)\s*$')}, {quoted(r'$1 = \\frac{$2}{$3}')})"
    known = ", ".join(f"if(x.plain rlike {quoted(f'(?<![A-Za-z]){s}(?![A-Za-z])')}, '{s}', null)" for s in SYMBOLS)
    clauses = f"flatten(transform(regexp_extract_all(coalesce(x.after, ''), {quoted(APPLIES)}, 1), c -> split(c, {quoted(r'\s+(?:AND|and)\s+')})))"
    conditions = f"array_distinct(filter(transform({clauses}, c -> regexp_replace(trim(c), {quoted(r'[.:]+$')}, '')), c -> c <> ''))"
    fields = {"formula_id": f"concat_ws('-f', {ref}, i)", "fence": "x.fence", "plain": "x.plain", "symbol": "x.symbol", "expression": "x.expression", "latex": latex,
              "variables": f"array_compact(array({known}))", "conditions": conditions}
    out = f"transform({found}, (x, i) -> named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items() if wanted(k))}))"
    return f"case when {ref} is not null and contains({content}, '```') then {out} end"


def formulas(sections: DataFrame) -> DataFrame:
    """``doc_id, element_id, formula_id, fence, plain, symbol, expression, latex, variables, conditions``.

    The first ``name = ...`` line of each fenced block of a section with a reference.  ``variables`` are the known symbols in it;
    ``conditions`` come from the text up to the next block, cut at "and", each once.
    """
    return sections.selectExpr("doc_id", "element_id", f"inline({_formulas('paragraph_ref', 'content')})")


def cross_references(elements: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, source_id, target_id, reference_text``: the first mention of each target.

    ``elements``: doc_id, element_id, content; ``index``: doc_id, ref (upper case), target_id.  Mentions led
    by a verb come before tables, those before bare references, which never point at their own element.
    """
    passes = (rf"(?i){LEAD}\s+(Table\s+{REFERENCE}|{REFERENCE})", rf"(?i)(Table\s+{REFERENCE})", rf"(?i)\b({REFERENCE})\b")
    # Every reference holds a hyphen and a digit after it, so most elements meet no pattern; the others are read once for all three.
    held = elements.filter(F.col("content").rlike("-[0-9]"))
    each = F.array(*(F.struct(F.lit(n).alias("pass"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("wholes")) for n, p in enumerate(passes)))
    found = held.select("doc_id", "element_id", F.inline(each)).select("doc_id", "element_id", "pass", F.posexplode("wholes").alias("pos", "whole"))
    # Only the first pattern holds more than the reference; it finds the same in what it has matched.
    ref = F.when(F.col("pass") == 0, F.regexp_extract("whole", passes[0], 1)).otherwise(F.col("whole"))
    found = found.select("doc_id", "element_id", "pass", "pos", F.upper(F.regexp_replace(ref, r"\s+", " ")).alias("ref"), F.col("whole").alias("reference_text"))
    met = found.join(index, ["doc_id", "ref"]).filter("pass < 2 or target_id <> element_id")
    first = W.partitionBy("doc_id", "element_id", "target_id").orderBy("pass", "pos")
    return met.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc_id", F.col("element_id").alias("source_id"), "target_id", "reference_text")


def reference_index(elements: DataFrame) -> DataFrame:
    """``doc_id, ref, target_id``: the last element of a document with each reference, and of each table id after "TABLE "."""
    refs = elements.select("doc_id", "element_id", "ord", F.upper("paragraph_ref").alias("ref"))
    if "table_id" in elements.columns:
        refs = refs.unionByName(elements.select("doc_id", "element_id", "ord", F.concat(F.lit("TABLE "), F.upper("table_id")).alias("ref")))
    return refs.filter("ref is not null").groupBy("doc_id", "ref").agg(F.max_by("element_id", "ord").alias("target_id"))


def _tables(title: str, ref: str, content: str, only: set[str] | None = None) -> str:
    """SQL: the pipe tables of a section, an array of structs, or null; see ``tables``.  With ``only``, fields of other names may be left out."""
    wanted = lambda name: only is None or name in only
    after = lambda lead: rf"(?i){lead}\\Q', tid, '\\E\\b\\s*(.*)$"
    pick = " ".join(f"when cl rlike concat('{p}') then regexp_extract(cl, concat('{p}'), 1)" for p in (after(r"\\bTable\\s+"), after(r"\\b")))
    caption = f"case {pick} end"
    # Fixed patterns of what a caption is rid of.
    for pattern, to in ((r"^[ :;-]+|[ :;-]+$", ""), (r"(?i)\bCont(?:inued)?'?d\b\.?", ""), (r"\(\s*\)", ""), (r"\s+", " "), (r"^[ :;-]+|[ :;-]+$", "")):
        caption = f"regexp_replace({caption}, {quoted(pattern)}, '{to}')"
    explicit = f"if(contains(cl, '-'), nullif(upper(regexp_extract(cl, {quoted(rf'(?i)\bTable\s+({REFERENCE})\b')}, 1)), ''), null)"
    placed = f"case when {ref} is null then concat('TBL-', n) when n = 0 then {ref} else concat_ws('-', {ref}, n) end"
    fields = {"block": "n", "table_id": "tid", "caption": f"nullif({caption}, '')", "table_ref": f"coalesce({ref}, if(startswith(tid, 'TBL-'), null, tid))",
              "headers": "gr[0]", "rows": "slice(gr, 2, size(gr))", "content": "array_join(lines, '\\n')"}
    one = f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items() if k in ('block', 'table_id') or wanted(k))})"
    one = let("cl", stripped(title), let("tid", f"coalesce({explicit}, {placed})", one))
    if wanted("headers") or wanted("rows"):
        one = let("gr", _repaired(_grid("lines")), f"case when gr is not null then {one} end")
    else:
        one = f"case when {_is_table('lines')} then {one} end"
    return f"case when contains({content}, '|') then filter(transform({_blocks(content)}, (lines, n) -> {one}), t -> t is not null) end"


def tables(sections: DataFrame) -> DataFrame:
    """``doc_id, element_id, block, table_id, caption, table_ref, headers, rows, content``: pipe tables with their ids, one row each.

    The id is the one that the heading names after "Table", else the section's reference (with the table's place after the
    first), else ``TBL-`` and its place.  The caption is what follows the id in the heading.
    """
    return sections.selectExpr("doc_id", "element_id", f"inline({_tables('title', 'paragraph_ref', 'content')})")


def elements(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All elements of markdown documents in order, with ids of one namespace.

    ``doc_id, ord, element_id, element_type, paragraph_ref, title, page, parent_id, content, table_id, caption, headers, rows,
    variables, conditions``: sections, each followed by its tables and its formulas.  With ``only``, what other columns (after
    ``element_type``) would hold is neither parsed nor returned: Spark does not prune what is put together within a row.
    """
    wanted = lambda name: only is None or name in only
    none = {k: f"cast(null as {t})" for k, t in (
        ("table_id", "string"), ("caption", "string"), ("headers", "array<string>"), ("rows", "array<array<string>>"), ("variables", "array<string>"), ("conditions", "array<string>")) if wanted(k)}
    parsed = {"formula_id", "table_id", "plain", *none, *(k for k, e in (("table_ref", "paragraph_ref"), ("content", "content")) if wanted(e))}

    def element(kind: str, own: dict[str, str]) -> str:
        fields = {"element_type": f"'{kind}'", "page": "s.page"} | none | own
        return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items() if k in ('element_type', 'element_id') or wanted(k))})"

    head = element("section", {k: f"s.{k}" for k in ("element_id", "paragraph_ref", "title", "parent_id", "content")})
    table = element("table", {k: f"t.{k}" for k in ("table_id", "caption", "headers", "rows")} | {
        "element_id": f"concat('tbl-', {slug('t.table_id')})", "paragraph_ref": "t.table_ref", "title": "concat('Table ', t.table_id)", "parent_id": "s.element_id", "content": "trim(t.content)"})
    formula = element("formula", {k: f"f.{k}" for k in ("variables", "conditions")} | {
        "element_id": f"concat('fml-', {slug('f.formula_id')})", "paragraph_ref": "s.paragraph_ref", "title": "f.formula_id", "parent_id": "s.element_id", "content": "trim(f.plain)"})
    below = f"coalesce(transform({_tables('s.title', 's.paragraph_ref', 's.content', parsed)}, t -> {table}), array())", f"coalesce(transform({_formulas('s.paragraph_ref', 's.content', parsed)}, f -> {formula}), array())"
    every = f"flatten(transform({_sections('text', wanted('parent_id'))}, s -> concat(array({head}), {below[0]}, {below[1]})))"
    unique = F.when((F.col("e.element_type") != "section") & (F.col("n") > 1), F.concat_ws("-", "e.element_id", "n")).otherwise(F.col("e.element_id"))
    # Elements become rows before they are numbered, so that each is put together once.
    rows = docs.selectExpr("doc_id", f"{every} as ev").selectExpr("doc_id", "ev", f"{repeats('transform(ev, e -> e.element_id)')} as rp")
    # An outer one, as before another Spark puts a filter on the array, for which all is parsed twice.
    rows = rows.selectExpr("doc_id", "rp", "posexplode_outer(ev) as (at, e)").filter("e is not null")
    rows = rows.select("doc_id", (F.col("at") + 1).alias("ord"), F.get("rp", "at").alias("n"), "e")
    return rows.select("doc_id", "ord", unique.alias("element_id"), "e.element_type", *(f"e.{k}" for k in ("paragraph_ref", "title", "page", "parent_id", "content", *none) if wanted(k)))
