"""Deterministic thickness calculation over tables of requests.

A request is ``component, p_mpa, diameter_mm, temp_c, material, joint_type, rt_level, ca_mm``.
Lookups are broadcast joins with small dims, arithmetic is decimal, and a request that cannot be
computed gets an ``error_code`` (the first check that fails) rather than failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import pinned

COMPONENTS = ("cylinder_inside", "cylinder_outside", "sphere")
# Pressure limits as a share of S * E.
PRESSURE_LIMIT = "case when component = 'sphere' then 0.665BD else 0.385BD end"


def requests_from_lines(lineitem: DataFrame) -> DataFrame:
    """Deterministic requests from order lines, covering every reachable error."""
    names = ", ".join(f"'{m[0]}'" for m in pinned.MATERIALS)
    return lineitem.selectExpr(
        "l_orderkey", "l_linenumber",
        "element_at(array('cylinder_inside', 'cylinder_outside', 'sphere'), cast(l_orderkey % 3 as int) + 1) as component",
        "cast((0.5BD + cast(l_quantity as decimal(5,0)) / 20) * (case when l_partkey % 11 = 0 then 20 else 1 end) as decimal(7,3)) as p_mpa",
        "cast(case when l_orderkey % 50 <> 0 then 500 + (l_orderkey % 14) * 100 end as decimal(8,3)) as diameter_mm",
        "cast(20 + (l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % 621 as int) as temp_c",
        f"case when l_partkey % 7 < 6 then element_at(array({names}), cast(l_partkey % 7 as int) + 1) else 'unknown' end as material",
        "cast(l_linenumber % 7 as int) as joint_type",
        "case l_returnflag when 'A' then 'Full RT' when 'N' then 'Spot RT' else 'No RT' end as rt_level",
        "cast(round(l_discount * 100) as decimal(5,0)) * 0.2BD as ca_mm",
    )


def normalise_rt(col: str) -> str:
    """SQL for the radiography level: full, then spot, then anything that holds "no"."""
    return f"case when lower({col}) like '%full%' then 'Full RT' when lower({col}) like '%spot%' then 'Spot RT' when lower({col}) like '%no%' then 'No RT' end"


def with_stress(requests: DataFrame) -> DataFrame:
    """Add ``known_material, max_temp, s_mpa, s_num, s_den``: linear between tabulated temperatures, null outside them or above the limit.

    ``s_num / s_den`` is the stress without rounding, for arithmetic that rounds halves.
    """
    spark = requests.sparkSession
    b = pinned.brackets(spark)
    dims = b.groupBy("material").agg(F.first("max_temp").alias("max_temp"), F.collect_list(F.struct("lo", "hi", "s_lo", "s_hi")).alias("points"))
    joined = requests.join(F.broadcast(dims), "material", "left")
    at = F.expr("element_at(filter(points, p -> p.lo <= temp_c and temp_c < p.hi), 1)")
    # An empty filter gives no element, not an error.
    at = F.when(F.expr("exists(points, p -> p.lo <= temp_c and temp_c < p.hi) and temp_c <= max_temp"), at)
    # Temperatures may have fractions.
    told = joined.withColumn("b", at).selectExpr(
        "* except (points, b)", "max_temp is not null as known_material", "cast(b.hi - b.lo as decimal(5,0)) as s_den",
        "cast(cast(b.s_lo * (b.hi - b.lo) as decimal(10,0)) + cast(b.s_hi - b.s_lo as decimal(5,0)) * cast(temp_c - b.lo as decimal(9,4)) as decimal(14,4)) as s_num",
    )
    return told.withColumn("s_mpa", F.expr("s_num / s_den"))


def with_efficiency(requests: DataFrame) -> DataFrame:
    return requests.join(F.broadcast(pinned.joint_table(requests.sparkSession)), ["joint_type", "rt_level"], "left")


def calculate(requests: DataFrame) -> DataFrame:
    """Add ``s_mpa, e, t_min_mm, t_design_mm, plate_mm, mawp_mpa, limit_mpa, error_code``; one projection chain, no shuffle.

    Stress times efficiency stays a fraction ``se / s_den`` until the one division of each result, so halves round up exactly.
    ``limit_mpa`` is the pressure up to which the formula applies.
    """
    t = with_efficiency(with_stress(requests)).withColumn("r", F.expr("cast(diameter_mm / 2 as decimal(9,3))"))
    t = t.withColumn("se", F.expr("cast(s_num * e as decimal(18,6))")).withColumn("pd", F.expr("cast(p_mpa * s_den as decimal(12,3))"))
    t = t.withColumn("denominator", F.expr(
        "cast(case component when 'cylinder_inside' then se - 0.6BD * pd when 'cylinder_outside' then se + 0.4BD * pd else 2 * se - 0.2BD * pd end as decimal(20,6))"
    ))
    t = t.withColumn("t_min", F.expr("case when denominator > 0 then round(cast(pd * r as decimal(20,6)) / denominator, 2) end"))
    t = t.withColumn("t_design", F.expr("cast(t_min + ca_mm as decimal(12,2))"))
    plates = ", ".join(map(str, pinned.PLATES))
    t = t.withColumn("plate", F.expr(f"array_min(filter(array({plates}), x -> x >= t_design))"))
    t = t.withColumn("limit", F.expr(f"cast(round(cast(se * {PRESSURE_LIMIT} as decimal(22,9)) / s_den, 4) as decimal(12,4))"))
    error = F.expr(f"""
        case when not known_material then 'material' when s_num is null then 'temperature' when e is null then 'joint'
             when r is null then 'diameter' when pd > se * {PRESSURE_LIMIT} then 'applicability' when t_min is null then 'denominator'
             when t_min > r / 2 then 'thick_wall' when ca_mm < 0 then 'corrosion' when plate is null then 'plate' end
    """)
    t = t.withColumn("error_code", error).withColumn("tc", F.expr("cast(plate - ca_mm as decimal(8,2))"))
    mawp = F.expr("""
        round(cast(se * tc * (case when component = 'sphere' then 2 else 1 end) as decimal(26,8)) / cast(
            s_den * case component when 'cylinder_inside' then r + 0.6BD * tc when 'cylinder_outside' then r - 0.4BD * tc else r + 0.2BD * tc end as decimal(18,4)), 3)
    """)
    ok = F.col("error_code").isNull()
    t = t.withColumn("mawp", mawp).withColumn("s", F.expr("cast(s_mpa as decimal(12,8))"))
    return t.select(
        *requests.columns, *(F.when(ok, F.col(a)).cast(kind).alias(b) for a, b, kind in (
            ("s", "s_mpa", "double"), ("e", "e", "double"), ("t_min", "t_min_mm", "double"), ("t_design", "t_design_mm", "double"),
            ("plate", "plate_mm", "int"), ("mawp", "mawp_mpa", "double"), ("limit", "limit_mpa", "decimal(12,4)"))), "error_code",
    )


def trace(results: DataFrame, keys: list[str]) -> DataFrame:
    """The steps of each computed result as rows: ``step, step_key, result``."""
    values = {
        "allowable_stress": "s_mpa", "joint_efficiency": "e", "radius": "diameter_mm / 2", "min_thickness": "t_min_mm",
        "design_thickness": "t_design_mm", "nominal_plate": "plate_mm", "mawp": "mawp_mpa",
    }
    steps = F.array(*(
        F.struct(F.lit(i).alias("step"), F.lit(k).alias("step_key"), F.expr(v).cast("double").alias("result"))
        for i, (k, v) in enumerate(values.items(), 1)
    ))
    # A filter would move below the calculation, and calculate all again for its condition.
    return results.select(*keys, F.inline(F.when(F.col("error_code").isNull(), steps)))


# Fixed patterns of the request grammar.
NUMBER = r"([0-9.]+)"
PATTERNS = {
    "p_mpa": rf"(?i)(?:\bP\s*=?\s*|design\s+pressure(?:\s*=)?\s*){NUMBER}\s*MPa",
    "inside_mm": rf"(?i)(?:inside\s+diameter|ID)\s*=?\s*{NUMBER}(?:\s*mm)?",
    "outside_mm": rf"(?i)(?:outside\s+diameter|OD)\s*=?\s*{NUMBER}(?:\s*mm)?",
    "temp_c": r"(?i)(?:\bT\s*=?\s*|design\s+temperature(?:\s*=)?\s*)([0-9]+(?:\.[0-9]+)?)\s*°?\s*C",
    "any_temp_c": r"(?i)([0-9]+(?:\.[0-9]+)?)\s*°\s*C",
    "material": r"(?i)(SM-[0-9]+(?:\s+(?:Gr(?:ade)?|Type)\s+\w+)?)",
    "joint_type": r"(?i)Type\s+([0-9])\b",
    "rt": r"(?i)(full\s+(?:RT|radiography)|spot\s+(?:RT|radiography)|no\s+(?:RT|radiography))",
    "ca_mm": rf"(?i)(?:corrosion\s+allowance|CA)\s*=?\s*{NUMBER}(?:\s*mm)?",
}


def parse_requests(queries: DataFrame, text: str = "query") -> DataFrame:
    """Requests from sentences; null in every column where a required value is missing or no number (the allowance defaults to 0).

    Dots after a number end the sentence and are no part of it.  Without a temperature after "T" or "design temperature",
    the first one in degrees counts.
    """
    part = {k: F.nullif(F.regexp_extract(text, v, 1), F.lit("")) for k, v in PATTERNS.items()}
    q = queries.withColumns({f"_{k}": v for k, v in part.items()})
    number = lambda c: f"try_cast(rtrim('.', {c}) as double)"
    q = q.withColumns({
        "_p": F.expr(number("_p_mpa")), "_d": F.expr(number("coalesce(_inside_mm, _outside_mm)")), "_t": F.expr(number("coalesce(_temp_c, _any_temp_c)")),
        "_ca": F.when(F.col("_ca_mm").isNull(), 0.0).otherwise(F.expr(number("_ca_mm"))),
    })
    complete = F.expr("_p is not null and _d is not null and _t is not null and _ca is not null and _material is not null and _joint_type is not null and _rt is not null")
    values = {
        "component": f"case when _inside_mm is null then 'cylinder_outside' when lower({text}) like '%spher%' then 'sphere' else 'cylinder_inside' end",
        "p_mpa": "_p", "diameter_mm": "_d", "temp_c": "_t",
        "material": r"regexp_replace(trim(regexp_replace(_material, '\\s+', ' ')), '(?i)Grade', 'Gr')", "joint_type": "cast(_joint_type as int)",
        "rt_level": normalise_rt("_rt"), "ca_mm": "_ca",
    }
    return q.select(*queries.columns, *(F.when(complete, F.expr(v)).alias(k) for k, v in values.items()))


# The paragraph and the formula of each component.
FORMULAS = {
    "cylinder_inside": ("A-27(c)(1)", "t = (P × R) / (S × E − 0.6 × P)"), "cylinder_outside": ("A-27(c)(2)", "t = (P × Ro) / (S × E + 0.4 × P)"),
    "sphere": ("A-27(d)", "t = (P × R) / (2 × S × E − 0.2 × P)"),
}


def summaries(results: DataFrame) -> DataFrame:
    """Add ``summary``: nine lines for a computed result, null for one with an error."""
    pick = lambda i: "case component " + " ".join(f"when '{c}' then '{v[i]}'" for c, v in FORMULAS.items()) + " end"
    lines = (
        f"concat('formula = ', {pick(0)}, ': ', {pick(1)})", "concat('S (allowable stress) = ', format_string('%.3f', s_mpa), ' MPa')", "concat('E (joint efficiency) = ', format_string('%.2f', e))",
        "concat('R = ', format_string('%.1f', cast(diameter_mm / 2 as double)), ' mm')", "concat('applicability: ', format_string('%.3f', cast(p_mpa as double)), ' ≤ ', cast(limit_mpa as string), ' → OK')",
        "concat('t_min = ', format_string('%.2f', t_min_mm), ' mm')", "concat('t_design (with CA) = ', format_string('%.2f', t_design_mm), ' mm')",
        "concat('t_nominal (plate) = ', plate_mm, ' mm')", "concat('MAWP = ', format_string('%.3f', mawp_mpa), ' MPa')",
    )
    return results.withColumn("summary", F.when(F.col("error_code").isNull(), F.expr(f"array_join(array({', '.join(lines)}), '\n')")))


def coerced_joint(col: str) -> str:
    """SQL: a joint type from 1 to 6 out of "2", "Type 2" or a phrase with it; null otherwise."""
    return rf"cast(coalesce(nullif(regexp_extract(trim({col}), '^([1-6])$', 1), ''), nullif(regexp_extract(lower({col}), '\\btype\\s*([1-6])\\b', 1), '')) as int)"


def coerced_component(col: str) -> str:
    """SQL: a component out of its name or a phrase about it; null otherwise."""
    name, low = rf"regexp_replace(lower(trim({col})), '[\\s-]+', '_')", f"lower(trim({col}))"
    return rf"""case when {name} in ('cylindrical_shell', 'cylindrical_shell_inside_radius', 'inside_radius_cylindrical_shell') then 'cylinder_inside'
        when {name} in ('cylindrical_shell_outside_radius', 'outside_radius_cylindrical_shell') then 'cylinder_outside' when {low} like '%spher%' then 'sphere'
        when {low} like '%outside%' or {low} rlike '\\bod\\b' then 'cylinder_outside' when {low} rlike 'cylind|shell|vessel|inside|\\bid\\b' then 'cylinder_inside' end"""


def coerced_rt(col: str) -> str:
    """SQL: a radiography level out of a phrase; null where it has none of "full", "spot", "no", "without"."""
    low = rf"lower({col})"
    return f"case when {low} like '%full%' then 'Full RT' when {low} like '%spot%' then 'Spot RT' when {low} like '%no%' or {low} like '%without%' then 'No RT' end"


def is_lookup(query: str, kind: str) -> str:
    """SQL: whether a look-up of that kind answers the query by itself; one that asks for a calculation is not answered so."""
    q = f"lower({query})"
    return f"""(not {q} rlike 'calculate|compute|thickness|mawp' and case {kind} when 'allowable_stress' then {q} like '%stress%' when 'joint_efficiency' then {q} like '%efficiency%'
        when 'material' then {q} rlike 'product form|max temperature|maximum temperature|p-number|p number|group number|material|listed for' else false end)"""
