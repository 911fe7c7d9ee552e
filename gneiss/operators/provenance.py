"""Steps of calculations with their inputs, and what each of these is taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.calculation import FORMULAS, PRESSURE_LIMIT

CITE = "struct<kind:string,ref:string,needle:string>"
# Formulas of the pressure that the chosen plate bears.
MAWP_FORMULAS = {
    "cylinder_inside": "P = (S × E × t_corr) / (R + 0.6 × t_corr)", "cylinder_outside": "P = (S × E × t_corr) / (Ro − 0.4 × t_corr)",
    "sphere": "P = (2 × S × E × t_corr) / (R + 0.2 × t_corr)",
}


def _of(component: dict[str, str]) -> Column:
    return F.expr("case component " + " ".join(f"when '{k}' then '{v}'" for k, v in component.items()) + " end")


def _cite(kind: str | None = None, ref: Column | None = None, needle: Column | None = None) -> Column:
    if kind is None:
        return F.lit(None).cast(CITE)
    return F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), (F.lit(None).cast("string") if needle is None else needle).alias("needle")).cast(CITE)


def steps(results: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, step, step_key, formula, result, unit, cite, inputs`` of each computed result, in order.

    ``results``: requests with what ``calculation.calculate`` adds.  ``inputs`` maps a symbol to its value, unit, source (``user_input``, ``pinned_data`` or
    ``calculated``) and, for trusted data, its citation: kind, ref and needle for ``citations.build``.
    """
    formula = _cite("paragraph", _of({k: v[0] for k, v in FORMULAS.items()}))
    stress = _cite("material", F.lit("Table M-1"), F.col("material"))
    joint = _cite("row", F.lit("Table B-12"), F.concat(F.lit("| "), F.col("joint_type").cast("string"), F.lit(" |")))

    def value(v: Column | str, unit: str, source: str, cite: Column | None = None) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        return F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source"), (_cite() if cite is None else cite).alias("cite"))

    p, s, e = value("p_mpa", "MPa", "user_input"), value("s_mpa", "MPa", "pinned_data", stress), value("e", "", "pinned_data", joint)
    r = value(F.col("diameter_mm") / 2, "mm", "calculated")
    rows = [
        ("allowable_stress", F.concat(F.lit("S = Table M-1("), "material", F.lit(", "), F.col("temp_c").cast("double").cast("string"), F.lit(" °C)")), "s_mpa", "MPa", stress, {"T": value("temp_c", "°C", "user_input")}),
        ("joint_efficiency", F.concat(F.lit("E = Table B-12(Type "), F.col("joint_type").cast("string"), F.lit(", "), "rt_level", F.lit(")")), "e", "", joint, {"joint_type": value("joint_type", "", "user_input")}),
        ("applicability_check", F.expr(f"concat('P ≤ ', {PRESSURE_LIMIT}, ' × S × E')"), "limit_mpa", "MPa", formula, {"P": p, "S": s, "E": e}),
        ("min_thickness", _of({k: v[1] for k, v in FORMULAS.items()}), "t_min_mm", "mm", formula, {"P": p, "R": r, "S": s, "E": e}),
        ("design_thickness", F.lit("t_design = t_min + CA"), "t_design_mm", "mm", _cite("paragraph", F.lit("A-25")), {"t_min": value("t_min_mm", "mm", "calculated"), "CA": value("ca_mm", "mm", "user_input")}),
        ("nominal_plate", F.lit("t_nominal = next standard plate"), "plate_mm", "mm", formula, {"t_design": value("t_design_mm", "mm", "calculated")}),
        ("mawp", _of(MAWP_FORMULAS), "mawp_mpa", "MPa", formula, {"S": s, "E": e, "t_corr": value(F.col("plate_mm") - F.col("ca_mm"), "mm", "calculated"), "R": r}),
    ]
    each = F.array(*(
        F.struct(
            F.lit(i).alias("step"), F.lit(name).alias("step_key"), text.alias("formula"), F.col(result).cast("double").alias("result"), F.lit(unit).alias("unit"), cite.alias("cite"),
            F.create_map(*(x for k, v in inputs.items() for x in (F.lit(k), v))).alias("inputs"),
        )
        for i, (name, text, result, unit, cite, inputs) in enumerate(rows, 1)
    ))
    # A filter would move below the calculation, and calculate all again for its condition.
    return results.select(*keys, F.inline(F.when(F.col("error_code").isNull(), each)))


def citations_of(done: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, step, input, place, kind, ref, needle``: each step's own citation (``input`` null) and those of its inputs, unnested."""
    own = F.array(F.struct(F.lit(None).cast("string").alias("input"), F.col("cite").alias("c")))
    nested = F.transform(F.map_entries("inputs"), lambda x: F.struct(x["key"].alias("input"), x["value"]["cite"].alias("c")))
    each = done.select(*keys, "step", F.posexplode(F.concat(own, F.filter(nested, lambda x: x["c"].isNotNull()))).alias("place", "x"))
    return each.select(*keys, "step", "x.input", "place", "x.c.*")
