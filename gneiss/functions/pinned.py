"""Trusted reference tables: a few rows each, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Allowable stress in MPa by temperature in degrees Celsius, and the highest temperature.
TEMPERATURES = (40, 100, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600)
MATERIALS = (
    ("SM-516 Gr 70", 500, (138, 138, 138, 134, 127, 121, 114, 103, 73, 49)),
    ("SM-515 Gr 70", 500, (138, 138, 138, 132, 124, 118, 110, 98, 69, 46)),
    ("SM-106 Gr B", 500, (118, 118, 118, 115, 108, 102, 96, 86, 61, 41)),
    ("SM-105", 500, (138, 138, 138, 133, 125, 119, 112, 100, 71, 47)),
    ("SM-240 Type 304", 600, (137, 127, 119, 113, 108, 103, 100, 97, 95, 93, 82, 67)),
    ("SM-240 Type 316", 600, (137, 137, 130, 123, 117, 112, 108, 105, 103, 101, 92, 76)),
)
# Joint efficiency by joint type, for full, spot and no radiography.
RT_LEVELS = ("Full RT", "Spot RT", "No RT")
JOINT_EFFICIENCY = (
    (1, ("1.00", "0.85", "0.70")),
    (2, ("0.90", "0.80", "0.65")),
    (3, ("0.80", "0.70", "0.60")),
    (4, ("0.75", "0.65", "0.55")),
    (5, ("0.70", "0.60", "0.50")),
    (6, ("0.65", "0.55", "0.45")),
)
# Standard plate thicknesses in mm.
PLATES = (6, 8, 10, 12, 14, 16, 18, 20, 22, 25, 28, 30, 32, 36, 40, 45, 50)


def stress_rows() -> list[tuple[str, int, int, int]]:
    """material, max_temp, temp, stress."""
    return [(m, top, t, s) for m, top, row in MATERIALS for t, s in zip(TEMPERATURES, row, strict=False)]


def joint_rows() -> list[tuple[int, str, str]]:
    return [(j, rt, e) for j, row in JOINT_EFFICIENCY for rt, e in zip(RT_LEVELS, row, strict=True)]


def stress_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(stress_rows(), "material string, max_temp int, temp int, stress int")


def brackets(spark: SparkSession) -> DataFrame:
    """One row per material and pair of neighbouring tabulated temperatures: ``lo <= t < hi``.

    The last temperature is a bracket of its own, so an as-of lookup is an equi-join on the
    material and a range check.
    """
    rows = []
    for m, top, row in MATERIALS:
        points = list(zip(TEMPERATURES, row, strict=False))
        following = [*points[1:], (points[-1][0] + 1, points[-1][1])]
        rows += [(m, top, t0, t1, s0, s1) for (t0, s0), (t1, s1) in zip(points, following, strict=True)]
    return spark.createDataFrame(rows, "material string, max_temp int, lo int, hi int, s_lo int, s_hi int")


def joint_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(joint_rows(), "joint_type int, rt_level string, e string").selectExpr(
        "joint_type", "rt_level", "cast(e as decimal(3,2)) as e"
    )


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES list as text, for SQL counterparts."""
    body = ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"
