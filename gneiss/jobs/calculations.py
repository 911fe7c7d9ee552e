"""Queries of the calculation family, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import pinned
from gneiss.operators import calculation as C
from gneiss.session import table

KEYS = ["l_orderkey", "l_linenumber"]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return C.requests_from_lines(table(spark, sf, "lineitem"))


def calc_thickness(spark: SparkSession, sf: str) -> DataFrame:
    return C.calculate(requests(spark, sf)).select(*KEYS, "s_mpa", "e", "t_min_mm", "t_design_mm", "plate_mm", "mawp_mpa", "error_code")


def calc_errors(spark: SparkSession, sf: str) -> DataFrame:
    done = C.calculate(requests(spark, sf))
    return done.groupBy("component", F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("t_min_mm"), 6).alias("mean_t_min"))


def calc_trace(spark: SparkSession, sf: str) -> DataFrame:
    return C.trace(C.calculate(requests(spark, sf)), KEYS)


def stress_interp(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_stress(requests(spark, sf)).select(*KEYS, "material", "temp_c", F.round(F.col("s_mpa").cast("double"), 6).alias("s_mpa"))


def joint_eff_lookup(spark: SparkSession, sf: str) -> DataFrame:
    spelled = requests(spark, sf).withColumn("said", F.expr("case rt_level when 'Full RT' then 'FULL radiography' when 'Spot RT' then 'spot rt' else 'unknown' end"))
    return C.with_efficiency(spelled.withColumn("rt_level", F.expr(C.normalise_rt("said")))).select(*KEYS, "said", "rt_level", F.col("e").cast("double").alias("e"))


def next_plate(spark: SparkSession, sf: str) -> DataFrame:
    plates = ", ".join(map(str, pinned.PLATES))
    return table(spark, sf, "lineitem").selectExpr(*KEYS, "l_quantity + l_tax as t_mm", f"array_min(filter(array({plates}), x -> x >= l_quantity + l_tax)) as plate_mm")


def calc_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences in several forms: with fractional temperatures, without a "T", and with a dot at the end."""
    said = requests(spark, sf).selectExpr(
        *KEYS,
        """concat('Compute the ', case when component = 'sphere' then 'spherical' else 'cylindrical' end, ' shell thickness: P = ', cast(p_mpa as string), ' MPa, ',
                  case when component = 'cylinder_outside' then 'OD=' else 'inside diameter ' end, coalesce(cast(diameter_mm as string), 'unknown'), ' mm, ',
                  case when l_linenumber % 3 = 0 then 'at ' when l_linenumber % 3 = 1 then 'T=' else 'design temperature ' end, temp_c, case when l_orderkey % 2 = 0 then '.5' else '' end,
                  '°C, ', material, ', weld joint Type ', joint_type, ', ', replace(rt_level, 'RT', 'radiography'), ', CA ', cast(ca_mm as string), case when l_linenumber % 2 = 0 then '.' else ' mm' end) as query""",
    )
    return C.parse_requests(said).drop("query")


def calc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.summaries(C.calculate(requests(spark, sf))).filter("summary is not null").select(*KEYS, "summary")


def coerced_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases as a model would put them, and the values they stand for."""
    said = table(spark, sf, "lineitem").selectExpr(
        *KEYS,
        "element_at(array(cast(l_linenumber as string), concat('Type ', l_linenumber), concat('type', l_linenumber, ' with full radiography'), 'Type seven', ' 3 '), cast(l_partkey % 5 as int) + 1) as joint",
        "element_at(array('Cylindrical Shell', 'outside radius cylindrical-shell', 'a spherical head', 'pipe by OD', 'pressure vessel', 'flange'), cast(l_suppkey % 6 as int) + 1) as part",
        "element_at(array('Fully radiographed', 'spot_rt', 'without radiography', 'not radiographed', 'partly'), cast(l_orderkey % 5 as int) + 1) as rt",
        "element_at(array('Which allowable stress is listed for SM-105?', 'Compute the stress', 'What is the joint efficiency?', 'material P-number'), cast(l_orderkey % 4 as int) + 1) as query",
    )
    return said.selectExpr(
        *KEYS, f"{C.coerced_joint('joint')} as joint_type", f"{C.coerced_component('part')} as component", f"{C.coerced_rt('rt')} as rt_level",
        *(f"{C.is_lookup('query', repr(k))} as is_{k}" for k in ("allowable_stress", "joint_efficiency", "material")),
    )


_REQUESTS = f"""
    WITH m(k, material) AS (SELECT * FROM {pinned.values_sql(list(enumerate(m[0] for m in pinned.MATERIALS)), "k, material")}),
    q AS (SELECT l_orderkey, l_linenumber, ['cylinder_inside', 'cylinder_outside', 'sphere'][l_orderkey % 3 + 1] AS component,
            (500 + 50 * l_quantity::BIGINT) * (CASE WHEN l_partkey % 11 = 0 THEN 20 ELSE 1 END) AS p,
            CASE WHEN l_orderkey % 50 <> 0 THEN 500 + (l_orderkey % 14) * 100 END AS dia,
            20 + (l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % 621 AS temp_c,
            coalesce(m.material, 'unknown') AS material, (l_linenumber % 7)::INT AS joint_type,
            CASE l_returnflag WHEN 'A' THEN 'Full RT' WHEN 'N' THEN 'Spot RT' ELSE 'No RT' END AS rt_level,
            2 * round(l_discount * 100)::BIGINT AS ca10
          FROM lineitem LEFT JOIN m ON m.k = l_partkey % 7),
    st AS (SELECT * FROM {pinned.values_sql(pinned.stress_rows(), "material, max_temp, temp, stress")}),
    pts AS (SELECT material, temp_c, any_value(max_temp) AS max_temp,
              max_by(stress, temp) FILTER (WHERE temp <= temp_c) AS s0, max(temp) FILTER (WHERE temp <= temp_c) AS t0,
              min_by(stress, temp) FILTER (WHERE temp > temp_c) AS s1, min(temp) FILTER (WHERE temp > temp_c) AS t1
            FROM (SELECT DISTINCT material, temp_c FROM q) JOIN st USING (material) GROUP BY material, temp_c),
    s AS (SELECT q.*, max_temp, CASE WHEN temp_c > max_temp OR t0 IS NULL OR (t1 IS NULL AND temp_c > t0) THEN NULL
                                     WHEN temp_c = t0 THEN 1 ELSE t1 - t0 END AS qd,
            CASE WHEN temp_c = t0 THEN s0 ELSE s0 * (t1 - t0) + (s1 - s0) * (temp_c - t0) END AS sn
          FROM q LEFT JOIN pts USING (material, temp_c)),
    je AS (SELECT joint_type, rt_level, round(e::DOUBLE * 100)::BIGINT AS e FROM {pinned.values_sql(pinned.joint_rows(), "joint_type, rt_level, e")})
"""
# Whole numbers throughout: halves round up exactly.
CALC = _REQUESTS + f""",
    c AS (SELECT s.*, e, 10 * qd * p * dia AS num,
            2 * CASE component WHEN 'cylinder_inside' THEN 100 * sn * e - 6 * qd * p WHEN 'cylinder_outside' THEN 100 * sn * e + 4 * qd * p
                               ELSE 200 * sn * e - 2 * qd * p END AS den
          FROM s LEFT JOIN je USING (joint_type, rt_level)),
    d AS (SELECT *, CASE WHEN den > 0 THEN (200 * num + den) // (2 * den) END AS t100 FROM c),
    f AS (SELECT *, t100 + 10 * ca10 AS td100, (SELECT min(x) FROM unnest({list(pinned.PLATES)}) u(x) WHERE 100 * x >= t100 + 10 * ca10) AS plate FROM d),
    g AS (SELECT *, 10 * plate - ca10 AS tc10, CASE WHEN max_temp IS NULL THEN 'material' WHEN qd IS NULL THEN 'temperature' WHEN e IS NULL THEN 'joint'
                 WHEN dia IS NULL THEN 'diameter'
                 WHEN 100 * p * qd * 1000 > sn * e * 1000 * (CASE component WHEN 'sphere' THEN 665 ELSE 385 END) THEN 'applicability'
                 WHEN t100 IS NULL THEN 'denominator' WHEN t100 > 25 * dia THEN 'thick_wall' WHEN plate IS NULL THEN 'plate' END AS error_code FROM f),
    h AS (SELECT *, 2 * 1000 * sn * e * tc10 * (CASE component WHEN 'sphere' THEN 2 ELSE 1 END) AS mn,
            10 * qd * (50 * dia + CASE component WHEN 'cylinder_inside' THEN 6 WHEN 'cylinder_outside' THEN -4 ELSE 2 END * tc10) AS md FROM g),
    r AS (SELECT l_orderkey, l_linenumber, component, dia, error_code, CASE WHEN error_code IS NULL THEN sn::DOUBLE / qd END AS s_mpa,
            CASE WHEN error_code IS NULL THEN e / 100.0::DOUBLE END AS e, CASE WHEN error_code IS NULL THEN t100 / 100.0::DOUBLE END AS t_min_mm,
            CASE WHEN error_code IS NULL THEN td100 / 100.0::DOUBLE END AS t_design_mm, CASE WHEN error_code IS NULL THEN plate END AS plate_mm,
            CASE WHEN error_code IS NULL THEN ((mn + md) // nullif(2 * md, 0)) / 1000.0::DOUBLE END AS mawp_mpa FROM h)
"""

QUERIES = {f.__name__: f for f in (calc_thickness, calc_errors, calc_trace, stress_interp, joint_eff_lookup, next_plate, calc_parse, calc_summary, coerced_inputs)}
ORACLES = {
    "calc_thickness": CALC + "SELECT l_orderkey, l_linenumber, round(s_mpa, 8) AS s_mpa, e, t_min_mm, t_design_mm, plate_mm::INT AS plate_mm, mawp_mpa, error_code FROM r",
    "calc_errors": CALC + "SELECT component, coalesce(error_code, 'ok') AS outcome, count(*) AS n, round(avg(t_min_mm), 6) AS mean_t_min FROM r GROUP BY ALL",
    "calc_trace": CALC + """, w AS (SELECT * FROM r WHERE error_code IS NULL)
        SELECT l_orderkey, l_linenumber, 1 AS step, 'allowable_stress' AS step_key, round(s_mpa, 8) AS result FROM w
        UNION ALL SELECT l_orderkey, l_linenumber, 2, 'joint_efficiency', e FROM w UNION ALL SELECT l_orderkey, l_linenumber, 3, 'radius', dia / 2.0::DOUBLE FROM w
        UNION ALL SELECT l_orderkey, l_linenumber, 4, 'min_thickness', t_min_mm FROM w UNION ALL SELECT l_orderkey, l_linenumber, 5, 'design_thickness', t_design_mm FROM w
        UNION ALL SELECT l_orderkey, l_linenumber, 6, 'nominal_plate', plate_mm::DOUBLE FROM w UNION ALL SELECT l_orderkey, l_linenumber, 7, 'mawp', mawp_mpa FROM w""",
    "stress_interp": _REQUESTS + "SELECT l_orderkey, l_linenumber, material, temp_c::INT AS temp_c, round(sn::DOUBLE / qd, 6) AS s_mpa FROM s",
    "joint_eff_lookup": _REQUESTS + """SELECT l_orderkey, l_linenumber, CASE rt_level WHEN 'Full RT' THEN 'FULL radiography' WHEN 'Spot RT' THEN 'spot rt' ELSE 'unknown' END AS said,
        rt_level, e / 100.0::DOUBLE AS e FROM q LEFT JOIN je USING (joint_type, rt_level)""",
    "next_plate": f"SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS t_mm, (SELECT min(x) FROM unnest({list(pinned.PLATES)}) u(x) WHERE x >= l_quantity + l_tax)::INT AS plate_mm FROM lineitem",
    "calc_parse": _REQUESTS + """, o AS (SELECT *, dia IS NOT NULL AND material <> 'unknown' AS ok FROM q)
        SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN component END AS component, CASE WHEN ok THEN p / 1000.0::DOUBLE END AS p_mpa, CASE WHEN ok THEN dia::DOUBLE END AS diameter_mm,
            CASE WHEN ok THEN temp_c + CASE WHEN l_orderkey % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE END AS temp_c, CASE WHEN ok THEN material END AS material,
            CASE WHEN ok THEN joint_type END AS joint_type,
            CASE WHEN ok THEN rt_level END AS rt_level, CASE WHEN ok THEN ca10 / 10.0::DOUBLE END AS ca_mm FROM o""",
    "calc_summary": CALC + """, w AS (SELECT l_orderkey, l_linenumber, component, dia, p, sn, qd, plate, e AS e100, sn::DOUBLE / qd AS s_mpa, e / 100.0::DOUBLE AS e, t100 / 100.0::DOUBLE AS t_min_mm, td100 / 100.0::DOUBLE AS t_design_mm,
            plate AS plate_mm, ((mn + md) // nullif(2 * md, 0)) / 1000.0::DOUBLE AS mawp_mpa FROM h WHERE error_code IS NULL)
        SELECT l_orderkey, l_linenumber, 'formula = ' || CASE component WHEN 'cylinder_inside' THEN 'A-27(c)(1): t = (P × R) / (S × E − 0.6 × P)' WHEN 'cylinder_outside' THEN 'A-27(c)(2): t = (P × Ro) / (S × E + 0.4 × P)'
                ELSE 'A-27(d): t = (P × R) / (2 × S × E − 0.2 × P)' END || chr(10) || 'S (allowable stress) = ' || printf('%.3f', s_mpa) || ' MPa' || chr(10) || 'E (joint efficiency) = ' || printf('%.2f', e) || chr(10)
            || 'R = ' || printf('%.1f', dia / 2.0::DOUBLE) || ' mm' || chr(10) || 'applicability: ' || printf('%.3f', p / 1000.0::DOUBLE) || ' ≤ '
            || printf('%.4f', ((sn * e100 * CASE component WHEN 'sphere' THEN 665 ELSE 385 END * 2 + 10 * qd) // (20 * qd)) / 10000.0::DOUBLE) || ' → OK' || chr(10) || 't_min = ' || printf('%.2f', t_min_mm) || ' mm' || chr(10)
            || 't_design (with CA) = ' || printf('%.2f', t_design_mm) || ' mm' || chr(10) || 't_nominal (plate) = ' || plate_mm || ' mm' || chr(10) || 'MAWP = ' || printf('%.3f', mawp_mpa) || ' MPa' AS summary FROM w""",
    "coerced_inputs": """SELECT l_orderkey, l_linenumber, (CASE l_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN 3 ELSE CASE WHEN l_linenumber <= 6 THEN l_linenumber END END)::INT AS joint_type,
        ['cylinder_inside', 'cylinder_outside', 'sphere', 'cylinder_outside', 'cylinder_inside', NULL][l_suppkey % 6 + 1] AS component, ['Full RT', 'Spot RT', 'No RT', 'No RT', NULL][l_orderkey % 5 + 1] AS rt_level,
        l_orderkey % 4 = 0 AS is_allowable_stress, l_orderkey % 4 = 2 AS is_joint_efficiency, l_orderkey % 4 IN (0, 3) AS is_material FROM lineitem""",
}
