"""Wafer maps and spatial summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.functions.columns import rounded, steady
from dielens.operators import spatial
from dielens.plans import fixtures as fx
from dielens.plans.registry import query, r4

ZONES = {"center_x": 19.5, "center_y": 24.5, "radius_x": 20.0, "radius_y": 25.0, "center_share": 0.5, "edge_share": 1.0}


@query(
    "spatial_eligibility",
    """SELECT lot_id, wafer_id, count(*) AS n_units, count(*) FILTER (x_coord IS NULL) AS n_without_position,
 wafer_id IS NOT NULL AND count(*) FILTER (x_coord IS NULL) = 0 AS eligible,
 CASE WHEN wafer_id IS NULL THEN 'NO_WAFER' WHEN count(*) FILTER (x_coord IS NULL) > 0 THEN 'NO_POSITION' END AS reason
FROM vendor GROUP BY lot_id, wafer_id""",
)
def _(spark, sf):
    return spatial.spatial_eligibility(fx.vendor(spark, sf))


def eligible(spark, sf):
    """Two wafers have dice whose position is lost and are refused."""
    lost = F.concat_ws("/", "lot_id", "wafer_id").isin("L4/W3", "L6/W1") & (F.col("l_partkey") % 10 == 0)
    rows = fx.cp_rows(spark, sf)
    return spatial.spatial_eligibility(rows.withColumn("x_coord", F.when(~lost, F.col("x_coord"))))


_REFUSED = """(SELECT DISTINCT lot_id || '/' || wafer_id FROM cp_rows WHERE lot_id || '/' || wafer_id IN ('L4/W3', 'L6/W1')
 AND l_partkey % 10 = 0)"""
_FINAL = f"(SELECT * FROM final_u WHERE lot_id || '/' || wafer_id NOT IN {_REFUSED})"


def frames(spark, sf):
    """A coordinate frame per run; some state a direction, some a rotation, one an unusable angle."""
    n = F.col("receipt_id")
    origin = F.element_at(
        F.array(*[F.lit(x) for x in ("LOWER_LEFT", "UPPER_LEFT", "LOWER_RIGHT", "UPPER_RIGHT")]), (n % 4 + 1).cast("int")
    )
    notch = F.element_at(F.array(*[F.lit(x) for x in ("DOWN", "LEFT", "UP", "RIGHT")]), (n % 4 + 1).cast("int"))
    return fx.cp_runs(spark, sf).select(
        "run_id",
        origin.alias("origin_position"),
        F.when(n % 5 == 0, "RIGHT").alias("x_direction"),
        F.when(n % 7 == 0, "DOWN").alias("y_direction"),
        F.when(n % 3 == 0, (n % 4 * 90).cast("int")).when(n % 11 == 1, 45).alias("rotation_degree"),
        notch.alias("notch_orientation"),
    )


@query(
    "normalize_coordinates",
    """WITH f AS (SELECT run_id, CASE WHEN receipt_id % 5 = 0 OR receipt_id % 4 < 2 THEN 1 ELSE -1 END AS gx,
 CASE WHEN receipt_id % 7 = 0 OR receipt_id % 2 = 1 THEN -1 ELSE 1 END AS gy,
 CASE WHEN receipt_id % 3 = 0 THEN (360 - receipt_id % 4 * 90) % 360 WHEN receipt_id % 11 = 1 THEN 315 ELSE receipt_id % 4 * 90 END AS turn FROM cp_runs),
t AS (SELECT u.unit_id, u.x_coord * gx AS x, u.y_coord * gy AS y, turn FROM cp_rows u JOIN f ON f.run_id = u.run_id)
SELECT unit_id, CASE turn WHEN 0 THEN x WHEN 90 THEN -y WHEN 180 THEN -x WHEN 270 THEN y END AS x_norm,
 CASE turn WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN -y WHEN 270 THEN -x END AS y_norm FROM t""",
)
def _(spark, sf):
    placed = spatial.normalize_coordinates(fx.cp_rows(spark, sf), frames(spark, sf))
    return placed.select("unit_id", "x_norm", "y_norm")


@query(
    "wafer_map_bin",
    f"""SELECT lot_id, wafer_id, x_coord, y_coord, soft_bin, outcome, 'first' AS basis FROM first_u
WHERE lot_id || '/' || wafer_id NOT IN {_REFUSED}""",
)
def _(spark, sf):
    return spatial.wafer_map_bin(fx.outcomes(spark, sf), basis="first", eligible=eligible(spark, sf))


@query(
    "wafer_map_parameter",
    f"""SELECT u.unit_id, u.lot_id, u.wafer_id, u.x_coord, u.y_coord, 'final' AS basis, m.value_numeric, m.measurement_status
FROM {_FINAL} u LEFT JOIN meas m ON m.unit_id = u.unit_id AND m.parameter_code = 'VTH'""",
)
def _(spark, sf):
    return spatial.wafer_map_parameter(fx.cp(spark, sf), fx.meas(spark, sf), "VTH", eligible=eligible(spark, sf))


@query(
    "stacked_fail_map",
    f"""SELECT product_code, x_coord, y_coord, count(*) AS n_units, count(*) FILTER (outcome = 'FAIL') AS n_fail,
 round(count(*) FILTER (outcome = 'FAIL') / count(*), 6) AS fail_rate, 'final' AS basis FROM {_FINAL} f GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(spatial.stacked_fail_map(fx.outcomes(spark, sf), eligible=eligible(spark, sf)), 6, "fail_rate")


@query(
    "parameter_fail_overlay",
    f"""SELECT u.unit_id, u.lot_id, u.wafer_id, u.x_coord, u.y_coord, u.soft_bin, u.soft_bin IN ('0', '8', '9') AS fail_mark,
 'final' AS basis, m.value_numeric, m.measurement_status FROM {_FINAL} u LEFT JOIN meas m ON m.unit_id = u.unit_id AND m.parameter_code = 'BVDSS'""",
)
def _(spark, sf):
    return spatial.parameter_fail_overlay(fx.cp(spark, sf), fx.meas(spark, sf), "BVDSS", ["0", "8", "9"], eligible=eligible(spark, sf))


_D2 = "((x_coord - 19.5) / 20.0) * ((x_coord - 19.5) / 20.0) + ((y_coord - 24.5) / 25.0) * ((y_coord - 24.5) / 25.0)"
_ZONE = f"""CASE k WHEN 'RING' THEN CASE WHEN {_D2} <= 0.25 THEN 'CENTER' WHEN {_D2} <= 1.0 THEN 'MIDDLE' ELSE 'EDGE' END
 ELSE concat(CASE WHEN y_coord >= 24.5 THEN 'UPPER_' ELSE 'LOWER_' END, CASE WHEN x_coord >= 19.5 THEN 'RIGHT' ELSE 'LEFT' END) END"""
_KINDS = "(VALUES ('RING'), ('QUADRANT')) z(k)"


_ZONE_MEANS = ", ".join(
    r4(f"avg(value_numeric) FILTER (parameter_code = '{p}' AND measurement_status = 'MEASURED')") + f" AS mean_{p.lower()}"
    for p in ("VTH", "BVDSS", "IDSS", "RDSON")
)


@query(
    "zone_summary",
    f"""WITH f AS {_FINAL},
u AS (SELECT product_code, k AS zone_kind, {_ZONE} AS zone, count(*) AS n_units, count(*) FILTER (outcome = 'PASS') AS n_pass
 FROM f CROSS JOIN {_KINDS} GROUP BY 1, 2, 3),
p AS (SELECT product_code, k AS zone_kind, {_ZONE} AS zone, {_ZONE_MEANS}
 FROM (SELECT f.product_code, f.x_coord, f.y_coord, m.parameter_code, m.measurement_status, m.value_numeric FROM meas m
  JOIN f ON f.unit_id = m.unit_id) q CROSS JOIN {_KINDS} GROUP BY 1, 2, 3)
SELECT u.*, round(n_pass / n_units, 6) AS "yield", p.* EXCLUDE (product_code, zone_kind, zone), 'final' AS basis
FROM u LEFT JOIN p ON p.product_code = u.product_code AND p.zone_kind = u.zone_kind AND p.zone = u.zone""",
)
def _(spark, sf):
    params = ["VTH", "BVDSS", "IDSS", "RDSON"]
    summary = spatial.zone_summary(fx.outcomes(spark, sf), fx.meas(spark, sf), ZONES, params, eligible=eligible(spark, sf))
    return rounded(steady(summary, *[f"mean_{p.lower()}" for p in params]), 6, "yield")


@query(
    "neighbour_fail_count",
    f"""SELECT u.lot_id, u.wafer_id, u.x_coord, u.y_coord, u.unit_id, u.outcome, 'final' AS basis,
 count(f.unit_id) AS n_fail_neighbours FROM {_FINAL} u LEFT JOIN final_u f ON f.outcome = 'FAIL' AND f.lot_id = u.lot_id AND f.wafer_id = u.wafer_id AND abs(f.x_coord - u.x_coord) <= 1
 AND abs(f.y_coord - u.y_coord) <= 1 AND f.unit_id <> u.unit_id GROUP BY ALL""",
)
def _(spark, sf):
    return spatial.neighbour_fail_count(fx.outcomes(spark, sf), eligible=eligible(spark, sf))
