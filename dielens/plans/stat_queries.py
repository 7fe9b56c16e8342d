"""Parameter statistics and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from dielens.functions.columns import rounded, steady
from dielens.functions.shuffles import settled
from dielens.operators import quality, stats, units
from dielens.plans import fixtures as fx
from dielens.plans.inline import inline
from dielens.plans.registry import query, r4

KEYS = ["product_code", "parameter_code"]
PARAMS = ["VTH", "BVDSS", "IDSS", "RDSON"]
_USED = "FILTER (measurement_status = 'MEASURED')"
_BOX = """(SELECT product_code, parameter_code, count(*) AS n, quantile_cont(value_numeric, 0.25) AS p25,
 quantile_cont(value_numeric, 0.5) AS p50, quantile_cont(value_numeric, 0.75) AS p75 FROM meas WHERE measurement_status = 'MEASURED'
 GROUP BY 1, 2)"""
_FENCES = f"(SELECT *, p25 - (p75 - p25) * 1.5 AS fence_low, p75 + (p75 - p25) * 1.5 AS fence_high FROM {_BOX})"
_NARROW = f"(SELECT *, p25 - (p75 - p25) * 0.4 AS fence_low, p75 + (p75 - p25) * 0.4 AS fence_high FROM {_BOX})"
_PLACED = f"""(SELECT m.measurement_id, m.value_numeric, b.* FROM meas m JOIN {_FENCES} b ON b.product_code = m.product_code
 AND b.parameter_code = m.parameter_code WHERE m.measurement_status = 'MEASURED')"""


@query(
    "parameter_summary",
    f"""SELECT m.product_code, m.parameter_code, count(*) AS n_total, count(value_numeric) {_USED} AS n_used,
 count(*) - count(value_numeric) {_USED} AS n_excluded, {r4(f'avg(value_numeric) {_USED}')} AS mean,
 {r4(f'stddev_samp(value_numeric) {_USED}')} AS std, min(value_numeric) {_USED} AS min, max(value_numeric) {_USED} AS max,
 {r4('any_value(p25)')} AS p25, {r4('any_value(p50)')} AS p50, {r4('any_value(p75)')} AS p75
FROM meas m JOIN {_BOX} b ON b.product_code = m.product_code AND b.parameter_code = m.parameter_code GROUP BY 1, 2""",
)
def _(spark, sf):
    return steady(stats.parameter_summary(fx.meas(spark, sf), KEYS), "mean", "std", "p25", "p50", "p75")


@query(
    "boxplot",
    f"""SELECT product_code, parameter_code, n, {r4('p25')} AS p25, {r4('p50')} AS p50, {r4('p75')} AS p75,
 min(value_numeric) FILTER (value_numeric BETWEEN fence_low AND fence_high) AS whisker_low,
 max(value_numeric) FILTER (value_numeric BETWEEN fence_low AND fence_high) AS whisker_high,
 count(*) FILTER (value_numeric NOT BETWEEN fence_low AND fence_high) AS n_outliers FROM {_PLACED} GROUP BY ALL""",
)
def _(spark, sf):
    return steady(stats.boxplot(fx.meas(spark, sf), KEYS)[0], "p25", "p50", "p75")


@query(
    "boxplot_outliers",
    f"SELECT measurement_id, value_numeric FROM {_PLACED.replace(_FENCES, _NARROW)} WHERE value_numeric NOT BETWEEN fence_low AND fence_high",
)
def _(spark, sf):
    return stats.boxplot(fx.meas(spark, sf), KEYS, 0.4)[1].select("measurement_id", "value_numeric")


@query(
    "histogram_normal",
    f"""WITH b AS (SELECT product_code, CAST(CASE WHEN value_numeric < 10000.0 THEN 0 WHEN value_numeric >= 90000.0 THEN 17
 ELSE floor((value_numeric - 10000.0) / 5000.0) + 1 END AS INT) AS bin_no, count(*) AS n FROM meas
 WHERE parameter_code = 'BVDSS' AND measurement_status = 'MEASURED' GROUP BY 1, 2),
f AS (SELECT product_code, count(*) AS n_used, avg(value_numeric) AS m, stddev_samp(value_numeric) AS s FROM meas
 WHERE parameter_code = 'BVDSS' AND measurement_status = 'MEASURED' GROUP BY 1),
t AS (SELECT b.product_code, bin_no, n, n_used, m, s, CASE WHEN bin_no BETWEEN 1 AND 16 THEN 10000.0::DOUBLE + (bin_no - 0.5::DOUBLE) * 5000 END AS bin_middle
 FROM b JOIN f ON f.product_code = b.product_code)
SELECT product_code, bin_no, bin_middle, n, n_used, {r4('m')} AS fit_mean, {r4('s')} AS fit_std,
 {r4('exp(-((bin_middle - m) / s) * ((bin_middle - m) / s) / 2) / (s * sqrt(2 * pi())) * n_used * 5000')} AS expected_n FROM t""",
)
def _(spark, sf):
    bvdss = fx.meas(spark, sf).where("parameter_code = 'BVDSS'")
    return steady(
        stats.histogram_normal(bvdss, ["product_code"], 10000.0, 90000.0, 16), "fit_mean", "fit_std", "expected_n"
    )



_CAP = """e AS (SELECT product_code, parameter_code, lot_id, wafer_id, lsl_applied AS lsl, usl_applied AS usl,
  CASE WHEN measurement_status = 'MEASURED' THEN value_numeric END AS x FROM evals),
g AS (SELECT product_code, parameter_code, lsl, usl, lot_id, wafer_id, count(x) AS n, var_samp(x) AS v, count(*) AS c FROM e GROUP BY ALL),
w AS (SELECT product_code, parameter_code, lsl, usl, sqrt(sum((n - 1) * v) FILTER (n > 1) / sum(n - 1) FILTER (n > 1)) AS sw,
 sum(c)::BIGINT AS n_total FROM g GROUP BY ALL),
o AS (SELECT product_code, parameter_code, lsl, usl, count(*) AS n_used, avg(x) AS m, stddev_samp(x) AS so FROM e
 WHERE x IS NOT NULL GROUP BY ALL),
k AS (SELECT o.product_code, o.parameter_code, n_total, n_used, m, sw, so, o.lsl, o.usl,
 CASE WHEN sw > 0 THEN sw END AS s, CASE WHEN so > 0 THEN so END AS t FROM o JOIN w ON w.product_code = o.product_code
 AND w.parameter_code = o.parameter_code AND w.lsl IS NOT DISTINCT FROM o.lsl AND w.usl IS NOT DISTINCT FROM o.usl),
cap AS (SELECT *, (usl - lsl) / (6 * s) AS cp, least((usl - m) / (3 * s), (m - lsl) / (3 * s)) AS cpk, (usl - lsl) / (6 * t) AS pp,
 least((usl - m) / (3 * t), (m - lsl) / (3 * t)) AS ppk, CASE WHEN n_used < 2 THEN 'TOO_FEW' WHEN coalesce(so, 0) <= 0 THEN 'NO_SPREAD'
 WHEN lsl IS NULL AND usl IS NULL THEN 'NO_LIMIT' WHEN coalesce(sw, 0) <= 0 THEN 'NO_WITHIN_SPREAD' END AS reason FROM k)"""


def capabilities(spark, sf):
    """Over the limits that apply to each row."""
    return stats.capability(fx.applied_limits(spark, fx.meas(spark, sf)), None, KEYS, ["lot_id", "wafer_id"])


@query(
    "capability",
    f"""WITH {_CAP}
SELECT product_code, parameter_code, n_total, n_used, {r4('m')} AS mean, {r4('sw')} AS std_within, {r4('so')} AS std_overall, lsl, usl,
 {r4('cp')} AS cp, {r4('cpk')} AS cpk, {r4('pp')} AS pp, {r4('ppk')} AS ppk, reason FROM cap""",
)
def _(spark, sf):
    return steady(capabilities(spark, sf), "mean", "std_within", "std_overall", "cp", "cpk", "pp", "ppk")


@query(
    "low_capability_risk",
    f"""WITH {_CAP}
SELECT product_code, parameter_code, {r4('cpk')} AS cpk FROM cap WHERE cpk < 1.0 ORDER BY cap.cpk, product_code, parameter_code, lsl NULLS FIRST, usl NULLS FIRST LIMIT 10""",
)
def _(spark, sf):
    worst = stats.low_capability_risk(capabilities(spark, sf), 1.0, 10)
    return steady(worst.select("product_code", "parameter_code", "cpk"), "cpk")


_WIDE = """(SELECT unit_id, product_code, max(value_numeric) FILTER (parameter_code = 'VTH') AS vth,
 max(value_numeric) FILTER (parameter_code = 'BVDSS') AS bvdss, max(value_numeric) FILTER (parameter_code = 'IDSS') AS idss,
 max(value_numeric) FILTER (parameter_code = 'RDSON') AS rdson FROM meas WHERE measurement_status = 'MEASURED' GROUP BY 1, 2)"""


@query(
    "scatter_pairs",
    f"""WITH p AS (SELECT unit_id, vth AS x, bvdss AS y FROM {_WIDE} WHERE vth IS NOT NULL AND bvdss IS NOT NULL)
SELECT unit_id, x, y, 10 AS sample_rate, (SELECT count(*) FROM p) AS n_original FROM p
WHERE ('0x' || substr(md5(unit_id), 1, 8))::BIGINT % 10 = 0""",
)
def _(spark, sf):
    return stats.scatter_pairs(fx.meas(spark, sf), "VTH", "BVDSS", 10)


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"""SELECT product_code, '{a}' AS parameter_x, '{b}' AS parameter_y,
 count(*) FILTER ({a.lower()} IS NOT NULL AND {b.lower()} IS NOT NULL) AS n_used, {r4(f'corr({a.lower()}, {b.lower()})')} AS r
FROM {_WIDE} GROUP BY product_code"""
        for i, a in enumerate(PARAMS)
        for b in PARAMS[i + 1 :]
    ),
)
def _(spark, sf):
    return steady(stats.correlation_matrix(fx.meas(spark, sf), PARAMS, ["product_code"]), "r")


def ft_order():
    return [F.col("source_started_local"), F.col("event_id")]


_SEQ = "PARTITION BY lot_id ORDER BY source_started_local, event_id"


@query(
    "value_trend",
    f"""SELECT unit_id, lot_id, row_number() OVER ({_SEQ}) AS position, value_numeric,
 {r4(f'avg(value_numeric) OVER ({_SEQ} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS rolling_mean FROM ft""",
)
def _(spark, sf):
    trend = stats.value_trend(fx.ft(spark, sf), ["lot_id"], ft_order(), None, 4)
    return steady(trend.select("unit_id", "lot_id", "position", "value_numeric", "rolling_mean"), "rolling_mean")


@query(
    "spec_margin",
    f"""SELECT measurement_id, {r4("least(v - lsl_applied, usl_applied - v)")} AS spec_margin,
 {r4("least(v - lsl_applied, usl_applied - v) / CASE WHEN usl_applied > lsl_applied THEN usl_applied - lsl_applied END")} AS spec_margin_relative
FROM (SELECT *, CASE WHEN measurement_status = 'MEASURED' THEN value_numeric END AS v FROM evals)""",
)
def _(spark, sf):
    limited = stats.spec_margin(fx.applied_limits(spark, fx.meas(spark, sf)))
    return steady(limited.select("measurement_id", "spec_margin", "spec_margin_relative"), "spec_margin", "spec_margin_relative")


@query(
    "pass_fail_distribution",
    f"""SELECT m.parameter_code, u.outcome, count(*) AS n_total, count(m.value_numeric) AS n_used, {r4('avg(m.value_numeric)')} AS mean,
 {r4('stddev_samp(m.value_numeric)')} AS std, min(m.value_numeric) AS min, max(m.value_numeric) AS max
FROM meas m JOIN outcomes u ON u.unit_id = m.unit_id GROUP BY 1, 2""",
)
def _(spark, sf):
    judged = fx.with_outcome(spark, fx.cp_rows(spark, sf))
    return steady(stats.pass_fail_distribution(fx.meas(spark, sf), judged), "mean", "std")


@query(
    "group_difference_test",
    f"""WITH v AS (SELECT parameter_code, site_no, value_numeric AS x FROM meas WHERE measurement_status = 'MEASURED'),
s AS (SELECT DISTINCT parameter_code, site_no FROM v),
r AS (SELECT s.parameter_code, s.site_no, count(x) FILTER (v.site_no = s.site_no) AS n, avg(x) FILTER (v.site_no = s.site_no) AS m,
  var_samp(x) FILTER (v.site_no = s.site_no) AS vr, count(x) FILTER (v.site_no <> s.site_no) AS rn, avg(x) FILTER (v.site_no <> s.site_no) AS rm,
  var_samp(x) FILTER (v.site_no <> s.site_no) AS rv, avg(x) AS gm FROM s JOIN v ON v.parameter_code = s.parameter_code GROUP BY 1, 2),
a AS (SELECT parameter_code, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum((n - 1) * vr) / (sum(n) - count(*))) AS f,
  count(*) - 1 AS d1, CAST(sum(n) - count(*) AS BIGINT) AS d2 FROM r GROUP BY 1)
SELECT r.parameter_code, r.site_no, n AS n_used, {r4('m')} AS mean, {r4('rm')} AS rest_mean, {r4('(m - rm) / sqrt(vr / n + rv / rn)')} AS welch_t,
 round((vr / n + rv / rn) * (vr / n + rv / rn) / (vr / n * vr / n / (n - 1) + rv / rn * rv / rn / (rn - 1)), 2) AS welch_df,
 {r4('f')} AS f_statistic, d1 AS df_between, d2 AS df_within FROM r JOIN a ON a.parameter_code = r.parameter_code""",
)
def _(spark, sf):
    tested = stats.group_difference_test(fx.meas(spark, sf), ["parameter_code"], "site_no")
    return rounded(steady(tested, "mean", "rest_mean", "welch_t", "f_statistic"), 2, "welch_df")


@query(
    "zscore_anomalies",
    f"""WITH v AS (SELECT measurement_id, product_code, parameter_code, value_numeric AS x FROM meas WHERE measurement_status = 'MEASURED'),
d AS (SELECT product_code, parameter_code, quantile_cont(x, 0.5) AS median FROM v GROUP BY 1, 2),
a AS (SELECT v.*, median, abs(x - median) AS away FROM v JOIN d ON d.product_code = v.product_code AND d.parameter_code = v.parameter_code),
k AS (SELECT product_code, parameter_code, quantile_cont(away, 0.5) AS mad FROM a GROUP BY 1, 2)
SELECT a.measurement_id, {r4('(x - median) / (mad * 1.4826)')} AS robust_z FROM a JOIN k ON k.product_code = a.product_code
 AND k.parameter_code = a.parameter_code WHERE abs((x - median) / (mad * 1.4826)) > 1.34""",
)
def _(spark, sf):
    found = stats.zscore_anomalies(fx.meas(spark, sf), KEYS, 1.34)
    return steady(found.select("measurement_id", "robust_z"), "robust_z")


_PAT = """(SELECT parameter_code, lot_id, count(*) AS n_baseline, quantile_cont(value_numeric, 0.5) AS med,
 (quantile_cont(value_numeric, 0.75) - quantile_cont(value_numeric, 0.25)) / 1.35 AS sg FROM meas
 WHERE measurement_status = 'MEASURED' AND run_attempt_no = 0 GROUP BY 1, 2)"""


def pat(spark, sf):
    baseline = fx.meas(spark, sf).where("run_attempt_no = 0")
    return quality.pat_limits(baseline, ["parameter_code", "lot_id"], "PAT 1.1", "B-FIRST", 1.0)


@query(
    "pat_limits",
    f"""SELECT parameter_code, lot_id, n_baseline, {r4('med')} AS robust_mean, {r4('sg')} AS robust_sigma, {r4('med - sg')} AS pat_lower,
 {r4('med + sg')} AS pat_upper, 'PAT 1.1' AS rule_version, 'B-FIRST' AS baseline_id FROM {_PAT}""",
)
def _(spark, sf):
    return steady(pat(spark, sf), "robust_mean", "robust_sigma", "pat_lower", "pat_upper")


@query(
    "evaluate_pat",
    f"""SELECT m.measurement_id, 'PAT' AS evaluation_type, 'B-FIRST' AS evaluation_scope_key,
 CASE WHEN measurement_status <> 'MEASURED' THEN 'NOT_EVALUATED' WHEN value_numeric < med - sg - 1e-9 OR value_numeric > med + sg + 1e-9
  THEN 'FAIL' ELSE 'PASS' END AS evaluation_result
FROM meas m JOIN {_PAT} p ON p.parameter_code = m.parameter_code AND p.lot_id = m.lot_id""",
)
def _(spark, sf):
    # One nano of slack, here and in the SQL, keeps limits that fall on a value from following rounding.
    limits = pat(spark, sf).withColumns({"pat_lower": F.col("pat_lower") - 1e-9, "pat_upper": F.col("pat_upper") + 1e-9})
    judged = quality.evaluate_pat(fx.meas(spark, sf), limits, ["parameter_code", "lot_id"])
    return judged.select("measurement_id", "evaluation_type", "evaluation_scope_key", "evaluation_result")


_RATES = """(SELECT 'YIELD' AS item, 'YIELD' AS kind, lot_id, avg((outcome = 'PASS')::INT) AS rate FROM final_u GROUP BY lot_id
 UNION ALL SELECT 'BIN 8', 'BIN', lot_id, avg((outcome = 'FAIL' AND soft_bin = '8')::INT) FROM final_u GROUP BY lot_id)"""


@query(
    "sbl_syl_limits",
    f"""WITH h AS (SELECT item, kind, count(*) AS n_baseline_lots, avg(rate) AS m, stddev_samp(rate) AS s FROM {_RATES}
 WHERE lot_id NOT IN ('L3', 'L7') GROUP BY 1, 2),
t AS (SELECT r.*, n_baseline_lots, m, s, CASE WHEN r.kind = 'YIELD' THEN -1 ELSE 1 END AS g FROM {_RATES} r JOIN h ON h.item = r.item AND h.kind = r.kind)
SELECT item, kind, lot_id, {r4('rate')} AS rate, n_baseline_lots, {r4('m')} AS mean_rate, {r4('s')} AS std_rate,
 {r4('m + g * 3 * s')} AS limit_1, {r4('m + g * 4 * s')} AS limit_2,
 CASE WHEN (rate - m - g * 4 * s) * g > 0 THEN 'BEYOND_LIMIT_2' WHEN (rate - m - g * 3 * s) * g > 0 THEN 'BEYOND_LIMIT_1' ELSE 'WITHIN' END AS flag,
 'SBL 1.0' AS rule_version FROM t""",
)
def _(spark, sf):
    lots = units.final_units(fx.outcomes(spark, sf)).groupBy("lot_id").agg(
        F.avg((F.col("outcome") == "PASS").cast("int")).alias("y"),
        F.avg(((F.col("outcome") == "FAIL") & (F.col("soft_bin") == "8")).cast("int")).alias("b"),
    )
    rates = F.array(
        F.struct(F.lit("YIELD").alias("item"), F.lit("YIELD").alias("kind"), F.col("y").alias("rate")),
        F.struct(F.lit("BIN 8").alias("item"), F.lit("BIN").alias("kind"), F.col("b").alias("rate")),
    )
    per_lot = settled(lots.select("lot_id", F.inline(rates)))
    limits = quality.sbl_syl_limits(per_lot, ["item"], "SBL 1.0", ~F.col("lot_id").isin("L3", "L7"))
    return steady(limits, "rate", "mean_rate", "std_rate", "limit_1", "limit_2")


@query(
    "evaluate_safe_launch",
    """SELECT measurement_id, 'SAFE_LAUNCH' AS evaluation_type, 'LAUNCH' AS evaluation_scope_key,
 CASE WHEN s.test_item_id IS NULL THEN 'NO_MATCH' WHEN measurement_status <> 'MEASURED' OR NOT s.unit_ok THEN 'NOT_EVALUATED' WHEN value_numeric < s.lsl_applied OR value_numeric > s.usl_applied
 OR s.lsl_applied IS NULL AND s.usl_applied IS NULL THEN CASE WHEN s.lsl_applied IS NULL AND s.usl_applied IS NULL THEN 'NOT_EVALUATED' ELSE 'FAIL' END
 ELSE 'PASS' END AS evaluation_result
FROM meas m LEFT JOIN scope_applied s ON s.test_item_id = m.test_item_id AND s.evaluation_scope_key = 'SL1'""",
)
def _(spark, sf):
    tight = inline(spark, "scope_limits").where("evaluation_scope_key = 'SL1'")
    judged = quality.evaluate_safe_launch(fx.meas(spark, sf), tight, "LAUNCH", inline(spark, "factors"))
    return judged.select("measurement_id", "evaluation_type", "evaluation_scope_key", "evaluation_result")


_IMR = f"""p AS (SELECT unit_id, lot_id, value_numeric AS x, row_number() OVER ({_SEQ}) AS position,
 abs(value_numeric - lag(value_numeric) OVER ({_SEQ})) AS mr FROM ft),
l AS (SELECT lot_id, avg(x) AS c, avg(mr) AS mm, count(*) AS n_points FROM p GROUP BY 1)"""


def chart(spark, sf):
    series = fx.ft(spark, sf).select(
        "unit_id", "lot_id", "value_numeric", "measurement_status", "source_started_local", "event_id"
    )
    return quality.spc_imr(series, ["lot_id"], ft_order(), None, "SPC 1.0")


@query(
    "spc_imr",
    f"""WITH {_IMR}
SELECT unit_id, p.lot_id, position, x AS value_numeric, {r4('mr')} AS moving_range, n_points, {r4('c')} AS centre, {r4('c + 2.66 * mm')} AS ucl,
 {r4('c - 2.66 * mm')} AS lcl, {r4('3.267 * mm')} AS mr_ucl,
 x > c + 2.66 * mm OR x < c - 2.66 * mm OR coalesce(mr > 3.267 * mm, false) AS out_of_control, 'SPC 1.0' AS rule_version
FROM p JOIN l ON l.lot_id = p.lot_id""",
)
def _(spark, sf):
    points = chart(spark, sf).drop("source_started_local", "event_id", "measurement_status", "mr_mean")
    return steady(points, "moving_range", "centre", "ucl", "lcl", "mr_ucl")


@query(
    "spc_run_rules",
    f"""WITH {_IMR}, s AS (SELECT p.*, c, mm, sign(x - c) AS side FROM p JOIN l ON l.lot_id = p.lot_id)
SELECT unit_id, lot_id, position, x > c + 2.66 * mm OR x < c - 2.66 * mm AS rule_beyond_limits,
 abs(sum(side) OVER (PARTITION BY lot_id ORDER BY position ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) = 8 AS rule_one_side FROM s""",
)
def _(spark, sf):
    judged = quality.spc_run_rules(chart(spark, sf), ["lot_id"])
    return judged.select("unit_id", "lot_id", "position", "rule_beyond_limits", "rule_one_side")
