"""Parameter statistics over measured values.

Only MEASURED rows with a number enter a statistic; the rest is counted beside
it.  Quantiles are exact and computed without holding a group in one task;
moments are mergeable aggregates, so a hot parameter is combined on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.columns import measured, share
from dielens.functions.moments import pair_moments
from dielens.functions.shuffles import exact_quantiles, join_null_safe, join_sized, numbered, over_blocks, settled

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _value() -> Column:
    return F.when(measured(), F.col("value_numeric"))


def parameter_summary(meas: DataFrame, keys: Sequence[str]) -> DataFrame:
    value = _value()
    moments = meas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(value).alias("n_used"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_excluded"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(meas.where(measured()), keys, "value_numeric", QUARTILES).drop("n")
    return join_null_safe(moments, quartiles, keys, "left")


def boxplot(meas: DataFrame, keys: Sequence[str], reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Box summary per key and the outlying measurements, which are listed and never removed.

    Whiskers end at the furthest value inside the fences.
    """
    used = meas.where(measured())
    box = settled(exact_quantiles(used, keys, "value_numeric", QUARTILES))
    spread = F.col("p75") - F.col("p25")
    fences = box.withColumns({"fence_low": F.col("p25") - spread * reach, "fence_high": F.col("p75") + spread * reach})
    placed = join_null_safe(used, fences, keys, "inner")
    value = F.col("value_numeric")
    inside = value.between(F.col("fence_low"), F.col("fence_high"))
    ends = placed.groupBy(*keys).agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    outliers = placed.where(~inside).drop("n", *QUARTILES)
    return join_null_safe(box, ends, keys, "inner"), outliers


def _moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    value = _value()
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.count(F.lit(1)).alias("n_total"),
    )


def histogram_normal(meas: DataFrame, keys: Sequence[str], lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins over a declared range, with the fitted normal's expected count.

    Values outside the range are kept in bin 0 and bin ``bins + 1``.  Mean and
    deviation are merged from the bins, so the facts are read once.
    """
    width = (hi - lo) / bins
    value = _value()
    bin_no = (
        F.when(value < lo, 0)
        .when(value >= hi, bins + 1)
        .otherwise(F.floor((value - lo) / width).cast("int") + 1)
    )
    per_bin = (
        meas.where(measured())
        .groupBy(*keys, bin_no.alias("bin_no"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))
    )
    whole = Window.partitionBy(*keys)
    total, centre = F.sum("n").over(whole), F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    with_mean = per_bin.withColumns({"n_used": total, "fit_mean": centre})
    gap = F.col("mean") - F.col("fit_mean")
    m2 = F.sum(F.col("m2") + F.col("n") * gap * gap).over(whole)
    fitted = with_mean.withColumn("fit_std", F.when(F.col("n_used") > 1, F.sqrt(m2 / (F.col("n_used") - 1))))
    inner = F.col("bin_no").between(1, bins)
    middle = F.when(inner, lo + (F.col("bin_no") - 0.5) * width)
    z = (middle - F.col("fit_mean")) / F.col("fit_std")
    density = F.exp(-z * z / 2) / (F.col("fit_std") * math.sqrt(2 * math.pi))
    return fitted.select(
        *keys,
        "bin_no",
        middle.alias("bin_middle"),
        "n",
        "n_used",
        "fit_mean",
        "fit_std",
        (F.when(F.col("fit_std") > 0, density) * F.col("n_used") * width).alias("expected_n"),
    )


def capability(meas: DataFrame, limits: DataFrame | None, keys: Sequence[str], subgroup: Sequence[str]) -> DataFrame:
    """Cp/Cpk from the pooled within-subgroup deviation, Pp/Ppk from the overall one.

    One-sided where a limit is missing.  No spread or fewer than two values
    gives null and a reason, never infinity.  ``limits``: parameter_code, lsl,
    usl.  Without them every row carries the limits resolved for it
    (``lsl_applied``, ``usl_applied``): moments are kept per limit set and each
    set under a key is a row of its own, so values are never held against the
    limits of another lot or product.
    """
    shown = list(keys)
    if limits is None:
        meas = meas.withColumns({"lsl": F.col("lsl_applied"), "usl": F.col("usl_applied")})
        keys = [*keys, "lsl", "usl"]
    per_group = settled(_moments(meas, [*keys, *subgroup]))
    freedom = F.sum(F.greatest(F.col("n") - 1, F.lit(0)))
    merged = _overall(per_group, keys)
    pooled = per_group.groupBy(*keys).agg(
        F.sqrt(F.sum("m2") / F.when(freedom > 0, freedom)).alias("std_within"),
        F.sum("n_total").alias("n_total"),
    )
    figures = join_null_safe(merged, pooled, keys, "inner")
    if limits is not None:
        figures = figures.join(limits, "parameter_code", "left")
    mean, lsl, usl = F.col("mean"), F.col("lsl"), F.col("usl")

    def indices(std: str) -> tuple[Column, Column]:
        s = F.when(F.col(std) > 0, F.col(std))
        return (usl - lsl) / (6 * s), F.least((usl - mean) / (3 * s), (mean - lsl) / (3 * s))

    (cp, cpk), (pp, ppk) = indices("std_within"), indices("std_overall")
    reason = (
        F.when(F.col("n_used") < 2, "TOO_FEW")
        .when(F.coalesce(F.col("std_overall"), F.lit(0.0)) <= 0, "NO_SPREAD")
        .when(lsl.isNull() & usl.isNull(), "NO_LIMIT")
        .when(F.coalesce(F.col("std_within"), F.lit(0.0)) <= 0, "NO_WITHIN_SPREAD")
    )
    return figures.select(
        *shown,
        "n_total",
        "n_used",
        "mean",
        "std_within",
        "std_overall",
        "lsl",
        "usl",
        cp.alias("cp"),
        cpk.alias("cpk"),
        pp.alias("pp"),
        ppk.alias("ppk"),
        reason.alias("reason"),
    )


def _overall(per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per key, from the moments of its groups."""
    used = per_group.where("n > 0")
    centre = used.groupBy(*keys).agg(
        F.sum("n").alias("n_used"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__mean")
    )
    gap = F.col("mean") - F.col("__mean")
    spread = (
        join_null_safe(used, centre, keys, "inner")
        .groupBy(*keys, "n_used", "__mean")
        .agg(F.sum(F.col("m2") + F.col("n") * gap * gap).alias("__m2"))
    )
    std = F.when(F.col("n_used") > 1, F.sqrt(F.col("__m2") / (F.col("n_used") - 1)))
    return spread.select(*keys, "n_used", F.col("__mean").alias("mean"), std.alias("std_overall"))


def low_capability_risk(cap: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k worst parameters under a Cpk threshold."""
    names = [c for c in cap.columns if cap.schema[c].dataType.simpleString() == "string"]
    limits = [c for c in ("lsl", "usl") if c in cap.columns]
    return cap.where(F.col("cpk") < threshold).orderBy("cpk", *names, *limits).limit(k)


def _wide(meas: DataFrame, unit: Sequence[str], params: Sequence[str]) -> DataFrame:
    """One row per unit with a value column per listed parameter."""
    listed = meas.where(measured() & F.col("parameter_code").isin(list(params)))
    return listed.groupBy(*unit).agg(
        *[F.max(F.when(F.col("parameter_code") == p, F.col("value_numeric"))).alias(f"__v{i}") for i, p in enumerate(params)]
    )


def scatter_pairs(meas: DataFrame, px: str, py: str, rate: int, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Both parameters per unit; every ``rate``-th unit by a stable hash, with the full count beside it."""
    both = _wide(meas, unit, [px, py]).where("__v0 IS NOT NULL AND __v1 IS NOT NULL")
    token = F.conv(F.substring(F.md5(F.concat_ws("|", *unit)), 1, 8), 16, 10).cast("long") % rate
    total = both.agg(F.count(F.lit(1))).scalar()
    return both.where(token == 0).select(
        *unit,
        F.col("__v0").alias("x"),
        F.col("__v1").alias("y"),
        F.lit(rate).alias("sample_rate"),
        total.alias("n_original"),
    )


def correlation_matrix(
    meas: DataFrame, params: Sequence[str], keys: Sequence[str] = (), unit: Sequence[str] = ("unit_id",)
) -> DataFrame:
    """Pairwise Pearson coefficient over units that have both values; null where one of them does not vary.

    The values of a unit are one list; cross products are folded block by block (:func:`pair_moments`), so thousands
    of parameters are one plan and no pair of rows or of columns is an expression.  Values are taken from the mean of
    their parameter, which keeps the sums exact enough.
    """
    spark = meas.sparkSession
    names = spark.createDataFrame(list(enumerate(params)), "i int, parameter_code string")
    listed = meas.where(measured()).join(F.broadcast(names), "parameter_code")  # the list the caller wrote
    listed = listed.select(*keys, *unit, "i", "value_numeric")
    centre = listed.groupBy(*keys, "i").agg(F.avg("value_numeric").alias("__centre"))
    centred = join_sized(listed, centre, [*keys, "i"], "inner")
    entries = F.collect_list(F.struct("i", (F.col("value_numeric") - F.col("__centre")).alias("v")))
    sums = pair_moments(centred.groupBy(*keys, *unit).agg(entries.alias("entries")), keys, len(params))
    n = F.when(F.col("n") > 0, F.col("n"))
    across = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    label = F.array(*[F.lit(p) for p in params])
    return sums.select(
        *keys,
        F.get(label, F.col("i")).alias("parameter_x"),
        F.get(label, F.col("j")).alias("parameter_y"),
        F.col("n").alias("n_used"),
        F.when(spread > 0, across / F.sqrt(spread)).alias("r"),
    )


def value_trend(
    series: DataFrame, keys: Sequence[str], order: Sequence[Column], pieces: Column | None, k: int
) -> DataFrame:
    """Values in test order with the mean of the last ``k + 1``; ``pieces`` as in :func:`numbered`."""
    placed = numbered(series.where(measured()), keys, order, pieces, "position")

    def rolling(window):
        return {"rolling_mean": F.avg("value_numeric").over(window.rowsBetween(-k, 0))}

    return over_blocks(placed, keys, "position", k, rolling)


def spec_margin(limited: DataFrame) -> DataFrame:
    """Distance to the nearest applied limit, absolute and as a share of the limit width."""
    value, lsl, usl = _value(), F.col("lsl_applied"), F.col("usl_applied")
    nearest = F.least(value - lsl, usl - value)
    width = F.when(usl > lsl, usl - lsl)
    return limited.withColumns({"spec_margin": nearest, "spec_margin_relative": nearest / width})


def pass_fail_distribution(meas: DataFrame, units: DataFrame, keys: Sequence[str] = ("parameter_code",)) -> DataFrame:
    """Parameter statistics of passing, failing and unresolved units side by side."""
    value = _value()
    judged = meas.join(units.select("unit_id", "outcome"), "unit_id")
    return judged.groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(value).alias("n_used"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def group_difference_test(meas: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """One-way F over all groups, and Welch's t of each group against the rest.

    Everything comes from the moments per group; the rest of a group is the
    total less its own part, so groups are never paired.
    """
    groups = settled(_moments(meas, [*keys, by]).where("n > 0"))
    whole = _overall(groups, keys)
    sums = groups.groupBy(*keys).agg(F.sum("m2").alias("__within"), F.count(F.lit(1)).alias("n_groups"))
    joined = join_null_safe(join_null_safe(groups, whole.withColumnRenamed("mean", "__mean"), keys, "inner"), sums, keys, "inner")
    n, mean, m2 = F.col("n"), F.col("mean"), F.col("m2")
    total, centre = F.col("n_used"), F.col("__mean")
    all_m2 = F.col("std_overall") * F.col("std_overall") * (total - 1)
    between = all_m2 - F.col("__within")
    df1, df2 = F.col("n_groups") - 1, total - F.col("n_groups")
    within_ms = F.when((df2 > 0) & (F.col("__within") > 0), F.col("__within") / df2)
    rest_n = total - n
    rest_mean = F.when(rest_n > 0, (total * centre - n * mean) / rest_n)
    gap = mean - rest_mean
    rest_m2 = all_m2 - m2 - gap * gap * n * rest_n / total
    var_own, var_rest = m2 / F.when(n > 1, n - 1) / n, rest_m2 / F.when(rest_n > 1, rest_n - 1) / rest_n
    error = F.when(var_own + var_rest > 0, var_own + var_rest)
    freedom = error * error / (var_own * var_own / (n - 1) + var_rest * var_rest / (rest_n - 1))
    return joined.select(
        *keys,
        by,
        n.alias("n_used"),
        mean.alias("mean"),
        rest_mean.alias("rest_mean"),
        (gap / F.sqrt(error)).alias("welch_t"),
        freedom.alias("welch_df"),
        F.when(df1 > 0, between / df1 / within_ms).alias("f_statistic"),
        df1.alias("df_between"),
        df2.alias("df_within"),
    )


def zscore_anomalies(meas: DataFrame, keys: Sequence[str], z: float) -> DataFrame:
    """Measurements whose robust z (median and median absolute deviation) exceeds ``z``.

    A group without any spread has no z and gives no anomaly.
    """
    used = meas.where(measured())
    medians = settled(exact_quantiles(used, keys, "value_numeric", {"median": 0.5}).drop("n"))
    centred = join_null_safe(used, medians, keys, "inner").withColumn(
        "__away", F.abs(F.col("value_numeric") - F.col("median"))
    )
    mads = exact_quantiles(centred, keys, "__away", {"mad": 0.5}).drop("n")
    placed = join_sized(centred, mads, keys, "inner")
    score = share(F.col("value_numeric") - F.col("median"), F.col("mad") * 1.4826)
    return placed.withColumn("robust_z", score).where(F.abs("robust_z") > z).drop("__away")
