"""Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz(text: str) -> Column:
    """A UTC instant as a zone-free literal, independent of the session zone."""
    return F.lit(text).cast("timestamp_ntz")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def share(part: Column, whole: Column) -> Column:
    """A ratio that is null, never infinite, over nothing."""
    return F.when(whole != 0, part / whole)


def meets_lower(value: Column, limit: Column, operator: Column) -> Column:
    """True where there is no lower limit or the value respects it; null operator is inclusive."""
    strict = F.coalesce(operator, F.lit(">=")) == ">"
    return limit.isNull() | F.when(strict, value > limit).otherwise(value >= limit)


def meets_upper(value: Column, limit: Column, operator: Column) -> Column:
    strict = F.coalesce(operator, F.lit("<=")) == "<"
    return limit.isNull() | F.when(strict, value < limit).otherwise(value <= limit)


def known_operators(lower: Column, upper: Column) -> Column:
    return (lower.isNull() | lower.isin(">=", ">")) & (upper.isNull() | upper.isin("<=", "<"))


def in_window(instant: Column, start: Column, end: Column) -> Column:
    """Half-open validity window; a null bound is unbounded."""
    return (start.isNull() | (instant >= start)) & (end.isNull() | (instant < end))


def measured(status: str = "measurement_status", value: str = "value_numeric") -> Column:
    """The rows that may enter numeric statistics."""
    return (F.col(status) == "MEASURED") & F.col(value).isNotNull()


def steady(df: DataFrame, *names: str) -> DataFrame:
    """Four decimals for sums of doubles; the small shift keeps exact ties from following summation order."""
    return df.withColumns({n: F.round(F.col(n) + 1e-7, 4) for n in names})


def shifted(value: Column, places: Column) -> Column:
    """A decimal number with its point moved: the double nearest to ``value * 10 ** places``, without a product of doubles."""
    text = value.cast("string")
    digits = F.regexp_extract(text, "^([^E]*)", 1)
    own = F.coalesce(F.nullif(F.regexp_extract(text, "E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    moved = F.concat(digits, F.lit("E"), (own + places).cast("string")).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(moved)


def power_of_ten(factor: Column) -> Column:
    """The exponent of a factor that is a power of ten, else null."""
    places = F.round(F.log10(factor)).cast("int")
    return F.when(F.concat(F.lit("1E"), places.cast("string")).cast("double") == factor, places)
