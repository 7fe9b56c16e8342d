"""Shuffle patterns that stay balanced when one key holds a large share of the rows.

Built-in windows send every row of a partition key to one task.  That is fine
for groups bounded by the data model (the items of one unit, the attempts left
after a partial limit); the helpers here are for groups that are not: a lot, a
wafer session, a parameter, a file hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.packed import by_part, codes, packable, part_of, row_numbers, whole
from dielens.session import scratch_folder


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def settled(df: DataFrame, purpose: str = "settled") -> DataFrame:
    """The rows written once to the shared scratch folder and read back.

    A derived table that several joins use is then computed once, survives lost
    executors, and has a size the planner knows.
    """
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = True
) -> DataFrame:
    """Join a large left side with a derived right side that is expected to be small.

    The right side is settled first, so its real size decides: under the
    session's broadcast threshold the left side is not shuffled, above it the
    join is an ordinary shuffled one that AQE may split where it is skewed.
    """
    right = settled(right)
    if null_safe:
        return join_null_safe(left, right, keys, how)
    return left.join(right, list(keys), how)


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` is planned with a partial group limit below the
    exchange, so a map task ships at most one row per key however hot it is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def as_of(points: DataFrame, bounds: DataFrame, at: str) -> DataFrame:
    """The points with ``n_before``, the number of bounds at or before each.

    Points and bounds stand in one order, cut into ranges.  Inside a range the bounds are counted as they come; the
    totals of the ranges before are carried into it.  However many bounds there are, no point looks for its place.
    Equal instants fall into one range.
    """
    both = points.select(at, F.lit(0).alias("__bound")).unionByName(bounds.select(at, F.lit(1).alias("__bound")))
    ranged = settled(both.repartitionByRange(at).withColumn("__range", F.spark_partition_id()), "as-of")
    so_far = Window.partitionBy("__range").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("__range").agg(F.sum("__bound").alias("__total"))  # one row for each range
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__carry"))
    placed = ranged.withColumn("__own", F.sum("__bound").over(so_far)).where("__bound = 0")
    joined = placed.join(carry, "__range")
    return joined.select(at, (F.col("__own") + F.col("__carry")).cast("long").alias("n_before"))


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``__range``, the number of their range in the order of keys and order columns, written once.

    Ranges are cut at sampled quantiles of the whole order, so they are about equally large wherever the rows crowd.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return settled(ranged.withColumn("__range", F.spark_partition_id()), "ranges")


def ordering(order: Sequence[Column | str]) -> tuple[list[Column], bool]:
    """The order as columns, and whether it was given by names; ``-name`` descends."""
    named = all(isinstance(o, str) for o in order)
    return [o if isinstance(o, Column) else F.desc(o[1:]) if o.startswith("-") else F.col(o) for o in order], named


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    pieces: Column | None,
    name: str,
    sized_by: DataFrame | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """``row_number()`` per key (1-based) without putting a key into one task.

    ``pieces`` must never decrease along ``order`` (usually the leading order
    column cut to a day or hour).  Rows are ranked inside (key, piece) and
    shifted by the row counts of the earlier pieces; those counts are
    pre-aggregated before they are shuffled.  Where a piece may hold a large
    share of the rows, give None: the pieces are then ranges of equal size
    (:func:`in_ranges`).  ``sized_by`` may name a frame with the same keys and
    order columns per row that is cheaper to scan for them.
    With ``null_safe`` off (keys and pieces are never null) the ranked rows keep
    their partitioning through the join.
    An order given by names (``-name`` descends) lets wide rows travel as packed
    columns; a worker then ranks the pieces of one part at a time.
    """
    order, by_name, names = *ordering(order), order
    if pieces is None:
        if sized_by is not None:
            raise ValueError("ranges are cut and counted from the rows themselves")
        df, pieces = in_ranges(df, keys, order), F.col("__range")
    cut = df.withColumn("__piece", pieces).drop("__range")
    counted = cut if sized_by is None else sized_by.withColumn("__piece", pieces)
    sizes = counted.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__size"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("__piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = sizes.select(
        *keys, "__piece", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "__piece").orderBy(*order))
    ranked = cut.withColumn("__inside", inside)
    if null_safe:
        joined = join_null_safe(ranked, shift, [*keys, "__piece"], "inner")
    else:
        joined = ranked.join(shift, [*keys, "__piece"])
    plain = joined.withColumn(name, F.col("__inside") + F.col("__shift")).drop("__inside", "__shift", "__piece")
    own = [*keys, "__piece"]
    ordered = [o.lstrip("-") for o in names] if by_name else []
    alike = [cut.schema[c].dataType for c in own] == [shift.schema[c].dataType for c in own]
    if not (by_name and alike and packable(cut, own) and all(c in cut.columns for c in ordered)):
        return plain
    if not null_safe:
        cut, shift = cut.dropna(subset=own), shift.dropna(subset=own)

    def place(shifts, rows):
        before, held = list(shifts), list(rows)
        if held:
            table, shifted = pa.concat_tables(held), pa.concat_tables(before)
            m = shifted.num_rows
            number, count = codes([pa.concat_arrays([whole(shifted, c), whole(table, c)]) for c in own])
            at = np.zeros(count, np.int64)
            at[number[:m]] = whole(shifted, "__shift").to_numpy()
            yield table.append_column(name, pa.array(row_numbers(table, number[m:], names) + at[number[m:]]))

    return by_part([(x, part_of(x, *[F.col(c) for c in own])) for x in (shift, cut)], place, plain.schema)


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    reach: int,
    build: Callable[[Window], dict[str, Column]],
    block: int = 1 << 16,
) -> DataFrame:
    """Window expressions that look back at most ``reach`` rows, block by block.

    ``position`` numbers the rows of a key from 1 (see :func:`numbered`).  Each
    block also receives a copy of the last ``reach`` rows of the block before
    it, so frames are complete, and drops those copies afterwards.
    """
    if not 0 < reach <= block:
        raise ValueError("reach must be between 1 and the block size")
    offset = F.col(position) - 1
    own = F.floor(offset / block).cast("long")
    near_end = offset % block >= block - reach
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(copies))
    window = Window.partitionBy(*keys, "__block").orderBy(position)
    return (
        spread.withColumns(build(window))
        .where(F.col("__own") == F.col("__block"))
        .drop("__own", "__block")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
    pieces: int = 64,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, plus ``n``.

    1. equal values are counted per (key, value), with map-side combine;
    2. a mergeable sketch per key gives cut points of roughly equal size;
    3. cumulative counts of the pieces locate the ones holding a wanted rank;
    4. only those pieces are ordered by value, each on its own.

    The sketch only balances the work; the ranks are counted, so the result is
    exact.  No step holds the rows of a key in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    steps = [i / pieces for i in range(1, pieces)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("__v", steps, 10 * pieces).alias("__cuts"))
    cut_no = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    placed = join_null_safe(counts, cuts, keys, "inner").select(
        *keys, "__v", "__c", cut_no.alias("__piece")
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        placed.groupBy(*keys, "__piece")
        .agg(F.sum("__c").alias("__size"))
        .withColumns(
            {
                "__before": F.coalesce(F.sum("__size").over(earlier), F.lit(0)),
                "n": F.sum("__size").over(whole),
            }
        )
    )
    low = {name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in points.items()}
    high = {name: F.ceil(F.lit(p) * (F.col("n") - 1)) for name, p in points.items()}
    wanted = F.lit(False)
    for rank in (*low.values(), *high.values()):
        wanted = wanted | (
            (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__size"))
        )
    hit = sizes.where(wanted).select(*keys, "__piece", "__before", "n")
    running = (
        Window.partitionBy(*keys, "__piece")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = join_null_safe(placed, hit, [*keys, "__piece"], "inner").withColumn(
        "__upto", F.col("__before") + F.sum("__c").over(running)
    )
    sides = []
    for name in points:
        sides.append(F.min(F.when(F.col("__upto") > low[name], F.col("__v"))).alias(f"__lo_{name}"))
        sides.append(F.min(F.when(F.col("__upto") > high[name], F.col("__v"))).alias(f"__hi_{name}"))
    ends = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *sides)
    result = []
    for name, p in points.items():
        fraction = F.lit(p) * (F.col("n") - 1) - low[name]
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        result.append((lo + (hi - lo) * fraction).alias(name))
    return ends.select(*keys, "n", *result)
