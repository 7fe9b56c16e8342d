"""Traceability from probed die through assembly to final test."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.columns import share
from dielens.functions.shuffles import settled


def trace_direct(edges: DataFrame, cp: DataFrame, ft: DataFrame, min_confidence: float) -> DataFrame:
    """Die to assembly to final test, both results side by side; the weaker edge sets the confidence."""
    sure = edges.where(F.col("confidence") >= min_confidence)
    first = sure.where("trace_type = 'CP_ASSEMBLY'").select(
        F.col("source_unit_id").alias("cp_unit_id"), F.col("target_unit_id").alias("assembly_id"), F.col("confidence").alias("__c1")
    )
    second = sure.where("trace_type = 'ASSEMBLY_FT'").select(
        F.col("source_unit_id").alias("assembly_id"), F.col("target_unit_id").alias("ft_unit_id"), F.col("confidence").alias("__c2")
    )
    probed = cp.select(F.col("unit_id").alias("cp_unit_id"), F.col("overall_result").alias("cp_result"), "lot_id", "wafer_id")
    tested = ft.select(F.col("unit_id").alias("ft_unit_id"), F.col("overall_result").alias("ft_result"))
    return (
        first.join(second, "assembly_id")
        .join(probed, "cp_unit_id")
        .join(tested, "ft_unit_id")
        .withColumn("confidence", F.least("__c1", "__c2"))
        .drop("__c1", "__c2")
    )


def trace_lineage(
    edges: DataFrame, start: DataFrame, direction: str = "descendants", max_depth: int | None = None
) -> DataFrame:
    """Everything reachable from each start unit, level by level.

    ``start``: unit_id.  A pair is kept at its smallest depth with its best
    confidence (the product along the way), so cycles end and diamonds do not
    multiply.  Each level is one equi-join and is settled, which cuts the
    lineage and keeps finished levels safe from lost executors.  Levels are
    followed until no new pair is reached; ``max_depth`` ends them earlier.

    The edges are shuffled once: their sources meet the start units, which
    gives the first level, and the targets, which leaves the edges that a
    later level can use.  Pairs on a node without such an edge are not joined
    again, and earlier levels are looked at only for nodes they have in common
    with the new one.
    """
    source, target = ("source_unit_id", "target_unit_id")
    if direction == "ancestors":
        source, target = target, source
    elif direction != "descendants":
        raise ValueError(f"unknown direction {direction!r}")
    steps = edges.select(
        F.col(source).alias("node_id"), F.col(target).alias("__next"), F.col("confidence").alias("__c")
    )
    unit = start.schema["unit_id"].dataType
    if max_depth is not None and max_depth < 1:
        alone = start.select(F.col("unit_id").alias("start_unit_id"), F.col("unit_id").alias("node_id"))
        return alone.distinct().select("*", F.lit(1.0).alias("confidence"), F.lit(0).alias("depth"))
    best, worst = F.max("__c").alias("__best"), F.min("__c").alias("__worst")
    marked = (
        steps.join(_marked(start.select(F.col("unit_id").alias("node_id")), "__start"), "node_id", "left")
        .join(_marked(steps.select(F.col("__next").alias("node_id")), "__inner"), "node_id", "left")
        .where("__start OR __inner")
    )
    # of parallel edges the best one counts, the worst one if the confidence before is negative
    usable = settled(marked.groupBy("node_id", "__next", "__start", "__inner").agg(best, worst), "trace-edges")
    first = usable.where("__start AND NOT coalesce(node_id = __next, false)")
    found = frontier = first.select(
        F.col("node_id").cast(unit).alias("start_unit_id"),
        F.col("__next").alias("node_id"),
        F.col("__best").alias("confidence"),
        F.lit(1).alias("depth"),
    )
    if max_depth == 1 or found.isEmpty():
        return found
    inner = usable.where("__inner").drop("__start", "__inner")
    further = _marked(inner.select(F.col("node_id").alias("__next")), "__more")
    again = settled(inner.join(further, "__next", "left").withColumn("__more", F.coalesce("__more", F.lit(False))), "trace-again")
    passed = [frontier]
    for depth in count(2) if max_depth is None else range(2, max_depth + 1):
        # the best product of a pair is one with the best or the worst of parallel edges
        product = F.greatest(F.col("confidence") * F.col("__best"), F.col("confidence") * F.col("__worst"))
        reached = (
            frontier.join(again, "node_id")
            .where("NOT coalesce(start_unit_id = __next, false)")
            .groupBy("start_unit_id", F.col("__next").alias("node_id"))
            .agg(F.max(product).alias("confidence"), F.max("__more").alias("__more"))
        )
        reached = settled(reached, f"trace-{depth}")
        if reached.isEmpty():
            break
        earlier = reduce(DataFrame.unionByName, [p.select("start_unit_id", "node_id") for p in passed])
        common = settled(
            reached.select("node_id").distinct().join(earlier.select("node_id").distinct(), "node_id", "left_semi"), "trace-common"
        )
        if not common.isEmpty():
            again_met = earlier.join(common, "node_id", "left_semi")
            reached = settled(reached.join(again_met, ["start_unit_id", "node_id"], "left_anti"), f"trace-{depth}")
        level = reached.drop("__more").withColumn("depth", F.lit(depth))
        found = found.unionByName(level)
        passed.append(level)
        frontier = reached.where("__more").drop("__more")
        if frontier.isEmpty():
            break
    return found


def _marked(keys: DataFrame, name: str) -> DataFrame:
    """The different rows of ``keys`` with a true column of that name."""
    return keys.distinct().withColumn(name, F.lit(True))


def cp_ft_yield_correlation(traced: DataFrame, keys: list[str]) -> DataFrame:
    """Probe yield and final-test yield of the traced units per lot or wafer, and their correlation."""
    n = F.count(F.lit(1))
    per_group = traced.groupBy(*keys).agg(
        n.alias("n_traced"),
        share(F.count_if(F.col("cp_result") == "PASS"), n).alias("cp_yield"),
        share(F.count_if(F.col("ft_result") == "PASS"), n).alias("ft_yield"),
    )
    groups = settled(per_group)
    return groups.withColumn("correlation", groups.agg(F.corr("cp_yield", "ft_yield")).scalar())
