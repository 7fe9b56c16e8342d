"""The skew-proof patterns against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dielens.functions.shuffles import exact_quantiles, in_ranges, numbered, over_blocks, top_one


@pytest.fixture(scope="module")
def skewed(spark):
    pick = random.Random(7)
    data = [
        ("hot" if pick.random() < 0.7 else pick.choice(["a", "b", None]), pick.randrange(200), i, round(pick.gauss(5, 2), 2))
        for i in range(4000)
    ]
    return data, spark.createDataFrame(data, "k string, t int, id int, v double").repartition(6).cache()


def by_key(data):
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    return groups


def test_numbered(skewed):
    data, df = skewed
    got = numbered(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 10), "n").collect()
    want = {}
    for group in by_key(data).values():
        for i, row in enumerate(sorted(group, key=lambda r: (r[1], r[2])), 1):
            want[row[2]] = i
    assert {r["id"]: r["n"] for r in got} == want


@pytest.mark.parametrize("block", [7, 64, 100000])
def test_over_blocks(skewed, block):
    data, df = skewed
    placed = numbered(df, ["k"], [F.col("t"), F.col("id")], F.col("t"), "n")
    got = over_blocks(placed, ["k"], "n", 3, lambda w: {"s": F.sum("v").over(w.rowsBetween(-3, 0)), "l": F.lag("v", 3).over(w)}, block)
    want = {}
    for group in by_key(data).values():
        ordered = sorted(group, key=lambda r: (r[1], r[2]))
        for i, row in enumerate(ordered):
            want[row[2]] = (round(sum(r[3] for r in ordered[max(0, i - 3) : i + 1]), 6), ordered[i - 3][3] if i >= 3 else None)
    assert {r["id"]: (round(r["s"], 6), r["l"]) for r in got.collect()} == want


@pytest.mark.parametrize("pieces", [2, 16, 64])
def test_exact_quantiles(skewed, pieces):
    data, df = skewed
    points = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", points, pieces).collect()}
    for key, group in by_key(data).items():
        values = [r[3] for r in group]
        assert got[key]["n"] == len(values)
        for name, p in points.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_top_one_ships_one_row_per_key_and_task(skewed):
    _, df = skewed
    winners = top_one(df, ["k"], [F.desc("t"), F.desc("id")])
    plan = winners._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert winners.count() == 4


def test_numbered_by_ranges_where_one_hour_holds_half_of_all_rows(spark):
    pick = random.Random(11)
    rows = [
        ("hot" if pick.random() < 0.8 else pick.choice(["a", None]), pick.randrange(3600) if i % 2 else pick.randrange(3600 * 200), i)
        for i in range(20000)
    ]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    order = [F.col("t"), F.col("id")]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        sizes = sorted(r["count"] for r in in_ranges(df, ["k"], order).groupBy("__range").count().collect())
        got = numbered(df, ["k"], order, None, "n").collect()
    finally:
        spark.conf.set(coalesce, before)
    assert len(sizes) > 4
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    want = {}
    for group in by_key(rows).values():
        for i, row in enumerate(sorted(group, key=lambda r: (r[1], r[2])), 1):
            want[row[2]] = i
    assert {r["id"]: r["n"] for r in got} == want
    assert set(got[0].asDict()) == {"k", "t", "id", "n"}


def test_numbered_by_ranges_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, None)] * 3, "k string, t int")
    got = numbered(df, ["k"], [F.col("t")], None, "n").collect()
    assert sorted(r["n"] for r in got if r["k"] == "a") == list(range(1, 51))
    assert sorted(r["n"] for r in got if r["k"] is None) == [1, 2, 3]
    assert numbered(df.limit(0), ["k"], [F.col("t")], None, "n").count() == 0
