"""Pair moments, limit segments, the page index and mapped inserts against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dielens.functions.moments import pair_moments
from dielens.operators import query, stats, units, versions


@pytest.mark.parametrize(("size", "block"), [(1, 4), (4, 64), (70, 16), (70, 70)])
def test_pair_moments_in_blocks(spark, size, block):
    rng = np.random.default_rng(size)
    x = np.where(rng.random((300, size)) < 0.3, np.nan, rng.normal(size=(300, size)))
    group = rng.integers(0, 2, 300)
    data = [
        (None if g else "a", int(g), [(j, float(v)) for j, v in enumerate(r) if not np.isnan(v)]) for g, r in zip(group, x, strict=True)
    ]
    df = spark.createDataFrame(data, "k string, g int, entries array<struct<i:int,v:double>>").repartition(5)
    got = {(r["g"], r["i"], r["j"]): r for r in pair_moments(df, ["k", "g"], size, block, salts=2).collect()}
    assert len(got) == 2 * size * (size - 1) // 2
    for (g, i, j), r in got.items():
        both = x[group == g][:, [i, j]]
        a, b = both[~np.isnan(both).any(axis=1)].T
        assert r["k"] == (None if g else "a") and r["n"] == len(a)
        want = [a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()]
        assert [r[c] for c in ("sx", "sy", "sxx", "syy", "sxy")] == pytest.approx(want, abs=1e-9)


MEAS = "unit_id long, product_code string, lot_id string, parameter_code string, value_numeric double, measurement_status string"


def test_a_thousand_items_correlate_in_one_plan(spark):
    n, units_ = 1000, 12
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(units_, n))
    x[:, 5] = 7.0  # never varies
    rows = [(u, "P", "L", f"p{j}", float(x[u, j]), "MEASURED" if (u + j) % 7 else "INVALID") for u in range(units_) for j in range(n)]
    df = spark.createDataFrame(rows, MEAS)
    names = [f"p{j}" for j in range(n)]
    got = stats.correlation_matrix(df, names)
    assert got.count() == n * (n - 1) // 2
    some = {(r["parameter_x"], r["parameter_y"]): r for r in got.where("parameter_x IN ('p0', 'p5', 'p998')").collect()}
    for a, b in ((0, 1), (0, 999), (998, 999), (0, 64)):
        there = [u for u in range(units_) if (u + a) % 7 and (u + b) % 7]
        r = some[f"p{a}", f"p{b}"]
        assert r["n_used"] == len(there)
        assert r["r"] == pytest.approx(np.corrcoef(x[there][:, a], x[there][:, b])[0, 1], abs=1e-6)
    assert some["p0", "p5"]["r"] is None and some["p5", "p6"]["r"] is None


def test_bins_on_one_position(rows):
    data = [("P", 1, 1, "a"), ("P", 1, 1, "a"), ("P", 1, 1, "b"), ("P", 2, 1, "a"), ("P", 2, 1, "b"), ("P", 2, 2, "c"), ("Q", 1, 1, "b"), ("P", 1, 1, "z")]
    found = units.bin_cooccurrence(rows("product_code string, x_coord int, y_coord int, soft_bin string", *data), ["b", "a", "c"]).collect()
    assert [tuple(r) for r in found] == [("P", "b", "a", 2, 3)]


def test_capability_by_the_limits_of_each_row(rows):
    schema = MEAS + ", lsl_applied double, usl_applied double"
    values = [9.0, 10.0, 11.0, 10.5]
    data = [(i, p, "L", "VTH", v + shift, "MEASURED", lo, hi) for p, shift, lo, hi in (("A", 0, 5.0, 15.0), ("B", 100, 100.0, None), ("A", 50, 55.0, 65.0)) for i, v in enumerate(values)]
    got = stats.capability(rows(schema, *data), None, ["parameter_code"], ["product_code", "lot_id"]).collect()
    assert len(got) == 3 and {r["n_used"] for r in got} == {4}
    std, by = np.std(values, ddof=1), {r["lsl"]: r for r in got}
    for lo, shift in ((5.0, 0), (55.0, 50)):
        assert by[lo]["ppk"] == pytest.approx(min(15 - np.mean(values), np.mean(values) - 5) / (3 * std))
        assert by[lo]["mean"] == pytest.approx(np.mean(values) + shift)
    assert by[100.0]["pp"] is None and by[100.0]["ppk"] == pytest.approx((np.mean(values) + 0) / (3 * std))


def test_pages_from_an_index(spark):
    df = spark.range(5000).select(F.col("id").alias("unit_id"), (F.col("id") % 7).cast("string").alias("lot_id"), F.when(F.col("id") % 11 != 0, F.col("id") % 13).alias("v"))
    index = query.PageIndex(df, ["-lot_id", "v"], ranges=16)
    assert index.total == 5000 and len(index.starts) > 8
    order = ["lot_id DESC", "v", "unit_id"]
    want = [r["unit_id"] for r in df.selectExpr("*").orderBy(F.desc("lot_id"), "v", "unit_id").collect()]
    got = [[r["unit_id"] for r in index.page(k, 200).collect()] for k in (1, 2, 13, 25)]
    assert got == [want[200 * (k - 1) : 200 * k] for k in (1, 2, 13, 25)], order
    assert index.page(26, 200).count() == 0
    assert {r["total"] for r in index.page(25, 200).collect()} == {5000}
    touched = [s for s in index.starts if s[1] < 5000 and 4800 < s[1] + s[2]]
    assert sum(n for _, _, n in touched) < 1500  # the last page reads its own ranges only
    with pytest.raises(ValueError, match="size"):
        index.page(1, 7)
    assert query.PageIndex(df.limit(0), ["v"]).page(1).count() == 0


def test_codes_become_ids_once(rows):
    table = rows("name string, id long", ("a", 1), ("b", 2), ("twin", 3), ("twin", 4), ("b", 2))
    target = rows("user string, role_id long", ("u0", 9))
    source = rows("user string, role string", ("u0", "a"), ("u1", "a"), ("u1", "a"), ("u2", "gone"), ("u3", "twin"), ("u4", "a"), ("u4", "b"), ("u5", None))
    look = {"role_id": versions.Lookup(table, "role", "name", "id")}
    once, problems = versions.seed_mapped(target, source, look, ["user"])
    assert sorted(map(tuple, once.collect())) == [("u0", 9), ("u1", 1)]
    assert {tuple(r) for r in problems.collect()} == {("gone", "UNRESOLVED"), (None, "UNRESOLVED"), ("twin", "AMBIGUOUS"), ("a", "CONFLICT")}
    again, _ = versions.seed_mapped(once, source, look, ["user"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    pairs = rows("user string, role_id long", ("u4", 1))
    both, _ = versions.seed_mapped(pairs, source, look, ["user", "role_id"])
    assert sorted(map(tuple, both.collect())) == [("u0", 1), ("u1", 1), ("u4", 1), ("u4", 2)]
