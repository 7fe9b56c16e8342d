"""Rows that travel as packed columns: what comes out is what went in, and what travels is small."""

import random
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dielens.functions import packed
from dielens.functions.shuffles import numbered
from dielens.operators import clean, query, rules
from dielens.plans import fixtures
from dielens.sources import facts

EVALS = "measurement_id string, evaluation_type string, evaluation_scope_key string, evaluated_at_utc long, evaluation_run_id int, result string"


def shuffled(df):
    """Bytes that the exchanges of a finished query wrote."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name == "ShuffleQueryStageExec":
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found += node.metrics().apply("shuffleBytesWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_blocks_hold_every_type_and_null(spark):
    kinds = "a boolean, b byte, c short, d int, e long, f float, g double, h date, i timestamp, j timestamp_ntz, k string, l binary, m string"
    some = spark.range(0, 500, 1, 3).select(
        *[
            F.when(F.col("id") % (3 + n) != 0, F.lit(str(n % 2 if kind == "boolean" else n)) if kind not in ("date", "timestamp", "timestamp_ntz") else F.lit(f"2024-01-{n + 1:02}")).cast(kind).alias(name)
            for n, (name, kind) in enumerate(x.strip().split(" ") for x in kinds.split(","))
        ],
        F.when(F.col("id") > 600, "x").alias("never"),
        F.when(F.col("id") % 2 == 0, "").otherwise(F.repeat(F.lit("芯"), F.col("id").cast("int"))).alias("text"),
        (F.col("id") % 5).alias("way"),
    )
    blocks = packed.packed(some, ["way"], some.columns)
    assert blocks.count() == 15 and blocks.columns == ["way", "__rows"]
    back = packed.unpacked(blocks, some.schema)
    assert back.schema == some.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, some.collect()))
    assert packed.packed(some.where("way > 9"), ["way"], some.columns).count() == 0


def test_stretches_of_equal_and_of_like_values(spark, rows):
    texts = ["", "", "a", "b", "ab", "ab", "abc", "abd", "abe", None, None, "芯/1", "芯/2", "芯", None, "x"]
    some = rows("n long, way int, text string, at long, bytes binary, yes boolean", *[
        (i, i * 7 % 3, texts[i // 5 % 16], None if i % 40 < 9 else i // 8, bytes([i // 90]), None if i < 30 else i % 60 < 40) for i in range(400)
    ]).coalesce(1)
    blocks = packed.packed(some, ["way"], some.columns)
    assert blocks.count() == 3
    found = [tuple(r) for r in packed.unpacked(blocks, some.schema).collect()]
    want = [tuple(r) for r in some.collect()]
    assert len(found) == len(want)
    for way in range(3):
        assert [r for r in found if r[1] == way] == [r for r in want if r[1] == way]
    likes = spark.range(0, 300, 1, 1).select(F.lit(0).alias("way"), F.when(F.col("id") % 11 != 4, F.concat_ws("/", F.floor(F.col("id") / 5), F.col("id") % 5)).alias("text"))
    back = packed.unpacked(packed.packed(likes, ["way"], ["text"]), likes.select("text").schema)
    assert [r[0] for r in back.collect()] == [r[1] for r in likes.collect()]


@pytest.mark.parametrize("kind", ["string", "double"])
def test_packed_join_is_a_left_join(spark, rows, kind):
    drawn = random.Random(3)
    names = [None, *map(str, range(60))]
    left = rows("k string, a int", *[(drawn.choice(names), i) for i in range(150)]).withColumn("k", F.col("k").cast(kind))
    right = rows("k string, b string, c double", *[(drawn.choice(names[:40]), drawn.choice([None, "x", "y"]), float(i)) for i in range(300)])
    right = right.withColumn("k", F.col("k").cast(kind))
    before = packed.AT_ONCE
    packed.AT_ONCE = 7
    try:
        for one, other in ((left, right), (left.where("a < 0"), right), (left, right.where("c < 0"))):
            got, plain = packed.packed_join(one, other, "k"), one.join(other, "k", "left")
            assert got.schema == plain.schema
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    finally:
        packed.AT_ONCE = before


def test_units_and_values_meet_in_few_bytes(spark):
    unit = F.concat_ws("-", F.xxhash64("id"), F.xxhash64("id", F.lit(1)))
    units = spark.range(0, 20_000, 1, 4).select(
        unit.alias("unit_id"), unit.alias("logical_unit_key"), F.lit("R").alias("run_id"), F.lit(0).alias("attempt_no"), F.lit(1).alias("unit_sequence"), F.lit("1").alias("soft_bin")
    )
    values = units.select("unit_id", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("source_column_index")).select(
        "*", F.lit("VTH").alias("parameter_code"), F.lit("1.0").alias("raw_value"), F.lit(1.0).alias("value_numeric"), F.lit("MEASURED").alias("measurement_status"), F.lit("PASS").alias("evaluation_result")
    )
    found = query.unit_detail(units, values)
    assert found.count() == 80_000
    made = query.unit_detail(units, values)
    assert {r.n for r in made.groupBy("unit_id").agg(F.count("parameter_code").alias("n")).select("n").distinct().collect()} == {4}
    rows_ = made.collect()
    assert len(rows_) == 80_000
    # the texts of a unit are sent once with the unit and once with its values: 2 x 16 bytes of hash at least, 8 for each row
    assert shuffled(made) < 80_000 * 16


def test_other_types_are_not_packed(rows):
    assert not packed.packable(rows("a long, b array<int>", (1, [2])))
    assert not packed.packable(rows("a decimal(9,2)", (Decimal("1.00"),)))
    assert not packed.packable(rows("a double", (1.0,)), ["a"]) and packed.packable(rows("a double", (1.0,)))


@pytest.mark.parametrize("extra", ["", ", list array<int>"])
def test_the_latest_run_of_each_key(rows, extra):
    drawn = random.Random(5)
    made = set()
    for _ in range(4000):
        key = (drawn.choice([None, "m", *(f"measurement-{i}/{k}" for i in range(200) for k in (1, 2))]), drawn.choice(["SPEC", None]), drawn.choice("DE"))
        made.add((*key, drawn.choice([None, 1, 2, 70_000]), drawn.choice([None, -4, 1, 2])))
    made = [(*x, f"r{i}", *([[i]] if extra else [])) for i, x in enumerate(sorted(made, key=str))]
    want = {}
    for x in made:
        order = tuple(-(1 << 40) if v is None else v for v in x[3:5])
        want[x[:3]] = max(want.get(x[:3], (order, x)), (order, x), key=lambda v: v[0])
    found = rules.current_evaluation(rows(EVALS + extra, *made))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(x) for _, x in want.values())


def test_runs_meet_in_few_bytes(spark):
    """The values of a unit share their texts where they travel."""
    unit = F.concat_ws("-", F.xxhash64("id"), F.xxhash64("id", F.lit(1)))
    steps = spark.range(0, 20_000, 1, 4).select(unit.alias("unit"), F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("step"))
    evals = steps.select(
        F.concat_ws("/", "unit", "step").alias("measurement_id"),
        F.lit("SPEC").alias("evaluation_type"),
        F.lit("DEFAULT").alias("evaluation_scope_key"),
        F.lit(1).alias("evaluated_at_utc"),
        F.lit(1).alias("evaluation_run_id"),
        F.lit("PASS").alias("evaluation_result"),
    )
    current = rules.current_evaluation(evals)
    assert len(current.collect()) == 80_000
    # 16 bytes of hash for each unit are the least that can be sent: 4 for each of its rows
    assert shuffled(current) < 80_000 * 8


@pytest.mark.parametrize("lot", ["string", "double"])
def test_facts_are_moved_and_kept_in_few_bytes(spark, tmp_path, lot):
    """The four values of a unit share its texts in the exchange and in the table; rows that cannot be packed are written as well."""
    unit = F.concat_ws("-", F.xxhash64("id"), F.xxhash64("id", F.lit(1)))
    steps = spark.range(0, 20_000, 1, 4).select("id", unit.alias("unit_id"), F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("test_item_id"))
    made = steps.select(
        F.concat_ws("/", "unit_id", "test_item_id").alias("measurement_id"),
        "unit_id",
        "test_item_id",
        F.lit("CP").alias("test_stage"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 3).cast(lot).alias("lot_id"),
        F.timestamp_seconds(F.col("id") % 3 * 3_000_000).cast("timestamp_ntz").alias("tested_at_utc"),
    )
    facts.append_facts(made, str(tmp_path), "measurement")
    found = facts.scan_canonical(spark, str(tmp_path), "measurement")
    assert sorted(found.columns) == sorted(made.columns)
    same = found.select(*made.columns)
    assert same.exceptAll(made).count() == 0 and made.exceptAll(same).count() == 0
    files = list(tmp_path.glob("measurement/stage=*/tested_month=*/*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    if lot == "string":
        blocks = packed.packed(made, ["test_stage", "lot_id"], made.columns)
        assert blocks.agg(F.sum(F.length("__rows"))).first()[0] < 80_000 * 14


@pytest.mark.parametrize("null_safe", [True, False])
def test_places_by_names_are_those_by_columns(rows, null_safe):
    """Ranks inside pieces, shifted by the pieces before, whether rows travel as such or as packed columns."""
    drawn = random.Random(11)
    some = [None, -2.0, -0.0, 0.0, 7.5, float("nan")]
    made = rows("lot string, day int, a long, b double, c string, id int", *[
        (drawn.choice(["x", "y", None]), drawn.choice([None, 1, 2, 3]), drawn.choice([None, 5, 6, -(1 << 62)]), drawn.choice(some), drawn.choice([None, "", "u", "v"]), i) for i in range(600)
    ]).repartition(5)
    by = [F.col("day"), F.col("a"), F.desc("b"), F.desc("c"), F.col("id")]
    plain = numbered(made, ["lot"], by, F.col("day"), "n", null_safe=null_safe)
    found = numbered(made, ["lot"], ["day", "a", "-b", "-c", "id"], F.col("day"), "n", null_safe=null_safe)
    assert found.schema == plain.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    by_column, by_name = (clean.assign_attempt_no(made, ["lot", "day"], o) for o in (by, ["day", "a", "-b", "-c", "id"]))
    assert by_name.schema == by_column.schema
    assert sorted(map(str, by_name.collect())) == sorted(map(str, by_column.collect()))
    nested = made.withColumn("list", F.array("id"))
    assert clean.assign_attempt_no(nested, ["lot", "day"], ["a", "id"]).count() == 600


def test_dice_numbered_as_blocks_are_the_same_in_fewer_bytes(spark, sf):
    plain, blocks = fixtures.cp(spark, sf), fixtures.cp(spark, sf, as_blocks=True)
    assert blocks.schema == plain.schema
    kept = plain.collect()
    assert sorted(map(str, blocks.collect())) == sorted(map(str, kept))
