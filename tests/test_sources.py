"""Files in and out, and the incremental stream over two runs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from dielens.operators import trace
from dielens.operators.clean import CLEANERS, clean, extract_test_items, register_cleaner
from dielens.sources import exports, facts, files
from dielens.streaming.receipts import incremental_receipts


@pytest.mark.parametrize("encoding", ["UTF-8", "GB18030", "UTF-16", "UTF-16BE", "ISO-8859-1"])
def test_physical_lines_across_blocks(spark, tmp_path, encoding):
    name = "é" if encoding == "ISO-8859-1" else "芯片一Ā"
    ends = ("\n", "\r\n", "\n\n")
    text = "".join(f"{i};{name}{i}{ends[i % 3]}" for i in range(1, 5001))
    mark = "\ufeff" if encoding in ("UTF-8", "UTF-16BE") else ""
    (tmp_path / "big.csv").write_bytes((mark + text).encode(encoding))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "small.csv").write_bytes((mark + f"7;{name}7").encode(encoding))
    lines = text.split("\n")
    want = [(int(x.split(";")[0]), x.split(";")[1].rstrip("\r"), "big.csv", k) for k, x in enumerate(lines, 1) if x.strip()]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8001")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        paths = [str(tmp_path / f) for f in ("big.csv", "empty.csv", "small.csv")]
        rows = files.scan_vendor_text(spark, paths, ";", encoding, "n long, name string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r["n"], r["name"], r["source_file"].rsplit("/", 1)[-1], r["source_row_no"]) for r in rows)
    assert got == sorted([*want, (7, f"{name}7", "small.csv", 1)])
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_lines_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b"1;a\xff\r2;b;more\r\n \nx;c\n5")
    rows = files.scan_vendor_text(spark, str(tmp_path), ";", "UTF-8", "n long, name string").orderBy("source_row_no")
    got = [(r["n"], r["name"], r["source_row_no"]) for r in rows.collect()]
    assert got == [(1, "a\ufffd", 1), (2, "b", 2), (None, "c", 4), (5, None, 5)]


def test_archives_are_replaced_by_their_members(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b")
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as archive:
        archive.writestr("x/one.csv", "1")
        archive.writestr("two.csv", "22")
    found = files.expand_archives(files.scan_file_manifest(spark, str(tmp_path)))
    got = {r["member"].rsplit("/", 1)[-1]: (r["container"] is None, bytes(r["content"])) for r in found.collect()}
    assert got == {"plain.csv": (True, b"a,b"), "one.csv": (False, b"1"), "two.csv": (False, b"22")}


def test_canonical_scan_prunes_and_pushes(spark, rows, tmp_path):
    units = rows("unit_id string, lot_id string, test_stage string, d string", ("1", "A", "CP", "2024-01-05"), ("2", "B", "CP", "2024-02-05"), ("3", "A", "FT", "2024-01-06"))
    units = units.withColumn("tested_at_utc", F.col("d").cast("timestamp_ntz")).drop("d")
    facts.append_facts(units, str(tmp_path), "unit_result")
    facts.append_facts(units.where("unit_id = '2'"), str(tmp_path), "unit_result")
    read = facts.scan_canonical(spark, str(tmp_path), "unit_result", "CP", ["2024-01"], ["A"])
    assert [r["unit_id"] for r in read.collect()] == ["1"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lot_id,A)" in plan and "stage" in plan.split("PartitionFilters")[1][:200]
    assert facts.scan_canonical(spark, str(tmp_path), "unit_result").count() == 4


def test_stream_records_each_file_once_and_marks_repeats(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (folder / f"{name}.txt").write_text(text)

    def run():
        incremental_receipts(spark, str(folder), str(tmp_path / "ckpt"), str(tmp_path / "sink"), 2).awaitTermination()
        return {r["receipt_id"].rsplit("/", 1)[-1]: r["is_duplicate_receipt"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}

    first = run()
    assert len(first) == 3 and sum(first.values()) == 1
    (folder / "d.txt").write_text("two")
    (folder / "e.txt").write_text("new")
    second = run()
    assert len(second) == 5 and second["d.txt"] and not second["e.txt"]
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5


def test_stream_reads_no_history_and_replays_a_lost_batch(spark, tmp_path):
    folder, ckpt, sink = tmp_path / "in", tmp_path / "ckpt", tmp_path / "sink"
    folder.mkdir()
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(*texts):
        for text in texts:
            (folder / f"{len(list(folder.iterdir()))}.txt").write_text(text)
        incremental_receipts(spark, str(folder), str(ckpt), str(sink), 4).awaitTermination()
        rows = spark.read.parquet(str(sink)).collect()
        return sorted((int(r["receipt_id"].rsplit("/", 1)[-1][:-4]), r["is_duplicate_receipt"]) for r in rows)

    texts = [str(i % 17) for i in range(40)]
    got = run(*texts)
    assert [i for i, _ in got] == list(range(40))
    assert sum(not again for _, again in got) == 17
    # the commit of the last batch is lost: the batch runs again and leaves what it left before
    last = max((ckpt / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (ckpt / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == got
    assert run("3", "new")[-2:] == [(40, True), (41, False)]
    # what was written before is not read again: without it, repeats are still known
    assert run("new")[-1] == (42, True)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_export_needs_its_pins_and_has_a_manifest(spark, rows, tmp_path):
    df = rows("unit_id string", ("1",), ("2",))
    with pytest.raises(ValueError):
        exports.export_csv(df, {"dataset_version_id": "D"}, str(tmp_path / "no"))
    job = {"dataset_version_id": "D", "filter_hash": "h", "template_version": "T", "export_job_id": 1, "expires_at_utc": "2024-01-01 00:00:00"}
    exports.export_csv(df, job, str(tmp_path / "out"))
    listed = exports.export_artifact_manifest(spark, str(tmp_path / "out"), job).collect()
    assert listed and all(len(r["sha256"]) == 64 and r["file_size"] > 0 for r in listed)


def test_lineage_ends_on_cycles_and_merges_diamonds(rows):
    edges = rows(
        "source_unit_id string, target_unit_id string, confidence double",
        ("a", "b", 0.5), ("a", "c", 0.9), ("b", "d", 1.0), ("c", "d", 0.9), ("d", "a", 1.0),
    )
    got = {r["node_id"]: (r["depth"], round(r["confidence"], 6)) for r in trace.trace_lineage(edges, rows("unit_id string", ("a",))).collect()}
    assert got == {"b": (1, 0.5), "c": (1, 0.9), "d": (2, 0.81)}
    up = trace.trace_lineage(edges, rows("unit_id string", ("d",)), "ancestors", 1)
    assert {r["node_id"] for r in up.collect()} == {"b", "c"}


def test_cleaner_versions_are_fixed_once_registered(rows):
    register_cleaner("TEST", "1.0", lambda df: df.withColumn("done", F.lit(True)))
    try:
        assert clean(rows("a int", (1,)), "TEST", "1.0").first()["done"]
        with pytest.raises(ValueError):
            register_cleaner("TEST", "1.0", lambda df: df)
        with pytest.raises(ValueError):
            clean(rows("a int", (1,)), "TEST", "9.9")
    finally:
        del CLEANERS["TEST", "1.0"]


def test_archive_members_leave_in_batches(spark, rows):
    """Batches end by size, between archives and inside them; nothing is lost at their edges."""
    import io
    import zipfile

    def packed(n, size):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("folder/", b"")
            for k in range(n):
                archive.writestr(f"m{k}", bytes([k]) * size)
        return out.getvalue()

    made = {"a.zip": packed(5, 30), "b.zip": packed(0, 0), "c.zip": packed(1, 500), "d.zip": packed(3, 0)}
    manifest = rows("path string, content binary", *made.items(), ("plain.txt", b"text"), ("empty", None)).coalesce(1)
    found = {(r.container, r.member): r.content for r in files.expand_archives(manifest, batch_bytes=64).collect()}
    want = {("a.zip", f"m{k}"): bytearray([k] * 30) for k in range(5)} | {("c.zip", "m0"): bytearray(500)}
    want |= {("d.zip", f"m{k}"): bytearray() for k in range(3)} | {(None, "plain.txt"): bytearray(b"text"), (None, "empty"): None}
    assert found == want


def test_header_rows_are_not_sorted_where_they_are_read(rows):
    """Cells are aggregated only behind the exchange: an input split of any size is not sorted by one task."""
    header = rows(
        "source_file string, source_row_no int, cells array<string>",
        ("f", 1, ["X", " vth ", ""]), ("f", 2, ["", "V", "A"]), ("f", 3, ["", "1", "2"]), ("f", 4, ["", "9", "8"]), ("f", 5, ["1", "2", "3"]),
        ("f", 1, ["X", "late", ""]), (None, 1, ["X", "no file"]), ("g", 2, ["X", "V"]), ("h", 1, None),
    )
    profile = {"name_row": 1, "unit_row": 2, "lower_row": 3, "upper_row": 4, "first_item_column": 1}
    items = extract_test_items(header, profile)
    assert sorted(items.collect(), key=str) == sorted(
        [("f", 1, "vth", "V", "1", "9", 1), (None, 1, "no file", None, None, None, 1)], key=str
    )
    plan = items._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.rindex("Aggregate") < plan.index("Exchange")


def test_facts_are_computed_once_when_appended(spark, rows, tmp_path):
    """No pass over the rows only to sample them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    made = spark.range(0, 300, 1, 4).select(
        counted(F.concat(F.lit("u"), "id")).alias("unit_id"),
        F.lit("CP").alias("test_stage"),
        F.concat(F.lit("L"), F.col("id") % 7).alias("lot_id"),
        F.timestamp_seconds(F.col("id") % 3 * 3_000_000).alias("tested_at_utc"),
    )
    facts.append_facts(made, str(tmp_path), "unit_result")
    assert seen.value == 300
    found = facts.scan_canonical(spark, str(tmp_path), "unit_result")
    assert found.count() == 300 and found.select("unit_id").distinct().count() == 300
