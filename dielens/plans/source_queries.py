"""Sources, sinks and exports: each query writes derived data and reads it back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from dielens.functions.columns import rounded
from dielens.operators import spatial
from dielens.plans import fixtures as fx
from dielens.plans.registry import query
from dielens.session import scratch_folder
from dielens.sources import exports, facts, files
from dielens.streaming.receipts import incremental_receipts

JOB = {
    "export_job_id": 7,
    "dataset_version_id": "DV1",
    "filter_hash": "all",
    "template_version": "T1",
    "expires_at_utc": "2024-06-01 00:00:00",
}


@query(
    "scan_canonical",
    """SELECT unit_id, lot_id, soft_bin, tested_at_utc FROM cp_rows WHERE lot_id IN ('L2', 'L5')
 AND strftime(tested_at_utc, '%Y-%m') IN ('1995-03', '1996-11')""",
)
def _(spark, sf):
    root = scratch_folder(spark, "canonical")
    facts.append_facts(fx.cp_rows(spark, sf), root, "unit_result")
    rows = facts.scan_canonical(spark, root, "unit_result", "CP", ["1995-03", "1996-11"], ["L2", "L5"])
    return rows.select("unit_id", "lot_id", "soft_bin", "tested_at_utc")


@query("append_facts", "SELECT test_stage, lot_id, parameter_code, count(*) AS n FROM meas GROUP BY 1, 2, 3")
def _(spark, sf):
    root = scratch_folder(spark, "facts")
    rows = fx.meas(spark, sf)
    facts.append_facts(rows.where("run_attempt_no = 0"), root, "measurement")
    facts.append_facts(rows.where("run_attempt_no = 1"), root, "measurement")
    both = facts.scan_canonical(spark, root, "measurement")
    return both.groupBy("test_stage", "lot_id", "parameter_code").agg(F.count(F.lit(1)).alias("n"))


#: What the vendor files are written in, by nation.
ENCODINGS = ("UTF-8", "GB18030", "UTF-16LE")


def _encoded(encoding):
    @F.pandas_udf("binary")
    def encode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: x.encode(encoding))

    return encode


@query(
    "scan_vendor_text",
    """SELECT c_custkey AS c1, c_name AS c2, c_mktsegment || '测试' AS c3, 'nation=' || c_nationkey AS source,
 row_number() OVER w + count(*) FILTER (c_custkey % 5 = 0) OVER w - CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS source_row_no
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, sf):
    """One file for each nation, in three encodings, with a blank line after every fifth customer."""
    found = []
    for k, encoding in enumerate(ENCODINGS):
        folder = scratch_folder(spark, f"vendor-{encoding}")
        line = F.concat_ws(";", "c_custkey", "c_name", F.concat("c_mktsegment", F.lit("测试")))
        line = F.concat(line, F.when(F.col("c_custkey") % 5 == 0, "\n").otherwise(""))
        rows = fx.table(spark, sf, "customer").where(F.col("c_nationkey") % len(ENCODINGS) == k)
        rows = rows.select("c_custkey", F.col("c_nationkey").alias("nation"), _encoded(encoding)(line).cast("string").alias("value"))
        rows = rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("value", "nation")
        rows.write.option("lineSep", "\n").option("encoding", encoding).partitionBy("nation").text(folder)
        read = files.scan_vendor_text(spark, f"{folder}/nation=*", ";", encoding, "c1 long, c2 string, c3 string")
        found.append(read)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.withColumn("source", F.regexp_extract("source_file", "nation=[0-9]+", 0)).drop("source_file")


def _file_folder(spark, sf):
    """Orders as text files, one for each group of keys, in order of their keys."""
    folder = scratch_folder(spark, "files")
    line = F.concat_ws(",", "o_orderkey", "o_custkey")
    orders = fx.table(spark, sf, "orders").select(line.alias("value"), "o_orderkey", (F.col("o_orderkey") % 64).alias("part"))
    ordered = orders.repartition("part").sortWithinPartitions("part", "o_orderkey").select("value", "part")
    ordered.write.partitionBy("part").text(folder)
    return folder


#: The files of ``_file_folder``.
_FILES = """(SELECT 'part=' || (o_orderkey % 64) AS part,
 string_agg(o_orderkey || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey) AS content FROM orders GROUP BY 1)"""


@query("scan_file_manifest", f"SELECT part, strlen(content) AS file_size, sha256(content) AS sha256 FROM {_FILES}")
def _(spark, sf):
    found = files.scan_file_manifest(spark, _file_folder(spark, sf) + "/part=*/part-*")
    return found.select(F.regexp_extract("path", "part=[0-9]+", 0).alias("part"), "file_size", "sha256")


@query("expand_archives", "SELECT concat('doc-', doc_id, '.txt') AS member, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    import io
    import zipfile

    import pandas as pd

    def packed(doc, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(f"doc-{doc}.txt", text)
        return out.getvalue()

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                files_ = [packed(doc, text) for doc, text in zip(part["doc_id"], part["text"])]
                yield pd.DataFrame({"path": [f"{doc}.zip" for doc in part["doc_id"]], "content": files_})

    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    containers = docs.mapInPandas(pack, "path string, content binary")
    return files.expand_archives(containers).select("member", F.sha2("content", 256).alias("sha256"))


@query(
    "scan_wafer_summary",
    """SELECT lot_id, wafer_id, CAST(min(tested_at_utc) AS DATE) AS tested_on, count(*) AS total,
 count(*) FILTER (first_fail IS NULL) AS n_pass FROM cp_rows GROUP BY 1, 2""",
)
def _(spark, sf):
    as_text = fx.cp_rows(spark, sf).groupBy("lot_id", "wafer_id").agg(
        F.date_format(F.min("tested_at_utc"), "yyyy-MM-dd").alias("tested_on"),
        F.count(F.lit(1)).cast("string").alias("total"),
        F.count_if(F.col("first_fail").isNull()).cast("string").alias("n_pass"),
    )
    return files.scan_wafer_summary(as_text.withColumn("lot_id", F.concat(F.lit(" "), "lot_id")))


@query(
    "write_compat_cleaned",
    """SELECT c.unit_id, lot_id, wafer_id, x_coord, y_coord, unit_sequence, CAST(soft_bin AS INT) AS soft_bin, l_quantity AS VTH,
 CASE WHEN first_fail < 2 OR l_extendedprice > 100000 THEN NULL ELSE l_extendedprice END AS BVDSS,
 CASE WHEN first_fail < 3 THEN NULL ELSE l_discount END AS IDSS, CASE WHEN first_fail < 4 THEN NULL ELSE l_tax END AS RDSON, 'T1' AS template_version FROM cp c""",
)
def _(spark, sf):
    path = scratch_folder(spark, "cleaned")
    exports.write_compat_cleaned(fx.cp(spark, sf), fx.meas(spark, sf), ["VTH", "BVDSS", "IDSS", "RDSON"], path, "T1")
    return spark.read.option("header", True).schema(
        "unit_id string, lot_id string, wafer_id string, x_coord int, y_coord long, unit_sequence long, soft_bin int, "
        "VTH double, BVDSS double, IDSS double, RDSON double, template_version string"
    ).csv(path)


@query(
    "write_compat_yield",
    """SELECT lot_id, wafer_id, count(*) AS total, count(*) FILTER (outcome = 'PASS') AS n_pass,
 round(count(*) FILTER (outcome = 'PASS') / count(*), 6) AS "yield", 'T1' AS template_version FROM final_u GROUP BY 1, 2""",
)
def _(spark, sf):
    path = scratch_folder(spark, "yield")
    exports.write_compat_yield(fx.final(spark, sf), path, "T1")
    schema = "lot_id string, wafer_id string, total long, n_pass long, yield double, template_version string"
    return rounded(spark.read.option("header", True).schema(schema).csv(path), 6, "yield")


@query(
    "write_compat_spec",
    """SELECT DISTINCT lot_id, parameter_code, unit_raw AS unit, limit_source, lsl_applied, usl_applied, 'T1' AS template_version FROM evals""",
)
def _(spark, sf):
    path = scratch_folder(spark, "spec")
    exports.write_compat_spec(fx.applied_limits(spark, fx.meas(spark, sf)), path, "T1")
    schema = (
        "lot_id string, parameter_code string, unit string, limit_source string, lsl_applied double, usl_applied double, "
        "template_version string"
    )
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    "export_csv",
    """SELECT unit_id, lot_id, soft_bin, 'DV1' AS dataset_version_id, 'all' AS filter_hash, 'T1' AS template_version FROM cp_rows""",
)
def _(spark, sf):
    path = scratch_folder(spark, "export")
    exports.export_csv(fx.cp_rows(spark, sf).select("unit_id", "lot_id", "soft_bin"), JOB, path)
    schema = "unit_id string, lot_id string, soft_bin string, dataset_version_id string, filter_hash string, template_version string"
    return spark.read.option("header", True).schema(schema).csv(path)


@query(
    "export_bin_txt",
    """WITH e AS (SELECT lot_id, wafer_id, min(x_coord) AS x0, max(x_coord) AS x1 FROM final_u GROUP BY 1, 2),
r AS (SELECT DISTINCT lot_id, wafer_id, y_coord FROM final_u),
g AS (SELECT r.lot_id, r.wafer_id, r.y_coord, unnest(range(x0, x1 + 1)) AS x FROM r JOIN e ON e.lot_id = r.lot_id AND e.wafer_id = r.wafer_id)
SELECT g.lot_id, g.wafer_id, string_agg(lpad(coalesce(f.soft_bin, '.'), 3, ' '), '' ORDER BY g.x) AS line
FROM g LEFT JOIN final_u f ON f.lot_id = g.lot_id AND f.wafer_id = g.wafer_id AND f.y_coord = g.y_coord AND f.x_coord = g.x
GROUP BY g.lot_id, g.wafer_id, g.y_coord""",
)
def _(spark, sf):
    path = scratch_folder(spark, "bin-txt")
    exports.export_bin_txt(spatial.wafer_map_bin(fx.outcomes(spark, sf)), path)
    return spark.read.text(path).select("lot_id", "wafer_id", F.col("value").alias("line"))


@query("export_artifact_manifest")
def _(spark, sf):
    path = scratch_folder(spark, "export")
    exports.export_csv(fx.cp_rows(spark, sf).select("unit_id", "lot_id", "soft_bin"), JOB, path)
    return exports.export_artifact_manifest(spark, path, JOB)


@query(
    "incremental_receipts",
    f"""SELECT sha256(content) AS sha256, strlen(content) AS file_size, again AS is_duplicate_receipt
FROM {_FILES}, (VALUES (false), (true)) v(again)""",
)
def _(spark, sf):
    """Every file arrives twice, in batches that hold some of the copies and not others."""
    first, second, sink = _file_folder(spark, sf), _file_folder(spark, sf), scratch_folder(spark, "receipts")
    folder = f"{first[: first.rindex('/')]}/{{{first.rsplit('/', 1)[1]},{second.rsplit('/', 1)[1]}}}"
    stream = incremental_receipts(spark, f"{folder}/part=*/part-*", scratch_folder(spark, "stream"), sink, 48)
    stream.awaitTermination()
    return spark.read.parquet(sink).select("sha256", "file_size", "is_duplicate_receipt")
