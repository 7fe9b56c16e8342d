"""Vendor files: manifests, archives and delimited text."""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dielens.functions.shuffles import join_sized


def scan_file_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size, hash and bytes of every file of an input set."""
    found = spark.read.format("binaryFile").load(glob)
    return found.select(
        "path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content"
    )


def expand_archives(manifest: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Files of the manifest with ZIP containers replaced by their members.

    Containers are found by their leading bytes.  Each file is opened by the
    task that read it; members leave in batches of about ``batch_bytes``.
    """
    is_zip = F.hex(F.substring("content", 1, 4)) == "504B0304"
    plain = manifest.where(~F.coalesce(is_zip, F.lit(False))).select(
        F.lit(None).cast("string").alias("container"), F.col("path").alias("member"), "content"
    )

    fields = pa.schema([("container", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            rows.append({"container": path.as_py(), "member": info.filename, "content": archive.read(info)})
                            size += info.file_size
                            if size >= batch_bytes or len(rows) >= 10_000:
                                yield pa.RecordBatch.from_pylist(rows, fields)
                                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, fields)

    inside = manifest.where(is_zip).select("path", "content").mapInArrow(
        members, "container string, member string, content binary"
    )
    return plain.unionByName(inside)


def _byte_order(spark: SparkSession, paths: str | list[str], encoding: str) -> str:
    """UTF-16 with the byte order that the mark at the start of a file gives; without a mark, little end first."""
    if encoding.upper() not in ("UTF-16", "UTF16"):
        return encoding
    begun = spark.read.text(paths).where(F.col("_metadata.file_block_start") == 0)
    head = begun.select(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("head")).first()
    return "UTF-16BE" if head and head["head"] == "FEFF" else "UTF-16LE"


def scan_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(line, source_file, source_row_no): physical lines, numbered from 1 in each file, blank ones included.

    A large file is read in blocks by many tasks, and no line is shuffled: a task numbers the lines of its blocks, and
    the line counts of the blocks before, a table of one row per block, are added.  Bytes are cut into lines first and
    decoded then, by any codec Python has; bytes that are no characters become U+FFFD.  Lines end with LF, CR or CRLF; in
    UTF-16, whose line ends are found as pairs of bytes, with LF or CRLF.  There a Gurmukhi or Gujarati letter beside a
    character U+xx00 may look like a line end; such a line would have an odd number of bytes, and ends the read with an
    error.  A byte order mark is no part of the first line.  Files of one call share their encoding and byte order.
    """
    codec = _byte_order(spark, paths, encoding)
    wide = codecs.lookup(codec).name in ("utf-16-le", "utf-16-be")
    reader = spark.read.option("lineSep", "\n").option("encoding", codec) if wide else spark.read
    raw = reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.col("value").cast("binary").alias("line"),
    )

    def decoded(line: bytes) -> str:
        if wide and len(line) % 2:
            raise ValueError("a UTF-16 line has an odd number of bytes")
        return line.decode(codec, "replace")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("source_file").dictionary_encode()
            file, block = names.indices.to_numpy(), batch.column("__block").to_numpy()
            new = np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])])
            heads = np.flatnonzero(new)
            at = np.arange(len(new)) - np.repeat(heads, np.diff(np.append(heads, len(new)))) + 1
            key = lambda i: (names.dictionary[int(file[i])].as_py(), int(block[i]))  # noqa: B023, E731
            if key(0) == last:  # a block that began in the batch before
                at[: heads[1] if len(heads) > 1 else len(at)] += done
            last, done = key(-1), int(at[-1])
            lines = [decoded(x) for x in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_file"), batch.column("__block"), pa.array(lines, pa.string()), pa.array(at, pa.int64())],
                ["source_file", "__block", "line", "__at"],
            )

    lines = raw.mapInArrow(number, "source_file string, __block long, line string, __at long")
    before = Window.partitionBy("source_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("source_file", "__block").agg(F.count(F.lit(1)).alias("__n"))
    blocks = blocks.select("source_file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # a block that the count did not see means that the files were split anew in between: better an error than a wrong number
    unseen = F.raise_error(F.lit("the blocks of the files changed while they were read")).cast("long")
    row = F.when(F.col("__before").isNull(), unseen).otherwise(F.col("__before") + F.col("__at"))
    line = F.regexp_replace("line", "^\ufeff", "") if wide or codecs.lookup(codec).name == "utf-8" else F.col("line")
    line = F.when(row == 1, line).otherwise(F.col("line"))
    line = F.regexp_replace(line, "\r$", "") if wide else line
    placed = join_sized(lines, blocks, ["source_file", "__block"], "left")
    return placed.select(line.alias("line"), "source_file", row.alias("source_row_no"))


def scan_vendor_text(
    spark: SparkSession,
    paths: str | list[str],
    sep: str,
    encoding: str,
    schema: StructType | str,
) -> DataFrame:
    """Delimited text: the columns of ``schema``, the file, and the number of the physical line (``scan_lines``).

    Blank lines give no row but are counted.  A field that is missing or no value of its type is null; fields beyond
    the schema are left out.
    """
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    lines = scan_lines(spark, paths, encoding).where(F.trim("line") != "")
    fields = F.from_csv("line", schema, {"sep": sep, "mode": "PERMISSIVE"})
    return lines.select(fields.alias("__fields"), "source_file", "source_row_no").select(
        "__fields.*", "source_file", "source_row_no"
    )


def scan_wafer_summary(df: DataFrame) -> DataFrame:
    """The wafer-level summary as its own dataset type: five typed columns and no measurements."""
    return df.select(
        F.trim("lot_id").alias("lot_id"),
        F.trim("wafer_id").alias("wafer_id"),
        F.col("tested_on").try_cast("date").alias("tested_on"),
        F.col("total").try_cast("long").alias("total"),
        F.col("n_pass").try_cast("long").alias("n_pass"),
    )
