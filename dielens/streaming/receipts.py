"""Incremental arrival of files as a bounded stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_RECEIPTS = "receipt_id string, sha256 string, file_size long, received_at_utc timestamp, is_duplicate_receipt boolean"


def _mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The receipts of one content in one batch: the first ever is new, all others repeat it."""
    rows = pd.concat(list(batches)).sort_values(["received_at_utc", "receipt_id"], ignore_index=True)
    rows["is_duplicate_receipt"] = rows.index > 0 if not state.exists else True
    state.update((True,))
    yield rows[["receipt_id", "sha256", "file_size", "received_at_utc", "is_duplicate_receipt"]]


def incremental_receipts(
    spark: SparkSession, folder: str, checkpoint: str, sink: str, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Record every new file once and mark contents that arrived before; stops when nothing is left.

    The contents seen so far are keys of Spark's state store (RocksDB, hashed into partitions, committed with each
    batch), so a batch reads the keys it brings and no history.  A repeated or late file is recognised by its content
    hash, so no watermark is needed.  Contents are hashed where they are read and do not travel; the receipts of one
    content in one batch are at most ``files_per_batch`` short rows.  The log of the sink makes a replayed batch
    replace its earlier attempt.  The store is set on a session of its own; the caller's settings stay.
    """
    own = spark.newSession()
    own.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    arrived = (
        own.readStream.format("binaryFile")
        .schema(_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(
            F.col("path").alias("receipt_id"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("received_at_utc"),
        )
    )
    marked = arrived.groupBy("sha256").applyInPandasWithState(
        _mark, _RECEIPTS, "seen boolean", "append", GroupStateTimeout.NoTimeout
    )
    return (
        marked.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
