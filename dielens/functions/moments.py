"""Cross products of many columns, mergeable block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = pa.schema([("__key", pa.string()), ("bi", pa.int32()), ("bj", pa.int32()), ("salt", pa.int32()), ("data", pa.binary())])
_DDL = "__key string, bi int, bj int, salt int, data binary"
_OUT = pa.schema(
    [("__key", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())]
    + [(c, pa.float64()) for c in ("sx", "sy", "sxx", "syy", "sxy")]
)
_OUT_DDL = "__key string, i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double"


def pair_moments(rows: DataFrame, keys: Sequence[str], size: int, block: int = 64, salts: int = 64) -> DataFrame:
    """(keys, i, j, n, sx, sy, sxx, syy, sxy) for every pair i < j of ``size`` columns, over the rows that have both.

    ``rows``: the keys and ``entries``, an array of (i, v) with the values a row has, of which the largest of a column
    counts.  A task folds all its rows into
    matrix products and gives one array for each pair of blocks of columns; arrays are added by salt first and then
    for good, so neither the rows of a key nor the parts of a pair meet in one task.
    """
    blocks = -(-size // block)
    keyed = rows.select(F.to_json(F.struct(*keys)).alias("__key") if keys else F.lit("{}").alias("__key"), "entries")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        held: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for key, (n, sx, sxx, sxy) in held.items():
                for bi in range(blocks):
                    for bj in range(bi, blocks):
                        a, b = slice(bi * block, (bi + 1) * block), slice(bj * block, (bj + 1) * block)
                        data = np.stack([n[a, b], sx[a, b], sx[b, a].T, sxx[a, b], sxx[b, a].T, sxy[a, b]])
                        values = zip(((key,), (bi,), (bj,), (salt,), (data.tobytes(),)), _PART, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in values], schema=_PART)
            held.clear()

        step = max(1, 4_000_000 // size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                entries = b.column("entries")
                count = entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = entries.flatten()
                row = np.repeat(np.arange(b.num_rows), count)
                x = np.full((b.num_rows, size), np.nan)
                v = flat.field("v").to_numpy(zero_copy_only=False)
                by = np.argsort(v, kind="stable")
                x[row[by], flat.field("i").to_numpy(zero_copy_only=False)[by]] = v[by]
                names, group = np.unique(np.array(b.column("__key").to_pylist(), object), return_inverse=True)
                for k, key in enumerate(names.tolist()):
                    own = x[group == k]
                    there = ~np.isnan(own)
                    own = np.where(there, own, 0.0)
                    there = there.astype(np.float64)
                    new = np.stack([there.T @ there, own.T @ there, (own * own).T @ there, own.T @ own])
                    held[key] = held[key] + new if key in held else new
                if len(held) * size * size * 32 > 256_000_000:
                    yield from given()
        yield from given()

    def added(table: pa.Table) -> np.ndarray:
        total = 0
        for x in table.column("data"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        return total

    def first(table: pa.Table) -> pa.Table:
        head = [table.column(c).slice(0, 1) for c in ("__key", "bi", "bj", "salt")]
        return pa.table([*head, pa.array([added(table).tobytes()], pa.binary())], schema=_PART)

    def last(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        high, wide = min(block, size - bi * block), min(block, size - bj * block)
        n, *sums = added(table).reshape(6, high, wide)
        i, j = np.nonzero(np.arange(high)[:, None] + bi * block < np.arange(wide)[None, :] + bj * block)
        key = pa.array([table.column("__key")[0].as_py()] * len(i), pa.string())
        columns = [key, pa.array(i + bi * block, pa.int32()), pa.array(j + bj * block, pa.int32()), pa.array(n[i, j].astype(np.int64))]
        return pa.table([*columns, *[pa.array(s[i, j]) for s in sums]], schema=_OUT)

    parts = keyed.mapInArrow(fold, _DDL).groupBy("__key", "bi", "bj", "salt").applyInArrow(first, _DDL)
    merged = parts.groupBy("__key", "bi", "bj").applyInArrow(last, _OUT_DDL)
    schema = rows.select(*keys).schema.simpleString() if keys else "struct<>"
    named = merged.withColumn("__key", F.from_json("__key", schema)) if keys else merged
    return named.select(*[F.col(f"__key.{c}").alias(c) for c in keys], "i", "j", "n", "sx", "sy", "sxx", "syy", "sxy")
