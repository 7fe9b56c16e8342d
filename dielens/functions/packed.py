"""Rows that travel between tasks as packed columns.

A shuffled row repeats the texts its neighbours have, and the shuffle's own compression hardly finds them again between
the fields of other columns.  Here a task gathers rows and makes one block of those that go the same way: column after
column, numbers by their bytes, texts as lengths and characters, compressed as a whole.  The rows keep their order inside
a block, so what was made side by side (the values of one unit) stays side by side.  Blocks are shuffled by Spark.
"""

from __future__ import annotations

import itertools
import struct
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the functions go to the workers as they are; these need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes a task gathers before it packs them, rows that are worked on at once, and parts for each shuffle partition.
GATHERED, AT_ONCE, PARTS = 64 << 20, 1 << 20, 4

_ARROW = {
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
    T.BooleanType(): pa.bool_(),
    T.ByteType(): pa.int8(),
    T.ShortType(): pa.int16(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.FloatType(): pa.float32(),
    T.DoubleType(): pa.float64(),
    T.DateType(): pa.date32(),
    T.TimestampType(): pa.timestamp("us", "UTC"),
    T.TimestampNTZType(): pa.timestamp("us"),
}
_NO_KEY = (T.FloatType(), T.DoubleType())


def packable(df: DataFrame, keys: Sequence[str] = ()) -> bool:
    """Whether all columns have plain types, and the keys such that equal values have equal bytes."""
    kinds = {f.name: f.dataType for f in df.schema}
    return (
        len(kinds) == len(df.columns)
        and all(k in _ARROW for k in kinds.values())
        and not any(kinds[k] in _NO_KEY for k in keys)
    )


def part_of(df: DataFrame, *near: Column) -> Column:
    """The part a row goes to, the same wherever ``near`` is the same."""
    parts = PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*near), F.lit(parts)).cast("int")


def stem(name: str) -> Column:
    """An identifier without its last two characters, if it is long: those that differ only there travel together."""
    text = F.col(name).cast("string")
    return F.when(F.length(text) > 8, F.expr(f"left(cast(`{name}` AS string), length(cast(`{name}` AS string)) - 2)")).otherwise(text)


def packed(df: DataFrame, deal: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """``deal`` and ``__rows``, a block of the rows of a task that are equal there; ``carried`` are the columns in it."""
    kinds = {f.name: f.dataType for f in df.schema}
    types = {c: _ARROW[kinds[c]] for c in (*deal, *carried)}
    deal, carried = list(deal), list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHERED:
                yield _pack(held, deal, carried, types)
                held, size = [], 0
        if any(b.num_rows for b in held):
            yield _pack(held, deal, carried, types)

    schema = T.StructType([*[df.schema[c] for c in deal], T.StructField("__rows", T.BinaryType())])
    return df.select(*dict.fromkeys((*deal, *carried))).mapInArrow(run, schema)


def unpacked(blocks: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the blocks, in the order of the blocks."""
    types = {f.name: _ARROW[f.dataType] for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (block.as_buffer() for batch in batches for block in batch.column(0))
        for table in _gathered(rows, types, 1 << 16):
            yield from table.to_batches()

    return blocks.select("__rows").mapInArrow(run, schema)


def by_part(
    sides: Sequence[tuple[DataFrame, Column]],
    work: Callable[..., Iterable[pa.RecordBatch | pa.Table]],
    schema: T.StructType,
) -> DataFrame:
    """What ``work`` makes of each part.

    ``sides``: rows and their part (:func:`part_of`).  ``work`` is given one iterator of tables for each side and must
    take them one after another; no more than a table of ``AT_ONCE`` rows is unpacked at a time.
    """
    blocks, types = None, []
    for side, (rows, part) in enumerate(sides):
        types.append({f.name: _ARROW[f.dataType] for f in rows.schema})
        made = packed(rows.withColumn("__part", part), ["__part"], rows.columns).select("__part", F.lit(side).alias("__side"), "__rows")
        blocks = made if blocks is None else blocks.unionByName(made)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for b in batches for x in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), strict=True))
        for _, part in itertools.groupby(found, lambda x: x[0]):
            by_side = itertools.groupby(part, lambda x: x[1])
            ahead = next(by_side, None)

            def tables(side: int) -> Iterator[pa.Table]:
                nonlocal ahead
                if ahead is not None and ahead[0] == side:
                    yield from _gathered((x[2].as_buffer() for x in ahead[1]), types[side], AT_ONCE)
                    ahead = next(by_side, None)

            for made in work(*[tables(i) for i in range(len(types))]):
                made = made.select(names)
                yield from made.to_batches(1 << 16) if isinstance(made, pa.Table) else [made]

    dealt = blocks.repartition("__part").sortWithinPartitions("__part", "__side")
    return dealt.select("__part", "__side", "__rows").mapInArrow(run, schema)


def packed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The left join of two large sides on one key, which meet as packed columns.

    A worker holds the left rows of one part; the right ones pass by.
    """
    joined = left.join(right, key, "left")
    alike = set(left.columns) & set(right.columns) == {key} and left.schema[key].dataType == right.schema[key].dataType
    if not (alike and packable(left, [key]) and packable(right, [key])):
        return joined
    schema = joined.schema
    kinds = {f.name: _ARROW[f.dataType] for f in schema}
    own = left.columns

    def meet(lefts: Iterator[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.Table]:
        held = list(lefts)
        if not held:
            return
        rows = pa.concat_tables(held).combine_chunks()
        found = whole(rows, key).dictionary_encode()
        code = found.indices.fill_null(-1).to_numpy()
        by_code = np.argsort(code, kind="stable")
        by_code = by_code[np.searchsorted(code[by_code], 0) :]  # a null key meets nothing
        counts = np.bincount(code[by_code], minlength=len(found.dictionary))
        starts = np.cumsum(counts) - counts
        met = np.zeros(len(counts), bool)
        for table in rights:
            other = pc.index_in(whole(table, key), value_set=found.dictionary, skip_nulls=True).fill_null(-1).to_numpy()
            at = np.flatnonzero(other >= 0)
            met[other[at]] = True
            many = counts[other[at]]
            # so many right rows at a time as make AT_ONCE rows
            turns = (np.cumsum(many) - many) // AT_ONCE
            for turn in np.unique(turns):
                here = at[turns == turn]
                c = counts[other[here]]
                step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                from_left = by_code[np.repeat(starts[other[here]], c) + step]
                yield _beside(rows.take(pa.array(from_left)), table.take(pa.array(np.repeat(here, c))), own, kinds)
        alone = np.flatnonzero((code < 0) | ~met[np.maximum(code, 0)] if len(met) else np.ones(len(code), bool))
        if len(alone):
            yield _beside(rows.take(pa.array(alone)), None, own, kinds)

    return by_part([(left, part_of(left, F.col(key))), (right, part_of(right, F.col(key)))], meet, schema)


def _beside(left: pa.Table, right: pa.Table | None, own: list[str], kinds: dict[str, pa.DataType]) -> pa.Table:
    made = {c: left.column(c) if c in own else right.column(c) if right is not None else pa.nulls(left.num_rows, kind) for c, kind in kinds.items()}
    return pa.table(made)


def codes(columns: Sequence[pa.Array]) -> tuple[np.ndarray, int]:
    """A number for each row, the same where all columns are (null equals null), and how many numbers there are."""
    number, count = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        found = column.dictionary_encode(null_encoding="encode")
        many = max(1, len(found.dictionary))
        number, count = number * many + found.indices.to_numpy(), count * many
        if count > len(number):
            dense = pa.array(number).dictionary_encode()
            number, count = dense.indices.to_numpy().astype(np.int64), len(dense.dictionary)
    return number, count


def row_numbers(table: pa.Table, key: np.ndarray, order: Sequence[str]) -> np.ndarray:
    """The place of each row among those of its key, from 1; ``-name`` descends, and a null is the least."""
    by = [_rank(whole(table, o.lstrip("-")), o.startswith("-")) for o in order]
    sorted_ = np.lexsort([*reversed(by), key])
    own = key[sorted_]
    first = np.r_[True, own[1:] != own[:-1]]
    at = np.arange(len(own))
    place = np.empty(len(own), np.int64)
    place[sorted_] = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    return place


def _rank(column: pa.Array, descending: bool) -> np.ndarray:
    kind = column.type
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_timestamp(kind)):
        rank = column.view(pa.int64()).to_numpy() if pa.types.is_timestamp(kind) else column.to_numpy().astype(np.int64)
    else:
        if pa.types.is_floating(kind):
            column = pc.add(column, pa.scalar(0, kind))  # one zero
        found = column.dictionary_encode()
        place = np.empty(len(found.dictionary), np.int64)
        place[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(1, len(place) + 1)
        rank = np.r_[0, place][pc.add(found.indices, 1).fill_null(0).to_numpy()]
    return ~rank if descending else rank


def latest(table: pa.Table, keys: Sequence[str], order: Sequence[str]) -> pa.Table:
    """One row for each key: one whose order columns are the largest, a null being the least."""
    key, count = codes([whole(table, c) for c in keys])
    rank = np.zeros(len(key), np.int64)
    for name in order:
        found = whole(table, name).dictionary_encode()
        place = np.empty(len(found.dictionary), np.int64)
        place[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(1, len(place) + 1)
        own = np.r_[0, place][pc.add(found.indices, 1).fill_null(0).to_numpy()]
        rank = rank * (len(place) + 1) + own
        if rank.max(initial=0) >= 1 << 16:
            rank = np.unique(rank, return_inverse=True)[1]
    by_rank = np.argsort(rank.astype(np.uint16) if rank.max(initial=0) < 1 << 16 else rank, kind="stable")
    best = np.full(count, -1, np.int64)
    best[key[by_rank]] = by_rank  # of several, the last one stays
    return table.take(pa.array(np.sort(best[best >= 0])))


def whole(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _pack(held: list[pa.RecordBatch], deal: list[str], carried: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    held.clear()
    number, count = codes([whole(table, c) for c in deal])
    if count <= 1 << 16:
        number = number.astype(np.uint16)  # numpy sorts these by radix
    order = np.argsort(number, kind="stable")
    number = number[order]
    starts = np.flatnonzero(np.diff(number, prepend=number[:1], append=number[-1:]))
    ends = np.r_[starts, len(order)]
    starts = np.r_[0, starts]
    cuts = [_cutter(whole(table, c).take(pa.array(order)).cast(types[c]), starts) for c in carried]
    rows = []
    codec = pa.Codec("zstd", compression_level=3)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        raw = b"".join([struct.pack("<q", b - a), *[x for cut in cuts for x in cut(a, b)]])
        rows.append(struct.pack("<q", len(raw)) + codec.compress(raw, asbytes=True))
    firsts = pa.array(order[starts])
    given = [whole(table, c).take(firsts).cast(types[c]) for c in deal]
    return pa.RecordBatch.from_arrays([*given, pa.array(rows, pa.binary())], names=[*deal, "__rows"])


def _cutter(column: pa.Array, starts: np.ndarray) -> Callable[[int, int], list[bytes]]:
    """What gives the bytes of a stretch of a column from one of the starts.

    Values that follow each other are written once where that is shorter, and so are texts that differ in their last two bytes.
    """
    runs = _runs(column, starts)
    if runs is not None:
        return runs
    if pa.types.is_string(column.type):
        chars = column.view(pa.binary())
        stems = _runs(pc.binary_slice(chars, 0, -2), starts)
        if stems is not None:
            ends = _plain(pc.binary_slice(chars, -2))
            return lambda a, b: [b"\4", *stems(a, b), *ends(a, b)]
    if pa.types.is_floating(column.type) and not column.null_count:
        found = column.view(pa.int64() if column.type == pa.float64() else pa.int32()).dictionary_encode()
        # few different numbers are listed with every block
        if len(found.dictionary) <= min(255, len(column) // len(starts) // 8):
            listed = b"".join(_plain(found.dictionary)(0, len(found.dictionary)))
            index = found.indices.to_numpy().astype(np.uint8)
            return lambda a, b: [b"\3", struct.pack("<q", len(found.dictionary)), listed, index[a:b].tobytes()]
    return _plain(column)


def _runs(column: pa.Array, starts: np.ndarray) -> Callable[[int, int], list[bytes]] | None:
    if pa.types.is_floating(column.type):
        return None  # 0.0 equals -0.0
    n = len(column)
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(column.slice(1), column.slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False)
    new[starts] = True
    firsts = np.flatnonzero(new)
    if len(firsts) * 3 > n * 2:
        return None
    lengths = np.diff(np.r_[firsts, n]).astype("<i4").view(np.uint8).reshape(-1, 4)
    values = _plain(column.take(pa.array(firsts)))

    def cut(a: int, b: int) -> list[bytes]:
        c, d = np.searchsorted(firsts, (a, b)).tolist()
        return [b"\2", struct.pack("<q", d - c), lengths[c:d].T.tobytes(), *values(c, d)]

    return cut


def _plain(column: pa.Array) -> Callable[[int, int], list[bytes]]:
    n, at = len(column), column.offset
    valid = column.is_valid().cast(pa.uint8()).to_numpy() if column.null_count else None
    kind = column.type
    if pa.types.is_boolean(kind):
        column, kind = column.cast(pa.uint8()).fill_null(0), pa.uint8()
        at = column.offset
    buffers = column.buffers()
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        offsets = np.frombuffer(buffers[1], np.int32, n + 1, at * 4)
        lengths = np.diff(offsets).astype("<i4").view(np.uint8).reshape(n, 4)
        chars = memoryview(buffers[2]) if buffers[2] is not None else b""

        def body(a: int, b: int) -> list[bytes]:
            return [lengths[a:b].T.tobytes(), chars[offsets[a] : offsets[b]]]
    else:
        width = kind.bit_width // 8
        places = np.frombuffer(buffers[1], np.uint8, n * width, at * width).reshape(n, width)

        def body(a: int, b: int) -> list[bytes]:
            return [places[a:b].T.tobytes()]

    def cut(a: int, b: int) -> list[bytes]:
        if valid is None or valid[a:b].all():
            return [b"\0", *body(a, b)]
        return [b"\1", valid[a:b].tobytes(), *body(a, b)]

    return cut


def _gathered(blocks: Iterable[pa.Buffer], types: dict[str, pa.DataType], most: int) -> Iterator[pa.Table]:
    """The rows of blocks as tables of about ``most`` rows; only a block that is larger makes a larger one."""
    held, n = [], 0
    for block in blocks:
        batch = _unpack(block, types)
        if held and n + batch.num_rows > most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _unpack(block: pa.Buffer, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    (size,) = struct.unpack_from("<q", block)
    raw, p = np.frombuffer(pa.Codec("zstd").decompress(block.slice(8), size), np.uint8), 0

    def take(n: int) -> np.ndarray:
        nonlocal p
        p += n
        return raw[p - n : p]

    def numbers(n: int) -> np.ndarray:
        return np.ascontiguousarray(take(4 * n).reshape(4, n).T).view("<i4").ravel()

    def column(n: int, kind: pa.DataType) -> pa.Array:
        how = take(1)[0]
        if how == 4:
            both = pc.binary_join_element_wise(column(n, pa.binary()), column(n, pa.binary()), b"")
            return both.view(kind)
        if how == 3:
            listed = column(int(take(8).view("<i8")[0]), kind)
            return listed.take(pa.array(take(n)))
        if how == 2:
            m = int(take(8).view("<i8")[0])
            lengths = numbers(m)
            return column(m, kind).take(pa.array(np.repeat(np.arange(m), lengths)))
        valid, nulls = None, 0
        if how == 1:
            there = take(n)
            valid, nulls = pa.py_buffer(np.packbits(there, bitorder="little")), n - int(there.sum())
        if pa.types.is_string(kind) or pa.types.is_binary(kind):
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum(numbers(n), out=offsets[1:])
            buffers = [valid, pa.py_buffer(offsets), pa.py_buffer(take(int(offsets[-1])))]
        elif pa.types.is_boolean(kind):
            buffers = [valid, pa.py_buffer(np.packbits(take(n), bitorder="little"))]
        else:
            width = kind.bit_width // 8
            buffers = [valid, pa.py_buffer(np.ascontiguousarray(take(n * width).reshape(width, n).T))]
        return pa.Array.from_buffers(kind, n, buffers, null_count=nulls)

    n = int(take(8).view("<i8")[0])
    return pa.RecordBatch.from_arrays([column(n, kind) for kind in types.values()], names=list(types))
