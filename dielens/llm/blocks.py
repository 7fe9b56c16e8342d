"""Blocks of documents, and the exchange by which they learn which of their names other blocks have too.

A block is a run of whole documents with its text compressed, written once as a bucketed table.  Each exchange sends
only sorted arrays of names, cut into parts of the name space, and answers every block with one bit for each
name; since the table is bucketed by block, the answers join it without moving a text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.shuffles import settled
from dielens.llm.text import map_arrow, texts_of
from dielens.session import scratch_folder

U = np.uint64
#: Stands for a null id: after every other one.
LAST = 2**63 - 1
TABLE = "block long, docs binary, ends binary, text binary"
ARROW = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("ends", pa.binary()), ("text", pa.binary())])


@dataclass
class Plan:
    """How the corpus is cut: about 8 blocks in a bucket, the names of 1.5 MB of text in a part, 16 names at least in a message.

    The block grows with the square root of the corpus, so that messages stay worth sending.  ``name_bits`` is how much of
    a name is sent where names are only counted: two names of a corpus then meet by chance with less than 1 in 256.
    """

    block_bytes: int
    buckets: int
    parts: int
    part_bytes: int
    name_bits: int

    @staticmethod
    def of(total: int, shuffle_partitions: int) -> Plan:
        block = int(min(max(2_000_000, (total * 1000) ** 0.5), 64_000_000))
        buckets = max(shuffle_partitions, -(-total // (8 * block)))
        parts = max(2 * shuffle_partitions, -(-total // 1_500_000))
        parts = 1 << min(int(parts - 1).bit_length(), max((block // 256).bit_length(), 4))
        return Plan(block, buckets, parts, max(total // parts, 1_000_000), min(max(int(total).bit_length() + 8, parts.bit_length()), 64))


@dataclass
class Block:
    number: int
    docs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: bytes

    @staticmethod
    def of(row: dict) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(row["text"])
        end = np.frombuffer(row["ends"], "<i8")
        # the text of a document ends one byte, a line end, before its end
        start = np.concatenate([[0], end[:-1]])
        return Block(row["block"], np.frombuffer(row["docs"], "<i8"), start, end - 1, raw)


def store(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """The block table of ``docs``."""
    spark = docs.sparkSession
    source = texts_of(docs, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan.of(total, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, own = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            ends = np.cumsum([len(x) + 1 for x in texts]).astype("<i8")
            packed = press.compress(b"\n".join(texts) + b"\n")
            row = [[own], [np.array(ids, "<i8").tobytes()], [ends.tobytes()], [packed]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                raw = part.column("text").cast(pa.binary()).to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), raw, strict=True):
                    if size and size + len(text) > plan.block_bytes:
                        yield made()
                        own += 1
                        ids, texts, size = [], [], 0
                    ids.append(LAST if doc is None else doc)
                    texts.append(text)
                    size += len(text)
        if ids:
            yield made()

    name = f"blocks_{uuid.uuid4().hex}"
    made = map_arrow(source, run, TABLE).write.option("compression", "none")
    made.option("path", scratch_folder(spark, "blocks")).bucketBy(plan.buckets, "block").saveAsTable(name)
    return spark.table(name), plan


def cut(names: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the name space begins in sorted names."""
    return np.searchsorted(names >> U(64 - (parts.bit_length() - 1)), np.arange(parts + 1, dtype=U)) if parts > 1 else np.array([0, len(names)])


def answered(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """The blocks with an array of what the parts say to each."""
    return blocks.join(listed(answers, name), "block", "left")


def listed(answers: DataFrame, name: str = "answers") -> DataFrame:
    """One written row of answers for each block; the parts bound their number."""
    return settled(answers.groupBy("block").agg(F.collect_list(F.struct("part", "said")).alias(name)), name)


def packed(names: np.ndarray, parts: int, name_bits: int) -> np.ndarray:
    """The first bits of sorted names as the distances inside each part, one row for each byte of the widest one."""
    inside = (names >> U(64 - name_bits)) & U((1 << (name_bits - parts.bit_length() + 1)) - 1)
    at = cut(names, parts)[:-1]
    step = inside.copy()
    step[1:] -= inside[:-1]
    first = at[at < len(names)]
    step[first] = inside[first]
    width = max(-(-int(step.max(initial=0)).bit_length() // 8), 1)
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T)


def unpacked(packs: list[bytes], size: np.ndarray) -> np.ndarray:
    """The names of the messages of one part, from the beginning of the part."""
    ends = np.cumsum(size)
    step = np.zeros((int(ends[-1]), 8), np.uint8)
    for pack, n, end in zip(packs, size.tolist(), ends.tolist(), strict=True):
        rows = np.frombuffer(pack, np.uint8).reshape(-1, n)
        step[end - n : end, : len(rows)] = rows.T
    total = np.concatenate([np.zeros(1, U), np.cumsum(step.view(U).ravel())])
    return total[1:] - np.repeat(total[ends - size], size)


def shared_names(
    blocks: DataFrame, plan: Plan, hot: int, names_of: Callable[[Block, dict], tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> DataFrame:
    """(block, part, said): two rows of bits for the names of the block in the part: not alone, and hot.

    ``names_of`` gives, for a block and its row, the sorted different names, which are not alone inside it already, and how often each
    occurs.  A name is hot that occurs more than ``hot`` times in the corpus (a block counts up to 255 of its own).  Only
    the first bits of a name are sent, so that now and then a name that is alone is taken for a shared one; what is said
    to be alone is.
    """
    parts = plan.parts
    message = pa.schema(
        [("block", pa.int64()), ("part", pa.int32()), ("names", pa.binary()), ("twice", pa.binary()), ("often", pa.binary())]
    )
    reply = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("said", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block.of(row)
            names, twice, often = names_of(block, row)
            often = np.minimum(often, 255).astype(np.uint8)
            at, planes = cut(names, parts), packed(names, parts, plan.name_bits)
            full = np.flatnonzero(at[1:] > at[:-1]).tolist()
            columns = [  # one batch for all messages of a block
                [block.number] * len(full),
                full,
                [planes[:, at[p] : at[p + 1]].tobytes() for p in full],
                [np.packbits(twice[at[p] : at[p + 1]]).tobytes() for p in full],
                [often[at[p] : at[p + 1]].tobytes() for p in full],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, message, strict=True)], schema=message)

    def meet(table: pa.Table) -> pa.Table:
        often = table.column("often").to_pylist()
        size = np.array([len(x) for x in often])
        names = unpacked(table.column("names").to_pylist(), size)
        alone = np.concatenate([
            np.unpackbits(np.frombuffer(x, np.uint8), count=n) == 0
            for x, n in zip(table.column("twice").to_pylist(), size.tolist(), strict=True)
        ])
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        alone[order[1:][same]] = alone[order[:-1][same]] = False
        often = np.frombuffer(b"".join(often), np.uint8)
        group = np.concatenate([[0], np.cumsum(~same)])
        many = np.zeros(len(names), bool)
        many[order] = (np.bincount(group, often[order]) > hot)[group]
        ends = np.cumsum(size)
        said = [
            np.packbits(np.stack([~alone[e - n : e], many[e - n : e]]), axis=1).tobytes()
            for e, n in zip(ends.tolist(), size.tolist(), strict=True)
        ]
        return pa.table([table.column("block"), table.column("part"), pa.array(said, pa.binary())], schema=reply)

    sent = map_arrow(blocks, send, "block long, part int, names binary, twice binary, often binary")
    return sent.groupBy("part").applyInArrow(meet, "block long, part int, said binary")


def messages(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The messages of a block as one batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row holds a block."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def bits(names: np.ndarray, parts: int, answers: list[dict] | None) -> np.ndarray:
    """The answers to the sorted names of a block, as two rows: not alone, and hot."""
    out, at = np.zeros((2, len(names)), bool), cut(names, parts)
    for a in answers or []:
        lo, hi = at[a["part"]], at[a["part"] + 1]
        out[:, lo:hi] = np.unpackbits(np.frombuffer(a["said"], np.uint8).reshape(2, -1), axis=1, count=hi - lo)
    return out


