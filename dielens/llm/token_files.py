"""Token ids in bit-plane files.

A file is a Parquet table of chunks.  A chunk holds whole documents in ascending id order: their ids, their lengths,
and their tokens in blocks of a fixed number of ids.  A block is transposed into planes (one for each bit, or each
byte, of an id) and every plane is compressed with zstandard on its own.  ``plane_bytes`` is the chunk's index of
planes; the table ``index`` beside it has the place of every chunk in the whole stream of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dielens.llm.bpe_automaton import folded, spaced_words
from dielens.llm.text import WordStore, batch, map_arrow, slices, texts_of, vocabulary

CHUNK_SCHEMA = (
    "bucket int, seq int, first_doc long, last_doc long, n_docs int, n_ids long, width int, by_bit boolean, "
    "block_ids int, docs binary, counts binary, plane_bytes array<int>, planes binary"
)


def to_planes(ids: np.ndarray, width: int, by_bit: bool) -> list[bytes]:
    """Planes of one block: plane k holds bit (or byte) k of every id."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if not by_bit:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int, by_bit: bool) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if by_bit:
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view(f"<u{width}").reshape(n).astype(np.uint32)


@lru_cache(2)
def _library(path: str) -> WordStore:
    """The tokenizers library, asked once for each different word.

    Its pattern drops white space and its normaliser does not act across it, so the ids of a text are those of its
    words one after another.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], []
        for lo in range(0, len(words), 20_000):
            found = [e.ids for e in tokenizer.encode_batch_fast(words[lo : lo + 20_000], add_special_tokens=False)]
            count += map(len, found)
            flat.append(np.fromiter((i for ids in found for i in ids), np.int32))
        return np.concatenate(flat), np.array(count, np.int64)

    return WordStore(spaced_words, encode, np.int32)


def encoded(docs: DataFrame, bounds: list[int], vocab: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(bucket, doc_id, ids) with the ids and an end id as little-endian integers of ``width`` bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _library(vocab)
        for part in (part for b in batches for part in slices(b)):
            flat, count = store.texts(folded(part.column("text")))
            ends = np.cumsum(count)
            flat = np.insert(flat, ends, end_id).astype(f"<u{width}")
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32) * width
            ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            doc = part.column("doc_id")
            key = doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            yield batch(schema, np.searchsorted(cuts, key, side="right").astype(np.int32), doc, ids)

    return map_arrow(texts_of(docs, id_col, text_col), run, "bucket int, doc_id long, ids binary")


def write_tokens(
    docs: DataFrame,
    path: str,
    vocab: str = "word_bpe_49k.json",
    end_id: int = 2,
    block_ids: int = 32_768,
    chunk_ids: int = 1_000_000,
    by_bit: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the files below ``path``, in ascending order of the id.

    Null and empty texts give the end id alone; rows of equal id stay together in any order; a null id comes first.
    An empty table gives empty files.  The cuts between the buckets are quantiles of the ids; a chunk is closed when
    it holds ``chunk_ids`` ids, and never splits a document.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).dropna()
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    width = 2
    from tokenizers import Tokenizer

    if max(Tokenizer.from_file(vocabulary(vocab)).get_vocab(with_added_tokens=True).values(), default=0) > 65_535 or end_id > 65_535:
        width = 4
    fields = ["bucket", "seq", "first_doc", "last_doc", "n_docs", "n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        held: list[tuple[int | None, bytes]] = []
        size, bucket, seq = 0, None, 0

        def chunk() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(x for _, x in held), f"<u{width}")
            planes, sizes = [], []
            for at in range(0, len(flat), block_ids):
                for plane in to_planes(flat[at : at + block_ids], width, by_bit):
                    planes.append(press.compress(plane))
                    sizes.append(len(planes[-1]))
            known = np.array([-(2**63) if d is None else d for d, _ in held], "<i8")
            row = {
                "bucket": bucket, "seq": seq, "first_doc": held[0][0], "last_doc": held[-1][0], "n_docs": len(held),
                "n_ids": len(flat), "width": width, "by_bit": by_bit, "block_ids": block_ids,
                "docs": press.compress(np.diff(known, prepend=0).tobytes()),
                "counts": press.compress(np.array([len(x) // width for _, x in held], "<u4").tobytes()),
                "plane_bytes": sizes, "planes": b"".join(planes),
            }
            return pa.RecordBatch.from_pylist([row], schema=out)

        for b in batches:
            for own, doc, ids_ in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if held and (own != bucket or size >= chunk_ids * width):
                    yield chunk()
                    held.clear()
                    seq, size = seq + 1 if own == bucket else 0, 0
                bucket = own
                held.append((doc, ids_))
                size += len(ids_)
        if held:
            yield chunk()

    out = pa.schema(
        [("bucket", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
         ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("by_bit", pa.bool_()),
         ("block_ids", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()),
         ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())]
    )
    ordered = (
        encoded(docs, bounds, vocab, end_id, width, id_col, text_col)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "doc_id")
    )
    map_arrow(ordered, run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").select(*fields)
    # one row for each bucket at most: their number is a setting, not a property of the data
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    buckets = chunks.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", before.alias("base"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    (
        chunks.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(buckets, "bucket")
        .select(*fields, (F.col("base") + F.col("within")).alias("start"))
        .write.parquet(f"{path}/index")
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ids are little-endian 32-bit integers."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    schema = pa.schema(
        [("bucket", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()),
         ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                width, planes = row["width"], row["width"] * (8 if row["by_bit"] else 1)
                at, parts, left = 0, [], row["n_ids"]
                for k in range(0, len(row["plane_bytes"]), planes):
                    block = []
                    for size in row["plane_bytes"][k : k + planes]:
                        block.append(unpress.decompress(row["planes"][at : at + size]))
                        at += size
                    n = min(left, row["block_ids"])
                    parts.append(from_planes(block, n, width, row["by_bit"]))
                    left -= n
                flat = np.concatenate(parts).astype("<u4")
                docs = np.cumsum(np.frombuffer(unpress.decompress(row["docs"]), "<i8"))
                count = np.frombuffer(unpress.decompress(row["counts"]), "<u4").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(count)])
                ids = pa.Array.from_buffers(
                    pa.binary(), len(docs), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(flat)]
                )
                whole = pa.array(docs, mask=docs == -(2**63))
                same = lambda x, n=len(docs): np.full(n, x, np.int32)
                yield batch(schema, same(row["bucket"]), same(row["seq"]), whole, ends[:-1], count, ids)

    found = map_arrow(chunks, run, "bucket int, seq int, doc_id long, offset long, n_tokens long, ids binary")
    index = spark.read.parquet(f"{path}/index").select("bucket", "seq", "start")
    return found.join(index, ["bucket", "seq"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )
