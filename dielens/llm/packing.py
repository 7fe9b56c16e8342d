"""Packing by concatenate and cut.

All token ids stand in one stream: the documents of a partition one after another, the partitions one after another.
The first pass encodes every text once and writes the ids with their place in the partition; the totals of the
partitions, summed up, give each partition its global offset, and so each document its place in the stream without an
exchange of ids.  The second pass cuts the stream at multiples of the window: a document gives one boundary record for
each window it lies in.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.shuffles import join_sized, settled
from dielens.llm.text import WordStore, batch, map_arrow, slices, texts_of, vocabulary
from dielens.llm.words import Texts

#: Kinds of bytes: beyond ASCII, letter, digit, other, white space, apostrophe.
_KIND = np.full(256, 3, np.uint8)
_KIND[128:] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"\t\n\x0b\x0c\r ")] = 4
_KIND[ord("'")] = 5
#: Between which kinds (before, after) a match of the byte-level pattern always ends.
_ENDS = np.zeros((6, 6), bool)
_ENDS[:, 4] = [True, True, True, True, False, True]
_ENDS[1, [2, 3, 5]] = _ENDS[2, [1, 3, 5]] = _ENDS[3, [1, 2]] = True
#: White space beyond ASCII as UTF-8, by the last byte and the bytes before it.
_WIDE = [(c.encode()[-1], c.encode()[:-1]) for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def chunks(t: Texts, whole: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk, and the number of chunks of each text.

    Chunks end only where every match of the byte-level pattern ends whatever stands around: before white space that
    follows something else, and between letters, digits and other signs of ASCII (an apostrophe may belong to the
    letters after it).  The strings ``whole`` are not cut.  So chunks are encoded one by one as in the whole text.
    """
    b = t.bytes
    kind = _KIND[b]
    ends = np.zeros(len(b), bool)
    ends[1:] = _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    ends[t.end] = False  # the line end between two texts
    at = np.flatnonzero(ends & (kind == 4))
    at = at[kind[at - 1] == 0]
    for last, before in _WIDE:
        hit = b[at - 1] == last
        for k, x in enumerate(reversed(before)):
            hit &= (at >= k + 2) & (b[at - 2 - k] == x)
        ends[at[hit]] = False
    for string in whole:
        place = t.raw.find(string)
        while place >= 0:
            ends[place + 1 : place + len(string)] = False
            place = t.raw.find(string, place + 1)
    ends[t.start[t.size > 0]] = True
    start = np.flatnonzero(ends)
    n = t.per_text(start)
    end = np.append(start[1:], 0)
    end[np.cumsum(n)[n > 0] - 1] = t.end[n > 0]
    return start, end, n


@lru_cache(2)
def _library(path: str) -> WordStore:
    """The tokenizers library, asked once for each different chunk; other than byte-level vocabularies get whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    made = json.loads(tokenizer.to_str())
    level = made["pre_tokenizer"] or {}
    known = tokenizer.get_added_tokens_decoder().values()
    plain = (
        level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and made["normalizer"] is None
        and not any(x.lstrip or x.rstrip or x.single_word for x in known)
    )
    added = tuple(x.content.encode() for x in known)

    def cut(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return chunks(t, added) if plain else (t.start, t.end, np.ones(len(t.size), np.int64))

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], []
        for lo in range(0, len(words), 20_000):
            found = [e.ids for e in tokenizer.encode_batch_fast(words[lo : lo + 20_000], add_special_tokens=False)]
            count += map(len, found)
            flat.append(np.fromiter((i for ids in found for i in ids), np.int32))
        return np.concatenate(flat), np.array(count, np.int64)

    return WordStore(cut, encode, np.int32, limit=2_000_000)


def tokens(docs: DataFrame, vocab: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, place, doc_id, doc_tokens, ids): the ids with the end id, and how many ids of the partition stand before."""
    schema = pa.schema(
        [("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, place = _library(vocab), TaskContext.get().partitionId(), 0
        for b in (x for rows in batches for x in slices(rows)):
            flat, count = store.texts(Texts(b.column("text")))
            ends = np.cumsum(count)
            flat = np.insert(flat, ends, end_id).astype("<u4")
            stop = ends + np.arange(1, len(ends) + 1)
            offsets = np.concatenate([[0], stop]).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield batch(schema, np.full(len(ends), part), place + stop - count - 1, b.column("doc_id"), count + 1, ids)
            place += len(flat)

    ddl = "part long, place long, doc_id long, doc_tokens long, ids binary"
    return map_arrow(texts_of(docs, id_col, text_col), run, ddl)


def pack(
    docs: DataFrame,
    window: int = 1024,
    vocab: str = "byte_bpe_50k.json",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, four bytes each).

    A piece is the part of a document (its ids and the end id) that lies in one window of the stream.  Every sequence
    but the last is full.  Null and empty texts give the end id alone; repeated rows and null ids are documents of
    their own; an empty table gives no pieces.  The order of the stream is that of the input's partitions.
    """
    made = settled(tokens(docs, vocab, end_id, id_col, text_col), "packing-tokens")
    totals = made.groupBy("part").agg(F.sum("doc_tokens").alias("total"))  # one row for each partition of the input
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = join_sized(made, bases, ["part"], "inner", null_safe=False).withColumn("at", F.col("base") + F.col("place"))
    at, n, size = F.col("at"), F.col("doc_tokens"), F.lit(window).cast("long")

    def piece(w):
        first = F.greatest(w * size, at)
        length = F.least((w + 1) * size, at + n) - first
        begin = first - at
        return F.struct(
            begin.alias("start"), length.alias("length"), w.alias("sequence_id"), (first - w * size).alias("offset"),
            F.substring("ids", (4 * begin + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        )

    numbers = F.sequence(F.floor(at / size).cast("long"), F.floor((at + n - 1) / size).cast("long"))
    cut = placed.select("doc_id", "doc_tokens", F.explode(F.transform(numbers, piece)).alias("piece"))
    return cut.select("doc_id", "piece.start", "piece.length", "doc_tokens", "piece.sequence_id", "piece.offset", "piece.ids")


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, padded, boundaries, ids): the pieces of each sequence put together.

    ``boundaries`` has doc_id, start and offset of each piece in order.  A sequence that is not full is padded to
    ``window`` ids, unless its length is a power of two.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"),
        F.sum("length").alias("n_tokens"),
    )
    n = F.col("n_tokens")
    padded = F.when(F.bit_count(n) == 1, n).otherwise(F.lit(window).cast("long"))
    pad = F.lit(int(pad_id).to_bytes(4, "little").hex())
    whole = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    filled = F.unhex(F.concat(whole, F.repeat(pad, (padded - n).cast("int"))))
    bounds = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset")))
    return joined.select("sequence_id", "n_tokens", padded.alias("padded"), bounds.alias("boundaries"), filled.alias("ids"))
