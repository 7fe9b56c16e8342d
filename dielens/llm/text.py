"""Helpers the text operators share: running Arrow functions, word codes and ragged arrays."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.llm.words import Texts

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def vocabulary(path: str) -> str:
    """A vocabulary file: a path as it stands, or the name of a public one."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def on_workers(df: DataFrame) -> DataFrame:
    """Let the Python workers of this session import this package from the driver's path."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
        # large arrays go back to the system when a worker frees them
        env["MALLOC_MMAP_THRESHOLD_"] = env["MALLOC_TRIM_THRESHOLD_"] = str(8 << 20)
    return df


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(given_back(batches))
        give_back()

    return on_workers(df).mapInArrow(run, schema)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one of them needed goes back to the system before the next is read."""
    for b in batches:
        yield b
        del b
        give_back()


def give_back() -> None:
    """Let the allocators return their free memory: a worker lives on between tasks and beside other workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so that other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


class Ragged:
    """Rows of different length in one flat array; rows are appended, and taken by number."""

    def __init__(self, dtype):
        self.flat, self.count = np.zeros(0, dtype), np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
        self.count = np.concatenate([self.count, count])
        self.start = np.cumsum(self.count) - self.count

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The named rows one after another, and the length of each."""
        count = self.count[rows]
        return self.flat[spread(self.start[rows], count)], count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... (count of them) of every row, one row after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - count), count) + np.arange(total)


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of each row of a ragged array; an empty row gives 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


class WordStore:
    """Encodes every different word of a task once and puts whole texts together from the results.

    ``cut`` gives the start and end of every word and the number of words of each text; ``encode`` maps a list of words
    to (flat ids, length of each).  ``limit`` bounds memory only: after a restart a word is encoded again.
    """

    def __init__(self, cut: Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]], encode, dtype, limit: int = 500_000):
        self.cut, self.encode, self.dtype, self.limit = cut, encode, dtype, limit
        self._restart()

    def _restart(self) -> None:
        self.known, self.at, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), Ragged(self.dtype)

    def texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each text."""
        start, end, n_words = self.cut(texts)
        rows = self._rows(texts, start, end)  # may start ``self.rows`` anew
        flat, count = self.rows.take(rows)
        return flat, sums(count, n_words)

    def _rows(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.known) > self.limit:
            self._restart()
        names = texts.names(start, end)
        order = np.argsort(names)
        edge = np.ones(len(names), bool)
        edge[1:] = names[order[1:]] != names[order[:-1]]
        group = np.empty(len(names), np.int64)
        group[order] = np.cumsum(edge) - 1
        first = order[edge]
        own = names[first]
        at = np.searchsorted(self.known, own)
        new = np.ones(len(own), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != own[inside]
        row = np.zeros(len(own), np.int64)
        row[~new] = self.at[at[~new]]
        if new.any():
            raw, places = texts.raw, first[new]
            words = [raw[a:b].decode("utf-8") for a, b in zip(start[places].tolist(), end[places].tolist(), strict=True)]
            row[new] = np.arange(len(words)) + len(self.rows.count)
            self.rows.append(*self.encode(words))
            self.known = np.insert(self.known, at[new], own[new])
            self.at = np.insert(self.at, at[new], row[new])
        return row[group]


def slices(b: pa.RecordBatch, column: str = "text", size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about so many bytes of text, one row at least: bounds what a task holds as Python objects."""
    ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    begin = done = 0
    while begin < b.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield b.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])
