"""Token counts by rank-synchronous merging of arrays.

All different pre-tokens of a batch are held as ragged arrays of symbols, in segments of equal length.  In every step
each pre-token that has a pair of the table merges its pair of the lowest rank (the leftmost of several), all of
them at once; a pre-token without a pair has survived, and its symbols are its tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.llm.text import WordStore, batch, map_arrow, slices, spread, texts_of, vocabulary
from dielens.llm.words import Texts

#: Fixed value: longer pre-tokens are merged one by one with a heap, in n log n steps.
LONG = 64
NONE = np.iinfo(np.int32).max


def marked(texts: pa.Array) -> Texts:
    """The texts with a space for U+2581 and one more in front of each that is not empty."""
    return Texts(texts, before=b" ", change=("▁".encode(), b" "))


def pre_tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run of spaces with the word after it, a line end, or the word after a line end."""
    b = texts.bytes
    space, line = b == 32, b == 10
    begins = line.copy()
    begins[1:] |= (space[1:] & ~space[:-1]) | (~space[1:] & line[:-1])
    begins[:1] = True
    begins[texts.end] = False  # the line end behind a text is not its own
    start = np.flatnonzero(begins)
    stops = begins.copy()
    stops[texts.end] = True
    stop = np.flatnonzero(stops)
    end = stop[np.searchsorted(stop, start, side="right")]
    return start, end, texts.per_text(start)


class PieceBpe:
    """The BPE of a sentencepiece model with byte fallback.

    A space is the symbol U+2581, which only leads a piece or stands in a run, so a text falls into pre-tokens: a run
    of spaces with the word after it, a line end (it is in no piece), or the word after a line end.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        n = model.get_piece_size()
        pieces = {
            model.id_to_piece(i): i
            for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        self.first_byte = model.piece_to_id("<0x00>")
        self.n_bytes = 256
        self.char = {ord(p): i for p, i in pieces.items() if len(p) == 1}
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[model.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.pair_id = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        chars = sorted(self.char)
        self.chars = np.array(chars, np.int64)
        self.char_id = np.array([self.char[c] for c in chars], np.int32)
        self.store = WordStore(pre_tokens, self.merge, np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key
        return np.where(found, self.pair_rank[at], NONE), np.where(found, self.pair_id[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and the number of ids of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).replace(" ", "▁").encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.searchsorted(self.chars, points)
        at[at == len(self.chars)] = 0
        ids = np.where(self.chars[at] == points, self.char_id[at], -1 - points.astype(np.int64)).astype(np.int32)
        begin = np.cumsum(size) - size
        left = np.zeros(len(words), np.int64)
        parts, places = [], []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > LONG:
                for r in rows.tolist():
                    own = np.array(self._long(ids[begin[r] : begin[r] + n].tolist()), np.int32)
                    left[r] = len(own)
                    parts.append(own)
                    places.append(np.array([r]))
            elif n:
                for rows_, symbols in self._equal(rows, ids[begin[rows][:, None] + np.arange(n)]):
                    left[rows_] = symbols.shape[1]
                    parts.append(symbols.ravel())
                    places.append(rows_)
        flat = np.zeros(int(left.sum()), np.int32)
        start = np.cumsum(left) - left
        for own, rows in zip(parts, places, strict=True):
            flat[spread(start[rows], left[rows])] = own
        return self._bytes(flat, left)

    def _equal(self, rows: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One segment: every round shortens each pre-token that still has a pair by one symbol."""
        rank, new = self.ranks(symbols[:, :-1], symbols[:, 1:])
        while True:
            n = symbols.shape[1]
            if n == 1:
                yield rows, symbols
                return
            at = np.argmin(rank, axis=1)
            line = np.arange(len(rows))
            live = rank[line, at] < NONE
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, rank, new, at = rows[live], symbols[live], rank[live], new[live], at[live]
                line = np.arange(len(rows))
            if not len(rows):
                return
            symbols[line, at] = new[line, at]
            keep = np.ones(symbols.shape, bool)
            keep[line, at + 1] = False
            symbols = symbols[keep].reshape(len(rows), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank, new = rank[keep].reshape(len(rows), n - 2), new[keep].reshape(len(rows), n - 2)
            for side in (at - 1, at):
                own = np.flatnonzero((side >= 0) & (side < n - 2))
                col = side[own]
                rank[own, col], new[own, col] = self.ranks(symbols[own, col], symbols[own, col + 1])

    def _long(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.pairs.get(symbols[i] << 20 | symbols[j])) and min(symbols[i], symbols[j]) >= 0:
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j] = made, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def _bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A character outside the vocabulary becomes the tokens of its UTF-8 bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, count
        spelled = [chr(-1 - s).encode("utf-8", "replace") for s in flat[odd].tolist()]
        more = np.ones(len(flat), np.int64)
        more[odd] = list(map(len, spelled))
        out = np.repeat(flat, more)
        begin = np.cumsum(more) - more
        raw = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + self.first_byte
        out[spread(begin[odd], more[odd])] = raw
        owner = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(owner, more, len(count)).astype(np.int64)


@lru_cache(2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def count_tokens(
    docs: DataFrame,
    vocab: str = "piece_bpe_32k.model",
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per row of ``docs``.

    Null and empty texts have no bytes and no tokens; repeated rows give repeated rows; a null id stays null.
    ``over_limit`` is true above ``limit`` tokens.  Special strings in a text are ordinary text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(vocab)
        for part in (part for b in batches for part in slices(b)):
            _, count = bpe.store.texts(marked(part.column("text")))
            yield batch(schema, part.column("doc_id"), part.column("n_bytes"), count)

    source = texts_of(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    found = map_arrow(source, run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
