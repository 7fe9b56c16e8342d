"""Removal of repeated word windows by recompression.

Runs of one token are named first.  Then, round by round, every symbol falls into one of two classes by its name, and
a symbol of the first class followed by one of the second becomes one symbol named by the two.  Names depend on the
content alone, so all tasks give them alike, and so do the decisions: every symbol knows the words that its making has
looked at.  Wherever those words recur, the symbol recurs.

A window is represented by a symbol made from words inside it, of the highest round that has one.  Spark counts the
names over all documents; a window whose symbol occurs once cannot repeat.  Windows that share a symbol occurrence
travel together, once for each different content of a block, with a 128-bit name for each; in the task of their
symbol the names are compared, and the first place of each is found.  The windows of a hot symbol, such as the border
of a passage that very many documents share, travel one by one and are spread by their whole content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dielens.llm import blocks as B
from dielens.llm.suffix_dedup import sliding_least
from dielens.llm.text import map_arrow, spread
from dielens.llm.words import Texts, byte_class, covered, mixed, run_names, window_names, window_starts

U = np.uint64
INSIDE = byte_class(r"[^\x20\x09-\x0D]")
NONE = U(2**64 - 1)
#: Bits of a key for the place of a symbol among the words of a block.
PLACE = 26


class Symbols:
    """The symbols of one round: name, first word, and the words [low, high) that its making has looked at."""

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.low, self.high = name, low, high

    @staticmethod
    def runs(words: np.ndarray, ends: np.ndarray) -> Symbols:
        """Runs of one word; ``ends`` tells which entries stand between two texts."""
        n = len(words)
        edge = np.ones(n, bool)
        edge[1:] = (words[1:] != words[:-1]) | ends[1:] | ends[:-1]
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, n))
        name = words[first].copy()
        name[length > 1] = mixed(name[length > 1] + length[length > 1].astype(U) * U(0xA0761D6478BD642F))
        # a run ends where another word stands, so its making has looked one word to each side
        return Symbols(name, first - 1, first + length + 1)

    def paired(self, turn: int) -> Symbols:
        name, low, high = self.name, self.low.copy(), self.high.copy()
        n = len(name)
        first = (mixed(name + U(turn * 7919)) >> U(17) & U(1)).astype(bool)
        joins = np.zeros(n, bool)
        joins[:-1] = first[:-1] & ~first[1:]
        joined = np.zeros(n, bool)
        joined[1:] = joins[:-1]
        # a symbol of the first class has looked at the one behind it, one of the second at the one before
        for rows, side in ((np.flatnonzero(first[:-1]), 1), (np.flatnonzero(~first[1:] & ~joined[1:]) + 1, -1)):
            low[rows] = np.minimum(self.low[rows], self.low[rows + side])
            high[rows] = np.maximum(self.high[rows], self.high[rows + side])
        made = name.copy()
        at = np.flatnonzero(joins)
        made[at] = mixed(name[at] * U(3) + mixed(name[at + 1]))
        return Symbols(made[~joined], low[~joined], high[~joined])


class Windows:
    """The windows of a block in runs that have the same symbol: first word, number of windows, symbol name, document."""

    def __init__(self, block: B.Block, window: int, reach: tuple[tuple[int, int], ...]):
        self.block, self.window = block, window
        texts = Texts.of(block.raw, block.start, block.end)
        begin, end = texts.runs(INSIDE)
        self.names, self.n_words = texts.names(begin, end), texts.per_text(begin)
        n, owner = len(self.names), np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.owner, self.first = owner, np.cumsum(self.n_words) - self.n_words
        # words with one entry behind each text, so that no symbol with words of two texts lies in a window
        place = np.arange(n) + owner
        size = n + len(self.n_words)
        if size >= 1 << PLACE:
            raise ValueError("a block has too many words")
        words, ends = np.full(size, U(1)), np.ones(size, bool)
        words[place], ends[place] = self.names, False
        rounds = [Symbols(words, np.arange(size), np.arange(1, size + 1))]
        if size:
            rounds.append(Symbols.runs(words, ends))
        for turn in range(1, max(r for r, _ in reach) + 1):
            rounds.append(rounds[-1].paired(turn))
        starts = place[window_starts(self.n_words, window)] if n else place
        best, name = np.full(size, NONE), np.zeros((len(reach), size), U)
        for level, (turn, longest) in enumerate(reach):
            s = rounds[turn + 1] if turn >= 0 else rounds[0]
            fit = np.flatnonzero((s.high - s.low <= longest) & (s.low >= 0))
            value = (U(level) << U(61)) | (mixed(s.name[fit]) >> U(PLACE + 3) << U(PLACE)) | s.low[fit].astype(U)
            at = s.low[fit]
            least = np.full(size + window, NONE)
            np.minimum.at(least, at, value)
            won = np.flatnonzero(value == least[at])[::-1]  # of equal values the first is written last
            name[level][at[won]] = mixed(s.name[fit][won] + U(level))
            best = np.minimum(best, sliding_least(least, window - longest + 1)[:size])
        key = best[starts]
        edge = np.ones(len(key), bool)
        edge[1:] = (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(edge)
        self.count = np.diff(np.append(head, len(key)))
        own = key[head]
        self.symbol = name[(own >> U(61)).astype(np.int64), (own & U((1 << PLACE) - 1)).astype(np.int64)]
        self.start = np.flatnonzero(window_starts(self.n_words, window))[head] if n else head
        self.doc = block.docs[owner[self.start]] if n else head
        self.at = self.start - self.first[owner[self.start]] if n else head

    def different_symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted different symbols, which are not alone in the block, and how often each occurs."""
        symbol, count = np.unique(self.symbol, return_counts=True)
        return symbol, count > 1, count

    def keep_shared(self, parts: int, answers: list[dict] | None) -> None:
        """Only windows whose symbol occurs elsewhere too; those of a hot symbol one by one."""
        symbols = np.unique(self.symbol)
        shared, hot = B.bits(symbols, parts, answers)[:, np.searchsorted(symbols, self.symbol)]
        whole, single = np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)
        count = self.count[single]
        start = spread(self.start[single], count)
        at = spread(self.at[single], count)
        self.start, self.at = np.concatenate([self.start[whole], start]), np.concatenate([self.at[whole], at])
        self.doc = np.concatenate([self.doc[whole], np.repeat(self.doc[single], count)])
        self.count = np.concatenate([self.count[whole], np.ones(len(start), np.int64)])
        self.symbol = np.concatenate([self.symbol[whole], self.contents()[len(whole) :]])

    def contents(self) -> np.ndarray:
        """The name of all words of each run of windows."""
        return run_names(self.names, self.start, self.count - 1 + self.window)

    def firsts(self, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each different content the run that comes first; and the group of every run."""
        order = np.lexsort((self.at, self.doc, contents))
        edge = np.ones(len(order), bool)
        edge[1:] = contents[order[1:]] != contents[order[:-1]]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(edge) - 1
        return order[edge], group


MESSAGE = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("contents", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()),
     ("counts", pa.binary()), ("names", pa.binary())]
)
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("said", pa.binary())])


def _windows_to_parts(rows: Iterator[dict], window: int, reach, parts: int) -> Iterator[pa.RecordBatch]:
    for row in rows:
        own = Windows(B.Block.of(row), window, reach)
        own.keep_shared(parts, row["shared"])
        contents = own.contents()
        first, _ = own.firsts(contents)
        first = first[np.argsort(own.symbol[first], kind="stable")]
        cut = B.cut(own.symbol[first], parts)
        names = np.stack([window_names(own.names, window), window_names(mixed(own.names + U(1)), window)], axis=1)
        sent = []
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            some = first[cut[p] : cut[p + 1]]
            sent.append((own.block.number, p, contents[some].tobytes(), own.doc[some].tobytes(), own.at[some].tobytes(),
                         own.count[some].astype(np.uint8).tobytes(), names[spread(own.start[some], own.count[some])].tobytes()))
        if sent:
            yield B.messages(sent, MESSAGE)


def _meet(table: pa.Table) -> pa.Table:
    """For each run of each block: which of its windows also start earlier."""
    column = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    size = np.array([len(x) // 8 for x in table.column("contents").to_pylist()])
    contents, doc, at = column("contents", U), column("docs", "<i8"), column("at", "<i8")
    count = column("counts", np.uint8).astype(np.int64)
    names = column("names", U).reshape(-1, 2)
    bit = np.arange(len(names)) - np.repeat(np.cumsum(count) - count, count)
    docs, places = np.repeat(doc, count), np.repeat(at, count) + bit
    order = np.lexsort((places, docs, names[:, 1], names[:, 0]))
    edge = np.ones(len(order), bool)
    edge[1:] = (names[order[1:]] != names[order[:-1]]).any(axis=1)
    head = order[edge][np.cumsum(edge) - 1]
    flag = np.zeros(len(names), bool)
    flag[order] = (docs[head] < docs[order]) | ((docs[head] == docs[order]) & (places[head] < places[order]))
    mask = np.zeros(len(contents), U)
    np.bitwise_or.at(mask, np.repeat(np.arange(len(contents)), count)[flag], U(1) << bit[flag].astype(U))
    said, begin = [], 0
    for n in size.tolist():
        own = np.flatnonzero(mask[begin : begin + n]) + begin
        said.append(contents[own].tobytes() + mask[own].tobytes())
        begin += n
    return pa.table([table.column("block"), table.column("part"), pa.array(said, pa.binary())], schema=REPLY)


def _removed(rows: Iterator[dict], window: int, reach, parts: int) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", spans), ("kept", pa.string())])
    for row in rows:
        own = Windows(B.Block.of(row), window, reach)
        own.keep_shared(parts, row["shared"])
        block, contents = own.block, own.contents()
        first, group = own.firsts(contents)
        head = first[group]
        later = (own.doc > own.doc[head]) | ((own.doc == own.doc[head]) & (own.at > own.at[head]))
        said = [np.frombuffer(a["said"], U).reshape(2, -1) for a in row["answers"] or []]
        known = np.concatenate(said, axis=1) if said else np.zeros((2, 0), U)
        known = known[:, np.argsort(known[0], kind="stable")]
        mask = np.zeros(len(contents), U)
        if known.shape[1]:
            at = np.minimum(np.searchsorted(known[0], contents), known.shape[1] - 1)
            mask = np.where(known[0][at] == contents, known[1][at], U(0))
        mask[later] = NONE
        hits = [own.start[(own.count > k) & (mask >> U(k) & U(1) == 1)] + k for k in range(int(own.count.max(initial=0)))]
        gone = covered(np.concatenate(hits) if hits else np.zeros(0, np.int64), window, len(own.names))
        found, kept = [], []
        for k, (a, n) in enumerate(zip(own.first.tolist(), own.n_words.tolist(), strict=True)):
            words = block.raw[block.start[k] : block.end[k]].split()
            lost = gone[a : a + n]
            runs = []
            if lost.any():
                step = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).view(np.int8)))
                runs = [{"start": x, "end": y} for x, y in step.reshape(-1, 2).tolist()]
                words = [w for w, g in zip(words, lost.tolist(), strict=True) if not g]
            found.append(runs)
            kept.append(b" ".join(words).decode("utf-8"))
        docs = pa.array(block.docs, mask=block.docs == B.LAST)
        for k in range(0, len(docs), 1000):
            part = slice(k, k + 1000)
            yield pa.RecordBatch.from_arrays(
                [docs[part], pa.array(own.n_words[part]), pa.array(found[part], spans), pa.array(kept[part])], schema=out
            )


def dedup(
    docs: DataFrame,
    window: int = 20,
    reach: tuple[tuple[int, int], ...] = ((4, 12), (3, 9), (2, 6), (-1, 1)),
    hot: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every whole text, one row per row of ``docs``.

    Removed is each word inside a window of ``window`` words that also starts earlier: in a document with a smaller id, or
    at an earlier word of the same one; windows are judged on the input.  ``spans`` are the removed runs of words, ``kept``
    the other words joined by one space.  Null and empty texts have no words; rows of one id count as one document, in
    which equal windows at the same word do not remove each other; null ids come after every other one.

    ``reach`` lists rounds and the most words their symbols may have looked at, best first; (-1, 1), the words
    themselves, stands for every window.  No entry may leave more than 64 windows for a symbol.  A symbol that occurs more
    than ``hot`` times is hot.
    """
    if window - min(longest for _, longest in reach) > 63 or reach[-1] != (-1, 1) or max(x for _, x in reach) > window:
        raise ValueError("reach must end with (-1, 1) and fit the window")
    table, plan = B.store(docs, id_col, text_col)
    parts = plan.parts
    symbols = B.shared_names(table, plan, hot, lambda block, _: Windows(block, window, reach).different_symbols())
    known = table.join(B.listed(symbols, "shared"), "block", "left")
    sent = map_arrow(
        known,
        lambda batches: _windows_to_parts(B.rows_of(batches), window, reach, parts),
        "block long, part int, contents binary, docs binary, at binary, counts binary, names binary",
    )
    met = sent.groupBy("part").applyInArrow(_meet, "block long, part int, said binary")
    return map_arrow(
        B.answered(known, met),
        lambda batches: _removed(B.rows_of(batches), window, reach, parts),
        "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string",
    )
