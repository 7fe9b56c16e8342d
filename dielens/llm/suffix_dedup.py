"""Exact substring dedup by a depth-limited radix sort of suffixes.

Only repeats of a threshold length matter, so suffixes are ordered through that many bytes and no further.  The first
pass looks at one wide digit: of the grams inside a window the one with the least hash stands for it, and a window
whose gram is in one document only cannot repeat.  The second pass looks at a wider one, the gram with half of what a
window has beside it.  Windows left that share their gram travel as one string, once for each different string of a
block.  The strings of a part of the gram space meet in one task, where their suffixes are
sorted by passes of eight bytes, the most significant first; suffixes alone in their group drop out, and groups that
are left after the last pass are exactly the repeated windows.  The strings of a hot gram, such as one in
a passage that very many documents share, are spread by that wider gram, and where it has too many different strings
itself, as at the border of such a passage, window by window by their whole content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from dielens.llm import blocks as B
from dielens.llm.text import map_arrow, spread
from dielens.llm.words import Texts, mixed

U = np.uint64
#: Grams of one pass over a block: their places fit into the low bits of a key.
STRETCH = 1 << 19
LOW = U(STRETCH - 1)


def at_bytes(raw: bytes | np.ndarray, n: int) -> np.ndarray:
    """The little-endian 64-bit number at each of n places; ``raw`` must be 8 bytes longer than the last."""
    return np.ndarray((n,), "<u8", buffer=raw, strides=(1,))


def gram_names(raw: bytes, gram: int, n: int) -> np.ndarray:
    """The name of the gram at each of n places."""
    out = np.zeros(n, U)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        out = (out ^ at_bytes(raw[k:] if k else raw, n)) * U(0x9FB21C651E98DF25)
        out ^= out >> U(29)
    return mixed(out)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def different(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted different names, which are in more than one document, and how often each occurs."""
    order = np.lexsort((docs, names))
    name, doc = names[order], docs[order]
    edge = np.ones(len(name), bool)
    edge[1:] = name[1:] != name[:-1]
    twice = np.zeros(len(name), bool)
    twice[1:] = ~edge[1:] & (doc[1:] != doc[:-1])
    groups = np.cumsum(edge) - 1
    n = int(edge.sum())
    return name[edge], np.bincount(groups, twice, n) > 0, np.bincount(groups, minlength=n)


class Strings:
    """The windows of a block in runs that have the same gram: start, number of windows, gram name, document."""

    def __init__(self, block: B.Block, window: int, gram: int):
        raw, n = block.raw + bytes(16), len(block.raw)
        self.block, self.window, self.gram_bytes = block, window, gram
        width = window - gram + 1
        longer = np.flatnonzero(block.end - block.start >= window)
        edge = np.zeros(n + 1, np.int8)
        edge[block.start[longer]] += 1
        edge[block.end[longer] - window + 1] -= 1
        inside = np.cumsum(edge, dtype=np.int8)[:n] > 0
        starts, counts, grams, places = [], [], [], []
        # a run that goes over the end of a stretch becomes two
        for lo in range(0, max(n - window + 1, 0), STRETCH - width):
            hi = min(lo + STRETCH, n - gram + 1)
            own = gram_names(raw[lo : hi + gram + 8], gram, hi - lo)
            least = sliding_least((own & ~LOW) | np.arange(hi - lo, dtype=U), width)
            at = (least & LOW).astype(np.int64)
            at = np.where(inside[lo : lo + len(at)], at, -1)[: STRETCH - width]
            step = np.flatnonzero(np.diff(np.concatenate([[-1], at, [-1]])))
            first = step[:-1][at[step[:-1]] >= 0]
            starts.append(first + lo)
            counts.append(step[1:][at[step[:-1]] >= 0] - first)
            grams.append(own[at[first]])
            places.append(at[first] + lo)
        none = np.zeros(0, np.int64)
        self.start = np.concatenate([none, *starts])
        self.count = np.concatenate([none, *counts])
        self.gram = np.concatenate([none.astype(U), *grams])
        self.place = np.concatenate([none, *places])
        self.doc = block.docs[np.searchsorted(block.end, self.start)] if len(self.start) else none

    def different_grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted different grams, which are in more than one document of the block, and how often each occurs."""
        return different(self.gram, self.doc)

    def keep_shared(self, parts: int, answers: list[dict] | None) -> None:
        """Only runs whose gram other documents have too; ``hot`` tells which of the grams are hot."""
        grams = self.different_grams()[0]
        shared, hot = B.bits(grams, parts, answers)[:, np.searchsorted(grams, self.gram)]
        some = np.flatnonzero(shared)
        self.start, self.count, self.place, self.gram, self.doc, self.hot = (
            x[some] for x in (self.start, self.count, self.place, self.gram, self.doc, hot)
        )

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """After :meth:`keep_shared`, each run in two: run, start and number of windows of a piece, its core, its name.

        The windows of the first piece have at least half of their other bytes before the gram.  They all hold the gram and
        that half, those of the second piece the gram and the half behind it; this is the core, and equal windows have
        equal ones.
        """
        half = (self.window - self.gram_bytes + 1) // 2
        before = np.clip(self.place - half - self.start + 1, 0, self.count)
        left, right = np.flatnonzero(before > 0), np.flatnonzero(before < self.count)
        run = np.concatenate([left, right])
        start = np.concatenate([self.start[left], self.start[right] + before[right]])
        count = np.concatenate([before[left], self.count[right] - before[right]])
        begin = np.concatenate([self.place[left] - half, self.place[right], start])
        end = [self.place[left] + self.gram_bytes, self.place[right] + self.window - half + 1, start + count - 1 + self.window]
        names = Texts.of(self.block.raw, self.block.start, self.block.end).names(begin, np.concatenate(end))
        return run, start, count, names[: len(run)], names[len(run) :]

    def different_cores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted different cores, which are in more than one document of the block, and how many pieces differ."""
        run, _, _, core, name = self.pieces()
        order = np.lexsort((name, core))
        core, name, doc = core[order], name[order], self.doc[run[order]]
        if not len(core):
            return core, np.zeros(0, bool), np.zeros(0, np.int64)
        edge = np.ones(len(core), bool)
        edge[1:] = core[1:] != core[:-1]
        other = edge.copy()
        other[1:] |= name[1:] != name[:-1]
        first = np.flatnonzero(edge)
        twice = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        return core[first], twice, np.add.reduceat(other.astype(np.int64), first)

    def keep_known(self, parts: int, answers: list[dict] | None) -> None:
        """Only windows whose core other documents have too, as strings; ``gram`` says where a string goes.

        What is left of a run stays one string.  The pieces of a hot gram go by their core, and those of a hot core window
        by window.
        """
        run, start, count, core, _ = self.pieces()
        cores = np.unique(core)
        shared, hot = B.bits(cores, parts, answers)[:, np.searchsorted(cores, core)]
        apart = self.hot[run]
        whole = np.flatnonzero(shared & ~apart)
        begin, stop = np.full(len(self.start), len(self.block.raw)), np.zeros(len(self.start), np.int64)
        np.minimum.at(begin, run[whole], start[whole])
        np.maximum.at(stop, run[whole], start[whole] + count[whole])
        kept = np.flatnonzero(stop > 0)
        alone, single = np.flatnonzero(shared & apart & ~hot), np.flatnonzero(shared & apart & hot)
        windows = spread(start[single], count[single])
        text = Texts.of(self.block.raw, self.block.start, self.block.end)
        self.gram = np.concatenate([self.gram[kept], core[alone], text.names(windows, windows + self.window)])
        self.doc = np.concatenate([self.doc[kept], self.doc[run[alone]], np.repeat(self.doc[run[single]], count[single])])
        self.start = np.concatenate([begin[kept], start[alone], windows])
        self.count = np.concatenate([stop[kept] - begin[kept], count[alone], np.ones(len(windows), np.int64)])

    def named(self) -> np.ndarray:
        """The name of each whole string."""
        text = Texts.of(self.block.raw, self.block.start, self.block.end)
        return text.names(self.start, self.start + self.count - 1 + self.window)

    def firsts(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each different name: a string that has it, in its smallest document; and the group of every string."""
        order = np.lexsort((self.doc, names))
        edge = np.ones(len(order), bool)
        edge[1:] = names[order[1:]] != names[order[:-1]]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(edge) - 1
        return order[edge], group


def radix_groups(text: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """A group number for each suffix, equal where the first ``window`` bytes are; -1 where a suffix is alone.

    Each pass orders the suffixes that are still tied by their next eight bytes.
    """
    raw = np.concatenate([text, np.zeros(16, np.uint8)])
    digits = at_bytes(raw, len(text) + 8)
    rows, group = np.arange(len(places)), np.zeros(len(places), np.int64)
    for depth in [*range(0, window - 8, 8), window - 8]:
        digit = digits[places[rows] + depth].byteswap()
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        edge = np.ones(len(rows), bool)
        edge[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(edge) - 1
        tied = np.bincount(group, minlength=1)[group] > 1
        rows, group = rows[tied], group[tied]
    out = np.full(len(places), -1, np.int64)
    out[rows] = group
    return out


def _strings_to_parts(rows: Iterator[dict], window: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for row in rows:
        own = Strings(B.Block.of(row), window, gram)
        own.keep_shared(parts, row["shared"])
        own.keep_known(parts, row["known"])
        names = own.named()
        first, _ = own.firsts(names)
        first = first[np.argsort(own.gram[first], kind="stable")]
        at = B.cut(own.gram[first], parts)
        size = own.count - 1 + window
        raw = np.frombuffer(own.block.raw, np.uint8)
        sent = []
        for p in np.flatnonzero(at[1:] > at[:-1]).tolist():
            some = first[at[p] : at[p + 1]]
            text = raw[spread(own.start[some], size[some])]
            sent.append((own.block.number, p, names[some].tobytes(), own.doc[some].tobytes(),
                         own.count[some].astype(np.uint8).tobytes(), press.compress(text.tobytes())))
        if sent:
            yield B.messages(sent, MESSAGE)


MESSAGE = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())]
)
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("said", pa.binary())])


def _meet(table: pa.Table, window: int) -> pa.Table:
    """For each string of each block: which of its windows start in a document smaller than its own."""
    unpress = zstandard.ZstdDecompressor()
    column = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    names, docs, counts = column("names", U), column("docs", "<i8"), column("counts", np.uint8)
    texts = [np.frombuffer(unpress.decompress(x), np.uint8) for x in table.column("text").to_pylist()]
    size = np.array([len(x) for x in names])
    name, doc, count = np.concatenate(names), np.concatenate(docs), np.concatenate(counts).astype(np.int64)
    text = np.concatenate(texts)
    length = count - 1 + window
    begin = np.cumsum(length) - length
    order = np.lexsort((doc, name))
    edge = np.ones(len(order), bool)
    edge[1:] = name[order[1:]] != name[order[:-1]]
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(edge) - 1
    first = order[edge]  # of each different string, its smallest document
    windows = count[first]
    place = spread(begin[first], windows)
    owner = np.repeat(np.arange(len(first)), windows)
    least = doc[first][owner]
    group = radix_groups(text, place, window)
    tied = np.flatnonzero(group >= 0)
    if len(tied):
        best = np.full(int(group[tied].max()) + 1, B.LAST)
        np.minimum.at(best, group[tied], least[tied])
        least[tied] = best[group[tied]]
    ends = np.cumsum(windows)
    # back to every string of every block, one bit for each window
    rows = spread(ends[string] - windows[string], windows[string])
    flag = least[rows] < np.repeat(doc, windows[string])
    bit = (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)).astype(U)
    total = np.concatenate([[0], np.cumsum(flag)])
    some = total[np.cumsum(count)] - total[np.cumsum(count) - count] > 0
    mask = np.zeros(len(name), U)
    np.bitwise_or.at(mask, np.repeat(np.arange(len(name)), count)[flag], U(1) << bit[flag])
    said, at = [], 0
    for n in size.tolist():
        own = np.flatnonzero(some[at : at + n]) + at
        said.append(name[own].tobytes() + mask[own].tobytes())
        at += n
    return pa.table([table.column("block"), table.column("part"), pa.array(said, pa.binary())], schema=REPLY)


def _removed(rows: Iterator[dict], window: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", spans), ("kept", pa.binary())])
    for row in rows:
        own = Strings(B.Block.of(row), window, gram)
        own.keep_shared(parts, row["shared"])
        own.keep_known(parts, row["known"])
        block, names = own.block, own.named()
        first, group = own.firsts(names)
        later = own.doc > own.doc[first][group] if len(first) else np.zeros(0, bool)
        said = [np.frombuffer(a["said"], U).reshape(2, -1) for a in row["answers"] or []]
        known = np.concatenate(said, axis=1) if said else np.zeros((2, 0), U)
        by = np.argsort(known[0], kind="stable")
        known = known[:, by]
        mask = np.zeros(len(names), U)
        if known.shape[1]:
            at = np.minimum(np.searchsorted(known[0], names), known.shape[1] - 1)
            mask = np.where(known[0][at] == names, known[1][at], U(0))
        mask[later] = U(2**64 - 1)
        n = len(block.raw)
        step = np.zeros(n + 1, np.int32)
        for k in range(int(own.count.max(initial=0))):
            hit = own.start[(own.count > k) & (mask >> U(k) & U(1) == 1)] + k
            step[hit] += 1
            step[hit + window] -= 1  # no two hits of one k are at one place
        gone = np.cumsum(step)[:n] > 0
        raw = np.frombuffer(block.raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
        begin, stop = edge[::2], edge[1::2]  # the line end between two documents is never covered
        lo = np.searchsorted(begin, block.start)
        hi = np.searchsorted(begin, block.end)
        found, kept = [], []
        for k, (a, b) in enumerate(zip(block.start.tolist(), block.end.tolist(), strict=True)):
            found.append([{"start": int(x) - a, "end": int(y) - a} for x, y in zip(begin[lo[k] : hi[k]], stop[lo[k] : hi[k]], strict=True)])
            kept.append(raw[a:b][~gone[a:b]].tobytes() if hi[k] > lo[k] else block.raw[a:b])
        docs = pa.array(block.docs, mask=block.docs == B.LAST)
        size = block.end - block.start
        for k in range(0, len(docs), 1000):
            part = slice(k, k + 1000)
            yield pa.RecordBatch.from_arrays(
                [docs[part], pa.array(size[part]), pa.array(found[part], spans), pa.array(kept[part], pa.binary())], schema=out
            )


def dedup(
    docs: DataFrame, window: int = 50, gram: int = 20, hot: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every whole text as UTF-8 bytes, one row per row of ``docs``.

    Removed is each byte inside a string of ``window`` bytes that also starts in a document with a smaller id; strings
    are judged on the input.  ``spans`` are the maximal removed runs, ``kept`` the other bytes.  Null and empty texts
    keep nothing and lose nothing; repeated rows of one id do not count against each other; a null id comes after
    every other one.  ``window - gram`` is at most 63.  A gram that occurs more than ``hot`` times is hot, and a core
    with more than ``hot`` different strings (a block counts its own); by default a 32nd of the runs in the text of a part.
    """
    if not 8 <= gram <= window or window - gram > 63:
        raise ValueError("gram must have 8 bytes at least, and window - gram be 63 at most")
    table, plan = B.store(docs, id_col, text_col)
    parts = plan.parts
    hot = plan.part_bytes // 512 if hot is None else hot
    grams = B.shared_names(table, plan, hot, lambda block, _: Strings(block, window, gram).different_grams())
    known = table.join(B.listed(grams, "shared"), "block", "left")

    def cores(block: B.Block, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = Strings(block, window, gram)
        own.keep_shared(parts, row["shared"])
        return own.different_cores()

    known = known.join(B.listed(B.shared_names(known, plan, hot, cores), "known"), "block", "left")
    sent = map_arrow(
        known,
        lambda batches: _strings_to_parts(B.rows_of(batches), window, gram, parts),
        "block long, part int, names binary, docs binary, counts binary, text binary",
    )
    met = sent.groupBy("part").applyInArrow(lambda t: _meet(t, window), "block long, part int, said binary")
    return map_arrow(
        B.answered(known, met),
        lambda batches: _removed(B.rows_of(batches), window, gram, parts),
        "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
    )
