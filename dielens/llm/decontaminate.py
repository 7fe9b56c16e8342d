"""Benchmark decontamination with suffix arrays of the training texts.

The words of a shard (some megabytes of documents) are ranked, and its suffixes are sorted to the depth of a window,
three words a pass; only suffixes that are still equal go to the next pass.  Every test window is then found by binary
search in each shard, which gives all its places in the training texts; windows that follow one another at following
places are one longer match.  A benchmark larger than ``block_bytes`` is taken in blocks, each searched over all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.shuffles import join_sized, settled
from dielens.llm.text import batch, map_arrow, on_workers, slices, spread, texts_of
from dielens.llm.words import Texts, byte_class, covered

#: Fixed value: what a word is made of, after A-Z have become a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INSIDE = byte_class(WORD)
SPANS = "array<struct<start:int,end:int>>"
SCHEMA = (
    f"doc_id long, text_key long, n_words long, hits {SPANS}, items array<string>, "
    "longest long, longest_at long, longest_item string"
)


class SuffixArray:
    """The suffixes of a shard's words, in order of their first ``depth`` words.

    ``names`` are the words of all texts one after another and ``n_words`` says how many each text has.  A suffix ends
    with its text: rank 0 stands behind every text and below every word.
    """

    def __init__(self, names: np.ndarray, n_words: np.ndarray, depth: int):
        self.depth = depth
        self.known, rank = np.unique(names, return_inverse=True)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        place = np.arange(len(names), dtype=np.int32) + owner.astype(np.int32)  # of a word among words and ends
        words = np.zeros(len(names) + len(n_words) + depth + 3, np.int32)
        words[place] = rank + 1
        self.words, self.place = words, place
        bits = int(len(self.known) + 1).bit_length()
        per = min(63 // bits, depth)  # the padding holds no more than the depth
        
        def key(at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            for k in range(per):
                out <<= bits
                out |= words[at + k]
            return out

        order = place
        first = key(order)
        by = np.argsort(first, kind="stable")
        order, first = order[by], first[by]
        group = np.zeros(len(order), np.int32)
        np.cumsum(first[1:] != first[:-1], out=group[1:])
        del first, by
        for done in range(per, depth, per):
            tied = np.zeros(len(order), bool)
            if len(order):
                equal = group[1:] == group[:-1]
                tied[1:] |= equal
                tied[:-1] |= equal
            rows = np.flatnonzero(tied)
            if not len(rows):
                break
            more = key(np.minimum(order[rows] + done, len(words) - per))
            by = np.lexsort((more, group[rows]))
            order[rows] = order[rows][by]
            split = np.zeros(len(order), bool)
            more, own = more[by], group[rows]
            split[rows[1:]] = (more[1:] != more[:-1]) & (own[1:] == own[:-1])
            group += np.cumsum(split, dtype=np.int32)
        self.order = order

    def ranks(self, names: np.ndarray) -> np.ndarray:
        """The rank of each word, 0 for a word the shard does not have."""
        at = np.searchsorted(self.known, names)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == names, at + 1, 0) if len(self.known) else np.zeros(len(names), np.int64)

    def find(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each window; ``windows`` are rows of ranks, filled up with 0."""
        steps = np.arange(self.depth)

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = self.order[np.minimum(mid, len(self.order) - 1)]
                own = np.where(steps < length[:, None], self.words[at[:, None] + steps], 0)
                differ = own != windows
                first = differ.argmax(axis=1)
                row = np.arange(len(windows))
                less = own[row, first] < windows[row, first]
                go_on = np.where(differ.any(axis=1), less, after) & open_
                lo, hi = np.where(go_on, mid + 1, lo), np.where(open_ & ~go_on, mid, hi)
            return lo

        return bound(False), bound(True)


class TestSet:
    """The windows of a block of test items."""

    __test__ = False  # for pytest

    def __init__(self, items: list[tuple[str, str]], length: int):
        texts = Texts(pa.array([t for _, t in items], pa.string()), lower=True)
        start, end = texts.runs(INSIDE)
        self.names, n_words = texts.names(start, end), texts.per_text(start)
        self.items = [i for i, _ in items]
        size = np.minimum(n_words, length)
        count = np.where(n_words > 0, n_words - size + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), count)
        begin = np.repeat(np.cumsum(n_words) - n_words, count)
        ends = np.cumsum(count)
        self.within = np.arange(len(self.owner)) - np.repeat(ends - count, count)
        self.start, self.size, self.length = begin + self.within, size[self.owner], length

    def matches(self, shard: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """(test window, word of the shard) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.start) or not len(shard.order):
            return none, none
        ranks = np.concatenate([shard.ranks(self.names), np.zeros(self.length, np.int64)])
        unknown = np.concatenate([[0], np.cumsum(ranks == 0)])
        rows = np.flatnonzero(unknown[self.start + self.size] == unknown[self.start])
        if not len(rows):
            return none, none
        size, steps = self.size[rows], np.arange(self.length)
        windows = np.where(steps < size[:, None], ranks[self.start[rows][:, None] + steps], 0)
        lo, hi = shard.find(windows, size)
        at = shard.order[spread(lo, hi - lo)]
        return np.repeat(rows, hi - lo), np.searchsorted(shard.place, at)


#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 2_000_000


def _blocks(
    benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int
) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of blocks of about ``block_bytes``, and their items, one block at a time on the driver."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1

    def each() -> Iterator[list[tuple[str, str]]]:
        for k in range(n):
            own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
            yield [(r["item"], r["text"]) for r in own.distinct().toLocalIterator()]

    return n, each()


def _occurrences(tests: TestSet, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a shard, and (test window, word of the shard) of every occurrence."""
    texts = Texts(column, lower=True)
    start, end = texts.runs(INSIDE)
    names, n_words = texts.names(start, end), texts.per_text(start)
    del texts, start, end
    return n_words, *tests.matches(SuffixArray(names, n_words, tests.length))


def _clean(tests: TestSet, column: pa.Array, share: int) -> np.ndarray:
    """Which texts of a shard are not contaminated."""
    n_words, window, word = _occurrences(tests, column)
    hit = covered(word, tests.size[window], int(n_words.sum()))
    n_hit = np.bincount(np.repeat(np.arange(len(n_words)), n_words)[hit], minlength=len(n_words))
    return ~((n_hit > 0) & (share * n_hit >= n_words))


def _search(tests: TestSet, part: pa.RecordBatch) -> list:
    """The columns of SCHEMA after the text key, for the documents of one shard."""
    n_words, window, word = _occurrences(tests, part.column("text"))
    n, first = int(n_words.sum()), np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(len(n_words)), n_words)
    size = tests.size[window]
    flags = np.concatenate([[False], covered(word, size, n), [False]])
    # a hit run ends with its text at the latest: runs are cut at the first word of each text
    cut = np.zeros(n + 1, bool)
    cut[first[first < n]] = True
    begin = np.flatnonzero(flags[1:-1] & (~flags[:-2] | cut[:-1]))
    stop = np.flatnonzero(flags[1:-1] & (~flags[2:] | cut[1:])) + 1
    doc = owner[begin]
    hits = [[] for _ in n_words]
    for d, a, b in zip(doc.tolist(), (begin - first[doc]).tolist(), (stop - first[doc]).tolist(), strict=True):
        hits[d].append({"start": a, "end": b})
    items = [[] for _ in n_words]
    pair = np.unique(np.stack([owner[word], tests.owner[window]]), axis=1) if len(word) else np.zeros((2, 0), int)
    for d, i in pair.T.tolist():
        items[d].append(tests.items[i])
    # windows of one item that follow each other on one diagonal are one match
    best = np.zeros((3, len(n_words)), np.int64)
    if len(word):
        item, place = tests.owner[window], tests.within[window]
        by = np.lexsort((word, word - place, item))
        item, place, at, size = item[by], place[by], word[by], size[by]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (at[1:] - place[1:] != at[:-1] - place[:-1])
        head = np.flatnonzero(new)
        long = np.diff(np.append(head, len(at))) - 1 + size[head]
        by = np.lexsort((-at[head], long, owner[at[head]]))
        d = owner[at[head]][by]
        last = np.flatnonzero(np.append(d[1:] != d[:-1], True))
        best[0, d[last]] = long[by][last]
        best[1, d[last]] = (at[head][by] - first[d])[last]
        best[2, d[last]] = item[head][by][last]
    found = [tests.items[i] if n else None for n, i in zip(best[0].tolist(), best[2].tolist(), strict=True)]
    return [n_words, hits, [sorted(set(x)) for x in items], best[0], best[1], found]


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 13,
    block_bytes: int = 16_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The places of benchmark windows in every document: columns of ``SCHEMA``, one row per row of ``docs``.

    A window is ``length`` words of an item, or the whole item if it has fewer.  ``hits`` are the merged runs of words
    inside any occurrence; ``items`` are the ids (as text, sorted) with an occurrence; ``longest`` is the longest
    verbatim match in words, at word ``longest_at`` (ties: the first place).  Null and empty texts and items have no words and
    match nothing; a null item id counts as an empty string; items of equal id are one item; an empty benchmark gives
    rows without hits.
    """
    source = texts_of(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("hits", spans),
         ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())]
    )
    passes = []
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for items in blocks:

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            tests = TestSet(items, length)
            for part in (part for b in batches for part in slices(b, size=SHARD)):
                yield batch(out, part.column("doc_id"), part.column("text_key"), *_search(tests, part))

        found = map_arrow(source, run, SCHEMA)
        # of several blocks only one is on the driver: the finds of each are written before the next is fetched
        passes.append(found if n == 1 else settled(found, "decontaminate"))
    if len(passes) == 1:
        return passes[0]
    return _merged(passes)


def _merged(passes: list[DataFrame]) -> DataFrame:
    """One row per document from one row per block; repeated rows are counted and given back."""
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    n = len(passes)
    best = F.max(F.struct("longest", (-F.col("longest_at")).alias("at"), F.col("longest_item").alias("item")))
    grouped = every.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("best"),
        (F.count("*") / n).cast("int").alias("copies"),
    )
    last = lambda done: F.element_at(done, -1)

    def add(done, s):
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))),
        )
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] < s["start"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(joined)

    merged = F.aggregate("hits", F.array().cast(SPANS), add)
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "doc_id", "text_key", "n_words", merged.alias("hits"), "items", F.col("best.longest").alias("longest"),
        (-F.col("best.at")).alias("longest_at"), F.col("best.item").alias("longest_item"),
    )


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: at least one word in ``share`` is inside a benchmark window."""
    n_hit = F.aggregate("hits", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, share: int = 20, length: int = 13, block_bytes: int = 16_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay, whatever their names.

    Texts are judged by themselves, so rows with a null id are judged too and repeated rows stay or go together.  Null
    and empty texts stay; an empty benchmark drops nothing; an empty table gives no rows.  A benchmark of one block is
    searched while the documents pass through, without an exchange.
    """
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if n == 1:
        items = next(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = TestSet(items, length)
            for part in (part for b in batches for part in slices(b, text_col, SHARD)):
                yield part.filter(pa.array(_clean(tests, part.column(text_col).cast(pa.string()), share), pa.bool_()))

        return on_workers(docs).mapInArrow(run, docs.schema)
    options = {"length": length, "block_bytes": block_bytes, "id_col": id_col, "text_col": text_col}
    found = find_matches(docs, benchmark, item_col=item_col, item_text_col=item_text_col, **options)
    bad = judged(found, share).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    named = on_workers(docs).withColumns({"__id": F.col(id_col).cast("long"), "__key": key})
    return join_sized(named, bad, ["__id", "__key"], "left_anti").drop("__id", "__key")


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(13, len(ws)) AS l, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS pos
      FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[pos:pos + l - 1], ' ') AS s FROM i),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, ws, unnest(generate_series(1, len(ws) - l + 1)) AS pos FROM d, lens WHERE len(ws) >= l),
ds AS (SELECT doc_id, l, pos, array_to_string(ws[pos:pos + l - 1], ' ') AS s FROM dw),
occ AS (SELECT doc_id, pos, ds.l AS l, item_id FROM ds JOIN win ON ds.l = win.l AND ds.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(pos, pos + l - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
