"""Toxicity by the nearest labelled examples.

Terms are words and word beginnings; a term that occurs 2, 4 or 8 times in a text is also a term of its own, so that
frequency survives in the cosine.  The terms that differ most between the labelled classes (chi-square) are weighted
by their inverse document frequency over the whole corpus.  Every text is compared with the examples by exact TF-IDF
cosine through an inverted index in blocks of examples: a block whose largest possible similarity is below the k-th
best one found is not opened.  The neighbours vote with weights that fall with their distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.shuffles import settled
from dielens.llm.text import batch, map_arrow, on_workers, slices, spread, texts_of
from dielens.llm.words import Texts, byte_class, mixed

U = np.uint64
LETTERS = byte_class(r"[^\x00-\x60\x7B-\x7F]")
#: Bytes of a word beginning, and how often a term must occur for each of its forms.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
OFTEN = (1, 2, 4, 8)


def terms_of(texts: pa.Array, wanted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term name) of every different term of each text; ``wanted``: the sorted names of words and beginnings to keep."""
    t = Texts(texts, lower=True)
    start, end = t.runs(LETTERS)
    owner = np.searchsorted(t.end, start)
    parts = [(owner, t.names(start, end))]
    for n in BEGINNINGS:
        rows = np.flatnonzero(end - start > n)
        parts.append((owner[rows], mixed(t.names(start[rows], start[rows] + n) ^ U(n))))
    doc = np.concatenate([d for d, _ in parts])
    name = np.concatenate([x for _, x in parts])
    if wanted is not None:
        base = wanted["base"]
        maybe = np.zeros(1 << 16, bool)
        maybe[(base & U(0xFFFF)).astype(np.int64)] = True
        rows = np.flatnonzero(maybe[(name & U(0xFFFF)).astype(np.int64)])
        doc, name = doc[rows], name[rows]
        at = np.searchsorted(base, name)
        at[at == len(base)] = 0
        rows = np.flatnonzero(base[at] == name) if len(base) else np.zeros(0, int)
        doc, name = doc[rows], name[rows]
    by = np.lexsort((name, doc))
    doc, name = doc[by], name[by]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])])) if len(doc) else doc
    often = np.diff(np.append(edge, len(doc)))
    forms = [(doc[edge[often >= n]], mixed(name[edge[often >= n]] + U(n))) for n in OFTEN]
    return np.concatenate([d for d, _ in forms]), np.concatenate([x for _, x in forms])


@dataclass
class Index:
    """Examples in blocks, their terms as postings ordered by term and example, and the largest weight of each block."""

    names: np.ndarray  # sorted names of terms
    base: np.ndarray  # sorted names before the forms were made, to skip other words early
    idf: np.ndarray
    label: np.ndarray
    weight: np.ndarray  # of a vote: examples of a class stand for all its labelled rows
    example: np.ndarray  # ids
    first: np.ndarray  # of a term's postings
    post: np.ndarray
    value: np.ndarray
    most: np.ndarray  # term x block
    block: int
    empty: float  # share of label 1 among examples without any term
    overall: float

    @property
    def wanted(self) -> dict:
        return {"base": self.base}

    def vector(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of one text that the index has, and their weights with length 1."""
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        at = np.unique(at[self.names[at] == names]) if len(self.names) else at[:0]
        w = self.idf[at]
        norm = np.sqrt((w * w).sum())
        return at, w / norm if norm else w

    def nearest(self, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine above 0 (ties: the first in the index), and their cosines."""
        terms, w = self.vector(names)
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms):
            return none
        bound = w @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        found, score = none
        step, at = 4, 0
        while at < len(order) and bound[at] > 0:
            if len(score) == k and bound[at] < score[-1] - 1e-9:
                break
            blocks = order[at : at + step]
            at, step = at + step, step * 2
            begin, count = self._ranges(terms, blocks)
            rows = spread(begin.ravel(), count.ravel())
            ids = self.post[rows]
            local = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), count.ravel()) * self.block + ids % self.block
            total = np.bincount(local, self.value[rows] * np.repeat(np.repeat(w, len(blocks)), count.ravel()))
            hit = np.flatnonzero(total > 0)
            ids = blocks[hit // self.block] * self.block + hit % self.block
            found, score = np.concatenate([found, ids]), np.concatenate([score, np.round(total[hit], 9)])
            keep = np.lexsort((found, -score))[:k]
            found, score = found[keep], score[keep]
        return found, score

    def _ranges(self, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.first[terms[:, None], blocks]
        return begin, self.first[terms[:, None], blocks + 1] - begin

    def score(self, names: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        """The vote for label 1, smoothed by one vote of the overall share, with its evidence."""
        found, cosine = self.nearest(names, k)
        if not len(found):
            return self.empty, found, cosine
        vote = self.weight[found] * cosine / (1.05 - cosine)
        return float((vote @ self.label[found] + self.overall) / (vote.sum() + 1.0)), found, cosine


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, folds: int, id_col: str, text_col: str, label_col: str
) -> tuple[DataFrame, dict[int, int]]:
    """The texts of at most ``per_class`` rows of each label, chosen by a hash of the id, and all labelled rows by label.

    Rows whose id has crc32 0 modulo ``folds`` are held out; an id with both labels counts as label 1.
    """
    key = F.col(id_col).cast("long")
    usable = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull())
    usable = usable.where(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) != 0)
    usable = usable.groupBy(key.alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    count = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    chosen = None
    for y in (0, 1):
        some = usable.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_class ids
    chosen = F.broadcast(settled(chosen, "toxicity-sample"))
    return settled(texts_of(docs, id_col, text_col).join(chosen, "doc_id"), "toxicity-texts"), count


def _term_counts(sample: DataFrame) -> DataFrame:
    """(name, ones, zeros): in how many examples of each label a term is."""
    schema = pa.schema([("name", pa.int64()), ("ones", pa.int64()), ("zeros", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in slices(b, size=2_000_000)):
            doc, name = terms_of(part.column("text"))
            names, at = np.unique(name, return_inverse=True)
            y = part.column("label").to_numpy(zero_copy_only=False)[doc]
            ones = np.bincount(at, y, len(names)).astype(np.int64)
            zeros = np.bincount(at, 1 - y, len(names)).astype(np.int64)
            yield batch(schema, names.view(np.int64), ones, zeros)

    return map_arrow(sample, run, "name long, ones long, zeros long").groupBy("name").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    )


def _document_frequency(docs: DataFrame, wanted: dict, names: np.ndarray, id_col: str, text_col: str) -> tuple[int, dict]:
    """Rows of the whole corpus, and in how many each of a bounded set of terms is."""
    schema = pa.schema([("name", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) + 1, np.int64)
        for part in (part for b in batches for part in slices(b)):
            _, name = terms_of(part.column("text"), wanted)
            at = np.searchsorted(names, name)
            at[at == len(names)] = 0
            total[:-1] += np.bincount(at[names[at] == name], minlength=len(names)) if len(names) else 0
            total[-1] += part.num_rows
        shown = np.append(names, U(0)).view(np.int64)
        yield batch(schema, shown[total > 0], total[total > 0])

    rows = map_arrow(texts_of(docs, id_col, text_col), run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    count = {r["name"]: r["n"] for r in rows.collect()}  # a row for each wanted term at most
    return count.pop(0, 0), count


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    least_chi2: float = 10.0,
    least_share: float = 0.5,
    folds: int = 5,
    block: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Index:
    """The index of a bounded sample of labelled rows; ``per_class`` bounds what the driver holds.

    The terms are all those whose chi-square reaches ``least_chi2``, or ``least_share`` of the largest
    one where that is less: the statistic cannot exceed the number of examples, and a few of them must do.  Without
    labelled rows, or without any such term, every score is 0.  Rows with a null id or label are not examples.
    """
    sample, total = labelled_sample(docs, labels, per_class, folds, id_col, text_col, label_col)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    ones, zeros = F.col("ones"), F.col("zeros")
    p = (ones + zeros) / F.lit(max(n1 + n0, 1))
    spread_ = F.greatest(p * (1 - p) * F.lit(n1 * n0 / max(n1 + n0, 1)), F.lit(1e-9))
    gap = (ones * n0 - zeros * n1) / F.lit(max(n1 + n0, 1))
    scored = settled(
        _term_counts(sample)
        .where((ones + zeros >= max(1, min(5, n1, n0))) & (gap != 0))
        .select("name", (gap * gap / spread_).alias("chi2")),
        "toxicity-terms",
    )
    most = scored.agg(F.max("chi2")).first()[0] or 0.0
    best = scored.where(F.col("chi2") >= min(least_chi2, least_share * most)).collect()  # bounded by the sampled texts
    names = np.sort(np.array([r["name"] for r in best], np.int64).view(U))
    examples, base = _examples(sample, names)
    wanted = {"base": base}
    rows, df = _document_frequency(docs, wanted, names, id_col, text_col)
    idf = np.array([np.log(1 + rows / df.get(int(x), 1)) for x in names.view(np.int64)])
    overall = total.get(1, 0) / max(sum(total.values()), 1)
    return _build(examples, names, base, idf, n, total, overall, block)


def _examples(sample: DataFrame, names: np.ndarray) -> tuple[list, np.ndarray]:
    """(id, label, terms) of every example, and the names of the words behind the terms."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int64())), ("base", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in slices(b, size=2_000_000)):
            doc, name = terms_of(part.column("text"), {"base": all_bases(part.column("text"), names)})
            at = np.searchsorted(names, name)
            at[at == len(names)] = 0
            keep = names[at] == name if len(names) else np.zeros(len(name), bool)
            doc, name = doc[keep], name[keep]
            by = np.argsort(doc, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
            terms = pa.ListArray.from_arrays(ends, name[by].view(np.int64))
            found = [[] for _ in range(part.num_rows)]
            found[0] = all_bases(part.column("text"), names).view(np.int64).tolist()
            yield batch(schema, part.column("doc_id"), part.column("label"), terms, found)

    rows = map_arrow(sample, run, "doc_id long, label int, terms array<long>, base array<long>").collect()
    base = np.array(sorted({x for r in rows for x in r["base"]}), np.int64).view(U)
    return [(r["doc_id"], r["label"], np.array(r["terms"], np.int64).view(U)) for r in rows], np.sort(base)


def all_bases(texts: pa.Array, names: np.ndarray) -> np.ndarray:
    """The words and beginnings of these texts that have a form among ``names``."""
    t = Texts(texts, lower=True)
    start, end = t.runs(LETTERS)
    parts = [t.names(start, end)]
    for n in BEGINNINGS:
        rows = np.flatnonzero(end - start > n)
        parts.append(mixed(t.names(start[rows], start[rows] + n) ^ U(n)))
    base = np.unique(np.concatenate(parts))
    keep = np.zeros(len(base), bool)
    for n in OFTEN:
        keep |= np.isin(mixed(base + U(n)), names)
    return base[keep]


def _build(examples: list, names, base, idf, n: dict, total: dict, overall: float, block: int) -> Index:
    """Examples with like terms are put in the same blocks, so that the largest weights of a block are telling."""
    rows = []
    for doc_id, label, terms in examples:
        at = np.unique(np.searchsorted(names, terms))
        w = idf[at]
        rows.append((tuple(at[np.argsort(-w, kind="stable")].tolist()), doc_id, label, at, w / max(np.sqrt((w * w).sum()), 1e-12)))
    rows.sort(key=lambda r: r[:2])
    bare = [r for r in rows if not len(r[3])]
    rows = [r for r in rows if len(r[3])]
    scale = {y: total.get(y, 0) / max(n.get(y, 0), 1) for y in (0, 1)}
    weight = np.array([scale[r[2]] for r in rows])
    weight = weight / weight.mean() if len(weight) else weight
    blocks = -(-len(rows) // block)
    most = np.zeros((len(names), blocks), np.float64)
    term = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, int)
    post = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    value = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0)
    np.maximum.at(most, (term, post // block), value)
    by = np.lexsort((post, term))
    term, post, value = term[by], post[by], value[by]
    key = term * (blocks + 1) + post // block
    first = np.searchsorted(key, np.arange(len(names))[:, None] * (blocks + 1) + np.arange(blocks + 1))
    mass = [sum(scale[y] for r in bare if r[2] == y) for y in (0, 1)]
    # only examples without terms speak against a text without terms, and in an index without terms nothing does
    empty = mass[1] / (sum(mass) + 1) if len(names) else 0.0
    return Index(
        names, base, idf, np.array([r[2] for r in rows], float), weight, np.array([r[1] for r in rows], np.int64),
        first, post, value, most, block, empty, overall,
    )


def score(
    docs: DataFrame, index: Index, k: int = 25, folds: int = 5, evidence: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row per row of ``docs``.

    ``evidence`` lists the nearest examples as struct(doc_id, cosine, label).  A text without any term of the index,
    such as a null or empty one, gets the share of label 1 among such examples, and 0 without any.  ``held_out`` of a
    null id is false.
    """
    near = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(near))])
    held = on_workers(docs).sparkSession.sparkContext.broadcast(index)  # bounded by per_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for part in (part for b in batches for part in slices(b)):
            doc, name = terms_of(part.column("text"), index.wanted)
            by = np.argsort(doc, kind="stable")
            name = name[by]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            scores, shown, known = [], [], {}
            for a, b_ in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.sort(name[a:b_])
                if (key := own.tobytes()) not in known:
                    s, found, cosine = index.score(own, k)
                    known[key] = s, [
                        {"doc_id": d, "cosine": c, "label": y}
                        for d, c, y in zip(
                            index.example[found[:evidence]].tolist(), cosine[:evidence].tolist(),
                            index.label[found[:evidence]].astype(int).tolist(), strict=True,
                        )
                    ]
                scores.append(known[key][0])
                shown.append(known[key][1])
            yield batch(schema, part.column("doc_id"), scores, shown)

    ddl = "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    found = map_arrow(texts_of(docs, id_col, text_col), run, ddl)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return found.select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def keep_clean(docs: DataFrame, index: Index, most: float = 0.5, k: int = 25, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``most``; all columns stay."""
    held = on_workers(docs).sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for part in (part for b in batches for part in slices(b, text_col)):
            texts = part.column(text_col).cast(pa.string())
            doc, name = terms_of(texts, index.wanted)
            name = name[np.argsort(doc, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            clean = [index.score(np.sort(name[a:b_]), k)[0] < most for a, b_ in zip(ends[:-1], ends[1:], strict=True)]
            yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
