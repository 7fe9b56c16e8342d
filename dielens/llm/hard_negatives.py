"""Hard negatives by rotated one-bit codes and exact integer scores.

Vectors are rotated (random signs and a Hadamard transform, twice) and written as a few one-bit codes, each of what the
code before it leaves; beside every code stands its alignment, the share of the vector along it.  The inner product of
an anchor with a coded vector follows from popcounts of the code and the bit planes of the anchor; what neither
expresses is bounded by Cauchy and Schwarz, so every row has an interval that holds its true score.  Rows whose interval
may matter are scored in integers.  Anchors meet all rows in blocks; a block gives back only its best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.shuffles import join_sized, settled
from dielens.llm.text import map_arrow, on_workers

STAGES, PLANES = 4, 5
_EXACT = 2.0**53
PACKED = "block long, n int, dim int, ids binary, labels binary, vec binary, codes binary, align binary, norms binary, caps binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows under a fixed rotation, padded to a power of two of 64 at least."""
    width = max(64, 1 << max(int(x.shape[1]) - 1, 0).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(13).integers(0, 2, (2, width)) * 2.0 - 1
    for s in signs:
        out *= s
        h = 1
        while h < width:
            pair = out.reshape(len(x), -1, 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            h *= 2
    return out / width


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (stage, row, word), alignments (stage, row), and for each row its norm, that of its code, and that of the rest."""
    rest = rotated(x)
    whole = np.sqrt((rest * rest).sum(axis=1))
    kept = np.zeros_like(rest)
    codes, align = [], []
    for _ in range(STAGES):
        up = rest >= 0
        a = np.abs(rest).mean(axis=1)
        part = np.where(up, a[:, None], -a[:, None])
        kept += part
        rest = rest - part
        codes.append(_words(up))
        align.append(a)
    return np.stack(codes), np.stack(align), np.stack([whole, np.sqrt((kept**2).sum(axis=1)), np.sqrt((rest**2).sum(axis=1))])


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as integers of a few bits, plane by plane: (planes, least, step, sum, error norm)."""
    r = rotated(x)
    least, step = r.min(axis=1), np.ptp(r, axis=1) / (2**PLANES - 1)
    q = np.rint((r - least[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
    near = least[:, None] + step[:, None] * q
    bits = np.stack([_words((q >> p) & 1 == 1) for p in range(PLANES)])
    return bits, least, step, near.sum(axis=1), np.sqrt(((r - near) ** 2).sum(axis=1))


class Block:
    """Rows of one packed block."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        kind = "<f8" if len(row["vec"]) == 8 * n * dim else "<f4"
        self.x = np.frombuffer(row["vec"], kind).reshape(n, dim).astype(np.float64)
        self.top = float(np.abs(self.x).max(initial=0))
        if row["codes"] is not None:
            self.codes = np.frombuffer(row["codes"], "<u8").reshape(STAGES, n, -1)
            self.align = np.frombuffer(row["align"], "<f8").reshape(STAGES, n)
            self.whole, self.kept, self.rest = np.frombuffer(row["norms"], "<f8").reshape(3, n)
        if row["caps"] is not None:
            self.caps = np.frombuffer(row["caps"], "<i8").reshape(n, -1)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; components are whole numbers, exact as doubles up to 2**53, beyond it as integers of any size."""
        x = self.x[rows]
        if self.top * float(np.abs(anchor).max(initial=0)) * max(len(anchor), 1) < _EXACT:
            return (x @ anchor).astype(np.int64)
        one = [int(v) for v in anchor]
        exact = [sum(int(v) * w for v, w in zip(r, one, strict=True)) for r in x]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def intervals(anchors: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Estimated scores of all rows of a block for some anchors, and by how much a true score can differ from them."""
    bits, least, step, total, error = planes(anchors)
    m, n = len(anchors), len(block.ids)
    estimate = np.zeros((m, n))
    for code, align in zip(block.codes, block.align, strict=True):
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        count = np.zeros((m, n), np.int32)
        for p in range(PLANES):
            for w in range(code.shape[1]):
                count += np.bitwise_count(bits[p][:, None, w] & code[None, :, w]).astype(np.int32) << p
        along = step[:, None] * count
        along += least[:, None] * ones[None, :]
        along *= 2
        along -= total[:, None]
        along *= align
        estimate += along
    length = np.sqrt((anchors * anchors).sum(axis=1))
    half = error[:, None] * block.kept + length[:, None] * block.rest
    half += 1e-6 + 1e-9 * length[:, None] * block.whole  # rounding of doubles
    return estimate, half


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _best_alike(anchors: Block, lo: int, hi: int, block: Block, k: int) -> list[tuple]:
    estimate, half = intervals(anchors.x[lo:hi], block)
    out = []
    for i in range(lo, hi):
        alike = np.flatnonzero((block.labels == anchors.labels[i]) & (block.ids != anchors.ids[i]))
        if len(alike) > k:
            about, reach = estimate[i - lo, alike], half[i - lo, alike]
            probe = alike[np.argpartition(-about, k)[: k + 1]]
            least = np.sort(block.scores(probe, anchors.x[i]))[-k]
            alike = alike[about + reach >= least]
        score = block.scores(alike, anchors.x[i])
        best = _first(score, block.ids[alike], k)
        out += [(int(anchors.ids[i]), int(block.ids[alike[b]]), int(score[b])) for b in best.tolist()]
    return out


def _best_unlike(anchors: Block, lo: int, hi: int, block: Block, k: int, low: int, high: int) -> list[tuple]:
    estimate, half = intervals(anchors.x[lo:hi], block)
    out = []
    for i in range(lo, hi):
        wanted = sorted({int(p) for p, there in anchors.caps[i].reshape(-1, 2) if there})
        # whole bounds of 100 * score
        bands = [(p, -((-low * p) // 100), (high * p) // 100) for p in wanted if low * p <= high * p]
        live = np.flatnonzero(block.labels != anchors.labels[i])
        if not bands or not len(live):
            continue
        about, reach = estimate[i - lo, live], half[i - lo, live]
        floor = min(b[1] for b in bands)
        fits = (about + reach >= floor) & (about - reach <= max(b[2] for b in bands))
        live, about, reach = live[fits], about[fits], reach[fits]
        if len(live) > 8 * k:
            probe = block.scores(live[np.argpartition(-about, 8 * k - 1)[: 8 * k]], anchors.x[i])
            least = []
            for _, a, b in bands:
                inside = np.sort(probe[(probe >= a) & (probe <= b)])
                least.append(inside[-k] if len(inside) >= k else a)
            live = live[about + reach >= min(least)]
        score = block.scores(live, anchors.x[i])
        for p, a, b in bands:
            inside = np.flatnonzero((score >= a) & (score <= b))
            best = inside[_first(score[inside], block.ids[live[inside]], k)]
            out += [(int(anchors.ids[i]), p, int(block.ids[live[j]]), int(score[j])) for j in best.tolist()]
    return out


def _packed(rows: DataFrame, dim: int, codes: bool) -> DataFrame:
    """One row for each ``block`` of (block, id, label, vec, caps); vectors are filled up to ``dim`` components."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        n = len(part)
        x = np.zeros((n, dim))
        for i, v in enumerate(part["vec"]):
            x[i, : len(v)] = v
        small = np.abs(x).max(initial=0) < 2**24
        row = {
            "block": int(part["block"].iloc[0]), "n": n, "dim": dim, "ids": part["id"].to_numpy("<i8").tobytes(),
            "labels": part["label"].to_numpy("<i8").tobytes(), "vec": x.astype("<f4" if small else "<f8").tobytes(),
            "codes": None, "align": None, "norms": None, "caps": None,
        }
        if codes:
            row |= dict(zip(("codes", "align", "norms"), (a.tobytes() for a in coded(x)), strict=True))
        elif part["caps"].iloc[0] is not None:
            most = max(len(c) for c in part["caps"])
            caps = np.zeros((n, most, 2), np.int64)
            for i, c in enumerate(part["caps"]):
                caps[i, : len(c), 0], caps[i, : len(c), 1] = c, 1
            row["caps"] = caps.astype("<i8").tobytes()
        return pd.DataFrame([row], columns=NAMES)

    return on_workers(rows).groupBy("block").applyInPandas(pack, PACKED)


def _met(anchors: DataFrame, blocks: DataFrame, n_blocks: int, fn, schema: str) -> DataFrame:
    """``fn(anchors, lo, hi, block)`` for every block of anchors and every block of rows."""
    there = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    left = anchors.select(F.explode(there).alias("block"), F.struct(*[c for c in NAMES if c != "block"]).alias("asked"))
    both = left.repartition(n_blocks, "block").join(blocks.repartition(n_blocks, "block"), "block")
    out = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                asked, block = Block(row["asked"]), Block(row)
                step = max(1, (1 << 21) // max(len(block.ids), 1))  # bounds the arrays of all pairs
                for lo in range(0, len(asked.ids), step):
                    found = fn(asked, lo, min(lo + step, len(asked.ids)), block)
                    if found:
                        columns = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    return map_arrow(both, run, schema)


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The score of two rows is the inner product of their vectors, each component ``floor(scale * x)``.  Positives of an
    anchor are its best other rows of the same label; the negatives of a positive are the best rows of other labels
    with ``low * positive_score <= 100 * score <= high * positive_score``.  Ties go to the smaller id.  Rows with a null
    id, label, vector or component, or one that is not finite, take no part; of several rows of one id the one of the smallest
    (label, vector) does.  Shorter vectors count as filled up with zeros; scores beyond 64 bits stop at their limits.
    An empty table gives no rows.  A block of rows grows with the square root of their number.
    """
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    one = usable.groupBy("id").agg(F.min(F.struct("label", "vec", "asked")).alias("row"))
    whole = F.transform("row.vec", lambda x: F.rint(F.floor(scale * x).cast("double")))
    plain = settled(one.select("id", "row.label", whole.alias("vec"), "row.asked", F.lit(None).cast("array<long>").alias("caps")), "negatives-rows")
    n, n_asked, dim = plain.agg(F.count("*"), F.count_if("asked"), F.max(F.size("vec"))).first()
    dim = dim or 0
    size = min(max(4096, int(16 * n**0.5)), 1 << 18)
    n_blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")
    blocks = settled(_packed(plain.drop("asked").select(block, "id", "label", "vec", "caps"), dim, codes=True), "negatives-blocks")
    asked_block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_asked // 512)))).alias("block")
    asked = plain.where("asked").select(asked_block, "id", "label", "vec", "caps")

    found = _met(
        settled(_packed(asked, dim, codes=False), "negatives-anchors"), blocks, n_blocks,
        lambda a, lo, hi, b: _best_alike(a, lo, hi, b, positives), "anchor_id long, id long, score long",
    )
    alike = _top(found, ["anchor_id"], positives).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    alike = settled(alike, "negatives-positives")
    caps = alike.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("caps"))
    ready = asked.drop("caps").join(caps.withColumnRenamed("anchor_id", "id"), "id").select("block", "id", "label", "vec", "caps")
    found = _met(
        settled(_packed(ready, dim, codes=False), "negatives-anchors"), blocks, n_blocks,
        lambda a, lo, hi, b: _best_unlike(a, lo, hi, b, negatives, low, high),
        "anchor_id long, positive_score long, id long, score long",
    )
    unlike = _top(found, ["anchor_id", "positive_score"], negatives)
    return join_sized(unlike, alike, ["anchor_id", "positive_score"], "inner", null_safe=False).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH moved AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
e AS MATERIALIZED (SELECT vec_id, label, list_transform(v, lambda x: floor(256 * x)) AS v FROM one),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
    list_dot_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
    FROM pos p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike
        AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
