"""Packing, Merkle manifests and hard negatives against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dielens.llm import hard_negatives, merkle, packing
from dielens.llm.text import vocabulary


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def pieces_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["start"]) for k, v in out.items()}


ODD = [
    "a  b", "x　\n y", "  two  spaces  ", "\n\n\n", "don't  we'll\t\tgo", "a<|endoftext|> b <|endoftext|>  c", "\u0085   z",
    "\x1c \x1d x", "日本語 テキスト\n\n中文  。", "tab\t\n mixed \r\n end ", " ", "", "é è   ü", "1 000 000 12345  678",
]


def test_chunks_encode_as_whole_texts(spark):
    rng, alphabet = random.Random(8), [" ", " ", "\n", "\t", " ", "　", " ", "a", "B", "é", "'s", "1", "!", "日", "<|endoftext|>", "\u0085", "\x1f"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.tokens(df, "byte_bpe_50k.json", 0, "doc_id", "text").collect()}
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    wrong = [(t, got[i], w) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if got[i] != [*w, 0]]
    assert not wrong, wrong[:3]


def test_packing_is_gapless(hard, plain):
    packed = packing.pack(hard).cache()
    rows, t = packed.collect(), library()
    own = pieces_of(packed)
    for doc, text in plain:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        got = own[doc]
        assert [r["start"] for r in got] == list(np.cumsum([0] + [r["length"] for r in got])[:-1])
        assert b"".join(r["ids"] for r in got) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in got} == {len(ids)}
    assert len(own[None]) >= 1
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["length"] > 0
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends)))
    assert all(ends[k] == 1024 for k in list(ends)[:-1]) and max(ends.values()) <= 1024
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    for k, r in whole.items():
        n = ends[k]
        assert r["n_tokens"] == n and len(r["ids"]) == 4 * r["padded"] and r["padded"] == (n if n & (n - 1) == 0 else 1024)
        assert r["ids"][: 4 * n] == b"".join(x["ids"] for x in stream if x["sequence_id"] == k)


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0 and packing.sequences(packing.pack(nothing)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels, and the siblings of every node."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
            steps[i].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
            at[i] = a // 3
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], steps


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    own = {}
    for r in rows:
        own.setdefault(r[1], []).append(r)
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = {}, []
    for s in order:
        own[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, H(*map(field, r))))
        subs[s] = tree([H(*map(field, r)) for r in own[s]])
    root, upper = tree([subs[s][0] for s in order])
    for k, s in enumerate(order):
        for r, below in zip(own[s], subs[s][1], strict=True):
            steps = below + upper[k]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = H(*map(field, (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])))
            for a, b in steps:
                node = H(a, node, b)
            leaf = H(*map(field, r))
            out.append((r[0], leaf, subs[s][0], root, H(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_merkle_against_brute_force(spark, digits):
    rng = random.Random(4)
    rows = []
    for source, n in (("big", 100), ("one", 1), (None, 7), ("é", 9), ("three", 3), ("four", 4), ("", 28)):
        for _ in range(n):
            rows.append((rng.randrange(10**6), source, rng.choice(["en", None, ""]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "\n", "x é"])))
    rows += [rows[3], rows[3], (None, "big", None, None, None), (None, None, None, None, "t\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("leaf", "hash", "rank", "n", "body", "block", "path", "root", "seen", "at", "depth")])
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.proofs(merkle.leaves(df, {"text": cut}), digits=digits)
    got = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(), merkle.folded("seen").alias("folded")
    ).withColumn("ok", F.col("folded") == F.col("root"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


def test_merkle_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.proofs(merkle.leaves(spark.createDataFrame([], schema))).count() == 0
    one = merkle.proofs(merkle.leaves(spark.createDataFrame([(1, "s", None, None, "t")], schema))).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


def brute_negatives(rows, anchor):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    ints = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in filter(anchor, ints):
        score = {i: sum(p * q for p, q in zip(ints[a][1], v)) for i, (_, v) in ints.items() if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ints[i][0] == ints[a][0]][:5]:
            fit = [i for i in order if ints[i][0] != ints[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_hard_negatives_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(900):
        c = int(rng.integers(6))
        v = (centres[c] + rng.normal(size=dim) * rng.choice([0.05, 0.5, 2])).astype(np.float32).tolist()
        rows.append((i, int(rng.integers(4)) if rng.random() < 0.4 else c % 4, v))
    same = rows[50][2]
    rows += [(1000 + i, i % 4, same) for i in range(300)]  # one common vector
    rows += [(None, 1, same), (2000, None, same), (2050, 1, None), (2100, 1, [float("nan")] * dim), (2150, 1, [None] * dim)]
    rows += [(0, 9, same), rows[1], (2200, 1, same[:2]), (2250, 2, []), (2300, 3, [0.0] * dim), (2350, 1, [float("inf")] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)
    df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("id", "vec", "block", "caps", "asked", "score", "rank")])
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_negatives(rows, lambda i: i % 50 == 0)


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(i, i % 2, [float(2**30 + i), float(-(2**29)), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0, scale=1, low=50, high=100).collect()))
    ints = {i: [int(x) for x in v] for i, _, v in rows}
    dot = lambda a, b: min(sum(p * q for p, q in zip(ints[a], ints[b], strict=True)), 2**63 - 1)
    for a, p, _, n, ps, ns in got:
        assert ps == dot(a, p) and ns == dot(a, n) and 50 * ps <= 100 * ns <= 100 * ps
    short = spark.createDataFrame([(0, 0, [1.0]), (50, 0, [1.0, 2.0, 3.0]), (1, 0, []), (2, 1, [0.7])], df.schema)
    assert [tuple(r) for r in hard_negatives.mine(short, F.col("vec_id") % 50 == 0).collect() if r["anchor_id"] == 50] == [
        (50, 0, 1, 2, 65536, 256 * 179)
    ]
    assert got and hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_intervals_hold_true_scores():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 70)))
    codes, align, norms = hard_negatives.coded(x)
    row = {"n": 500, "dim": 70, "ids": np.arange(500).tobytes(), "labels": np.zeros(500, "<i8").tobytes(), "vec": x.astype("<f8").tobytes(), "caps": None}
    block = hard_negatives.Block(row | {"codes": codes.tobytes(), "align": align.tobytes(), "norms": norms.tobytes()})
    about, reach = hard_negatives.intervals(x[:40], block)
    true = x[:40] @ x.T
    assert (np.abs(true - about) <= reach).all()
    assert reach.mean() < 0.3 * np.sqrt((x**2).sum(axis=1)).mean() ** 2
