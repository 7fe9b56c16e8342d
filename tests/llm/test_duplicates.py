"""Duplicate operators against brute force over all pairs or windows."""

import re

import pytest

from dielens.llm import components, minhash, recompression, suffix_dedup

from .conftest import by_id

LOWER = {c: c + 32 for c in range(65, 91)}


def bytes_removed(rows, window):
    """Kept bytes by the definition; ``rows`` in ascending order of the id."""
    seen, out = set(), {}
    for i, text in rows:
        b = text.encode()
        own = [b[k : k + window] for k in range(len(b) - window + 1)]
        gone = bytearray(len(b))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + window] = b"\1" * window
        seen.update(own)
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def words_removed(rows, window):
    seen, out = set(), {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        out[i] = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return out


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def groups(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("window", "gram", "hot"), [(50, 20, 256), (50, 9, 0), (30, 30, 3)])
def test_suffix_dedup(hard, plain, window, gram, hot):
    found = by_id(suffix_dedup.dedup(hard, window=window, gram=gram, hot=hot))
    kept = bytes_removed(plain, window)
    for i, text in plain:
        assert bytes(found[i]["kept"]) == kept[i], i
        assert found[i]["n_bytes"] == len(text.encode())
        assert sum(s["end"] - s["start"] for s in found[i]["spans"]) == len(text.encode()) - len(kept[i])
    assert sum(len(t.encode()) - len(kept[i]) for i, t in plain) > 1000


@pytest.mark.parametrize(
    ("window", "reach", "hot"),
    [(20, ((4, 12), (3, 9), (2, 6), (-1, 1)), 256), (12, ((2, 6), (-1, 1)), 3), (20, ((-1, 1),), 0)],
)
def test_recompression(hard, plain, window, reach, hot):
    found = by_id(recompression.dedup(hard, window=window, reach=reach, hot=hot))
    kept = words_removed(plain, window)
    for i, text in plain:
        assert found[i]["kept"] == kept[i], i
        assert found[i]["n_words"] == len(text.split()) or "\x1c" in text
    assert found[18]["spans"]  # a text that repeats itself


def test_symbols_of_windows_are_found_without_sorting(monkeypatch):
    import numpy as np

    from dielens.llm import blocks

    texts = [t.encode() for t in ("b a a b c " * 30, "one two three " * 9 + "a b c d e f g " * 8, "", "x")]
    raw, end = b"\n".join(texts) + b"\n", np.cumsum([len(t) + 1 for t in texts])
    block = blocks.Block(0, np.arange(4), np.concatenate([[0], end[:-1]]), end - 1, raw)
    monkeypatch.setattr(np, "lexsort", None)
    own = recompression.Windows(block, 20, ((4, 12), (3, 9), (2, 6), (-1, 1)))
    assert own.count.sum() == sum(max(len(t.split()) - 19, 0) for t in texts)
    assert (own.symbol != 0).all()


def test_radix_groups_are_the_equal_windows():
    import numpy as np

    text = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabc" * 3, np.uint8)
    places = np.arange(len(text) - 20)
    group = suffix_dedup.radix_groups(text, places, 20)
    names = [bytes(text[p : p + 20]) for p in places]
    for a in range(0, len(places), 7):
        for b in range(a + 1, len(places)):
            assert (group[a] == group[b] >= 0) == (names[a] == names[b])


def test_minhash(hard, plain):
    found = by_id(minhash.near_duplicates(hard))
    for i, (n, component) in groups(plain).items():
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (n, component), i
        assert found[i]["kept"] == (component == i)
    assert found[None]["component_id"] is None
    assert found[None]["kept"]


def test_minhash_finds_chains_and_hot_groups(spark):
    """A template with many edited copies, where some are too far from each other to be linked directly."""
    import random

    rng = random.Random(7)
    template = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(300):
        own = list(template)
        for _ in range(i % 4):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, (_, component) in groups(rows).items():
        assert found[i]["component_id"] == component, i


def test_minhash_reads_few_pairs_of_unlinked_near_copies(spark, monkeypatch):
    """Copies of one template that are all a little too far from each other: pairs are told apart without their full sets."""
    import random

    rng = random.Random(11)
    template = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        own = list(template)
        for place in rng.sample(range(150), 4 if i % 5 else 2):
            own[place] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    read, confirmed = [], minhash._confirmed

    def counted(pairs, *rest):
        read.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(minhash.near_duplicates(docs, hub_rounds=0))
    expected = groups(rows)
    assert {i: f["component_id"] for i, f in found.items()} == {i: c for i, (_, c) in expected.items()}
    sets = {i: shingles(t) for i, t in rows}
    links = sum(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a in sets for b in range(a))
    assert read[-1] <= 1.1 * links


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    shared, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    a = minhash.signature(np.concatenate([shared, one]), 1024)
    b = minhash.signature(np.concatenate([shared, two]), 1024)
    assert (a == b).mean() == pytest.approx(0.6, abs=0.06)


def test_keep_one_leaves_all_columns(hard, plain):
    left = minhash.keep_one(hard)
    assert left.columns == hard.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    best = {c for _, c in groups(plain).values()}
    assert sorted(i for i in ids if i is not None) == sorted(best)
    assert ids.count(None) == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_empty_tables(nothing):
    assert suffix_dedup.dedup(nothing).count() == 0
    assert recompression.dedup(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.keep_one(nothing).count() == 0


def test_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(1, text), (1, text), (2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.dedup(df).collect()
    assert sorted((r["doc_id"], len(r["kept"])) for r in found) == [(1, len(text)), (1, len(text)), (2, 0)]
    assert sorted((r["doc_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()) == [(1, True), (1, True), (2, False)]
    assert minhash.keep_one(df).count() == 1
    assert recompression.dedup(df).count() == 3


def edited_copies(n, places, other=3):
    """Copies of one text with words of their own; every fifth has fewer."""
    import random

    rng = random.Random(17)
    template = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        own = list(template)
        for place in rng.sample(range(150), places if i % 5 else other):
            own[place] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("direct", "turns"), [(100_000, 2), (0, 3)])
def test_minhash_stops_trying_hubs_that_do_not_pay(spark, monkeypatch, direct, turns):
    """Near copies that no hub links: the driver plans no more rounds for them than it needs."""
    rows, confirmed, calls = edited_copies(60, 7, 7), minhash._confirmed, []
    monkeypatch.setattr(minhash, "_confirmed", lambda *args: calls.append(1) or confirmed(*args))
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), direct=direct))
    assert {i: f["component_id"] for i, f in found.items()} == {i: c for i, (_, c) in groups(rows).items()}
    assert len(calls) <= turns


@pytest.mark.parametrize(("places", "other"), [(4, 2), (5, 3)])
def test_minhash_with_hubs_finds_the_same(spark, places, other):
    rows = edited_copies(120, places, other)
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), direct=0))
    assert {i: f["component_id"] for i, f in found.items()} == {i: c for i, (_, c) in groups(rows).items()}


def test_keep_one_moves_only_rows_of_repeated_ids(spark, monkeypatch):
    texts = [f"{k} " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "quite another text"), (40, texts[5]), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "id long, text string")
    frame, moved = type(docs), []
    first = frame.dropDuplicates

    def counted(self, subset=None):
        if subset == ["id"]:
            moved.append(self.count())
        return first(self, subset)

    monkeypatch.setattr(frame, "dropDuplicates", counted)
    left = sorted(r["id"] for r in minhash.keep_one(docs, id_col="id").collect() if r["id"] is not None)
    assert left == list(range(20))
    assert moved == [3]
    assert minhash.keep_one(docs, id_col="id").where("id IS NULL").count() == 2


def test_members_of_buckets_are_moved_once(spark):
    rows = [(7, 1), (7, 4), (7, 2), (8, 5), (9, 6), (9, 6), (10, 3), (10, 1)]
    found = minhash._members(spark.createDataFrame(rows, "key long, rep long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [(7, 1, 1), (7, 2, 1), (7, 4, 1), (10, 1, 1), (10, 3, 1)]


def test_minhash_leaves_sets_behind_that_no_pair_names(spark, monkeypatch):
    """Most texts have too many words of their own to be linked: their sets are not looked up in later rounds."""
    far = [(1000 + i, text) for i, text in edited_copies(60, 8, 8)]
    rows, confirmed, held = edited_copies(24, 3, 3) + far, minhash._confirmed, []

    def counted(pairs, sets, percent):
        held.append(sets.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), direct=0))
    assert {i: f["component_id"] for i, f in found.items()} == {i: c for i, (_, c) in groups(rows).items()}
    assert len(held) > 1
    assert 2 * held[-1] < held[0]


def test_components_looks_once_whether_only_stars_are_left(spark, monkeypatch):
    links = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(20, 21)], "a long, b long")
    frame, looks = type(links), []
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda self: looks.append("first") or first(self))
    monkeypatch.setattr(frame, "isEmpty", lambda self: pytest.fail("a second look"))
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {k: 1 for k in range(1, 9)} | {20: 20, 21: 20}
    assert len(looks) == 1
