"""Near duplicates by circulant MinHash.

A document is the set of its word shingles.  One permutation shuffles the numbers of shingles, a second one, shifted
circularly by k, gives the k-th coordinate of the signature, so two permutations make all of them.  Bands of
coordinates give buckets.  Documents with equal sets form a class first; in a bucket the classes are compared with one
hub, not with each other, and links are confirmed on the full sets.  Classes of a bucket that are then still in
different components are compared with other hubs while these pay.  Of what is left after that, a class can only have a link if enough
of its shingles occur in another component at all; the shingles are counted, which drops copies with too many changes
of their own, and the rest is compared by signature and by hashes of whole short sets inside the bucket, so no link is
lost.  Bands of five rows keep
texts that only share a passage out of common buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.shuffles import settled
from dielens.llm.components import compact, components
from dielens.llm.text import batch, map_arrow, on_workers, slices, texts_of
from dielens.llm.words import Texts, byte_class, mixed, run_names, window_names, window_starts

U = np.uint64
INSIDE = byte_class(r"[^\x20\x09-\x0D]")


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles of all texts one after another, and their number for each text; repeats are not removed."""
    t = Texts(texts, lower=True)
    start, end = t.runs(INSIDE)
    names, n_words = t.names(start, end), t.per_text(start)
    first = np.cumsum(n_words) - n_words
    long = window_starts(n_words, width)
    out = window_names(names, width)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):  # the whole sequence is one shingle, named with its length
        out[first[short]] = run_names(names, first[short], n_words[short])
        long[first[short]] = True
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    return out[long], count


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(names: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k, over the shuffled shingles."""
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shuffled = _sigma(names.astype(np.uint32))
    for at in range(0, len(names), 1024):
        x = shuffled[None, at : at + 1024] - shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def signatures(
    docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str
) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, brief): ``brief`` is the lowest byte of each coordinate."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("brief", pa.list_(pa.int8()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(bands, dtype=U) + U(77))
        for part in (part for b in batches for part in slices(b)):
            names, count = shingle_sets(part.column("text"), width)
            sizes, keys, found, briefs, at = [], [], [], [], 0
            for n in count.tolist():
                own = np.unique(names[at : at + n])
                at += n
                sizes.append(len(own))
                if not n:
                    keys.append(None)
                    found.append([])
                    briefs.append([])
                    continue
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sign = signature(own, bands * rows)
                value = salt.copy()
                for column in sign.reshape(bands, rows).T:
                    value = mixed(value ^ column.astype(U))
                found.append(value.view(np.int64))
                briefs.append(sign.astype(np.uint8).view(np.int8))
            yield batch(schema, part.column("doc_id"), sizes, keys, found, briefs)

    ddl = "doc_id long, n_shingles long, set_key binary, bands array<long>, brief array<byte>"
    return map_arrow(texts_of(docs, id_col, text_col), run, ddl)


def _sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the named documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for b in batches for part in slices(b)):
            names, count = shingle_sets(part.column("text"), width)
            found, at = [], 0
            for n in count.tolist():
                found.append(np.unique(names[at : at + n]).view(np.int64))
                at += n
            yield batch(schema, part.column("doc_id"), found)

    own = texts_of(docs, id_col, text_col).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return map_arrow(own, run, "doc_id long, shingles array<long>")


def _alike(n_a: Column, n_b: Column, brief_a: Column, brief_b: Column, percent: int, least: int) -> Column:
    """Whether sizes and signatures allow a link.

    Sizes exclude exactly.  ``least`` equal coordinates are so far below those of a link that one at 75 % is lost with a
    chance of about 3e-6, that of sharing no band; it spares reading the full sets of unlike texts.
    """
    equal = F.size(F.filter(F.zip_with(brief_a, brief_b, lambda x, y: x == y), lambda x: x))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (equal >= least)


def _possible(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (key, rep, c, n, shared) of open buckets that can have a link to another component.

    ``shared`` counts the shingles of a class that another component has too; an intersection is no larger.  A link
    needs ``percent * (n_a + n_b) <= (100 + percent) * intersection``, and n_b is the least of the bucket at best.
    """
    own = _by_class(rest, "c", "n")
    tokens = sets.join(own.select("rep", "c"), F.col("doc_id") == F.col("rep")).select("rep", "c", F.explode("shingles").alias("shingle"))
    common = tokens.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("shingle")
    counted = tokens.join(common, "shingle").groupBy("rep").agg(F.count("*").alias("shared"))
    known = own.join(counted, "rep").select(F.explode("keys").alias("key"), "rep", "c", "n", "shared")
    smallest = known.groupBy("key").agg(F.min("n").alias("smallest"))
    able = known.join(smallest, "key").where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("smallest")))
    return able.select("key", "rep", "c", "n", "shared")


def _apart(members: DataFrame) -> DataFrame:
    """(key, least, size) of the buckets whose members are of different components."""
    ends = [F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size")]
    return members.groupBy("key").agg(*ends).where("least < most").select("key", "least", "size")


def _left(members: DataFrame) -> tuple[int, float]:
    """The number of members of open buckets, and of the pairs inside these."""
    return members.agg(F.count("*"), F.coalesce(F.sum((F.col("size") - 1) / 2), F.lit(0.0))).first()


def _members(exploded: DataFrame) -> DataFrame:
    """(key, rep, hub) of the buckets that hold different classes; the hub is the smallest.

    Rows are moved once, as most buckets have one class only.  A class is in a bucket of each band, so one bucket holds
    no more than a share of one band of all rows.
    """
    bucket = Window.partitionBy("key")
    ends = exploded.select("key", "rep", F.min("rep").over(bucket).alias("hub"), F.max("rep").over(bucket).alias("last"))
    return ends.where("hub < last").select("key", "rep", "hub")


def _by_class(members: DataFrame, *carried: str) -> DataFrame:
    """One row for each class with its buckets (at most one for each band of a set) in ``keys``.

    What belongs to a class is joined once and not once for each of its buckets.
    """
    return members.groupBy("rep").agg(*[F.first(c).alias(c) for c in carried], F.collect_list("key").alias("keys"))


def _hashed(sets: DataFrame, longest: int = 512) -> DataFrame:
    """(rep, size, hashes): the different 16-bit hashes of sets that are short enough to travel with every bucket."""
    short = F.transform("shingles", lambda x: (x.bitwiseAND(65535) - 32768).cast("short"))
    some = sets.where(F.size("shingles") <= longest)
    return some.select(F.col("doc_id").alias("rep"), F.size("shingles").alias("size"), F.array_distinct(short).alias("hashes"))


def _overlapping(percent: int) -> Column:
    """False only for pairs that cannot be linked: common hashes, and those a set lost to equal ones, bound the intersection.

    Pairs with a long set, which has no hashes, are true.
    """
    lost = [F.col(f"size_{k}") - F.size(f"hashes_{k}") for k in ("a", "b")]
    most = F.size(F.array_intersect("hashes_a", "hashes_b")) + F.least(*lost)
    known = F.col("hashes_a").isNotNull() & F.col("hashes_b").isNotNull()
    return ~known | ((100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 75,
    bands: int = 48,
    rows: int = 5,
    hub_rounds: int = 2,
    hubs: int = 4,
    direct: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Linked are sets with ``100 * intersection >= percent * union``; the component is the smallest id reachable.  A pair
    at exactly 75 % shares no band of the default 48 x 5 with a chance of about 2e-6.  Null and empty texts have an empty set
    and are linked with nothing; a text of fewer than ``width`` words is one shingle.  Repeated rows of an id give
    repeated rows; an id with different texts is one node.  A null id takes part in nothing and is kept.  Where the open
    buckets hold no more than ``direct`` pairs of classes, or other hubs have linked less than a tenth of the members, all
    that is left is compared at once; the links are the same.
    """
    sign = settled(signatures(docs, width, bands, rows, id_col, text_col), "minhash")
    some = sign.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = settled(some.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    reps = some.join(
        classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi"
    ).select(F.col("doc_id").alias("rep"), "n_shingles", "brief", "bands")
    # an id with different texts may stand for several sets; one row for each is enough here
    members = settled(_members(reps.select("rep", F.explode("bands").alias("key"))), "minhash-members")
    grouped = settled(_by_class(members), "minhash-grouped")
    # written alone, so that the planner knows how small the ids are and moves no text to find theirs
    ids = settled(grouped.select(F.col("rep").alias("doc_id")), "minhash-ids")
    about = reps.join(ids.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").dropDuplicates(["rep"])
    about = settled(about.select("rep", F.col("n_shingles").alias("n"), "brief"), "minhash-briefs")
    sets = settled(_sets(docs, ids, width, id_col, text_col), "minhash-sets")
    least = bands * rows * (percent - 13) // 100

    def checked(pairs: DataFrame) -> DataFrame:
        for k in ("a", "b"):
            renamed = {"rep": k, "n": f"n_{k}", "brief": f"brief_{k}"}
            pairs = pairs.join(about.withColumnsRenamed(renamed), k)
        fits = _alike(*map(F.col, ("n_a", "n_b", "brief_a", "brief_b")), percent, least)
        return pairs.where(fits).select("a", "b")

    stars = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = settled(_confirmed(checked(stars), sets, percent), "minhash-links")
    grouped = grouped.join(about.select("rep", "n"), "rep")
    n, named = members.count(), None
    for turn in range(hub_rounds + 1):
        if named is None:
            named = compact(components(links).withColumnRenamed("node", "rep"), n, "minhash-found")
        # common shingles counted in an earlier turn still bound an intersection, as components only grow
        carried = ["n", "shared"] if turn else ["n"]
        at = grouped.join(named, "rep", "left").select("keys", "rep", F.coalesce("component", "rep").alias("c"), *carried)
        at = at.select(F.explode("keys").alias("key"), "rep", "c", *carried)
        open_, before = compact(_apart(at), n, "minhash-open"), n
        at = compact(at.join(open_, "key"), n, "minhash-apart")
        n, pairs = _left(at)
        if not n:
            break
        # more hubs are tried where comparing all costs more, and where those of the turn before have linked something
        in_vain = turn > 0 and 10 * n > 9 * before
        last = turn == hub_rounds or pairs <= direct or in_vain
        if not turn:
            at = at.withColumn("shared", F.col("n"))
        if pairs > direct and not in_vain:
            # classes that cannot have a link to another component leave, and with them the buckets that are of one then
            all_open = n
            able = compact(_possible(at, sets, percent), n, "minhash-able")
            at = compact(able.join(_apart(able), "key"), n, "minhash-apart")
            n, pairs = _left(at)
            if not n:
                break
            last = last or pairs <= direct
            if 2 * n < all_open:
                # sets are looked up several times from here on: those that no pair can name any more stay behind
                ids = compact(at.select(F.col("rep").alias("doc_id")).distinct(), n, "minhash-ids")
                sets = settled(sets.join(ids, "doc_id", "left_semi"), "minhash-sets")
        # buckets that are of one component stay so: only the others are looked at again
        grouped = compact(_by_class(at, "c", "n", "shared"), n, "minhash-grouped")
        if not last:
            # other hubs of the first component: the last of its members in orders that change with every turn
            orders = [F.xxhash64("rep", F.lit(turn * hubs + k)) for k in range(hubs)]
            some_hubs = F.array_distinct(F.array(*[F.max_by("rep", order) for order in orders]))
            hub = compact(at.where("c = least").groupBy("key").agg(some_hubs.alias("hubs")), n, "minhash-hubs")
            tried = at.where("c != least").join(hub, "key").select(F.explode("hubs").alias("a"), F.col("rep").alias("b"))
            pairs = checked(tried.distinct())
        else:
            # what is left: classes of one bucket and different components, compared by signature inside the join
            whole = grouped.join(about.select("rep", "brief"), "rep").join(_hashed(sets), "rep", "left")
            whole = whole.withColumn("key", F.explode("keys"))
            names = ("key", "rep", "c", "n", "brief", "shared", "size", "hashes")
            sides = [whole.select(*[F.col(c).alias(f"{c}_{k}") for c in names]) for k in ("a", "b")]
            enough = (100 + percent) * F.least("shared_a", "shared_b") >= percent * (F.col("n_a") + F.col("n_b"))
            fits = enough & _alike(*map(F.col, ("n_a", "n_b", "brief_a", "brief_b")), percent, least) & _overlapping(percent)
            on = (F.col("key_a") == F.col("key_b")) & (F.col("c_a") < F.col("c_b")) & fits
            pairs = sides[0].join(sides[1], on).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
        new = settled(_confirmed(pairs, sets, percent), "minhash-links")
        if not new.isEmpty():
            links, named = links.unionByName(new), None
        if last:
            break
    if named is None:
        named = compact(components(links).withColumnRenamed("node", "rep"), n, "minhash-found")
    member = classes.join(named, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id")
    )
    out = sign.select("doc_id", "n_shingles", "set_key").join(settled(member, "minhash-named"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every group: the smallest id, and of its rows one; all columns stay.

    Texts are not moved to find the one row of an id that has no other.  They are where the ids that go are too many to
    be sent to every task.
    """
    id_col = options.get("id_col", "doc_id")
    gone = settled(near_duplicates(docs, **options).where("NOT kept").select("doc_id").distinct(), "minhash-gone")
    on_workers(docs)
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__several")).agg(F.count("*").alias("__n"))
    several = settled(several.where("__n > 1").select("__several"), "minhash-several")

    def left(how: str) -> DataFrame:
        own = docs.join(several, F.col(id_col) == F.col("__several"), how)
        return own.join(gone.withColumnRenamed("doc_id", "__gone"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")

    return left("left_anti").unionByName(left("left_semi").dropDuplicates([id_col]))
