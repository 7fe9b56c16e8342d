"""A Merkle manifest of a table by nested-struct rollup.

The rows of a source are leaves in the order of their id; every three consecutive nodes become one until one is left,
and the subroots of the sources become the root in the same way.  The rank of a node is written as digits of base
three.  Blocks of ``3 ** digits`` nodes are brought together once; inside a block the digits are grouped away one after
another, each aggregate nesting the structs of its children, so a block ends as one row that holds its whole tree.  The
nodes of the blocks are the leaves of the next tier.  Downwards a transform gives each child its siblings and an explode
makes it a row: inside a block no proof needs a join; a block takes the proof of its own node, one row, from the tier
above.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dielens.functions.shuffles import join_sized, settled

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    written = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(written)


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values, each with its length in UTF-8 bytes; a null is ``-`` and differs from an empty text."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def leaves(
    docs: DataFrame, seen: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """(source, doc_id, leaf, seen): ``seen`` is the leaf of the row with the columns of that dict put in place."""
    now = [F.col(c) for c in columns]
    later = [(seen or {}).get(c, F.col(c)) for c in columns]
    return docs.select(
        F.col(source_col).cast("string").alias("source"),
        F.col(id_col).alias("doc_id"),
        leaf(now).alias("leaf"),
        leaf(later).alias("seen"),
    )


def _ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0) and ``n`` within the group.

    Rows are sorted by ranges of (group, order), so a group of any size spreads over many tasks; the place of a row is
    its place in its own range and group plus the counts of the ranges before.
    """
    keys = [*group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settled(placed.withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    counts = placed.groupBy("__range", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "__range",
        *group,
        (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__size").over(whole).alias("n"),
    )
    joined = join_sized(placed, base, ["__range", *group], "inner")
    return joined.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def _depth(n: Column) -> Column:
    """How many levels reduce n nodes to one."""
    return reduce(Column.__add__, [(n > F.lit(3**j)).cast("int") for j in range(40)])


def _climbed(nodes: DataFrame, group: Sequence[str], digits: int, carried: Sequence[str]) -> list[DataFrame]:
    """The tiers, from the leaves up: (group, depth, block, hash, body), one row for each block.

    ``nodes``: group, rank, depth (levels still to climb), hash, and the carried columns, which the leaves keep.
    """
    tiers = []
    while True:
        kept = carried if not tiers else []
        digit = {f"__d{j}": (F.floor(F.col("rank") / F.lit(3**j)) % 3).cast("int") for j in range(digits)}
        body = F.struct(*kept) if kept else F.lit(None).cast("string")
        rows = nodes.select(
            *group, "depth", F.floor(F.col("rank") / F.lit(3**digits)).cast("long").alias("block"),
            *[c.alias(name) for name, c in digit.items()], "hash", body.alias("body"),
        ).repartition(*group, "block")
        for j in range(digits):
            keys = [*group, "depth", "block", *[f"__d{k}" for k in range(j + 1, digits)]]
            kids = F.array_sort(F.collect_list(F.struct(F.col(f"__d{j}").alias("digit"), "hash", "body")))
            node = F.sha2(F.array_join(F.col("body")["hash"], ""), 256)
            # a group of few nodes is done before the digits of a block are
            rows = rows.groupBy(*keys).agg(kids.alias("body")).withColumn(
                "hash", F.when(F.col("depth") > j, node).otherwise(F.col("body")[0]["hash"])
            )
        tiers.append(settled(rows, "merkle-tier"))
        deepest = tiers[-1].agg(F.max("depth")).first()[0]
        if (deepest or 0) <= digits:
            return tiers
        nodes = tiers[-1].select(
            *group, F.col("block").alias("rank"), F.greatest(F.col("depth") - digits, F.lit(0)).alias("depth"), "hash"
        )


def _kid(k: Column, i: Column) -> Column:
    """A child of the row's ``body`` with the digests of its siblings."""
    hashes = F.col("body")["hash"]
    step = F.struct(
        F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
        F.array_join(F.slice(hashes, i + 2, F.lit(3)), "").alias("right"),
    )
    return F.struct(k["digit"].alias("digit"), k["hash"].alias("hash"), k["body"].alias("body"), step.alias("step"))


def _descended(
    tiers: list[DataFrame], above: DataFrame, group: Sequence[str], digits: int, carried: Sequence[str]
) -> DataFrame:
    """The leaves with ``path``, the steps from the leaf up, and the other columns of ``above``.

    ``above``: group, path, and what each leaf of the group shall carry.
    """
    shared = [c for c in above.columns if c not in (*group, "path")]
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for tier, blocks in reversed(list(enumerate(tiers))):
        rows = join_sized(blocks, paths, [*group, "block"], "inner")
        rows = rows.select(*group, *shared, "depth", F.col("block").alias("at"), "path", "hash", "body")
        for j in range(digits - 1, -1, -1):
            rows = rows.withColumn("kid", F.explode(F.transform("body", _kid))).select(
                *group, *shared, "depth",
                (F.col("at") * 3 + F.col("kid.digit")).alias("at"),
                F.when(F.col("depth") > j, F.concat(F.array("kid.step"), "path")).otherwise(F.col("path")).alias("path"),
                F.col("kid.hash").alias("hash"), F.col("kid.body").alias("body"),
            )
        paths = rows.select(*group, *shared, F.col("at").alias("block"), "path", "hash", "body")
        if tier:
            paths = paths.drop("hash", "body")
    leaf_columns = [F.col(f"body.{c}").alias(c) for c in carried]
    return paths.select(*group, *shared, "path", "hash", *leaf_columns)


def proofs(rows: DataFrame, digits: int = 6) -> DataFrame:
    """(source, doc_id, leaf, seen, subroot, root, path) of every row of :func:`leaves`.

    ``path`` has one step for each level up to the root: the digests of the siblings to the left and to the right, each
    side concatenated.  A source of one row has its leaf as subroot and no steps below it; a run of one node is hashed
    alone.  A null source is a source and the first; a null id is the first of its source; rows of equal source and
    id stand in the order of their leaves; an empty table gives no rows.  No more than ``3 ** digits`` leaves are
    nested in one row.
    """
    rows = settled(rows, "merkle-leaves")
    ranked = _ranked(rows, ["source"], ["doc_id", "leaf"])
    carried = ["doc_id", "leaf", "seen"]
    nodes = ranked.select("source", "rank", _depth(F.col("n")).alias("depth"), F.col("leaf").alias("hash"), *carried)
    tiers = _climbed(nodes, ["source"], digits, carried)
    subroots = tiers[-1].select("source", F.col("hash").alias("subroot"), F.lit(0).alias("all"))
    tops = _ranked(subroots, ["all"], ["source"])
    tops = tops.select("all", "rank", _depth(F.col("n")).alias("depth"), F.col("subroot").alias("hash"), "source", "subroot")
    upper = _climbed(tops, ["all"], digits, ["source", "subroot"])
    start = upper[-1].select("all", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    above = _descended(upper, start, ["all"], digits, ["source", "subroot"])
    found = _descended(tiers, above.select("source", "subroot", "root", "path"), ["source"], digits, carried)
    return found.select("source", "doc_id", "leaf", "seen", "subroot", "root", "path")


def proof_digest(path: str = "path") -> Column:
    """SHA-256 (hex) of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(value: str, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, F.col(value), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


#: crc32 of the decimal id, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""


def _sql_leaf(text: str) -> str:
    parts = [
        f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
        for c in ("doc_id", "source", "lang", "n_chars", text)
    ]
    return f"sha256({' || '.join(parts)})"


def oracle() -> str:
    """The same trees level by level, and every row with the list of its steps."""
    cut = "replace(text, chr(10), '')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT source, doc_id, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 THEN {_sql_leaf(cut)} ELSE {_sql_leaf("text")} END AS seen FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER () AS own, row_number() OVER w - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
up AS (SELECT source, 0 AS lvl, rank, n, leaf AS hash FROM r
    UNION ALL
    SELECT source, lvl + 1, rank // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY rank)) FROM up WHERE n > 1
    GROUP BY source, lvl, rank // 3, n),
sub AS MATERIALIZED (SELECT source, hash AS subroot, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank,
    count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, rank, n, subroot AS hash FROM sub
    UNION ALL
    SELECT lvl + 1, rank // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY rank)) FROM top WHERE n > 1
    GROUP BY lvl, rank // 3, n),
nodes AS MATERIALIZED (SELECT 0 AS tree, source, lvl, rank, n, hash FROM up UNION ALL SELECT 1, NULL, lvl, rank, n, hash FROM top),
steps AS MATERIALIZED (SELECT k.tree, k.source, k.lvl, k.rank,
    coalesce(string_agg(o.hash, '' ORDER BY o.rank) FILTER (WHERE o.rank < k.rank), '') AS l,
    coalesce(string_agg(o.hash, '' ORDER BY o.rank) FILTER (WHERE o.rank > k.rank), '') AS r
    FROM nodes k JOIN nodes o ON k.tree = o.tree AND k.source IS NOT DISTINCT FROM o.source AND k.lvl = o.lvl
        AND k.rank // 3 = o.rank // 3
    WHERE k.n > 1 GROUP BY k.tree, k.source, k.lvl, k.rank),
asked AS (SELECT own, 0 AS tree, r.source, r.rank, unnest(range(depth)) AS lvl
    FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source
    UNION ALL
    SELECT own, 1, NULL, sub.rank, unnest(range((SELECT max(lvl) FROM top)))
    FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source),
path AS (SELECT own, list({{'l': l, 'r': s.r, 'h': ''}} ORDER BY a.tree, a.lvl) AS path
    FROM asked a JOIN steps s ON a.tree = s.tree AND a.source IS NOT DISTINCT FROM s.source AND a.lvl = s.lvl
        AND a.rank // (3 ** a.lvl)::BIGINT = s.rank
    GROUP BY own),
found AS (SELECT r.doc_id, r.leaf, r.seen, sub.subroot, (SELECT hash FROM top WHERE n = 1) AS root,
    coalesce(path, []) AS path
    FROM r JOIN sub ON r.source IS NOT DISTINCT FROM sub.source LEFT JOIN path USING (own)),
fold AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': '', 'h': seen}}, path),
    lambda a, s: {{'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}}).h AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified FROM fold
"""
