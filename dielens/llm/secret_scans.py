"""Secrets and who owns them, in DataFrame functions only.

Patterns give candidate spans of every text.  Every candidate value is hashed, and its hash is counted over the whole
corpus by distinct repositories and owners.  A value that one owner has, in few repositories, looks live; one that
many share is a widely copied example.  Equal texts of an owner are copies of one repository.  Spans of the fixed kinds are always reported; a span of the generic kind
``random`` (a long run with letters and digits) is reported only where its value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dielens.functions.shuffles import settled

#: The kinds in the order of equal starts, their patterns, and what a match must have to count.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# a run of the class is one match, so a least length inside the pattern drops exactly the runs that are too short
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_-]{24,}"
BASE = KINDS[:3]
#: Signs that no pattern matches: the first marks the ends of matches, and is first replaced by the second in texts.
MARK, OTHER = "\x01", "\x02"


def _spans(text: Column, kind: int, pattern: str, keep, value) -> Column:
    """array<struct(start, kind, end, hash)> of the matches that ``keep`` accepts; positions are code points.

    The text is cut at its matches; a match starts where the pieces before it end.
    """
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(done: Column, piece: Column) -> Column:
        return F.struct((done["at"] + F.length(piece)).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts"))

    def found(cut: Column) -> Column:
        def span(i: Column) -> Column:
            start, match = F.get(cut["starts"], 2 * i - 1), F.get(cut["pieces"], 2 * i - 1)
            return F.struct(
                start.alias("start"),
                F.lit(kind).alias("kind"),
                (start + F.length(match)).alias("end"),
                F.when(keep(match), F.sha2(value(match), 256)).alias("hash"),
            )

        return F.transform(F.sequence(F.lit(1), ((F.size(cut["pieces"]) - 1) / 2).cast("int")), span)

    starts = lambda pieces: F.aggregate(pieces, begun, add, lambda done: done["starts"])
    cut = lambda pieces: F.struct(pieces.alias("pieces"), starts(pieces).alias("starts"))
    # named by lambdas, pieces and starts are made once for a text and not again for each match
    spans = let(F.split(marked, MARK, -1), lambda pieces: let(cut(pieces), found))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(spans, lambda s: s["hash"].isNotNull())).otherwise(none)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(row, doc_id, owner, text_key, spans) for every row: the matches of all kinds, with the hash of each value."""
    always = lambda m: F.lit(True)
    whole = lambda m: m
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, OTHER)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        text.alias("text"),
    )
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    spans = F.concat(
        _spans(F.col("text"), 0, ASSIGN, lambda m: F.length(assigned(m)) >= 8, assigned),
        _spans(F.col("text"), 1, ACCESS, always, whole),
        _spans(F.col("text"), 2, HEX, always, whole),
        _spans(F.col("text"), 3, RANDOM, mixed, whole),
    )
    return rows.select("row", "doc_id", "owner", F.xxhash64("text").alias("text_key"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories): distinct texts first, so that a value everybody has is counted in parts.

    A repository is a text of an owner, whatever the number of its copies there.
    """
    value = found.select("owner", "text_key", F.explode("spans.hash").alias("hash"))
    repositories = value.groupBy("hash", "owner", "text_key").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def scan(
    docs: DataFrame,
    max_owners: int = 1,
    max_repositories: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: (row, doc_id, spans), spans in order of start and kind.

    A span is struct(start, kind, end, hash, live): ``live`` where its value is in at most ``max_repositories``
    repositories (different texts of an owner) of at most ``max_owners`` owners.  A null owner is one owner of its own.
    Null and empty texts have no spans; repeated rows are one repository; an empty table gives no rows.
    """
    found = settled(candidates(docs, id_col, text_col, owner_col), "secret-candidates")
    owned = settled(ownership(found), "secret-owners")
    each = found.select("row", F.explode("spans").alias("span")).withColumn("hash", F.col("span.hash"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = (
        each.join(owned, "hash")
        .withColumn("live", live)
        .where((F.col("span.kind") < len(BASE)) | F.col("live"))
        .select("row", F.struct("span.start", "span.kind", "span.end", "hash", "live").alias("span"))
    )
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return (
        found.select("row", "doc_id")
        .join(listed, "row", "left")
        .select("row", "doc_id", F.coalesce("spans", none).alias("spans"))
    )


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, placeholder: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced; overlapping spans become one placeholder.

    All rows and columns stay; ``n_chars``, where it exists, is that of the new text.
    """
    out = docs.columns
    text_col, id_col = options.get("text_col", "text"), options.get("id_col", "doc_id")
    digest = lambda: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("i"), digest().alias("t")))
    # rows of one id and text have the same spans: the key names them, whatever their number
    scanned = scan(keyed.withColumn("__id", F.col("__key")), **(options | {"id_col": "__id"}))
    spans = scanned.where(F.size("spans") > 0).groupBy("doc_id").agg(F.first("spans").alias("__spans"))
    spans = settled(spans.select(F.col("doc_id").alias("__key"), "__spans"), "secret-spans")
    seen = F.col("__spans")

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))

    def add(done: Column, s: Column) -> Column:
        gap = F.array(F.struct(done["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["gaps"], gap).alias("gaps"))

    gaps = F.aggregate(seen, begun, add, lambda done: done["gaps"])
    gaps = F.filter(gaps, lambda g: (g["a"] == 0) | (g["b"] > g["a"]))
    text = F.col(text_col)
    parts = F.transform(gaps, lambda g: text.substr(g["a"] + 1, g["b"] - g["a"]))
    tail = text.substr(F.array_max(seen["end"]) + 1, F.length(text))
    clean = F.concat(F.array_join(F.concat(parts, F.array(tail)), placeholder))
    # a text without any match has no span: it stays where it is, only the others are moved to meet theirs
    matched = F.rlike(F.coalesce(text.cast("string"), F.lit("")), F.lit("|".join((ASSIGN, ACCESS, HEX, RANDOM))))
    joined = keyed.where(matched).join(spans, "__key", "left").withColumn(text_col, F.when(seen.isNull(), text).otherwise(clean))
    if "n_chars" in out:
        joined = joined.withColumn(
            "n_chars", F.when(seen.isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType)
        )
    return joined.select(*out).unionByName(docs.where(~matched))


def oracle(max_owners: int = 1, max_repositories: int = 3) -> str:
    """The same in DuckDB SQL, for rows whose ids are unique."""
    quoted = lambda p: p.replace("'", "''")
    cut = lambda k, p: (
        f"SELECT doc_id, owner, digest, {k} AS kind, "
        f"string_split(regexp_replace(text, '{quoted(p)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS pieces FROM t"
    )
    patterns = (ASSIGN, ACCESS, HEX, RANDOM)
    return f"""
WITH t AS (SELECT doc_id, source AS owner, replace(coalesce(text, ''), chr(1), chr(2)) AS text,
        md5(coalesce(text, '')) AS digest FROM documents),
p AS ({" UNION ALL ".join(cut(k, x) for k, x in enumerate(patterns))}),
e AS (SELECT doc_id, owner, digest, kind, generate_subscripts(pieces, 1) AS pos, unnest(pieces) AS piece FROM p
      WHERE len(pieces) > 1),
s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e),
m AS (SELECT doc_id, owner, digest, kind, start, start + length(piece) AS stop, piece,
        CASE WHEN kind = 0 THEN regexp_extract(piece, '{quoted(ASSIGN)}', 2) ELSE piece END AS value
      FROM s WHERE pos % 2 = 0),
k AS (SELECT * FROM m WHERE CASE kind WHEN 0 THEN length(value) >= 8
        WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
        ELSE true END),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS n_owners,
        count(DISTINCT (coalesce(owner, chr(0)), digest)) AS n_repositories FROM k GROUP BY value),
j AS (SELECT k.*, n_owners <= {max_owners} AND n_repositories <= {max_repositories} AS live,
        ['{"', '".join(KINDS)}'][kind + 1] || ':' || start || ':' || stop AS shown FROM k JOIN o USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
        coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3 OR live), '') AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind < 3) AS n_copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans of ``scan``."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return scanned.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )
