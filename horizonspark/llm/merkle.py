"""Merkle manifest of a dataset: a tree of digests for each branch and one above them, with a proof for each row.

The node store is one table for each level of the tree, written as Parquet. Leaves are sorted once, in ranges of (branch, order, leaf), so that each
has a coordinate: its place in its branch. A level is made from the one below it alone: every FANOUT consecutive nodes, found by their
coordinate, become one. A node keeps its children's digests, so that proofs are extracted from the top down by joining each
level to the one above by coordinate: a node's path is its siblings, then its parent's path. Paths are joined to runs of
leaves, not to each leaf, so what is moved falls by FANOUT from level to level. No branch is gathered in one task, and the driver sees the root alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch
from horizonspark.llm.minhash import BROADCAST_IDS

FANOUT = 8
#: Siblings to the left and right at each level, from the leaf up.
PATH = "array<struct<left: string, right: string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: each as its length in UTF-8 bytes, a colon and itself, or - if null."""
    texts = [v.cast("string") for v in values]
    return sha(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _placed(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """leaves with idx (the place in the branch, from 0) and n (the branch's size), sorted by branch, then order."""
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())  # spreads equal rows too
    keys = ["branch", *order, "tie"]
    runs = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("tie")
    runs = scratch.save(runs.withColumn("run", F.shiftright("at", 33).cast("int")))
    held = runs.groupBy("branch", "run").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("branch")
    before = F.coalesce(F.sum("held").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.save(held.select("branch", "run", (before - F.col("first")).alias("start"), F.sum("held").over(whole).alias("n")))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_IDS else starts
    return runs.join(starts, ["branch", "run"]).withColumn("idx", F.col("at") + F.col("start")).drop("at", "run", "start")


def _levels(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels above leaves (branch, idx, n, digest, payload): branch, idx, n, digest, kids (their digests and payloads)."""
    below, levels = leaves, []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parent = F.floor(F.col("idx") / FANOUT).cast("bigint")
        runs = below.where("n > 1").groupBy("branch", parent.alias("parent"), F.ceil(F.col("n") / FANOUT).alias("n"))
        kids = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *(["payload"] if not levels else [])))).alias("kids"))
        digest = F.sha2(F.concat_ws("", "kids.digest").cast("binary"), 256)
        below = scratch.save(kids.select("branch", F.col("parent").alias("idx"), "n", digest.alias("digest"), "kids"))
        levels.append(below)
        most = -(-most // FANOUT)
    return levels


@dataclass
class Manifest:
    """The node store: leaves and levels of the branches' trees, those of the tree above them, and the root (None without rows)."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def build_manifest(leaves: DataFrame, order: list[str], scratch: Scratch) -> Manifest:
    """The trees over leaves (branch, the columns of order, digest, payload). branch is not null; nulls come first in order, and ties are ordered by digest."""
    placed = scratch.save(_placed(leaves, [*order, "digest"], scratch).select("branch", "idx", "n", "digest", "payload"))
    levels = _levels(placed, scratch)
    ends = [df.where("n = 1").select("branch", "digest", F.lit(k).alias("level")) for k, df in enumerate([placed, *levels])]
    named = ends[0]
    for df in ends[1:]:
        named = named.unionByName(df)
    above = named.select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest", F.struct(F.col("branch").alias("name"), "level").alias("payload"))
    subroots = scratch.save(_placed(above, ["name"], scratch).select("branch", "idx", "n", "digest", "payload"))
    top = _levels(subroots, scratch)
    root = (top[-1] if top else subroots).select("digest").first()
    return Manifest(placed, levels, subroots, top, root and root[0])


def _below(nodes: DataFrame, *carried: str) -> DataFrame:
    """The children of nodes that know their path: branch, idx, digest, payload (if there), path and the carried columns."""
    digests, at = F.col("kids.digest"), F.col("at")
    left = F.concat_ws("", F.slice(digests, F.lit(1), at))
    right = F.concat_ws("", F.slice(digests, at + 2, F.size("kids")))
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
    return nodes.select("*", F.posexplode("kids").alias("at", "kid")).select("branch", "kid.*", path.alias("path"), *carried)


def proofs(m: Manifest) -> DataFrame:
    """branch, digest, payload, subroot and path of each leaf."""
    empty = F.array().cast(PATH)
    if not m.top:
        known = m.subroots.select("digest", "payload", empty.alias("path"))
    else:
        nodes = m.top[-1].withColumn("path", empty)
        for level in m.top[-2::-1]:
            nodes = level.join(_below(nodes).select("branch", "idx", "path"), ["branch", "idx"])
        known = _below(nodes).select("digest", "payload", "path")
    ends = known.select(F.col("payload.name").alias("branch"), F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("subroot"), "path", F.col("payload.level").alias("level"))
    columns, nodes = ["branch", "idx", "subroot", "path"], None
    for k in range(len(m.levels), 0, -1):
        paths = ends.where(F.col("level") == k).select(columns)
        if nodes is not None:
            paths = paths.unionByName(_below(nodes, "subroot").select(columns))
        nodes = m.levels[k - 1].join(paths, ["branch", "idx"])
    alone = m.leaves.where("n = 1").join(ends.where("level = 0").drop("idx", "level"), "branch").select("branch", "digest", "payload", "subroot", "path")
    return alone if nodes is None else alone.unionByName(_below(nodes, "subroot").drop("idx"))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    return sha(F.concat_ws("", F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"])))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda held, p: sha(p["left"], held, p["right"]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), branch: str = "lang", order: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the order column, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of columns; there is a tree for each value of branch and one over them (null first). As an audit of the proofs themselves, the rows whose order value has an
    unsigned crc32 that 3 divides are tampered with (text in ASCII lower case), and folded_root is what a row, tampered or not, gives with its
    proof: verified tells whether that is the root. So a tampered row without capitals still verifies.

    Nulls of any column count (as -); a null branch is a branch of its own, and rows with a null order come first and are not tampered with. Empty and very
    long values are digested whole. Rows that repeat an order value are ordered by their leaf; equal rows have equal leaves, so their order does not matter.
    A branch of one row has its leaf as subroot; one branch alone makes the root its subroot, and a single row's proof is the digest of nothing. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    values = [F.col(f"`{c}`") for c in columns]
    lowered = [ascii_lower(v) if c == text else v for c, v in zip(columns, values, strict=True)]
    tampered = F.when(F.crc32(F.col(order).cast("string").cast("binary")) % 3 == 0, leaf_digest(*lowered))
    key, place = F.coalesce(F.concat(F.lit("="), F.col(branch).cast("string")), F.lit("")), F.col(order)
    leaves = scratch.save(docs.select(key.alias("branch"), place.alias("place"), leaf_digest(*values).alias("digest"), F.struct(place.alias("place"), tampered.alias("tampered")).alias("payload")))
    m = build_manifest(leaves, ["place"], scratch)
    root = F.lit(m.root).cast("string")
    seen = folded(F.coalesce("payload.tampered", "digest"), F.col("path"))
    out = proofs(m).select(F.col("payload.place").alias(order), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), seen.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same as SQL, one level of the trees after another.
SQL = """
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    v AS (SELECT row_number() OVER () AS rid, doc_id, lang,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
    d AS (SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0
                      THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM v, crc),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
    nodes(lvl, lang, idx, n, h) AS (
        SELECT 0, lang, idx, n, leaf FROM leaves
        UNION ALL
        SELECT lvl + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, lang, idx // 8, (n + 7) // 8),
    tops(lvl, idx, n, h) AS (
        SELECT 0, row_number() OVER (ORDER BY lang NULLS FIRST) - 1, count(*) OVER (), h FROM nodes WHERE n = 1
        UNION ALL
        SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 8, (n + 7) // 8),
    names AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
    fold(rid, lang, lvl, idx, h, siblings) AS (
        SELECT rid, lang, 0, idx, coalesce(tampered, leaf), '' FROM leaves
        UNION ALL
        SELECT f.rid, f.lang, f.lvl + 1, f.idx // 8, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.h ELSE s.h END, '' ORDER BY s.idx)), f.siblings || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> f.idx), '')
        FROM fold f JOIN nodes s ON s.lvl = f.lvl AND s.lang IS NOT DISTINCT FROM f.lang AND s.idx // 8 = f.idx // 8 WHERE s.n > 1 GROUP BY f.rid, f.lang, f.lvl, f.idx, f.siblings),
    rise(rid, lvl, idx, h, siblings) AS (
        SELECT f.rid, 0, m.idx, f.h, f.siblings FROM fold f JOIN nodes s ON s.lvl = f.lvl AND s.lang IS NOT DISTINCT FROM f.lang AND s.n = 1 JOIN names m ON m.lang IS NOT DISTINCT FROM f.lang
        UNION ALL
        SELECT f.rid, f.lvl + 1, f.idx // 8, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.h ELSE s.h END, '' ORDER BY s.idx)), f.siblings || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> f.idx), '')
        FROM rise f JOIN tops s ON s.lvl = f.lvl AND s.idx // 8 = f.idx // 8 WHERE s.n > 1 GROUP BY f.rid, f.lvl, f.idx, f.siblings),
    root AS (SELECT lvl, h FROM tops WHERE n = 1)
    SELECT doc_id, leaf, subroot, root.h AS root, sha256(r.siblings) AS proof_sha256, r.h AS folded_root, r.h = root.h AS verified
    FROM leaves l JOIN names m ON m.lang IS NOT DISTINCT FROM l.lang JOIN rise r ON r.rid = l.rid JOIN root ON r.lvl = root.lvl"""
