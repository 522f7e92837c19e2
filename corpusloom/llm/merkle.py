"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over the languages, a proof for each leaf.

A leaf is the SHA-256 of a row's fields, each with its length in front. In a tree every two consecutive nodes become the
hash of their digests (as hex text); a last node that is alone becomes the hash of its own. What remains is the subroot of
the language, and the subroots, in the languages' order, give the root in the same way.

Ranks come from one sort by ranges, and every tree is cut into aligned blocks of 2**LEVELS leaves. A first round takes the
blocks' roots (which are the leaves of the next tier, again in blocks, and so on until a node is left), and a second one
goes down again. In it each block runs Merkle traversal: a treehash stack for each level is advanced by the logarithmic
schedule, so that the authentication path of the next leaf is there when its turn comes; besides the block's digests a
task holds about three nodes for each level. The path above a block is the same for all its leaves and is put behind theirs.

Cases: a null field counts as ``-``. Null doc_ids come first, rows of one doc_id are ordered by leaf, and rows that are equal
in all fields have places of their own. Null is a language, the first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved

#: Levels of a block; it has 2**LEVELS leaves.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, fields)), 256))


def join_nodes(left: bytes | None, right: bytes | None) -> bytes | None:
    """The parent of two digests (as hex text); the right one, or both, may be missing."""
    if left is None:
        return None
    return hashlib.sha256(left + right if right else left).hexdigest().encode()


class Treehash:
    """The node of `height` over the leaves from `start`, made in steps; it holds one node a level at most."""

    def __init__(self, leaves: list[bytes], height: int, start: int, done: bytes | None = None, full: bool = False) -> None:
        self.leaves, self.height, self.at, self.value, self.stack = leaves, height, start, done, []
        self.low = 1 << 30 if full else height  # the height of the lowest node, by which the schedule picks

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right = stack.pop()
            stack[-1] = (level + 1, join_nodes(stack[-1][1], right))
        else:
            stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1
        self.low = stack[-1][0]
        if len(stack) == 1 and self.low == self.height:
            self.value, self.low = stack.pop()[1], 1 << 30


def treehash(leaves: list[bytes], height: int, seen: Callable[[int, int, bytes | None], None] | None = None) -> bytes:
    """The root over the leaves, 2**height at most. seen(level, index, node): called for every node below it."""
    stack: list[tuple[int, int, bytes | None]] = []
    for i in range(1 << height):
        node = (0, i, leaves[i] if i < len(leaves) else None)
        while True:
            if seen and node[0] < height:
                seen(*node)
            if not stack or stack[-1][0] != node[0]:
                break
            level, index, left = stack.pop()
            node = (level + 1, index // 2, join_nodes(left, node[2]))
        stack.append(node)
    return stack[0][2]


def traverse(leaves: list[bytes], height: int):
    """The siblings of each leaf in turn, from the lowest level up (None: no sibling there)."""
    path: list[bytes | None] = [None] * height
    first: list[bytes | None] = [None] * height

    def seen(level: int, index: int, node: bytes | None) -> None:
        if index == 0:
            first[level] = node
        elif index == 1:
            path[level] = node

    treehash(leaves, height, seen)
    stacks = [Treehash(leaves, h, 0, first[h], full=True) for h in range(height)]
    for i in range(len(leaves)):
        yield path
        for h in range(height):
            if (i + 1) & ((1 << h) - 1):
                break
            path[h] = stacks[h].value
            start = (i + 1 + (1 << h)) ^ (1 << h)
            stacks[h] = Treehash(leaves, h, start, full=start >= len(leaves))
        for _ in range(2 * height - 1):
            next_one = min(stacks, key=lambda s: s.low)
            if next_one.low == 1 << 30:
                break
            next_one.step()


def height_of(n: int, levels: int) -> int:
    """Levels between the leaves of a block and its root, in a tree of n nodes."""
    return levels if n > 1 << levels else (n - 1).bit_length()


def encode(path: list[bytes | None], i: int) -> bytes:
    """A path as bytes: for each level N, or L or R (where the sibling stands) and its digest."""
    return b"".join(b"N" if node is None else (b"L" if i >> h & 1 else b"R") + bytes.fromhex(node.decode()) for h, node in enumerate(path))


def siblings(path: bytes) -> list[tuple[str, bytes]]:
    out, at = [], 0
    while at < len(path):
        side = chr(path[at])
        size = 0 if side == "N" else 32
        out.append((side, path[at + 1 : at + 1 + size].hex().encode()))
        at += 1 + size
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give; digests as hex text."""
    for side, node in siblings(path):
        leaf = join_nodes(node, leaf) if side == "L" else join_nodes(leaf, node or None)
    return leaf


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _root(levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        n, i = block["n"][0].as_py(), block["i"][0].as_py()
        root = treehash(_hex(block["node"]), height_of(n, levels))
        row = {"n": pa.array([-(-n >> levels)], pa.int64()), "i": pa.array([i >> levels], pa.int64()), "node": pa.array([bytes.fromhex(root.decode())], pa.binary())}
        return pa.table({"tree": block["tree"][:1]} | row)

    return run


def _paths(keep: list[str], extra: list[str], levels: int):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({k: block[k] for k in keep} | {"path": pa.array([], pa.binary())} | {k: above[k][:0] for k in extra})
        block, upper = block.sort_by("i"), above["path"][0].as_py()
        leaves, height = _hex(block["node"]), height_of(block["n"][0].as_py(), levels)
        paths = [encode(path, i) + upper for i, path in enumerate(traverse(leaves, height))]
        return pa.table({k: block[k] for k in keep} | {"path": pa.array(paths, pa.binary())} | {k: pa.array([above[k][0].as_py()] * len(paths), above.schema.field(k).type) for k in extra})

    return run


def authenticate(nodes: DataFrame, tops, keep: list[str], levels: int) -> DataFrame:
    """Columns `keep`, path, and what `tops` adds, for nodes(tree, n, i, node, ...): node i of the n of a tree.

    tops: from the trees' roots (tree, n, i, node) to a row for each tree with column path (what comes above the tree) and others.
    """
    most, block = nodes.agg(F.max("n")).first()[0] or 0, F.shiftright("i", levels)
    tiers = [nodes]
    while most > 1:
        blocks = tiers[-1].select("tree", "n", "i", "node", block.alias("block"))
        tiers.append(saved(blocks.groupBy("tree", "block").applyInArrow(_root(levels), "tree long, n long, i long, node binary")))
        most = -(-most >> levels)
    above = tops(tiers[-1])
    extra = [c for c in above.columns if c not in ("tree", "i", "path")]
    for k, tier in reversed(list(enumerate(tiers[:-1]))):
        names = keep if k == 0 else ["tree", "i"]
        kinds = [f"`{c}` {tier.schema[c].dataType.simpleString()}" for c in names] + ["path binary"] + [f"`{c}` {above.schema[c].dataType.simpleString()}" for c in extra]
        blocks = tier.withColumn("block", block).groupBy("tree", "block")
        above = blocks.cogroup(above.withColumnRenamed("i", "block").groupBy("tree", "block")).applyInArrow(_paths(names, extra, levels), ", ".join(kinds))
    if len(tiers) == 1:  # no tree has more than a node
        return nodes.join(above.drop("i"), "tree").select(*keep, "path", *extra)
    return above


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves(lang, doc_id, leaf, ...) with tree (the language's number), n (its leaves) and i (the leaf's place among them).

    A sort by ranges of (lang, doc_id, leaf), then counts by range and language; no language meets in one task.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("__row").asc()]
    dealt = saved(leaves).withColumn("__row", F.monotonically_increasing_id())
    placed = saved(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("lang", "__part").agg(F.count("*").alias("here"), F.min("__at").alias("first"))
    by_lang = Window.partitionBy("lang")
    counts = counts.select(
        F.col("lang").alias("__lang"), F.col("__part").alias("__of"), F.sum("here").over(by_lang).alias("n"),
        (F.coalesce(F.sum("here").over(by_lang.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("lang").asc_nulls_first())) - 1).cast("long").alias("tree"),
    )  # fmt: skip  rows: a few more than the languages and the sort's ranges together
    joined = placed.join(counts, placed["lang"].eqNullSafe(counts["__lang"]) & (F.col("__part") == F.col("__of")))
    return saved(joined.withColumn("i", F.col("__at") + F.col("shift")).drop("__lang", "__of", "__part", "__at", "shift"))


def manifest(leaves: DataFrame, keep: tuple[str, ...] = ("doc_id",), levels: int = LEVELS) -> DataFrame:
    """Columns `keep`, leaf, path, subroot and root for each row of leaves(lang, doc_id, leaf, ...)."""
    nodes = ranked(leaves)

    def root(tops: DataFrame) -> DataFrame:
        return tops.select("tree", "i", F.lit(b"").alias("path"), F.col("node").alias("root"))

    def languages(tops: DataFrame) -> DataFrame:
        tops = saved(tops.select("tree", "n", "i", "node"))
        one = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(tops.count()).cast("long").alias("n"), F.col("tree").alias("i"), "node")
        paths = authenticate(one, root, ["i"], levels)
        return tops.select("tree", F.lit(0).cast("long").alias("i"), F.col("node").alias("subroot")).join(paths.withColumnRenamed("i", "tree"), "tree")

    return authenticate(nodes.withColumn("node", F.col("leaf")), languages, [*keep, "leaf"], levels)


def _digest(batches):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    for batch in batches:
        rows = {k: batch.column(k).to_pylist() for k in batch.schema.names}
        proofs, folded = [], []
        for leaf, altered, path in zip(rows["leaf"], rows["altered"], rows["path"], strict=True):
            proofs.append(hashlib.sha256(b"".join(node for _, node in siblings(path))).hexdigest())
            folded.append(fold((altered or leaf).hex().encode(), path).decode())
        texts = {k: [x.hex() for x in rows[k]] for k in ("leaf", "subroot", "root")}
        columns = [batch.column("doc_id"), *(pa.array(x, pa.string()) for x in (texts["leaf"], texts["subroot"], texts["root"], proofs, folded))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([a == b for a, b in zip(folded, texts["root"], strict=True)], pa.bool_())], list(names))


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest's proofs over documents, checked against rows some of which were tampered with."""
    fields = {k: F.col(k) for k in FIELDS}
    more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select("lang", "doc_id", leaf_of(*fields.values()).alias("leaf"), F.when(hit, leaf_of(*more.values())).alias("altered"))
    found = manifest(leaves, ("doc_id", "altered"), levels)
    return found.mapInArrow(_digest, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(read_table(spark, sf_dir, "documents"))


_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {" || ".join(_FRAMED.format(k) for k in FIELDS)} AS whole,
    {" || ".join(_FRAMED.format("(n_chars + 1)" if k == "n_chars" else k) for k in FIELDS)} AS other,
    xor(4294967295, list_reduce(CAST([4294967295] AS BIGINT[]) || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END)) AS crc
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER () AS r
  FROM (SELECT doc_id, lang, sha256(whole) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(other) ELSE sha256(whole) END AS shown FROM d)),
t AS (
  SELECT tree, 0 AS lvl, i, n, leaf AS h FROM l
  UNION ALL SELECT tree, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, lvl, n, i // 2),
s AS (SELECT tree, h FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, tree AS i, (SELECT count(*) FROM s) AS n, h FROM s
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, n, i // 2),
p AS (
  SELECT r, 0 AS part, a.lvl, CASE WHEN b.h IS NULL THEN 'N' WHEN b.i < a.i THEN 'L' || b.h ELSE 'R' || b.h END AS step
  FROM l JOIN t a ON a.tree = l.tree AND a.i = l.i >> a.lvl AND a.n > 1 LEFT JOIN t b ON b.tree = a.tree AND b.lvl = a.lvl AND b.i = xor(a.i, 1)
  UNION ALL
  SELECT r, 1, a.lvl, CASE WHEN b.h IS NULL THEN 'N' WHEN b.i < a.i THEN 'L' || b.h ELSE 'R' || b.h END
  FROM l JOIN u a ON a.i = l.tree >> a.lvl AND a.n > 1 LEFT JOIN u b ON b.lvl = a.lvl AND b.i = xor(a.i, 1)),
q AS (SELECT r, list(step ORDER BY part, lvl) AS steps FROM p GROUP BY r),
f AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(steps, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce([shown] || coalesce(steps, []), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END) AS folded_root
  FROM l JOIN s USING (tree) LEFT JOIN q USING (r))
SELECT *, folded_root = root AS verified FROM f
"""
