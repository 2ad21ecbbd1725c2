"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups' roots, and proofs of rows.

Blocks: a tree's leaves in order are cut into aligned subtrees of HEIGHT levels of hashing, one row each. A block's nodes lie
in one binary value in van Emde Boas order: a tree of so many levels is cut at half height into a top and the subtrees below it, the top
lies first, then its subtrees from left to right, and each of them is laid out in the same way. Where a node lies follows from its depth
and number alone (`address`), so a walk from a leaf to its root touches few stretches of memory whatever the size of a cache line or
page, and no pointers are kept. Construction writes children and reads them by these addresses; proofs read siblings by them. The
blocks' roots are the leaves of the next blocks, until one block is left; the groups' roots then make a tree in the same way.

Jobs: rows become digests where they are read, and texts go no further. Digests are dealt by ranges of (group, id), so a group
with most rows lies over many tasks; ranks come of positions within ranges and of counts by range. Blocks have fanout ** HEIGHT leaves at
most, so no task ever holds a group. Proofs are made block by block, from the top down.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import cut, drop

FANOUT, HEIGHT = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nodes_of(levels: int, fanout: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (fanout**levels - 1) // (fanout - 1)


def address(depth: int, number: np.ndarray, levels: int, fanout: int) -> np.ndarray:
    """Where nodes lie in the van Emde Boas order of a complete tree: by depth (0 is the root's) and number within the depth."""
    number = np.asarray(number, "int64")
    at = np.zeros_like(number)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = fanout ** (depth - top)
        at = at + nodes_of(top, fanout) + number // below * nodes_of(levels - top, fanout)
        number, depth, levels = number % below, depth - top, levels - top
    return at


def digest_of(nodes: list[bytes]) -> bytes:
    """SHA-256 of digests, one after the other as lowercase hex."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


class Block:
    """An aligned subtree: `count` leaves below `height` levels of hashing, its nodes in one buffer."""

    def __init__(self, count: int, height: int, fanout: int, nodes: bytes | None = None):
        self.height, self.fanout, self.levels = height, fanout, height + 1
        self.counts = [-(-count // fanout**up) for up in range(height, -1, -1)]  # nodes at each depth
        size = nodes_of(self.levels, fanout)
        self.nodes = np.zeros((size, 32), "uint8") if nodes is None else np.frombuffer(nodes, "uint8").reshape(size, 32)

    @classmethod
    def built(cls, leaves: list[bytes], height: int, fanout: int) -> Block:
        block = cls(len(leaves), height, fanout)
        block.nodes[address(height, np.arange(len(leaves)), block.levels, fanout)] = np.frombuffer(b"".join(leaves), "uint8").reshape(-1, 32)
        for depth in range(height - 1, -1, -1):
            made = [digest_of(block.run(depth + 1, parent)) for parent in range(block.counts[depth])]
            block.nodes[address(depth, np.arange(len(made)), block.levels, fanout)] = np.frombuffer(b"".join(made), "uint8").reshape(-1, 32)
        return block

    def run(self, depth: int, parent: int) -> list[bytes]:
        """The children of a node, left to right."""
        children = np.arange(parent * self.fanout, min((parent + 1) * self.fanout, self.counts[depth]))
        return [x.tobytes() for x in self.nodes[address(depth, children, self.levels, self.fanout)]]

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def proofs(self) -> Iterator[tuple[bytes, bytes]]:
        """(siblings, shape) of each leaf, up to the block's root: siblings level by level, left to right; of each level its place and their number."""
        beside = {}
        for depth in range(1, self.levels):
            for parent in range(self.counts[depth - 1]):
                run = self.run(depth, parent)
                for place in range(len(run)):
                    beside[depth, parent * self.fanout + place] = b"".join(run[:place] + run[place + 1 :]), bytes([place, len(run) - 1])
        for leaf in range(self.counts[-1]):
            steps = [beside[depth, leaf // self.fanout ** (self.height - depth)] for depth in range(self.height, 0, -1)]
            yield b"".join(s for s, _ in steps), b"".join(s for _, s in steps)


def levels_of(count: int, fanout: int) -> int:
    """How often `count` nodes are hashed together until one remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def folded(leaf: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for place, number in zip(shape[::2], shape[1::2], strict=True):
        run = [siblings[at + 32 * i : at + 32 * (i + 1)] for i in range(number)]
        leaf, at = digest_of(run[:place] + [leaf] + run[place:]), at + 32 * number
    return leaf


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, as binary, of each field: `-` if null, else its length in bytes of UTF-8, a colon and its value."""
    text = lambda c: c.cast("string")
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in fields]), 256))


def group_key(group: Column) -> Column:
    """A string that orders groups with null first and then by their bytes, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def ranked(items: DataFrame, order: list[str]) -> DataFrame:
    """items (tree, ..., digest) with `rank` in their tree by the columns of order, nulls first, and `total`, the tree's number of items.

    Equal rows rank in any order, as their digests are equal too if order ends in the digest.
    """
    by = ["tree", *order]
    lined = items.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by, "salt").sortWithinPartitions(*by, "salt").drop("salt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lined.schema)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch["tree"].dictionary_encode()
            tree = code.indices.to_numpy()
            starts = np.flatnonzero(np.diff(tree, prepend=-1))
            place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(starts, append=batch.num_rows))
            if code.dictionary[tree[0]].as_py() == last:
                place[: starts[1] if len(starts) > 1 else None] += at
            last, at = code.dictionary[tree[-1]].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, "int32")), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    placed = cut(lined.mapInArrow(positions, f"{schema}, part int, place bigint"))
    counts = placed.groupBy("tree", "part").count()  # a row for each range that a tree lies in
    before = F.coalesce(F.sum("count").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "part", before.alias("before"), F.sum("count").over(Window.partitionBy("tree")).alias("total"))
    out = cut(placed.join(offsets, ["tree", "part"]).select(*items.columns, (F.col("before") + F.col("place")).alias("rank"), "total"))
    drop(placed)
    return out


_BLOCK = "tree string, block bigint, total bigint, count int, height int, nodes binary, root binary"


def _built(fanout: int, step: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, block, total = key
        height = max(0, min(step, levels_of(int(total), fanout) - step * level))
        built = Block.built(pdf.sort_values("rank")["digest"].tolist(), height, fanout)
        return pd.DataFrame({"tree": [tree], "block": [block], "total": [total], "count": [len(pdf)], "height": [height], "nodes": [built.nodes.tobytes()], "root": [built.root()]})

    return run


def blocks(items: DataFrame, fanout: int = FANOUT, step: int = HEIGHT) -> list[DataFrame]:
    """The blocks of the trees over items (tree, rank, digest, total), level by level: tree, block, total, count, height, nodes, root.

    A tree of one item is one block of height 0. Without items there is one level without blocks.
    """
    width, levels, current = fanout**step, [], items.select("tree", "rank", "digest", "total")
    while True:
        dealt = current.withColumn("block", F.floor(F.col("rank") / width))
        level = cut(dealt.groupBy("tree", "block", "total").applyInPandas(_built(fanout, step, len(levels)), _BLOCK))
        levels.append(level)
        more = level.where(F.col("total") > F.lit(width ** len(levels)).cast("decimal(38,0)"))
        if not more.take(1):
            return levels
        current = more.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"), "total")


def _proved(fanout: int, names: list[str]):
    def run(members: pd.DataFrame, store: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(store):
            return pd.DataFrame(columns=[*names, "proof", "shape", "top"])
        b = store.iloc[0]
        members = members.sort_values("rank")
        own = list(Block(int(b["count"]), int(b["height"]), fanout, b["nodes"]).proofs())
        places = members["rank"] - members["rank"].iloc[0]  # a block's members are all there
        return members[names].assign(proof=[own[i][0] + b["proof"] for i in places], shape=[own[i][1] + b["shape"] for i in places], top=b["top"])

    return run


def proofs(members: DataFrame, level: DataFrame, fanout: int = FANOUT, step: int = HEIGHT) -> DataFrame:
    """members (tree, rank, ...) of a level's blocks with proof, shape and top, which the blocks have themselves: siblings and shape up to
    the root, and their tree's root."""
    names = members.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", proof binary, shape binary, top binary"
    left = members.withColumn("parent", F.floor(F.col("rank") / fanout**step)).groupBy("tree", "parent")
    right = level.select("tree", F.col("block").alias("parent"), "count", "height", "nodes", "proof", "shape", "top").groupBy("tree", "parent")
    return left.cogroup(right).applyInPandas(_proved(fanout, names), schema)


def proved_blocks(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT, step: int = HEIGHT) -> DataFrame:
    """The lowest blocks with proof and shape from their roots up, and top; above has those of each tree's root (tree, proof, shape, top)."""
    over = None
    for n in range(len(levels) - 1, -1, -1):
        level = levels[n]
        last = F.col("total") <= F.lit((fanout**step) ** (n + 1)).cast("decimal(38,0)")
        done = level.where(last).join(above, "tree")  # one block a tree
        if over is not None:
            below = level.where(~last).withColumn("rank", F.col("block"))
            done = done.unionByName(proofs(below, over, fanout, step).drop("rank"))
        over = done
    return over


class Manifest:
    """Blocks of all groups and of the tree over them. Tables are checkpoints: `close` deletes them."""

    def __init__(self, items: DataFrame, fanout: int, step: int):
        self.items, self.fanout, self.step = items, fanout, step
        self.levels = blocks(items, fanout, step)
        tops = [level.where(F.col("total") <= F.lit((fanout**step) ** (n + 1)).cast("decimal(38,0)")) for n, level in enumerate(self.levels)]
        roots = tops[0]
        for top in tops[1:]:
            roots = roots.unionByName(top)
        #: A row a group: name (its key), digest (its root), rank among the groups.
        self.roots = ranked(roots.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"])
        self.upper = blocks(self.roots, fanout, step)
        top = self.upper[-1].select("root").first()
        self.root: bytes | None = bytes(top.root) if top else None

    def proofs(self) -> DataFrame:
        """items with top (their group's root), proof (the siblings' digests, one after the other) and shape (two bytes a level: own place, siblings)."""
        whole = self.items.sparkSession.createDataFrame([("", b"", b"", self.root)], "tree string, proof binary, shape binary, top binary")
        groups = proofs(self.roots.select("tree", "rank", "name", "digest"), proved_blocks(self.upper, whole, self.fanout, self.step), self.fanout, self.step)
        above = groups.select(F.col("name").alias("tree"), "proof", "shape", F.col("digest").alias("top"))
        lowest = proved_blocks(self.levels, above, self.fanout, self.step)
        return proofs(self.items, lowest, self.fanout, self.step)

    def close(self) -> None:
        drop(self.items, self.roots, *self.levels, *self.upper)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, claim: Column | None = None, fanout: int = FANOUT, step: int = HEIGHT) -> Manifest:
    """The manifest of a table: rows' digests in order of id within each group. items has tree, id, group, digest, claim, rank, total.

    claim is an expression over docs that goes along with each row, such as the digest of the row as another replica has it.
    A null in any field has a digest of its own (`-`); a null group is the first group, a null id the first of its group; rows with one id
    go by their digests, so repeated rows have the same digest whatever their order. Texts are hashed whole. Other columns aren't
    read. Without rows there is no root.
    """
    quoted = lambda c: F.col(f"`{c}`")
    leaves = docs.select(
        group_key(quoted(group_col)).alias("tree"), quoted(id_col).alias("id"), quoted(group_col).alias("group"),
        leaf_digest([quoted(c) for c in fields]).alias("digest"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
    )
    leaves = cut(leaves)
    items = ranked(leaves, ["id", "digest"])
    drop(leaves)
    return Manifest(items, fanout, step)


def root_of(leaf: Column, proof: Column, shape: Column) -> Column:
    """The root, as binary, that a leaf and its proof lead to; null if one of them is null."""

    def run(leaves: pa.Array, proofs: pa.Array, shapes: pa.Array) -> pa.Array:
        rows = zip(leaves.to_pylist(), proofs.to_pylist(), shapes.to_pylist(), strict=True)
        return pa.array([None if None in row else folded(*row) for row in rows], pa.binary())

    run.__annotations__ = {"leaves": pa.Array, "proofs": pa.Array, "shapes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(leaf, proof, shape)


def lowered(text: Column) -> Column:
    """A text with its letters A to Z in lower case and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def report(docs: DataFrame) -> DataFrame:
    """One row per document, repeats too: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Of every third document, by the CRC-32 of its id, the text is tampered with: its letters A to Z are lowered. A null id is never
    among them, a null text stays null, and a text without such letters is still verified. The proof of a table's only document is
    empty. Null groups and ids come first; an empty table gives no rows.
    """
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = leaf_digest([lowered(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    made = manifest(docs.select(*FIELDS), claim=F.when(third, tampered))
    hexed = lambda c: F.lower(F.hex(c))
    rows = made.proofs().select("id", "digest", F.coalesce("claim", "digest").alias("shown"), "proof", "shape", "top")
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    out = rows.select(
        F.col("id").alias("doc_id"), hexed("digest").alias("leaf"), hexed("top").alias("subroot"), root.alias("root"),
        F.sha2(hexed("proof").cast("binary"), 256).alias("proof_sha256"), hexed(root_of(F.col("shown"), F.col("proof"), F.col("shape"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels by recursion: nodes of a tree, then of the tree over the subroots; a document's walk folds both.
ORACLE = r"""
WITH RECURSIVE named AS (
  SELECT *, coalesce('+' || lang, '') AS tree,
    list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda crc, byte:
      list_reduce([xor(crc, byte)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS fields
  FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, tree, leaf, shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT doc_id, tree, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(fields || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE leaf END AS shown
    FROM named)
), nodes(tree, level, i, n, d) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n
), subroots AS MATERIALIZED (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper(level, i, n, d) AS (
  SELECT 0, k, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n
), every AS MATERIALIZED (
  SELECT tree, level, i, n, d FROM nodes UNION ALL SELECT '*', level, i, n, d FROM upper
), beside AS MATERIALIZED (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS pre, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS post
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
), walk(doc_id, tree, leaf, level, place, n, d, proof) AS (
  SELECT doc_id, tree, leaf, 0, i, n, shown, '' FROM leaves
  UNION ALL
  SELECT doc_id, walk.tree, leaf, walk.level + 1, place // 8, (n + 7) // 8, sha256(pre || d || post), proof || pre || post FROM walk JOIN beside ON walk.tree = beside.tree AND walk.level = beside.level AND place = beside.i
), climb(doc_id, leaf, subroot, level, place, n, d, proof) AS (
  SELECT doc_id, leaf, subroot, 0, k, subroots.n, d, proof FROM walk JOIN subroots USING (tree) WHERE walk.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, climb.level + 1, place // 8, (n + 7) // 8, sha256(pre || d || post), proof || pre || post FROM climb JOIN beside ON beside.tree = '*' AND climb.level = beside.level AND place = beside.i
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
FROM climb, (SELECT d AS root FROM upper WHERE n = 1) WHERE n = 1
"""
