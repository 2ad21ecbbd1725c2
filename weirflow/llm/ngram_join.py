"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set comparison decides.

Steps, each a Spark job over all documents:

1. Sets: the distinct five-word shingles of each text, as 64-bit hashes; a 128-bit digest of the sorted set names it.
   Documents with one set are copies: the set is one node, from here on.
2. Forest: in each of `trees` prefix tries, a node's label is its `deepest` minhashes. The tries are sorted arrays: labels in order,
   dealt by ranges, so a trie node with many members lies over many tasks. How far the labels of neighbours agree is the depth of
   the deepest trie node that holds both: runs of neighbours that agree to depth d are the trie nodes of depth d. A member is tied to
   the first of its run, at the depth to which it agrees with the one before it.
3. Rounds: prefixes start at full depth. Components of the ties are compared exactly (4), which tells of the least similarity
   of pairs about the threshold; prefixes are shortened until a pair like that shares one in some tree with the chance `recall`,
   and to `stop_depth`, where that holds for any pair at the threshold, if no pair is found. Components that a round changes
   are compared again, others aren't.
4. Verification: components are dealt as blocks of bounded size, all block pairs of a component as one task's group each. Inside,
   pairs meet by the shingles they share, whether or not they share a trie node, and only a spanning forest of the links and
   each member's number of links leave. So a group of m near copies makes rows in proportion to m times its number of
   blocks, not to m squared.
5. Classes: components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, hot_keys, join_hot, text_key

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 16, 8, 0.99
#: Shingles and members of a block, at most on average; two blocks are in memory at once.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 20, 1024
#: Pairs less similar than the threshold by this much still tell that there may be pairs at it.
NEAR = 0.15
#: Sets and classes with this share of all rows, and this many, are joined by broadcast.
HOT_SHARE, HOT_ROWS = 0.0005, 1000
_SEED, _BITS = 20_240_601, 16


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity shares a trie node with chance `recall` at least."""
    for depth in range(deepest, 0, -1):
        if chance(threshold, depth, trees) >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: lower-cased words between white space, `words` at a time.

    A text of fewer words is one shingle of all of them; without words, there is none.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype="uint64")
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("int64")
    word = hashes[codes] if len(codes) else np.zeros(0, "uint64")
    blank = xxhash.xxh3_64_intdigest("")
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    base = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(max(0, len(word) - words + 1), "uint64")
    for j in range(words):
        total = total * base + word[j : len(word) - words + 1 + j]
    total = _mix(total) if len(total) else total
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = word[a:b][word[a:b] != blank]  # white space at an end makes an empty word
        if len(own) != b - a:
            if len(own) < words:
                few = own
            else:
                own_total = np.zeros(len(own) - words + 1, "uint64")
                for j in range(words):
                    own_total = own_total * base + own[j : len(own) - words + 1 + j]
                sets.append(np.unique(_mix(own_total)))
                continue
        elif b - a >= words:
            sets.append(np.unique(total[a : b - words + 1]))
            continue
        else:
            few = own
        short = np.uint64(len(few))
        for h in few:
            short = short * base + h
        sets.append(_mix(np.array([short], "uint64")) if len(few) else np.zeros(0, "uint64"))
    return sets


class Forest:
    """Labels of a set: in each tree `deepest` minhashes of 16 bits, the first on top, as two numbers of 64 bits."""

    def __init__(self, trees: int, deepest: int):
        if not 1 <= deepest <= 8:
            raise ValueError("a label holds 8 minhashes at most")
        self.trees, self.deepest = trees, deepest
        rng = np.random.default_rng(_SEED)
        self.mul = rng.integers(1, 1 << 63, trees * deepest, dtype="uint64") | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, trees * deepest, dtype="uint64")

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        """High and low number of each tree in turn."""
        least = np.full(len(self.mul), np.iinfo("uint64").max, "uint64")
        for at in range(0, len(least), 16):
            own = slice(at, at + 16)
            for chunk in range(0, len(shingles), 4096):
                x = shingles[None, chunk : chunk + 4096] * self.mul[own, None] + self.add[own, None]
                least[own] = np.minimum(least[own], x.min(axis=1))
        small = np.zeros((self.trees, 8), "uint64")
        small[:, : self.deepest] = (_mix(least) & np.uint64((1 << _BITS) - 1)).reshape(self.trees, self.deepest)
        out = np.zeros((self.trees, 2), "uint64")
        for k in range(8):
            out[:, k // 4] |= small[:, k] << np.uint64(48 - _BITS * (k % 4))
        return out.ravel().view("int64")


def _neighbours(deepest: int, least: int):
    """(a, b, depth): a label a that agrees with the one before it to depth `least` or deeper, and the first b of its run at that
    depth, from rows in order of tree, label and node; and, with depth null, the first and the last row of the range. Only
    the last row and the first ones of its runs are remembered from batch to batch."""
    names = ["a", "b", "depth", "tree", "high", "low"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def end(row: tuple) -> pa.RecordBatch:
        tree, high, low, node = row
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((node, node, None, tree, high, low), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, high, low, node = (batch[c].to_numpy(zero_copy_only=False) for c in ("tree", "high", "low", "node"))
            if last is None:
                leaders = dict.fromkeys(range(least, deepest + 1), node[0])
            if last is None:
                yield end((tree[0], high[0], low[0], node[0]))
            else:
                tree, high, low, node = (np.concatenate([[x], y]) for x, y in zip(last, (tree, high, low, node), strict=True))
            last = tree[-1], high[-1], low[-1], node[-1]
            words = [(x[1:] ^ x[:-1]).view("uint64") for x in (high.astype("int64"), low.astype("int64"))]
            same, depth = tree[1:] == tree[:-1], np.zeros(len(tree) - 1, "int32")
            for k in range(deepest):
                same = same & ((words[k // 4] >> np.uint64(48 - _BITS * (k % 4))) == 0)
                depth += same
            first = node[:-1].copy()
            for d in range(least, deepest + 1):
                start = np.maximum.accumulate(np.where(depth < d, np.arange(1, len(node)), 0))  # 0: the run of the batch before
                leader = np.where(start > 0, node[start], leaders[d])
                first = np.where(depth == d, leader, first)
                leaders[d] = leader[-1] if len(leader) else leaders[d]
            own = depth >= least
            out = [node[1:][own], first[own], depth[own], tree[1:][own], high[1:][own], low[1:][own]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
        if last is not None:
            yield end(last)

    return run


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MB of text at most (or one row), so that arrays over their words stay bounded."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + (8 << 20), "right")))
            yield batch.slice(start, end - start)
            start = end


def _sets_of(words: int, forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sets = shingle_sets(batch["text"], words)
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            labels = [forest.labels(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["key"], pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(labels, pa.list_(pa.int64()))],
                names=["id", "key", "set", "n", "labels"],
            )

    return run


def _shingles_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            sets = shingle_sets(batch["text"], words)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*keep, "shingles"])

    return run


def _compare(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, root, least) of each member: its verified links to the other side, the least member it hangs with, and the least
    similarity of its pairs from threshold - NEAR on (2 if none).

    side is 0 or 1; with all members on one side, pairs within it count. Pairs meet by shared shingles, in a product of the
    incidence matrices of both sides, some shingles at a time.
    """
    m = len(sets)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(b)
    b = a if alone else b
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(start) - 1
    shared = np.bincount(column) > 1  # others are in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    both = np.zeros((len(a), len(b)), "float32")
    row = np.full(m, -1)
    row_b = np.full(m, -1)
    row[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    width = int(shared.sum())
    for at in range(0, width, 4096):
        own = (column >= at) & (column < at + 4096)
        x, y = np.zeros((len(a), 4096), "float32"), np.zeros((len(b), 4096), "float32")
        in_a, in_b = own & (row[owner] >= 0), own & (row_b[owner] >= 0)
        x[row[owner[in_a]], column[in_a] - at] = 1
        y[row_b[owner[in_b]], column[in_b] - at] = 1
        both += x @ y.T
    either = size[a][:, None] + size[b][None, :] - both
    linked = both >= threshold * either - 1e-6
    similar = both / either
    similar[similar < threshold - NEAR] = 2
    if alone:
        np.fill_diagonal(linked, False)
        np.fill_diagonal(similar, 2)
    least = np.full(m, 2.0)
    least[a] = similar.min(axis=1, initial=2)
    if not alone:
        least[b] = similar.min(axis=0, initial=2)
    links = np.zeros(m, "int64")
    links[a] += linked.sum(axis=1)
    if not alone:
        links[b] += linked.sum(axis=0)
    root = np.arange(m)
    while True:  # least label over links, until nothing changes
        new = root.copy()
        low_a = np.where(linked, root[b][None, :], m).min(axis=1)
        np.minimum.at(new, a, low_a)
        low_b = np.where(linked, root[a][:, None], m).min(axis=0)
        np.minimum.at(new, b, low_b)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, root, least
        root = new


_VERIFIED = "node bigint, root bigint, links bigint, least double"


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": [], "root": [], "links": []}).astype("int64").assign(least=0.0)]
        for _, group in pdf.groupby("component", sort=False):
            group = group.sort_values("node")
            if len(group) < 2 or group["crossed"].iloc[0] and group["side"].nunique() < 2:
                continue
            sets = [np.frombuffer(x, "uint64") for x in group["shingles"]]
            links, root, least = _compare(sets, group["side"].to_numpy(), threshold)
            names = group["node"].to_numpy()
            own = (links > 0) | (least < 2)
            out.append(pd.DataFrame({"node": names[own], "root": names[root[own]], "links": links[own], "least": least[own]}))
        return pd.concat(out)

    return run


def _trie_ties(reps: DataFrame, trees: int, deepest: int, least: int) -> DataFrame:
    """(a, b, depth) of sets that are neighbours in some tree's order, down to depth `least`."""
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.get("labels", 2 * t).alias("high"), F.get("labels", 2 * t + 1).alias("low")))
    entries = reps.select("node", F.explode(label).alias("x")).select("x.tree", "x.high", "x.low", "node")
    schema = "a bigint, b bigint, depth int, tree int, high bigint, low bigint"
    order = ["tree", "high", "low", "node"]
    found = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(deepest, least), schema))
    ends = found.where("depth is null").select("tree", "high", "low", F.col("a").alias("node"))  # two rows of each range
    across = ends.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours(deepest, least), schema)
    ties = cut(found.where("depth is not null").unionByName(across.where("depth is not null")).select("a", "b", "depth").where("a <> b"))
    drop(found)
    return ties


def _verified(where: DataFrame, loaded: DataFrame, threshold: float, block_shingles: int, block_members: int) -> DataFrame:
    """The verified links of components (node, component), whose shingles are loaded (node, n, shingles)."""
    placed = where.join(loaded, "node")
    sizes = placed.groupBy("component").agg(F.sum("n").alias("shingles"), F.count("*").alias("members"))
    blocks = F.greatest(F.ceil(F.col("shingles") / block_shingles), F.ceil(F.col("members") / block_members)).cast("int")
    sizes = cut(sizes.select("component", blocks.alias("blocks"), F.col("shingles").alias("total")))
    small = sizes.where("blocks = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bins = max(2 * int(where.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(small) // block_shingles))
    placed = placed.join(sizes.drop("total"), "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("x"), F.greatest("block", other).alias("y")))
    dealt = placed.withColumn("pair", F.explode(pair)).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "pair")).alias("bin"),
        "blocks", "component", "node", "shingles", (F.col("pair.x") != F.col("pair.y")).alias("crossed"),
        F.when((F.col("block") == F.col("pair.y")) & (F.col("pair.x") != F.col("pair.y")), 1).otherwise(0).alias("side"),
    )
    return dealt.groupBy("bin", "blocks").applyInPandas(_verify(threshold), _VERIFIED)


def _rounds(ties: DataFrame, loaded: DataFrame, threshold: float, trees: int, deepest: int, recall: float, block_shingles: int, block_members: int) -> DataFrame:
    """The verified links (node, root, links, least), from prefixes that are shortened until the target recall."""
    floor = stop_depth(threshold, trees, deepest, recall)
    depth, before, verified = deepest, None, None
    while True:
        where = cut(connected_components(ties.where(F.col("depth") >= depth)))
        if verified is None:
            verified = cut(_verified(where, loaded, threshold, block_shingles, block_members))
        else:
            new = ties.where((F.col("depth") >= depth) & (F.col("depth") < before)).select(F.explode(F.array("a", "b")).alias("node")).distinct()
            changed = cut(where.join(where.join(new, "node").select("component").distinct(), "component", "left_semi").select("node", "component"))
            again = _verified(changed, loaded, threshold, block_shingles, block_members)
            fresh = cut(verified.join(changed.select("node"), "node", "left_anti").unionByName(again))
            drop(verified, changed)
            verified = fresh
        drop(where)
        least = verified.agg(F.min("least")).first()[0]
        like = threshold if least is None else max(threshold, least)
        enough = [d for d in range(depth, floor - 1, -1) if chance(like, d, trees) >= recall]
        if depth == floor or least is not None and enough and enough[0] == depth:
            return verified.where("links > 0")
        depth, before = enough[0] if least is not None and enough else floor, depth


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    deepest: int = DEEPEST,
    recall: float = RECALL,
    block_shingles: int = BLOCK_SHINGLES,
    block_members: int = BLOCK_MEMBERS,
) -> DataFrame:
    """One row per document: id, key, class_id, class_key, class_size, links.

    Two documents are linked when the Jaccard similarity of their shingle sets is `threshold` or more; a class is a
    component of links. (class_id, class_key) is the first document of the class by id (nulls last) and key, class_size its number
    of documents. links is the number of other *sets* in link with the document's own: copies of one set count once.

    Texts without words (null, empty, blank) are classes of their own, with class_id null and links 0. A text of fewer
    words than a shingle is one shingle. Rows that repeat an id and text stay rows of one class; `key`
    (a hash of the text) tells rows with one id and different texts apart. A null id takes part in joins; a class
    of null ids only has class_id null. An empty table gives an empty result; other columns are not read.
    """
    floor = stop_depth(threshold, trees, deepest, recall)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    sets = cut(source.mapInArrow(_sets_of(words, Forest(trees, deepest)), f"id {id_type}, key bigint, set binary, n int, labels array<bigint>"))
    named = sets.select("id", "key", "set")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "key", "n")).alias("first")
    reps = sets.where("set is not null").groupBy("set").agg(first, F.count("*").alias("copies"), F.first("labels").alias("labels"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))  # numbers that a checkpoint holds fast
    ties = _trie_ties(reps, trees, deepest, floor)

    tied = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node").select("node", F.col("first.id").alias("i"), F.col("first.key").alias("k"), F.col("first.n").alias("n"))
    with_text = tied.join(source, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key"))).select("node", "n", "text").dropDuplicates(["node"])
    loaded = cut(with_text.mapInArrow(_shingles_of(words), "node bigint, n int, shingles binary"))
    verified = cut(_rounds(ties, loaded, threshold, trees, deepest, recall, block_shingles, block_members))

    drop(ties, loaded)
    classes = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "set", "first", "copies").join(classes, "node", "left").join(links, "node", "left")
    known = cut(known.select("set", "first", "copies", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links")))
    least = known.groupBy("class").agg(F.min("first").alias("least"), F.sum("copies").alias("class_size"))
    by_set = join_hot(known.select("set", "class", "links"), least, "class", hot_keys(known, "class", HOT_SHARE, HOT_ROWS), "inner")
    by_set = by_set.select("set", F.col("least.id").alias("class_id"), F.col("least.key").alias("class_key"), "class_size", "links")
    total = reps.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = reps.where(F.col("copies") >= max(HOT_ROWS, total * HOT_SHARE)).select("set")
    return join_hot(named, by_set, "set", hot, "left").select("id", "key", "class_id", "class_key", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"))


def join_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, links; nulls, ties and repeats as in ngram_join."""
    return ngram_join(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", "links")


def thin(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the least id, and of those the least key; of rows with its id and text, one.

    Texts without words all stay. All columns stay, whatever their names. An empty table stays empty.
    """
    found = cut(ngram_join(docs).where("class_size > 1"))
    wins: Column = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    gone = found.where(~wins).select("id", "key").distinct()
    twice = cut(found.where(wins).groupBy("id", "key").count().where("count > 1").select("id", "key"))
    kept = rows.join(gone, same(rows, gone), "left_anti")
    if twice.take(1):
        once = kept.join(twice, same(kept, twice), "left_semi").dropDuplicates(["id", "key"])
        kept = kept.join(twice, same(kept, twice), "left_anti").unionByName(once)
    return kept.select("row.*")


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM words)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS name FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b, x.name AS own, y.name AS other FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), classes AS (
  SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY doc_id
), counts AS (
  SELECT a AS doc_id, count(DISTINCT other) FILTER (own <> other) AS links FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(class_size, 1) AS class_size, coalesce(links, 0) AS links FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
