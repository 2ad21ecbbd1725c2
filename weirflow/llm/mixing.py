"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into permuted blocks (by a keyed hash). A source whose target is e times its size
and a rest gives every block e times, and of one more pass the first blocks in permuted order until the rest is
reached; the last of them gives its documents up to a cutoff in hash order. These block draws are the source's
quota. A binary tree splits the quotas of all sources among the output shards: at each node, the left half's counts
are one multivariate-hypergeometric draw from the node's, so every shard gets its exact number of blocks and each
source's total is exact. A shard then takes the next blocks of the source's permuted draws, disjoint from those of
any other shard, and shuffles its documents by hash. What the mix takes of a document are its places in the shards' draws.

Numbers of blocks and shards grow with the square root of the words, so that both a block and their number stay moderate.
Sources are dealt to strata; a tree on the driver splits the strata, STRATA at most, and one tree for each stratum, in a task,
splits its sources within what the stratum has in each shard. Draws of a hypergeometric split in two steps are draws of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_key

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
#: A source of n words has sqrt(n / BLOCK_UNIT) blocks, a mix of n words sqrt(n / SHARD_UNIT) shards, rounded up.
BLOCK_UNIT, SHARD_UNIT = 400, 50_000
#: Rows of the splitting tree on the driver, at most.
STRATA = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size), one row a source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at
    MOST_REPEATS times its source's size. In order of cap / weight, the capped sources are a prefix, and the
    level (target / weight) of the others is what the prefix leaves, over the weights of the rest.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_level), F.lit(0))
    left = ranked.withColumn("left", F.sum("source_size").over(everything) - before("cap")).withColumn("weights", F.sum("weight").over(everything) - before("weight"))
    left = left.withColumn("capped", F.col("cap") * F.col("weights") <= F.col("weight") * F.col("left"))
    level = F.max(F.when(~F.col("capped"), F.struct(F.col("weights"), F.col("left")))).over(everything)  # the first that isn't capped has most weights left
    left = left.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.weights"))
    return left.select("source", "source_size", "rank", "weight", target.alias("target"))


def split(quotas: np.ndarray, shards: int, seed: int = 1, sizes: np.ndarray | None = None) -> np.ndarray:
    """counts[shard, stratum]: the quotas split among shards of these sizes, which are (nearly) equal if not given."""
    rng = np.random.default_rng(seed)
    total = int(quotas.sum())
    ends = [total * i // shards for i in range(shards + 1)] if sizes is None else [0, *map(int, np.cumsum(sizes))]
    counts = np.zeros((shards, len(quotas)), "int64")
    nodes = [(0, shards, quotas.astype("int64"))]
    while nodes:
        a, b, own = nodes.pop()
        if b - a == 1:
            counts[a] = own
            continue
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(own, ends[mid] - ends[a], method="marginals") if own.sum() else own
        nodes += [(a, mid, left), (mid, b, own - left)]
    return counts


def _split_stratum(shards: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """(rank, ends): how many draws of each source the shards up to each have."""
        pdf = pdf.sort_values("rank")
        counts = split(pdf["quota"].to_numpy("int64"), shards, seed + 1 + int(pdf["stratum"].iloc[0]), np.array(pdf["sizes"].iloc[0], "int64"))
        return pd.DataFrame({"rank": pdf["rank"].to_numpy("int64"), "ends": [[int(x) for x in np.cumsum(c)] for c in counts.T]})

    return run


def _number(*parts: Column | str) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def allot(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", shards: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: id, key, source, size, place (its hash order), block, source_size, target of each row of docs.
    draws: source, block, pass, shard and limit: the rows of that block with place <= limit are in that shard.
    """
    key = F.lit(str(seed))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    place = _number(F.col(f"`{id_col}`").cast("string"), F.sha2(text, 256), key)
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{source_col}`").cast("string").alias("source"), words(text).alias("size"), place.alias("place")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("int")
    many = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / F.lit(float(BLOCK_UNIT))))).cast("bigint")
    targets = cut(targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("blocks", many))
    shards = shards or max(1, math.ceil(math.sqrt((targets.agg(F.sum("target")).first()[0] or 0) / SHARD_UNIT)))
    same = sized["source"].eqNullSafe(targets["source"])
    placed = sized.join(targets, same).select("id", "key", sized["source"], "size", "place", (F.col("place") % F.col("blocks")).alias("block"), "source_size", "target", "passes", "rest", "rank")
    blocks = placed.groupBy("source", "rank", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("rank").orderBy(_number(F.col("rank").cast("string"), F.col("block").cast("string"), key), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    blocks = cut(blocks.withColumn("room", F.when(F.col("before") < F.col("rest"), F.col("rest") - F.col("before"))))
    # the block in which a source's rest ends: its documents in hash order, to the nearest
    ends = blocks.where("room < words").select("rank", "block", "room")
    inside = placed.select("rank", "block", "place", "size").join(ends, ["rank", "block"])
    so_far = F.sum("size").over(Window.partitionBy("rank", "block").orderBy("place"))
    cutoff = inside.withColumn("so_far", so_far).where(F.col("so_far") <= F.col("room") + F.col("size") / 2).groupBy("rank", "block").agg(F.max("place").alias("limit"))
    top = F.lit(2**63 - 1)
    rested = blocks.where("room is not null").join(cutoff, ["rank", "block"], "left").where("room >= words or limit is not null")
    rested = rested.select("source", "rank", "block", F.lit(0).alias("pass"), F.when(F.col("room") >= F.col("words"), top).otherwise(F.col("limit")).alias("limit"))
    full = blocks.where("passes > 0").select("source", "rank", "block", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"), top.alias("limit"))
    turn = F.row_number().over(Window.partitionBy("rank").orderBy(_number(F.col("rank").cast("string"), F.col("block").cast("string"), F.col("pass").cast("string"), key, F.lit("turn")), "block", "pass")) - 1
    draws = cut(full.unionByName(rested).withColumn("turn", turn))

    own = draws.groupBy("rank").agg(F.count("*").alias("quota")).withColumn("stratum", (F.col("rank") % STRATA).cast("int"))
    strata = sorted(tuple(r) for r in own.groupBy("stratum").agg(F.sum("quota")).collect())  # STRATA rows at most
    counts = split(np.array([n for _, n in strata], "int64"), shards, seed) if strata else np.zeros((shards, 0), "int64")
    parts = docs.sparkSession.createDataFrame([(s, [int(x) for x in counts[:, i]]) for i, (s, _) in enumerate(strata)], "stratum int, sizes array<long>")
    bounds = own.join(parts, "stratum").groupBy("stratum").applyInPandas(_split_stratum(shards, seed), "rank bigint, ends array<bigint>")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("turn")))
    draws = draws.join(bounds, "rank").where(F.col("turn") < F.element_at("ends", -1)).select("source", "block", "pass", shard.alias("shard"), "limit")
    return placed.drop("passes", "rest", "rank"), draws


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted) and shards, one entry for each time it is taken.

    Null texts have size 0, as have empty ones; a null source is a source, the last. Rows that repeat have one place in
    hash order, so they are taken alike. A table without words has targets 0; an empty one, no rows. Very long texts are rows like others.
    """
    documents, draws = allot(docs)
    mine = draws.groupBy("source", "block").agg(F.collect_list(F.struct("shard", "limit")).alias("draws"))
    joined = documents.alias("d").join(mine.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.block") == F.col("m.block")), "left")
    own = F.filter(F.coalesce("draws", F.expr("array()").cast("array<struct<shard:int,limit:bigint>>")), lambda x: F.col("place") <= x["limit"])
    found = joined.withColumn("shards", F.array_sort(F.transform(own, lambda x: x["shard"])))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, shards: int | None = None, seed: int = 1) -> DataFrame:
    """The mix: the columns of docs, with mix_shard, mix_pass and mix_position (from 0 in each shard), which replace columns of their names.

    Positions are given to rows of keys; texts pass one shuffle. Null and empty texts have no words and may be in the mix; a null source is a
    source; of rows that repeat in id, text and source all go where one goes, one after another. An empty table gives an empty mix.
    """
    documents, draws = allot(docs, shards=shards, seed=seed)
    where = documents.groupBy("id", "key", "source", "place", "block").agg(F.count("*").alias("copies"))
    taken = where.alias("d").join(draws.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block"))).where("place <= limit")
    taken = taken.select("id", "key", F.col("d.source").alias("source"), "place", "copies", F.col("pass").alias("mix_pass"), F.col("shard").alias("mix_shard"))
    order = Window.partitionBy("mix_shard").orderBy(F.xxhash64("place", "mix_pass", F.lit(seed)), "place", "mix_pass")
    taken = taken.withColumn("first", F.sum("copies").over(order) - F.col("copies"))
    names = [c for c in docs.columns if c not in ("mix_shard", "mix_pass", "mix_position")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("i"), text_key(F.col("text")).alias("k"), F.col("source").cast("string").alias("s"))
    found = rows.join(taken, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")) & F.col("s").eqNullSafe(F.col("source")))
    single = found.where("copies = 1").withColumn("mix_position", F.col("first"))
    again = Window.partitionBy("i", "k", "s", "mix_pass", "mix_shard").orderBy(F.lit(0))
    several = found.where("copies > 1").withColumn("mix_position", F.col("first") + F.row_number().over(again) - 1)
    out = single.unionByName(several)
    return out.select("row.*", "mix_shard", "mix_pass", F.col("mix_position").cast("int").alias("mix_position"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || sha256(concat_ws('|', doc_id::VARCHAR, sha256(coalesce(text, '')), '1'))[1:15])::BIGINT AS place FROM documents
), ranked AS (
  SELECT *, rank % 3 + 1 AS weight, source_size * {MOST_REPEATS} AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source)
), lefts AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::BIGINT AS rest_, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS weights
  FROM ranked WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_max(rest_, weights) AS rest_, max(weights) AS weights FROM lefts WHERE cap * weights > weight * rest_
), targets AS (
  SELECT source, source_size, rank, CASE WHEN cap * l.weights <= weight * l.rest_ THEN cap::DOUBLE ELSE weight * level.rest_ / level.weights END AS target FROM lefts l, level
), plans AS (
  SELECT *, target - passes * source_size AS rest, greatest(1, ceil(sqrt(source_size / {BLOCK_UNIT}.0::DOUBLE)))::BIGINT AS blocks
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST_REPEATS})::BIGINT ELSE 0 END AS passes FROM targets)
), placed AS (
  SELECT doc_id, size, place, place % blocks AS block, p.* FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
), sums AS (
  SELECT rank, block, rest, sum(size)::BIGINT AS words FROM placed GROUP BY ALL
), rooms AS (
  SELECT *, rest - (sum(words) OVER (PARTITION BY rank ORDER BY sha256(concat_ws('|', rank::VARCHAR, block::VARCHAR, '1'))[1:15], block) - words) AS room FROM sums
), cutoffs AS (
  SELECT rank, block, max(place) AS most FROM (
    SELECT rank, block, place, room, size, sum(size) OVER (PARTITION BY rank, block ORDER BY place) AS so_far FROM placed JOIN rooms USING (rank, block) WHERE room > 0 AND room < words
  ) WHERE so_far <= room + size / 2 GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
       size * (passes + CASE WHEN room > 0 AND (room >= words OR place <= most) THEN 1 ELSE 0 END) AS taken
FROM placed JOIN rooms USING (rank, block) LEFT JOIN cutoffs USING (rank, block)
"""
