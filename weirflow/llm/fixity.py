"""WARC fixity audit with Merkle trees.

A replica's records are hashed into leaves, the leaves of each offset range of an archive into a range's digest, and
`fanout` neighbouring ranges into their parent's, up to one root an archive. Two replicas are compared from the roots
down: the children of a node are read only if its digests differ, so sound archives cost one comparison each,
and a flipped bit one path. What remains at the bottom are the records that differ, are missing or are extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of an archive below one leaf range, and children of an inner node.
RANGE_BYTES, FANOUT = 64 * 1024, 16
#: Pages of an archive that the query packs.
PAGES_PER_ARCHIVE = 500


def _listed(pages: DataFrame, per_archive: int) -> DataFrame:
    """Pages as records without a place: archive, page_id, url, record_id, length, digest, content."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), name, F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    records = pages.select(name.alias("record_id"), "page_id", F.coalesce("url", F.lit("")).alias("url"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("content"))
    records = records.withColumn("length", F.octet_length("content").cast("long")).withColumn("digest", F.sha2("content", 256))
    unnamed = max(1, -(-pages.where(F.col("page_id").isNull()).count() // per_archive))
    stray = -1 - F.pmod(F.xxhash64("url", "digest"), F.lit(unnamed))
    return records.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / per_archive), stray).cast("long"))


def _placed(records: DataFrame) -> DataFrame:
    """Records of an archive end to end, in order of id, url and digest, with their offset."""
    order = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def pack(pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """Pages as WARC response records: archive, offset, length, record_id, content (binary, header and payload).

    An archive holds the pages of `per_archive` consecutive ids, in order of id, end to end. Null ids are dealt over archives from -1 down,
    of `per_archive` pages each on average, and null htmls are empty payloads. Pages that repeat an id lie side by side, in order of url and
    the digest of the record. Contents are shuffled, as archives hold them; an audit of pages, `report`, does without.
    """
    return _placed(_listed(pages, per_archive)).select("archive", "offset", "length", "record_id", "content")


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, length, record_id, digest. Records may lie at any offsets, even the same."""
    return records.select("archive", "offset", "length", "record_id", F.sha2("content", 256).alias("digest"))


def height(leaf_table: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the leaf ranges until one node spans the longest archive."""
    last = leaf_table.agg(F.max("offset")).first()[0] or 0
    ranges, levels = last // range_bytes + 1, 0
    while ranges > 1:
        ranges, levels = -(-ranges // fanout), levels + 1
    return levels


def _digest(parts: list[str]) -> Column:
    """Of a node: the digest of its children in order, each with its place, so that moved bytes show."""
    listed = F.array_sort(F.collect_list(F.struct(*parts)))
    return F.sha2(F.concat_ws("\n", F.transform(listed, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts]))), 256).alias("digest")


def tree(leaf_table: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (archive, node, digest), from the leaf ranges (level 0) up to the roots.

    A node gathers the records of one offset range or `fanout` children at most, whatever the archive holds.
    """
    node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
    tables = [cut(leaf_table.groupBy("archive", node).agg(_digest(["offset", "length", "record_id", "digest"])))]
    for _ in range(levels):
        below = tables[-1].select("archive", F.floor(F.col("node") / fanout).cast("long").alias("parent"), "node", "digest")
        tables.append(cut(below.groupBy("archive", F.col("parent").alias("node")).agg(_digest(["node", "digest"]))))
    return tables


def _differ(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    return ours.select(*keys, F.col("digest").alias("ours")).join(theirs.select(*keys, F.col("digest").alias("theirs")), keys, "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records in which the replica differs: archive, offset, length, record_id, verdict, primary_root, replica_root.

    Both tables have archive, offset, length, record_id and content. verdict is `corrupt` (the record is at its place with
    other content), `missing` or `extra` (at this place only the primary, or only the replica, has such a record; a moved
    record is both). Of records that repeat in full, a difference in number is one row of `corrupt`. Roots are null
    for an archive that one side lacks. Equal replicas, and empty ones, give an empty result. Other columns are not read.
    """
    return audit_leaves(cut(leaves(primary)), cut(leaves(replica)), range_bytes, fanout)


def audit_leaves(mine: DataFrame, other: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The audit of two tables that `leaves` made; they are read several times, so they should be written or cut."""
    levels = max(height(mine, range_bytes, fanout), height(other, range_bytes, fanout))
    ours, theirs = (tree(x, levels, range_bytes, fanout) for x in (mine, other))
    top = cut(_differ(ours[-1], theirs[-1], ["archive", "node"]))
    roots = top.select("archive", F.col("ours").alias("primary_root"), F.col("theirs").alias("replica_root"))
    suspects = top.select("archive", "node")
    for level in range(levels - 1, -1, -1):
        under = lambda t: t.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(suspects.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi")  # noqa: B023, E731
        suspects = cut(_differ(under(ours[level]), under(theirs[level]), ["archive", "node"]).select("archive", "node"))
    keys = ["archive", "offset", "length", "record_id"]
    inside = lambda t: t.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long")).join(suspects, ["archive", "node"], "left_semi").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest"))
    found = _differ(inside(mine), inside(other), keys)
    verdict = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("corrupt")
    return found.withColumn("verdict", verdict).join(roots, "archive").select(*keys, "verdict", "primary_root", "replica_root")


def _copies() -> Column:
    """What a damaged replica has of a record: array<struct<record_id, content>>."""
    lot = F.conv(F.substring(F.sha2("record_id", 256), 1, 2), 16, 10).cast("int")
    flipped = F.concat(F.substring("content", F.lit(1), (F.col("length") - 5).cast("int")), F.lit("#").cast("binary"), F.substring("content", (F.col("length") - 3).cast("int"), F.lit(4)))
    copy = lambda name, content: F.struct(name.alias("record_id"), content.alias("content"))
    own, stray = copy(F.col("record_id"), F.col("content")), copy(F.concat(F.col("record_id"), F.lit("-stray")), F.col("content"))
    return F.when(lot == 0, F.array(copy(F.col("record_id"), flipped))).when(lot == 1, F.filter(F.array(own), lambda _: F.lit(False))).when(lot == 2, F.array(own, stray)).otherwise(F.array(own))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with planted damage, for trials: by digest of the record id, of 256 records one has a byte changed, one is lost and one is followed by a stray copy."""
    return records.withColumn("copy", F.explode(_copies())).select("archive", "offset", "length", "copy.record_id", "copy.content")


def report(pages: DataFrame) -> DataFrame:
    """The audit of all pages, packed as WARC archives, against a replica with planted damage.

    Each replica is read and hashed by itself, from its own contents; the digests are taken where pages are read, so that only
    they, lengths and names are shuffled. Pages may have null columns, and repeat; no pages make no rows.
    """
    own = ["archive", "page_id", "url", "record_id", "length", "digest"]
    primary = _placed(_listed(pages, PAGES_PER_ARCHIVE).select(*own))
    hashed = F.transform(_copies(), lambda c: F.struct(c["record_id"].alias("record_id"), F.sha2(c["content"], 256).alias("digest")))
    replica = _placed(_listed(pages, PAGES_PER_ARCHIVE).select(*own, hashed.alias("copies"))).select("archive", "offset", "length", F.explode("copies").alias("copy"))
    mine = cut(primary.select("archive", "offset", "length", "record_id", "digest"))
    other = cut(replica.select("archive", "offset", "length", "copy.record_id", "copy.digest"))
    return audit_leaves(mine, other).select("archive", "offset", "length", "record_id", "verdict")


ORACLE = f"""
WITH bodies AS (
  SELECT coalesce(page_id // {PAGES_PER_ARCHIVE}, -1) AS archive, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         '<urn:page:' || coalesce(page_id::varchar, 'none') || '>' AS record_id
  FROM pages
), records AS (
  SELECT *, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: ' || record_id
         || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::varchar
         || chr(13) || chr(10) || chr(13) || chr(10) || html) AS body
  FROM bodies
), placed AS (
  SELECT archive, record_id, body, octet_length(body) + 4 AS length,
         coalesce(sum(octet_length(body) + 4) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, sha256(body || encode(chr(13) || chr(10) || chr(13) || chr(10))) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset_,
         ('0x' || sha256(record_id)[1:2])::int AS lot
  FROM records
), sides AS (
  SELECT 'p' AS side, archive, offset_, length, record_id, sha256(body || encode(chr(13) || chr(10) || chr(13) || chr(10))) AS digest FROM placed
  UNION ALL
  SELECT 'r', archive, offset_, length, record_id,
         sha256(CASE WHEN lot = 0 THEN body[1:octet_length(body) - 1] || encode('#') ELSE body END || encode(chr(13) || chr(10) || chr(13) || chr(10)))
  FROM placed WHERE lot <> 1
  UNION ALL
  SELECT 'r', archive, offset_, length, record_id || '-stray', sha256(body || encode(chr(13) || chr(10) || chr(13) || chr(10))) FROM placed WHERE lot = 2
)
SELECT archive, offset_ AS "offset", length, record_id,
       CASE WHEN count(*) FILTER (side = 'r') = 0 THEN 'missing' WHEN count(*) FILTER (side = 'p') = 0 THEN 'extra' ELSE 'corrupt' END AS verdict
FROM sides GROUP BY ALL HAVING min(CASE WHEN side = 'p' THEN digest END) IS DISTINCT FROM min(CASE WHEN side = 'r' THEN digest END)
"""
