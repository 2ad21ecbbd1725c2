"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Has a query's shuffle files deleted at its end; else they stay until the driver happens to collect the plan. It holds for frames made while it is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation. The shuffles that led to it go at once.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder; a cluster without it raises.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-checkpoint-"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever file system it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that `cut` made, once nothing will read them again: what came of them must be cut itself."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def new_path(spark: SparkSession, name: str) -> str:
    """A path beside the checkpoints where nothing is yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut(spark.range(0))  # names the folder, or raises
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet beside the checkpoints, below a folder of its own, and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """64-bit hash of a text, null as empty: tells rows with one id apart when they are joined back."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of passage that df hasn't."""
    while name in df.columns:
        name += "_"
    return name


def hot_keys(rows: DataFrame, key: str, share: float, least: int) -> DataFrame:
    """The values of a column that `share` of all rows have, or more, and `least` rows at any rate: 1 / share values at most."""
    total = rows.count()
    return cut(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= max(least, total * share)).select(key))


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, how: str) -> DataFrame:
    """rows joined (inner or left) with a lookup of one row for each key, without bringing a hot key's rows together.

    Rows of hot keys stay where they are and meet a broadcast of the lookup's rows for those keys, one for each; rows without a
    key need no join. The others are shuffled.
    """
    few = lookup.join(F.broadcast(hot), key, "left_semi")
    warm = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    cold = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(lookup, key, how)
    found = cold.unionByName(warm)
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name != key]
        found = found.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
    return found


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the least node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. ("Connected components in
    MapReduce and beyond", 2014): every round points each node at the least neighbour it knows, so the
    number of rounds is logarithmic in the size of a component. Each step is one aggregation with
    map-side combining and one equi-join, which adaptive execution may split at a hub.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        before, edges = edges, cut(small.select("e.a", "e.b").where("a <> b").distinct())
        drop(before)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
