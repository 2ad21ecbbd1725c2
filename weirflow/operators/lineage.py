"""Tables that are used several times, written once where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no recomputation and later plans begin here."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


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
    """A path in the shared folder where nothing is yet."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
