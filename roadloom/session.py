"""Sessions, saved tables and the size checks that decide between local kernels and distributed loops."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a graph that one task may hold (about 100 MB as arrays); larger graphs take the distributed forms.
LOCAL_ROWS = 2_000_000


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where the session names none, a temporary one, on a single machine only: executors of
    a cluster would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="roadloom-"))
    return sc.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def saved(df: DataFrame, placed: bool = False) -> DataFrame:
    """The rows of df, computed once and held in the shared folder, where they outlive executors. placed: later joins know
    by which keys the rows are partitioned and leave them there; adaptive plans forget it, so df is planned without."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        if placed:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def ship(spark: SparkSession) -> None:
    """Lets Python workers of this session import the package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def fits(df: DataFrame, most: int = LOCAL_ROWS) -> bool:
    """Whether a table has at most `most` rows; stops counting there."""
    return df.limit(most + 1).count() <= most
