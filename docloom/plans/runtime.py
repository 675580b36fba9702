"""What operators need from the session: the shared folder for cut lineage, partition counts, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where the session names none (tests), a temporary one is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the shared folder, deleted when the session's JVM ends."""
    own = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{own}/table"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each (a few MB) that may be broadcast after they were counted.
SMALL_ROWS = 200_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A side of a join, to be broadcast if it is counted to have no more rows than that, else left to a shuffled join.

    Only for rows of a few fixed-size columns.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Give Python work on a small input as many tasks as there are cores; a larger one keeps its own partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def portions(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` characters together; a longer text is alone with those before it."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
