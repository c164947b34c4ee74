"""Reading the project's Parquet tables, and cutting lineage safely on a cluster."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder the session names and read it from there.

    Used where a result of costly Python work is read more than once. The folder comes from
    `spark.checkpoint.dir`; only where that is unset on one machine, as in tests, a temporary one is made.
    The files survive the loss of any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. On one machine, where it may be unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="corpuslens-checkpoint-")


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` as the URI that Spark reads it by; a plain path is one of the session's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", uri)


def settled(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` computed once: as rows of the driver if there are at most so many, else written out by `checkpointed`."""
    rows = df.limit(most_rows + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most_rows else checkpointed(df)


def fewer(df: DataFrame, of: int = 4) -> DataFrame:
    """`df` in a quarter of its partitions, though in no fewer than there are cores: rows much narrower than those they were made from need fewer files."""
    n, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, n // of)) if n > cores else df


def checked_broadcast(small: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """`small` marked for broadcast if it has at most so many rows, which are counted; else as it is, for a join by shuffle.

    For narrow rows that have been written out already, so that counting them costs little.
    """
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has; for columns that are dropped again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it comes in fewer than half as many partitions, as a small table in one file does.

    Costly Python work on texts follows. Larger tables come in more partitions and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df
