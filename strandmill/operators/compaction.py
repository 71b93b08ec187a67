"""Many tiny files to few well-sized ones, without losing or doubling a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import scratch_path


def multiset_checksum(df: DataFrame) -> tuple:
    """(rows, sum and exclusive-or of row hashes): equal for equal multisets of rows, in any order and layout."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    null_marks = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("string") for c in df.columns])
    h = F.xxhash64(h, null_marks)
    row = df.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return tuple(row)


def compact(df: DataFrame, target: str) -> DataFrame:
    """Write ``df`` to ``target`` as few well-sized parquet files and return the table read from there.

    The REBALANCE hint lets runtime statistics merge small and split large output partitions near
    the session's advisory partition size.  ``df`` is run a second time for its checksum: figures gathered while
    writing would count a task twice that is run again after a lost executor.  The files are written beside the target
    and moved there only when their multiset checksum equals that of ``df``; else they are removed and
    ``ValueError`` is raised.  A target that exists already is an error, too, and stays as it was.  Repeated rows are kept as often as they occur.
    An empty table gives an empty one with the same columns.
    """
    spark = df.sparkSession
    staging = f"{target.rstrip('/')}.staging"
    fs, goal = _files(spark, target)
    if fs.exists(goal):
        raise ValueError(f"{target} exists already")
    df.hint("rebalance").write.mode("overwrite").parquet(staging)
    written = spark.read.schema(df.schema).parquet(staging)
    source = _files(spark, staging)[1]
    if multiset_checksum(written) != multiset_checksum(df):
        fs.delete(source, True)
        raise ValueError(f"{staging} does not hold the rows that were to be written")
    if not fs.rename(source, goal):
        raise ValueError(f"{target} cannot be written")
    return spark.read.schema(df.schema).parquet(target)


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def compact_to_scratch(df: DataFrame, name: str) -> DataFrame:
    """``compact`` into a new path of the shared folder."""
    return compact(df, scratch_path(df.sparkSession, name))
