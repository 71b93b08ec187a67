"""Read lengths: histogram, mean and the partition that stands for their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGEST, LEAST = 999_999, 800


def length_histogram(reads: DataFrame, length: str = "length") -> DataFrame:
    """(length, n) of reads longer than 800; longer than 999,999 counts as that; null lengths do not count."""
    kept = reads.filter(F.col(length) > LEAST).select(F.least(F.col(length), F.lit(LONGEST)).cast("int").alias("length"))
    return kept.groupBy("length").agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("length").agg(F.sum("n").alias("n"))


def length_stats(histogram: DataFrame) -> DataFrame:
    """(n, mean_length, max_length); of no reads: 0 and nulls."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return histogram.agg(n.alias("n"), (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_length"), F.max("length").alias("max_length"))


def ccl_partition(histogram: DataFrame, parts: int = 10) -> DataFrame:
    """(part, ccl): discrete quantiles at (part + 0.5) / parts: the least length that no more than the rest exceed.

    The histogram has at most a million rows, so the running sum needs no partition.
    """
    run = F.sum("n").over(Window.orderBy("length"))
    ranked = histogram.select("length", run.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    each = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return each.filter(F.col("upto") * (2 * parts) >= F.col("all") * (2 * F.col("part") + 1)).groupBy("part").agg(F.min("length").alias("ccl"))
