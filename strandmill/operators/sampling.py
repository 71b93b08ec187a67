"""Numbering rows in an order, and reads in batches, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.classify import records_of
from strandmill.session import cut, spare_name


def number_rows(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 .. by ``order``, which has to tell rows apart for the same numbers every time.

    Rows are range-partitioned and sorted; a partition's numbers begin behind the rows of those before it.  Only one
    row for each partition passes through the window.  An empty table gives an empty one.
    """
    part, id_ = spare_name(df, "__part"), spare_name(df, "__id")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ordered.withColumn(part, F.spark_partition_id()).withColumn(id_, F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"), F.min(id_).alias("__first"))
    before = F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(part, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(F.broadcast(begins), part).withColumn(name, F.col(id_) + F.col("__shift")).drop(part, id_, "__shift")


def read_batches(reads: DataFrame, batch_size: int, max_batches: int | None, key: str = "read_id", seed: int | None = None) -> DataFrame:
    """``reads`` with ``batch``: batches of ``batch_size`` by ``key``, or shuffled by ``seed``; reads behind the last batch are left out (none if ``max_batches`` is null).

    Each read is in one batch, so batches are samples without replacement.  ``key`` has to be unique.
    """
    shuffled = reads if seed is None else reads.withColumn("__mix", F.xxhash64(F.lit(seed), key))
    numbered = number_rows(shuffled, *([] if seed is None else ["__mix"]), key, name="__number")
    batch = F.expr(f"__number div {batch_size}")
    out = numbered.withColumn("batch", batch).drop("__number", "__mix")
    return out if max_batches is None else out.filter(F.col("batch") < max_batches)


def read_batch(reads: DataFrame, batch_size: int, number: int, key: str = "read_id", seed: int | None = None) -> DataFrame:
    """One whole batch, by its number; ``ValueError`` if the reads do not reach so far."""
    out = cut(read_batches(reads, batch_size, number + 1, key, seed).filter(F.col("batch") == number), "batch")
    if out.count() < batch_size:
        raise ValueError(f"there are too few reads for batch {number}")
    return out


def reads_by_id(reads: DataFrame, ids: DataFrame, key: str = "read_id") -> DataFrame:
    """The reads that ``ids`` names (random access), as often as they occur."""
    return reads.join(ids.select(key), key, "left_semi")


def batch_with_records(reads: DataFrame, full: DataFrame, truncated: DataFrame, batch_size: int, number: int, seed: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of reads with the mappings of the whole reads and of their anchors."""
    batch = read_batch(reads, batch_size, number, seed=seed)
    return batch, records_of(full, batch), records_of(truncated, batch)


def records_by_batch(batches: DataFrame, full: DataFrame, truncated: DataFrame, *keep: str) -> DataFrame:
    """(batch, kind, ``keep``): of each batch's reads the mappings of the whole reads and of their anchors.

    ``batches``: (read_id, batch), each read once; records of other reads are left out, a read without any has no row.
    """
    both = [paf.select("qname", F.lit(kind).alias("kind"), *keep) for kind, paf in (("full", full), ("truncated", truncated))]
    return both[0].unionByName(both[1]).join(batches.select(F.col("read_id").alias("qname"), "batch"), "qname").select("batch", "kind", *keep)
