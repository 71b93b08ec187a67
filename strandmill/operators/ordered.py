"""Values carried along the rows of a key in an order, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import cut

PART = "__part"


def spread(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` range-partitioned by ``key`` and ``order``, with the number of each row's partition as ``__part``.

    A key with many rows lies in several partitions, in its order; rows equal in both stay together.
    """
    return cut(df.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()), "spread")


def carry(placed: DataFrame, key: str, order: tuple[str, ...], **values: Column) -> DataFrame:
    """Adds each of ``values``: its last non-null one among the rows of ``key`` before a row; null if there is none.

    ``placed`` comes from ``spread`` with the same key and order, which should tell the rows of a key apart.  A window
    holds the rows of a key in one partition; one row for each key and partition carries the values over the seams.
    A null key is a key; an empty table gives an empty one.
    """
    before = Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(key, PART).agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__end_{name}") for name, v in values.items()])
    parts = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    seams = ends.select(
        F.col(key).alias("__key"), F.col(PART).alias("__seam"), *[F.last(f"__end_{name}", ignorenulls=True).over(parts).alias(f"__from_{name}") for name in values]
    )
    here = placed.withColumns({name: F.last(v, ignorenulls=True).over(before) for name, v in values.items()})
    joined = here.join(seams, (F.col(PART) == F.col("__seam")) & F.col(key).eqNullSafe(F.col("__key")))
    carried = {name: F.coalesce(name, f"__from_{name}") for name in values}
    return joined.withColumns(carried).drop("__key", "__seam", *[f"__from_{name}" for name in values])
