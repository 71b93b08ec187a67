"""The N best items of every group, also where one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n(rows: DataFrame, group: str, scores: list[str], tie: str, n: int, same: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """(``group``, rnk, ``tie``): ranks 1 to ``n`` by ``scores`` descending (null counts as 0), then ``tie`` ascending.

    Rows whose ``same`` columns are equal (null equals null) are one item, that with the lowest ``tie``; with
    ``same=None`` every row is an item.  Rows with a null group are left out, a null ``tie`` ranks last, other
    columns are not read, and an empty table gives an empty one.

    Two stages: each group is hashed into subgroups by the item, the best ``n`` of each subgroup are kept (Spark
    limits them before the shuffle), and the survivors, at most ``n * salts`` a group, are ranked together.
    Items are made unique with a combine before the shuffle, so a row that is repeated without end stays one.
    """
    name = lambda c: F.col(f"`{c}`")
    rows = rows.filter(name(group).isNotNull())
    score = [F.coalesce(name(s), F.lit(0)).alias(f"__s{i}") for i, s in enumerate(scores)]
    if same is None:
        items = rows.select(name(group).alias("__g"), *score, name(tie).alias("__t"))
        salt = F.xxhash64("__t")
    else:
        rest = [c for c in dict.fromkeys(same) if c != group and c not in scores]
        raw = [name(s).alias(f"__r{i}") for i, s in enumerate(scores)]  # null and 0 rank alike but are not the same
        keys = [name(c).alias(f"__k{i}") for i, c in enumerate(rest)]
        wide = rows.select(name(group).alias("__g"), *raw, *keys, name(tie).alias("__t"))
        unique = wide.groupBy(*[c for c in wide.columns if c != "__t"]).agg(F.min("__t").alias("__t"))
        items = unique.select("__g", *[F.coalesce(F.col(f"__r{i}"), F.lit(0)).alias(f"__s{i}") for i in range(len(scores))], "__t")
        salt = F.xxhash64("__t")
    best_first = [*[F.col(f"__s{i}").desc() for i in range(len(scores))], F.col("__t").asc_nulls_last()]
    inner = Window.partitionBy("__g", "__salt").orderBy(*best_first)
    outer = Window.partitionBy("__g").orderBy(*best_first)
    return (
        items.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
        .withColumn("__in", F.row_number().over(inner))
        .filter(F.col("__in") <= n)
        .drop("__in", "__salt")
        .withColumn("__rnk", F.row_number().over(outer))
        .filter(F.col("__rnk") <= n)
        .select(F.col("__g").alias(group), F.col("__rnk").cast("bigint").alias("rnk"), F.col("__t").alias(tie))
    )
