"""Overlapping, nested and gapped intervals to continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import cut

BLOCK = 1 << 16  # starts in one block: the most rows that a window partition can hold


def periods_and_gaps(spans: DataFrame, entity: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """(``entity``, kind, pstart, pend): kind ``period`` for each maximal covered stretch, ``gap`` between two.

    Half-open integer intervals; those that overlap or meet are one period.  Rows with a null entity, start or
    end, or with start >= end, hold no interval and are left out.  Repeats and ties change nothing, other columns
    are not read, and an empty table gives an empty one.

    ``session_window`` with each row's own duration merges the spans that begin in the same block of coordinates.
    Spans are first reduced to the longest for each start (combined before the shuffle), so that no group holds
    more than ``block`` rows however hot the entity.  Blocks are then stitched through one row each.
    """
    spans = spans.select(
        F.col(f"`{entity}`").alias("entity"), F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{end}`").cast("bigint").alias("e")
    ).filter("entity is not null and s < e")
    longest = spans.groupBy("entity", "s").agg(F.max("e").alias("e"))
    block_no = F.floor(F.col("s") / block).cast("bigint")
    # One coordinate is one microsecond of session time.
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((e - s) / 1000000.0 as decimal(18, 6)))")
    sessions = (
        longest.withColumn("block", block_no)
        .withColumn("at", F.timestamp_micros("s"))
        .withColumn("length", length)
        .groupBy("entity", "block", F.session_window("at", F.col("length")).alias("session"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("session")
    )
    sessions = cut(sessions, "sessions")  # asked for twice, and far fewer rows than the spans
    in_block = Window.partitionBy("entity", "block").orderBy("s")
    blocks = sessions.groupBy("entity", "block").agg(F.max("e").alias("reach"))
    by_block = Window.partitionBy("entity").orderBy("block")
    carried = blocks.withColumn("carry", F.max("reach").over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
    # A piece begins a period unless what came before reaches it (sessions that only meet are still two here).
    pieces = sessions.join(carried.select("entity", "block", "carry"), ["entity", "block"])
    before = F.greatest("carry", F.max("e").over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.withColumn("head", F.coalesce(before < F.col("s"), F.lit(True)))
    pieces = pieces.withColumn("no", F.sum(F.col("head").cast("int")).over(in_block))
    runs = pieces.groupBy("entity", "block", "no").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    runs = cut(runs, "runs")
    # Run 0 of a block goes on with a period of an earlier block; the others begin here.
    runs = runs.withColumn("next_s", F.lead("s").over(Window.partitionBy("entity", "block").orderBy("no")))
    edges = runs.groupBy("entity", "block").agg(
        F.max("e").alias("reach"), F.max(F.when(F.col("no") == 0, F.col("e"))).alias("absorbed"), F.min(F.when(F.col("no") == 1, F.col("s"))).alias("first_s")
    )
    earlier = F.max("reach").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    later = by_block.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.withColumn("closed", F.when(F.col("first_s").isNotNull(), F.greatest(earlier, "absorbed")))
    edges = edges.select(
        "entity",
        "block",
        F.first("closed", ignorenulls=True).over(later).alias("last_e"),
        F.first("first_s", ignorenulls=True).over(later).alias("after_s"),
        F.max("reach").over(Window.partitionBy("entity")).alias("end_e"),
    )
    periods = (
        runs.filter("no > 0")
        .join(edges, ["entity", "block"])
        .select(
            "entity",
            F.col("s").alias("pstart"),
            F.when(F.col("next_s").isNotNull(), F.col("e")).otherwise(F.coalesce("last_e", "end_e")).alias("pend"),
            F.coalesce("next_s", "after_s").alias("next_start"),
        )
    )
    both = periods.select(
        F.col("entity").alias(entity),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), "pstart", "pend"),
                    F.struct(F.lit("gap").alias("kind"), F.col("pend").alias("pstart"), F.col("next_start").alias("pend")),
                ),
                lambda x: x["pend"].isNotNull(),
            )
        ).alias("p"),
    )
    return both.select(F.col(f"`{entity}`"), "p.kind", "p.pstart", "p.pend")
