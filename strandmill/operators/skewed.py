"""Figures for each key when a few keys hold most rows.

The rows are range-partitioned on the composite (key, member, order) with sampled quantiles, so that a heavy
key is spread over many partitions.  Each partition makes partial states in one pass over its sorted rows; the
few states of a key are stitched at the partition boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "key string, first_member string, first_order bigint, last_member string, n_rows bigint, n_members bigint, best_score bigint, best_order bigint"


def _change(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (null is a value); the first is not judged."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, member, order, score), sorted by the first three, to one state for each run of a key."""
    open_state: list | None = None
    names = [c.split()[0] for c in STATE.split(", ")]

    def flush(states: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*states), kinds)], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, member = batch.column(0), batch.column(1)
        order, score = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        new_key = _change(key)
        new_member = np.concatenate([[True], new_key | _change(member)]) & ~member.is_null().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new_key) + 1])
        ends = np.append(starts[1:], n)
        counts = np.add.reduceat(new_member.astype(np.int64), starts)
        tops = np.maximum.reduceat(score, starts)
        at_top = np.where(score == np.repeat(tops, ends - starts), order, np.iinfo(np.int64).max)
        best = np.minimum.reduceat(at_top, starts)
        keys = key.take(pa.array(starts)).to_pylist()
        firsts = member.take(pa.array(starts)).to_pylist()
        lasts = member.take(pa.array(ends - 1)).to_pylist()
        done = []
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            state = [keys[i], firsts[i], int(order[s]), lasts[i], e - s, int(counts[i]), int(tops[i]), int(best[i])]
            if firsts[i] is None and lasts[i] is not None:  # nulls come first in a key
                inner = pc.index_in(pa.scalar(False), member.slice(s, e - s).is_null()).as_py()
                state[1] = member[s + inner].as_py()
            if open_state is not None and open_state[0] == state[0]:
                seam = open_state[3] is not None and open_state[3] == state[1]
                open_state[1] = open_state[1] if open_state[1] is not None else state[1]
                open_state[3] = state[3] if state[3] is not None else open_state[3]
                open_state[4] += state[4]
                open_state[5] += state[5] - seam
                if (state[6], -state[7]) > (open_state[6], -open_state[7]):
                    open_state[6:] = state[6:]
            else:
                if open_state is not None:
                    done.append(open_state)
                open_state = state
        if done:
            yield flush(done)
    if open_state is not None:
        yield flush([open_state])


def key_figures(rows: DataFrame, key: str, member: str, order: str, score: str, partitions: int | None = None) -> DataFrame:
    """(``key``, n_rows, n_members, best_order) for each non-null key.

    n_rows counts rows, repeats included; n_members the distinct non-null members; best_order is the ``order``
    of the row with the highest score (null counts as 0), then the lowest order.  ``order`` must not be null
    (such rows are ordered as -1).  ``partitions`` defaults to the session's shuffle partitions.  Other columns
    are not read; an empty table gives an empty one.
    """
    source = rows.select(
        F.col(f"`{key}`").cast("string").alias("k"),
        F.col(f"`{member}`").cast("string").alias("m"),
        F.coalesce(F.col(f"`{order}`").cast("bigint"), F.lit(-1)).alias("o"),
        F.coalesce(F.col(f"`{score}`").cast("bigint"), F.lit(0)).alias("sc"),
    ).filter("k is not null")
    by = ["k", "m", "o"]
    spread = source.repartitionByRange(partitions, *by) if partitions else source.repartitionByRange(*by)
    states = spread.sortWithinPartitions(*by).mapInArrow(_partial_states, STATE)
    # A key has at most one state for each partition, so this window stays small; range partitions are numbered in order.
    states = states.withColumn("part", F.spark_partition_id())
    line = Window.partitionBy("key").orderBy("part")
    before = F.last("last_member", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    seam = F.coalesce((before == F.col("first_member")).cast("int"), F.lit(0))
    return (
        states.withColumn("seam", seam)
        .groupBy("key")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            (F.sum("n_members") - F.sum("seam")).alias("n_members"),
            (-F.max(F.struct("best_score", -F.col("best_order")))["col2"]).alias("best_order"),
        )
        .withColumnRenamed("key", key)
    )
