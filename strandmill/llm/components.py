"""Pairwise matches to groups: deterministic Borůvka hooking on DataFrames.

Each round every component selects its smallest outgoing edge, the trees that arise collapse by pointer
doubling, and the edges are relabelled and made unique, until none remain.  The number of components with edges
at least halves in a round.  Edges, pointers and labels stay in Spark; only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.session import cut

#: A key with more rows than this, and than a 200th of all rows, is looked up by broadcast: at most 200 keys.
HOT_ROWS, HOT_SHARE = 100_000, 200


def _lookup(left: DataFrame, n: int, key: str, right: DataFrame, outer: bool = False) -> DataFrame:
    """``left`` with ``right``'s (k, v) joined on ``key`` = k, as column v; ``right`` has each k once.

    ``n`` is the number of left rows.  Keys that hold more than HOT_ROWS and a HOT_SHAREth of them, at most
    HOT_SHARE keys, are broadcast, so that no task gets all rows of such a key; all others are shuffled.
    """
    how = "left" if outer else "inner"
    plain = lambda rows: rows.join(right, rows[key] == right["k"], how).drop("k")
    limit = max(HOT_ROWS, n // HOT_SHARE)
    if n <= limit:
        return plain(left)
    hot = left.groupBy(key).count().filter(F.col("count") > limit).select(F.col(key).alias("hot"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left")
    heavy = marked.filter("hot is not null").drop("hot")
    few = right.join(F.broadcast(hot), F.col("k") == F.col("hot"), "left_semi")
    heavy = heavy.join(F.broadcast(few), heavy[key] == few["k"], how).drop("k")
    return plain(marked.filter("hot is null").drop("hot")).unionByName(heavy)


def _hook(edges: DataFrame) -> DataFrame:
    """(x, p): each component points over its smallest outgoing edge; of two that chose the same, the lower is root."""
    order = F.struct(F.xxhash64("u", "v"), "u", "v").alias("e")
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"), order)
    picks = ends.groupBy("x").agg(F.min("e").alias("e")).select("x", "e.u", "e.v")
    chosen = picks.groupBy("u", "v").agg(F.max(F.col("x") == F.col("u")).alias("by_u"), F.max(F.col("x") == F.col("v")).alias("by_v"))
    both, pair = F.col("by_u") & F.col("by_v"), lambda x, p: F.struct(F.col(x).alias("x"), F.col(p).alias("p"))
    arrows = F.when(both, F.array(pair("u", "u"), pair("v", "u"))).when(F.col("by_u"), F.array(pair("u", "v"))).otherwise(F.array(pair("v", "u")))
    return chosen.select(F.explode(arrows).alias("a")).select("a.x", "a.p")


def _collapse(pointers: DataFrame) -> DataFrame:
    """Pointer doubling until every pointer of the forest ends at a root."""
    done, open_rows = None, cut(pointers)
    all_rows = open_rows
    n = open_rows.count()
    while True:
        known = all_rows.select(F.col("x").alias("k"), F.col("p").alias("v"))
        step = _lookup(open_rows, n, "p", known)
        step = cut(step.select("x", F.col("v").alias("p"), (F.col("v") == F.col("p")).alias("still")))
        # What a lookup left where it was points at a root.
        finished = step.filter("still").drop("still")
        done = finished if done is None else done.unionByName(finished)
        open_rows = step.filter("not still").drop("still")
        n = open_rows.count()
        if not n:
            return done
        all_rows = done.unionByName(open_rows)


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(id, group_id): every id named in ``pairs`` with the smallest id of all linked to it, directly or not.

    A row with two different non-null ids links them; one with a single id, or the same id twice, only names it.
    An id without a link is its own group.  Repeats, either order of a pair and other columns change nothing; an
    empty table gives an empty one.
    """
    pairs = pairs.select(F.col(f"`{left}`").alias("a"), F.col(f"`{right}`").alias("b"))
    linked = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    ends: Column = F.explode(F.array(F.struct(F.col("a").alias("id"), linked.alias("linked")), F.struct(F.col("b").alias("id"), linked.alias("linked"))))
    names = pairs.select(ends.alias("n")).select("n.id", "n.linked").filter("id is not null")
    alone = names.groupBy("id").agg(F.max("linked").alias("linked")).filter("not linked").select("id", F.col("id").alias("group_id"))
    edges = cut(pairs.filter(linked).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    n, rounds = edges.count(), []
    while n:
        roots = _collapse(_hook(edges))
        rounds.append(roots)
        known = roots.select(F.col("x").alias("k"), F.col("p").alias("v"))
        relabelled = _lookup(edges.select(F.col("u").alias("eu"), F.col("v").alias("ev")), n, "eu", known).withColumnRenamed("v", "a")
        relabelled = _lookup(relabelled.drop("eu"), n, "ev", known).withColumnRenamed("v", "b").filter("a <> b")
        edges = cut(relabelled.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        n = edges.count()
    if not rounds:
        return alone
    labels = rounds.pop()
    while rounds:  # from the last round's few labels back to every id
        earlier = rounds.pop()
        known = labels.select(F.col("x").alias("k"), F.col("p").alias("v"))
        labels = cut(_lookup(earlier, earlier.count(), "p", known, outer=True).select("x", F.coalesce("v", "p").alias("p")))
    least = labels.groupBy("p").agg(F.min("x").alias("v")).withColumnRenamed("p", "k")
    named = _lookup(labels, labels.count(), "p", least).select(F.col("x").alias("id"), F.col("v").alias("group_id"))
    return named.unionByName(alone)
