"""Groups of matches and the best items of a group, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.llm import components as K
from strandmill.llm.topn import top_n


def union_find(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                parent.setdefault(x, x)
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("id", F.lit(1)).withColumn("u", F.lit("x"))
    rows = K.components(df, "a", "b").collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.group_id for r in rows}


def test_random_chains_and_loose_ends(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    pairs += [("z", None), (None, "y"), (None, None), ("x", "x"), ("c000", "c001"), ("c001", "c000")]
    assert groups(spark, pairs) == union_find(pairs)


@pytest.mark.parametrize("hot", [3, 100_000])
def test_a_hub_with_most_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", hot)
    pairs = [("hub", f"l{i:03}") for i in range(90)] + [(f"l{i:03}", f"m{i:03}") for i in range(0, 90, 3)] + [("a", "m003"), ("p", "q")]
    assert groups(spark, pairs) == union_find(pairs)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert K.components(df, "a", "b").collect() == []


def brute_top(rows, n, same):
    items = {}
    for g, s, m, x, t in rows:
        if g is not None:
            key = (g, s, m, x) if same else (g, t)
            items[key] = min(items.get(key, (g, s, m, t)), (g, s, m, t), key=lambda r: r[3])
    out = set()
    for g in {k[0] for k in items}:
        own = sorted((r for r in items.values() if r[0] == g), key=lambda r: (-(r[1] or 0), -(r[2] or 0), r[3]))
        out |= {(g, i + 1, r[3]) for i, r in enumerate(own[:n])}
    return out


@pytest.mark.parametrize("same", [None, ["g", "s1", "mapq", "x"]])
def test_top_items(spark, same):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, 0, 1, 5]), rng.choice([None, 0, 2]), rng.choice([None, "p", "q"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s1 int, mapq int, x string, t bigint").withColumn("rnk", F.lit("x")).withColumn("__salt", F.lit(1))
    got = [tuple(r) for r in top_n(df, "g", ["s1", "mapq"], "t", 3, same, salts=4).collect()]
    assert set(got) == brute_top(rows, 3, same) and len(got) == len(set(got))
    assert top_n(df.limit(0), "g", ["s1"], "t", 3).count() == 0
