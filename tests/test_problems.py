"""Core data problems: rejects, periods, skewed keys, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import compaction
from strandmill.operators.intervals import periods_and_gaps
from strandmill.operators.rejects import parse_line, parse_paf, rejected_rows, valid_records
from strandmill.operators.skewed import key_figures
from strandmill.sources.fastq import complete_records, last_copy, parse_files

GOOD = "q1\t100\t0\t90\t+\tt1\t500\t10\t100\t80\t90\t60"


def changed(i, value):
    f = GOOD.split("\t")
    f[i] = value
    return "\t".join(f)


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None),
        (f"  \t{GOOD}\r\n ", None),
        (GOOD + "\ttp:A:P\ts1:i:-5\tdv:f:0.1\tcs:Z::6*ag", None),
        (changed(0, '"a\tb""c"'), None),
        (changed(0, '"never'), "quoting"),
        (changed(0, '"a"b'), "quoting"),
        (changed(0, 'a"b'), "quoting"),
        (GOOD + '\tco:Z:a"b', "quoting"),
        (changed(5, '"t1""'), "quoting"),
        (None, "columns"),
        ("", "columns"),
        (" \t \r\n", "columns"),
        ("\t".join(GOOD.split("\t")[:11]), "columns"),
        (GOOD + "\t999", "columns"),
        (GOOD + "\t1p:A:P", "columns"),
        (GOOD + "\ttp:B:P", "columns"),
        (changed(1, "1e2"), "value"),
        (changed(1, "-100"), "value"),
        (changed(1, "１００"), "value"),
        (changed(4, "plus"), "value"),
        (changed(5, " "), "value"),
        (changed(2, "90"), "value"),
        (changed(3, "101"), "value"),
        (changed(7, "100"), "value"),
        (changed(9, "91"), "value"),
        (changed(11, "256"), "value"),
        (changed(11, "255"), None),
        (GOOD + "\ts1:i:4O1", "value"),
        (GOOD + "\tdv:f:0,1", "value"),
        (GOOD + "\tdv:f:", "value"),
    ],
)
def test_reasons(line, reason):
    assert parse_line(line)[0] == reason


def test_quoted_fields_and_numbers_are_read():
    record = parse_line(changed(0, '"a\tb""c"') + "\tAS:i:7\ttp:A:P\tcg:Z:90M\tcg:Z:1M")[1]
    assert (record["qname"], record["align_score"], record["is_primary"], record["cigar"], record["s1"]) == ('a\tb"c', 7, True, "90M", 0)
    assert parse_line(changed(0, "007"))[1]["qname"] == "007"
    assert parse_line(changed(0, "a\nb"))[1]["qname"] == "a\nb"
    assert parse_line(changed(6, "9" * 30))[0] is None


def test_rejects_keep_other_columns_and_every_row(spark):
    rows = [(1, GOOD, "x", "y"), (1, GOOD, "x", "y"), (2, None, None, None), (3, '"', "x", None), (4, GOOD + "\tco:Z:" + "z" * 300_000, "x", "y")]
    df = spark.createDataFrame(rows, "line_no bigint, line string, reason string, QNAME string")
    parsed = parse_paf(df)
    assert parsed.columns == ["line_no", "QNAME", "reason", "record"]
    assert sorted((r.line_no, r.reason) for r in rejected_rows(df).collect()) == [(2, "columns"), (3, "quoting")]
    valid = valid_records(df)
    assert "QNAME" not in valid.columns and sorted(r.line_no for r in valid.collect()) == [1, 1, 4]
    assert parse_paf(df.limit(0)).count() == 0


def brute_periods(rows):
    out = set()
    for name in {n for n, s, e in rows if n is not None}:
        spans = sorted((s, e) for n, s, e in rows if n == name and s is not None and e is not None and s < e)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(name, "period", s, e) for s, e in merged}
        out |= {(name, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("block", [4, 16, 1 << 16])
def test_periods_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for _ in range(600):
        s = rng.randrange(0, 2000)
        rows.append((rng.choice("abc"), s, s + rng.choice([0, 1, 2, 3, 5, 40])))
    rows += [("d", 0, 4), ("d", 4, 8), ("d", 8, 9), ("e", 3, 300), ("e", 5, 6), ("e", 301, 302), (None, 1, 2), ("f", None, 2), ("f", 2, None), ("f", 5, 4), ("a", 1, 2), ("a", 1, 2)]
    df = spark.createDataFrame(rows, "name string, s int, e int").withColumn("kind", F.lit(1)).withColumn("block", F.lit(2))
    got = periods_and_gaps(df, "name", "s", "e", block)
    assert got.columns == ["name", "kind", "pstart", "pend"]
    collected = [tuple(r) for r in got.collect()]
    assert len(collected) == len(set(collected)) and set(collected) == brute_periods(rows)
    assert periods_and_gaps(df.limit(0), "name", "s", "e").count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_figures_of_heavy_keys(spark, partitions):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}"), rng.choice([None, *(f"m{i}" for i in range(9))]), i, rng.choice([None, 0, 3, 9])) for i in range(2000)]
    rows += [(None, "m", 9000, 1), ("none", None, 9001, None), ("none", None, 9002, 0), ("same", "m", 9003, 5), ("same", "m", 9004, 5)]
    df = spark.createDataFrame(rows, "k string, m string, o bigint, s int").withColumn("n_rows", F.lit("x"))
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == k]
        want[k] = (len(own), len({r[1] for r in own if r[1]}), max(own, key=lambda r: (r[3] or 0, -r[2]))[2])
    got = key_figures(df, "k", "m", "o", "s", partitions).collect()
    assert {r.k: (r.n_rows, r.n_members, r.best_order) for r in got} == want and len(got) == len(want)
    assert key_figures(df.limit(0), "k", "m", "o", "s").count() == 0


def test_fastq_records():
    text = "@a ch=1\nAC\n+\n!!\n\n@b\r\nACG\r\n+b\r\n@+!\r\n@cut\nACGT\n+\n!!"
    assert [r[0] for r in complete_records(text)] == ["a", "b"]
    assert [r[0] for r in complete_records("@x\n\n+\n\n@y\nA\n+\n@\n")] == ["y"]
    assert [r[0] for r in complete_records("@bad\nACGT\n+\n!!\n@ok\nA\n+\n!")] == ["ok"]
    assert complete_records(None) == complete_records("") == complete_records(" \n\n") == []


def test_last_copy_of_a_read(spark):
    files = [(1, "b", "@r ch=5 x\nAC\n+\n!!\n@r ch=6 x\nAC\n+\n!!\n"), (2, "c", "@r ch=7 x\nACG\n+\n!!"), (3, "a", "@r\nA\n+\n!\n@s y ch=9 barcode=barcode07 run\nA\n+\n!"), (4, "d", None)]
    df = spark.createDataFrame(files, "file_id bigint, path string, content string")
    got = {r.read_id: r for r in last_copy(parse_files(df)).collect()}
    assert {k: (v.file_id, v.channel) for k, v in got.items()} == {"r": (1, None), "s": (3, 9)}
    assert (got["s"].barcode, got["s"].source, got["r"].ordinal) == (7, "run", 1)


def test_compaction_keeps_the_multiset(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("b")).repartition(200)
    df = df.unionByName(df.limit(10))
    out = compaction.compact(df, f"file://{tmp_path}/t")
    assert compaction.multiset_checksum(out) == compaction.multiset_checksum(df)
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 4
    with pytest.raises(ValueError):
        compaction.compact(df, f"file://{tmp_path}/t")
    empty = compaction.compact(df.limit(0), f"file://{tmp_path}/e")
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_compaction_rejects_a_wrong_copy(spark, tmp_path, monkeypatch):
    sums = iter([(1, 2, 3), (1, 2, 4)])
    monkeypatch.setattr(compaction, "multiset_checksum", lambda df: next(sums))
    with pytest.raises(ValueError):
        compaction.compact(spark.range(5), f"file://{tmp_path}/t")
    assert not (tmp_path / "t").exists() and not (tmp_path / "t.staging").exists()


def test_checksum_tells_multisets_apart(spark):
    def f(rows):
        return compaction.multiset_checksum(spark.createDataFrame(rows, "a string, b string"))

    assert f([("x", None), ("y", "z")]) == f([("y", "z"), ("x", None)])
    assert f([("x", None)]) != f([(None, "x")]) and f([("x", "y")]) != f([("x", "y"), ("x", "y")])


def test_key_figures_with_nulls_over_seams(spark):
    """Null members of a hot key that span partitions, and a first member that spans the next seam."""
    rows = [("hot", None, i, 0) for i in range(400)] + [("hot", "a", -i, 1) for i in range(1, 400)] + [("hot", f"b{i % 7}", i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, m string, o bigint, s bigint")
    for partitions in (1, 5, 16):
        got = key_figures(df, "k", "m", "o", "s", partitions).first()
        assert (got.n_rows, got.n_members, got.best_order) == (849, 8, 0)
