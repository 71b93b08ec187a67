"""Sources, sinks, the live run, and the queries against their SQL."""

import gzip
import os
import random
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandmill import sinks
from strandmill.plans import mapping, problems, strategy
from strandmill.sources import assembly
from strandmill.sources.fastq import read_fastq
from strandmill.sources.paf import paf_line, read_paf
from strandmill.operators.coverage import bin_sums
from strandmill.operators.decisions import look_up
from strandmill.streaming.live import LiveRun, new_fastq, new_files

SMALL = "/root/testdata/sf0.001"


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first\nacgt\nAC\n>c2\r\nGG\r\n\n>c3\n" + "A" * 40 + "\n")
    got = {r.contig: (r.seq, r.length) for r in assembly.read_fasta(spark, str(tmp_path / "r.fa")).collect()}
    assert got == {"c1": ("ACGTAC", 6), "c2": ("GG", 2), "c3": ("A" * 40, 40)}
    ref = {r.contig: (r.seq, r.rejected) for r in assembly.reference_contigs(assembly.read_fasta(spark, str(tmp_path / "r.fa")), ["c3"], 3).collect()}
    assert ref == {"c1": ("ACGTAC", False), "c3": ("ACGT", True)}


def test_gfa(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("S\tutg1l\tACGT\tLN:i:4\nA\tutg1l\t0\t+\tr1\nA\tutg1l\t7\t-\tr2\nL\tutg1l\t+\tx\nx\tutg1l\t9\t9\t1\t0\nS\tutg2c\tAC\tLN:i:2\n")
    got = {r.unitig: r for r in assembly.read_gfa(spark, str(tmp_path / "a.gfa")).collect()}
    assert [tuple(a) for a in got["utg1l"].atoms] == [(0, False, "r1", 7), (7, True, "r2", -1)]
    assert (got["utg1l"].circular, got["utg1l"].cap_l, got["utg1l"].cap_r) == (False, True, False)
    assert got["utg2c"].circular and got["utg2c"].atoms is None


def test_paf_files(spark, tmp_path):
    good = "007\t100\t0\t90\t+\tt\t500\t10\t100\t80\t90\t60"
    (tmp_path / "m.paf").write_text(f"{good}\ttp:A:P\tAS:i:7\tcg:Z:90M\n{good}\ttp:A:S\nshort\tline\n{good.replace('100', 'x')}\ttp:A:P\n")
    rows = read_paf(spark, str(tmp_path / "m.paf")).orderBy("align_score").collect()
    assert [(r.qname, r.qlen, r.align_score, r.s1, r.cigar) for r in rows] == [("007", None, 0, 0, None), ("007", 100, 7, 0, "90M")]
    back = read_paf(spark, str(tmp_path / "m.paf")).filter("qlen = 100").select(paf_line()).first()[0]
    assert back == good + "\ts1:i:0"
    bare = read_paf(spark, str(tmp_path / "m.paf")).filter("qlen is null").withColumn("mapq", F.lit(None)).select(paf_line()).first()[0]
    assert bare == "007\t0\t0\t90\t+\tt\t500\t10\t0\t80\t90\t255\ts1:i:0"


def test_channels(spark, tmp_path):
    p = tmp_path / "channels.toml"
    p.write_text('[conditions.0]\nname = "a"\nchannels = [1, 2]\n[conditions.1]\nname = "b"\nchannels = [3]\n')
    assert assembly.read_channels(str(p), "b") == {3}
    with pytest.raises(ValueError):
        assembly.read_channels(str(p), "c")
    p.write_text('[conditions.0]\nname = "a"\nchannels = [1, 2]\n')
    assert assembly.read_channels(str(p), "zz") == set()
    reads = spark.createDataFrame([("r", 1), ("s", 9), ("t", None)], "read_id string, channel int")
    assert [r.read_id for r in assembly.keep_channels(reads, spark.createDataFrame([(1,), (1,)], "channel int")).collect()] == ["r"]


def test_fastq_files(spark, tmp_path):
    (tmp_path / "barcode01").mkdir()
    (tmp_path / "barcode01" / "a.fastq").write_text("@r1 x ch=5 barcode=barcode12 run\nACGT\n+\n!!!!\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r2 x ch=6\nAC\n+\n!!\n@r3\nA\n+\n!")
    got = {r.read_id: (r.length, r.channel, r.barcode, r.source) for r in read_fastq(spark, str(tmp_path)).collect()}
    assert got == {"r1": (4, 5, 12, "run"), "r2": (2, 6, 0, "ch=6"), "r3": (1, None, 0, None)}
    q = new_fastq(spark, str(tmp_path)).writeStream.format("memory").queryName("fq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fq").count() == 2


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert sinks.latest(spark, folder) is None
    sinks.publish(spark.range(3), folder, 0)
    sinks.publish(spark.range(5), folder, 1)
    sinks.publish(spark.range(9), folder, 1)  # a replay changes nothing
    assert sinks.latest(spark, folder).count() == 5 and sinks.latest(spark, folder, 1).count() == 3
    assert sinks.versions(spark, folder) == [0, 1]


def test_text_sinks(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT")], "header string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "f"))
    assert assembly.read_fasta(spark, str(tmp_path / "f")).first().seq == "ACGT"
    sinks.write_links(spark.createDataFrame([("x",), ("x",), ("y",)], "line string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    log = spark.createDataFrame([(1, "r", "single_on")], "loop_counter int, read_id string, decision string")
    sinks.append_decisions(log, str(tmp_path / "d"))
    sinks.append_decisions(log, str(tmp_path / "d"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "d")).count() == 2
    sinks.write_dumps(spark.createDataFrame([("control", 1, "r", "AC"), ("treatment", 2, "r", "AC")], "condition string, dump int, read_id string, seq string"), str(tmp_path / "00_reads"))
    assert os.path.isdir(tmp_path / "00_reads" / "condition=control" / "dump=1")


def test_live_run_replays_and_adds_up(spark, tmp_path):
    contigs = spark.createDataFrame([("c", 5000)], "contig string, length int")
    schema = "qname string, qlen int, tname string, strand string, tstart int, tend int, cigar string"
    parts = [[("p", 150, "c", "+", 0, 150, None), ("q", 9, "x", "+", 0, 9, None)], [("r", 1200, "c", "-", 100, 300, "50M20D130M"), ("s", 5, "c", "+", 5, 5, None)], [("t", 11, "c", "+", 4990, 5001, None)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run = LiveRun(contigs, f"file://{tmp_path}/state")
    stream = new_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet", 1)
    run.start(stream, f"{tmp_path}/checkpoint", None).awaitTermination()
    want = {0: 100, 1: 150, 2: 100}
    depth = lambda: {r.bin: r.total for r in bin_sums(run.state(spark, "depth").withColumn("all", F.col("bases") + F.col("dels")), ["contig"], "all").collect()}
    assert depth() == want
    assert {(r.s, r.e) for r in run.state(spark, "depth").filter("dels = 1").collect()} == {(150, 170)}
    assert run.state(spark, "reads").first().n == 2 and run.state(spark, "bases").first().n == 1375
    assert {r.length: r.n for r in run.state(spark, "lengths").collect()} == {1200: 1}
    assert run.state(spark, "strategy") is None  # no bucket is on
    n = len(sinks.versions(spark, f"file://{tmp_path}/state/depth"))
    run.update(spark.createDataFrame(parts[0], schema), n - 1)  # the last batch once more
    assert depth() == want
    run.start(stream, f"{tmp_path}/checkpoint", None).awaitTermination()  # nothing new
    assert run.state(spark, "reads").first().n == 2


def test_live_run_publishes_by_barcode(spark, tmp_path):
    contigs = spark.createDataFrame([("c", 40_000)], "contig string, length int")
    run = LiveRun(contigs, f"file://{tmp_path}/state", [0, 7], data_wait=0.5)
    schema = "qname string, qlen int, tname string, strand string, tstart int, tend int, cigar string, barcode int"
    rows = [(f"r{i}", 4000, "c", "+-"[i % 2], 100 * i, 100 * i + 4000, None, 7 if i % 3 else None) for i in range(100)]
    run.update(spark.createDataFrame(rows, schema), 0)
    assert run.state(spark, "strategy") is None  # too few bases
    run.update(spark.createDataFrame([(f"x{q}", *rest) for q, *rest in rows], schema), 1)
    strategy = run.state(spark, "strategy")
    assert strategy.count() == 400 * 2 * 2 and set(strategy.columns) == {"contig", "barcode", "bin", "strand", "accept"}
    asked = look_up(spark.createDataFrame(rows[:4], schema), strategy, contigs.withColumn("rejected", F.lit(False)), False)
    assert asked.count() == 4 and look_up(asked.drop("accept"), None, contigs.withColumn("rejected", F.lit(True)), True).filter("accept").count() == 0


CORE = {**problems.QUERIES, **mapping.QUERIES, **strategy.QUERIES}
SQL = {**problems.ORACLE, **mapping.ORACLE, **strategy.ORACLE}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def values(rows):
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(autouse=True, scope="module")
def one_update():
    """The update is planned once for all queries that ask for it here."""
    before = strategy.update, strategy.strategy
    strategy.update, strategy.strategy = map(lru_cache, before)
    yield
    strategy.update, strategy.strategy = before


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, SMALL)
    cols = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = values([[r[names.index(c)] for c in cols] for r in result.fetchall()])
    assert values([[r[c] for c in cols] for r in df.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_other_queries_run(spark, name):
    assert CORE[name](spark, SMALL).agg(F.count("*")).first()[0] >= 0


def fastq_table(spark, folder, files):
    """fastq_files of (file_id, sequences of its reads), and the table in DuckDB."""
    rows = [(i, f"{n}.fq", "".join(f"@r{n}.{k} ch=1\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(seqs))) for n, (i, seqs) in enumerate(files)]
    spark.createDataFrame(rows, "file_id bigint, path string, content string").write.parquet(f"{folder}/fastq_files.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW fastq_files AS SELECT * FROM '{folder}/fastq_files.parquet/*.parquet'")
    return con


def moved_rows(df):
    """Rows that ``df``, which has been collected, wrote to shuffles or broadcast."""
    names = {"Exchange": "shuffleRecordsWritten", "BroadcastExchange": "numOutputRows"}
    stack, total = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        else:
            total += node.metrics().apply(names[node.nodeName()]).value() if node.nodeName() in names else 0
            stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_same_species_moves_reads_only(spark, tmp_path):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    alike = draw(3000)
    con = fastq_table(spark, tmp_path, [(i, [alike, alike[:-30] + draw(30), "AC" * 60 + draw(90)]) for i in range(40)])
    df = CORE["same_species"](spark, str(tmp_path))
    want = values(con.execute(SQL["same_species"]).fetchall())
    assert len(want) == 40 and values(df.collect()) == want
    assert 0 < moved_rows(df) <= 120  # one for each read, none for a tetramer


def test_tetramer_distance_of_odd_files(spark, tmp_path):
    """Copies of a file number, also with other reads, none of it, letters without tetramers, reads with none in common."""
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("ACGTNacgt", weights=[9, 9, 9, 9, 1, 1, 1, 1, 1], k=n))
    files = [(i, [draw(rng.choice([1, 2, 3, 5, 60, 400])) for _ in range(rng.choice([1, 2, 5]))]) for i in range(60)]
    files += [(7, files[7][1]), (3, [draw(80), draw(90), draw(70)]), (3, [draw(50)]), (None, [draw(90), draw(90)]), (None, [draw(90)])]
    files += [(90, ["A" * 40, "C" * 40, "AC" * 20]), (91, ["N" * 30, draw(300)]), (92, []), (93, [draw(9), "A", draw(200), draw(300)] * 30)]
    con = fastq_table(spark, tmp_path, files)
    df = CORE["tetramer_distance"](spark, str(tmp_path))
    want = values(con.execute(SQL["tetramer_distance"]).fetchall())
    assert len(want) > 50 and values(df.collect()) == want
    assert 0 < moved_rows(df) <= sum(len(reads) for _, reads in files)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
