"""Operators against brute force and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import scoring
from strandmill.functions import sequences as S
from strandmill.model import DEFAULT_CCL, Config, read_config, write_template
from strandmill.operators import benefit as B
from strandmill.operators import classify as C
from strandmill.operators import coverage, graph, lengths, starts
from strandmill.operators import decisions as D
from strandmill.operators import sampling
from strandmill.operators.ordered import PART, carry, spread
from strandmill.operators.sampling import number_rows, read_batches
from strandmill.plans.update import update_from
from strandmill.sources import assembly

PAF = "line_no bigint, qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, num_matches int, blen int, mapq int, align_score int, s1 int, is_primary boolean"


def paf(spark, rows):
    """rows of (qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend[, s1])."""
    full = [(i, *r[:9], 1, max(r[3] - r[2], r[8] - r[7]), 60, 1, r[9] if len(r) > 9 else 500, True) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, PAF)


@pytest.mark.parametrize(
    "row, cls, sides",
    [
        (("q", 10_000, 4000, 6000, "+", "t", 10_000, 4000, 6000), 1, (None, None)),
        (("q", 3000, 0, 3000, "+", "t", 10_000, 2000, 5000), 2, (None, None)),
        (("q", 10_000, 2000, 5000, "-", "t", 3000, 0, 3000), 3, (None, None)),
        (("q", 10_000, 6000, 10_000, "+", "t", 10_000, 0, 4000), 4, ("R", "L")),
        (("q", 10_000, 0, 4000, "+", "t", 10_000, 6000, 10_000), 5, ("L", "R")),
        (("q", 10_000, 6000, 10_000, "-", "t", 10_000, 5900, 9900), 4, ("R", "R")),
        (("q", 10_000, 0, 4000, "-", "t", 10_000, 100, 4100), 4, ("L", "L")),
        (("q", 30_000, 10_000, 29_500, "+", "t", 40_000, 4500, 24_000), 2, (None, None)),
        (("q", 40_000, 29_000, 39_500, "+", "t", 40_000, 4500, 15_000), 6, (None, None)),
    ],
)
def test_classes(spark, row, cls, sides):
    r = C.with_class(paf(spark, [row])).first()
    assert (r.cls, (r.qside, r.tside)) == (cls, sides)


def test_trimming(spark):
    cut = C.trim_coords(C.with_class(paf(spark, [("q", 40_000, 29_000, 39_500, "+", "t", 40_000, 4500, 15_000)]))).first()
    assert (cut.sid, cut.trim_start, cut.trim_stop, cut.other) == ("t", 0, 4500, "q")
    seqs = spark.createDataFrame([("t", "ACGTACGT"), ("u", "A")], "header string, seq string")
    cuts = spark.createDataFrame([("t", 2, 4), ("t", 5, None)], "sid string, trim_start int, trim_stop int")
    assert sorted(tuple(r) for r in S.remove_stretches(seqs, cuts).collect()) == [("t%", "ACACGT"), ("t%", "ACGTA")]


def test_best_records_and_ties(spark):
    rows = [("a", 100, 0, 90, "+", "t", 100, 0, 90, 5), ("a", 100, 0, 90, "+", "u", 100, 0, 90, 5), ("u", 100, 0, 90, "+", "a", 100, 0, 90, 5)]
    assert C.best_mapping(paf(spark, rows)).filter("qname = 'a'").first().line_no == 1
    best = {r.pair: r.line_no for r in C.best_of_pair(paf(spark, rows)).collect()}
    assert best == {"a-t": 0, "a-u": 2}
    nulls = paf(spark, rows).withColumn("mapq", F.when(F.col("line_no") == 1, None).otherwise(F.col("mapq")))
    assert C.best_mapping(nulls).filter("qname = 'a'").first().line_no == 0


def test_model_matrices():
    assert [len(scoring.phi(p, d)[0]) for p in (1, 2) for d in (True, False)] == [5, 4, 15, 10]
    for p in (1, 2):
        assert np.allclose(np.array(scoring.phi(p)).sum(axis=0), 1)
    assert np.allclose(np.array(scoring.priors(1)).sum(axis=1), 1)
    assert np.allclose(np.array(scoring.priors(2)).sum(axis=1), 1.01133244, atol=1e-7)


def test_scores_of_known_patterns(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, "A"), (2, 0, 0, 0, 0, "T"), (28, 0, 0, 0, 0, "A"), (None, None, None, None, None, "N"), (5000, 0, 0, 0, 0, "a")], "a int, c int, g int, t int, d int, ref string")
    r = scoring.with_posterior(df, list("acgtd"), "ref").collect()
    assert math.isclose(r[0].score, 0.04969294, abs_tol=1e-8) and math.isclose(r[0].entropy, 0.09302521, abs_tol=1e-8)
    assert math.isclose(r[1].score, 0.17253973305650225, abs_tol=1e-12) and math.isclose(r[1].entropy, 0.22957118271635163, abs_tol=1e-12)
    assert r[2].score < 1e-15 and r[3].score == pytest.approx(r[0].score) and abs(sum(r[4].posterior) - 1) < 1e-12


def test_full_depth_and_dropout(spark):
    df = spark.createDataFrame([("x", 40, 0, 0, 0, 0, "A"), ("x", 1, 0, 0, 0, 0, "A"), ("x", 1, 0, 0, 0, 0, "A"), ("y", 1, 0, 0, 0, 0, "A")], "contig string, a int, c int, g int, t int, d int, ref string")
    s = scoring.position_scores(df, list("acgtd"), "ref").withColumn("total", F.col("a"))
    assert s.filter("a = 40").first().score == 2.2250738585072014e-308
    out = [(r.contig, r.a, r.score > 0) for r in scoring.drop_out(s, ["contig"]).collect()]
    assert sorted(out) == [("x", 1, False), ("x", 1, False), ("x", 40, True), ("y", 1, True)]


def test_pileup(spark):
    rows = [("c", 10, "2M1I2M1D1M", "ACGTAC", 1), ("c", 10, "1S2M", "TAC", None), ("c", 10, "2M", "NN", 1), (None, 1, "1M", "A", 1), ("c", None, "1M", "A", 1), ("c", 3, "2=1X", "acg", 1)]
    got = {(r.pos, r.barcode): (r.a, r.c, r.g, r.t, r.d) for r in S.cigar_pileup(spark.createDataFrame(rows, "contig string, tstart int, cigar string, seq string, barcode int")).collect()}
    assert got == {(10, 1): (1, 0, 0, 0, 0), (11, 1): (0, 1, 0, 0, 0), (12, 1): (0, 0, 0, 1, 0), (13, 1): (1, 0, 0, 0, 0), (14, 1): (0, 0, 0, 0, 1), (15, 1): (0, 1, 0, 0, 0),
                   (10, 0): (1, 0, 0, 0, 0), (11, 0): (0, 1, 0, 0, 0), (3, 1): (1, 0, 0, 0, 0), (4, 1): (0, 1, 0, 0, 0), (5, 1): (0, 0, 1, 0, 0)}


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_depth_bins_and_buckets(spark, tile):
    rng = random.Random(tile)
    spans = [("c", s, s + rng.randrange(0, 30)) for s in (rng.randrange(200) for _ in range(80))]
    depth = np.zeros(260, int)
    for _, s, e in spans:
        depth[s:e] += 1
    df = coverage.depth_stretches(spark.createDataFrame(spans, "contig string, tstart int, tend int"), ["contig"], tile=tile)
    got = np.zeros(260, int)
    for r in df.collect():
        assert not got[r.s : r.e].any()
        got[r.s : r.e] = r.depth
    assert (got == depth).all()
    sums = {r.bin: r.total for r in coverage.bin_sums(df, ["contig"], size=10).collect()}
    assert all(sums.get(b, 0) == depth[b * 10 : b * 10 + 10].sum() for b in range(26))
    lengths_ = spark.createDataFrame([("c", 255)], "contig string, length int")
    means = {r.bucket: r.mean_depth for r in coverage.bucket_means(df, lengths_, ["contig"], 50).collect()}
    want = [depth[b * 50 : b * 50 + 50].mean() for b in range(5)]
    assert [means[b] for b in range(6)] == pytest.approx([*want, want[-1]])
    before = spark.createDataFrame([("c", 0, True)], "contig string, bucket bigint, on boolean")
    on = {r.bucket: r.on for r in coverage.switch_buckets(coverage.bucket_means(df, lengths_, ["contig"], 50), 1e9, before).collect()}
    assert on[0] and not on[1]
    limit = coverage.repeat_limit(df, spark.createDataFrame([("c", 260)], "contig string, length int"), ["contig"], 0.9, 0.5).first()[0]
    assert limit == pytest.approx(max(np.quantile(depth, 0.9), 0.5))


def test_runs(spark):
    d = spark.createDataFrame([("c", 0, 10, 5), ("c", 10, 20, 6), ("c", 20, 30, 1), ("c", 30, 35, 9), ("c", 40, 90, 9)], "k string, s int, e int, depth int")
    assert sorted(tuple(r) for r in S.runs_at_least(d, ["k"], "s", "e", "depth", 5, 5).collect()) == [("c", 0, 20), ("c", 40, 90)]


def test_lengths(spark):
    reads = spark.createDataFrame([(i,) for i in [None, 500, 800, *range(801, 1801), 5_000_000]], "length int")
    h = lengths.length_histogram(reads)
    stats = lengths.length_stats(h).first()
    assert (stats.n, stats.max_length) == (1001, 999_999)
    ls = sorted([*range(801, 1801), 999_999])
    want = [ls[math.ceil(len(ls) * (2 * p + 1) / 20) - 1] for p in range(10)]
    assert [r.ccl for r in lengths.ccl_partition(h).orderBy("part").collect()] == want
    assert lengths.length_stats(h.limit(0)).first().n == 0


def test_starts(spark):
    contigs = spark.createDataFrame([("c", 5000), ("d", 1000)], "contig string, length int")
    maps = spark.createDataFrame([("c", "+", 0, 10), ("c", "+", 1999, 2500), ("c", "-", 0, 4000), ("c", "+", 4500, 4600), ("d", "+", 1, 2), ("x", "+", 1, 2)], "tname string, strand string, tstart int, tend int")
    counts = starts.start_counts(maps, contigs)
    assert {(r.window, r.strand): r.n for r in counts.collect()} == {(0, 0): 2, (1, 0): 0, (0, 1): 0, (1, 1): 1}
    f = {(r.window, r.strand): r.fhat for r in starts.start_probabilities(counts).collect()}
    assert f[0, 0] == pytest.approx(3 / 7) and f[1, 0] == pytest.approx((1 - 0.1 * 3 / 6) / 7)
    bins = starts.bin_probabilities(starts.start_probabilities(counts), contigs)
    assert bins.count() == 100 and bins.agg(F.sum("fhat")).first()[0] == pytest.approx(1)
    p = starts.dirichlet_priors(counts).first()
    x = np.array([2, 0, 0, 1]) / 3
    assert p.alpha == pytest.approx(3 / (x.var() * 64) - 1 / 4) and p.p_zero == 0.5


def brute_benefit(s, ccl, m):
    n = len(s)
    smu = np.array([[s[i : i + m].sum() for i in range(n)], [s[max(0, i - m + 1) : i + 1].sum() for i in range(n)]])
    exp = np.zeros((2, n))
    for k, w in enumerate(ccl):
        for i in range(n):
            exp[0, i] += (0.95 - 0.1 * k) * s[i : i + w].sum()
            exp[1, i] += (0.95 - 0.1 * k) * s[max(0, i - w + 1) : i + 1].sum()
    return smu, exp


def test_benefit_and_threshold(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 9, 60).astype(float)
    widths = [1, 2, 3, 5, 8, 9, 12, 20, 30, 70]
    bins = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(s)], "contig string, bin bigint, total double")
    cells = B.additional_benefit(bins, ["contig"], tuple(w * 100 for w in widths))
    smu, exp = brute_benefit(s, widths, 4)
    for r in cells.collect():
        assert (r.smu, r.expected) == pytest.approx((smu[r.strand, r.bin], exp[r.strand, r.bin]))
    add = np.maximum(exp - smu, 0)
    x = add[add > 0]
    e = np.abs(np.frexp(x / x.max())[1])
    es = sorted(set(e))
    n = np.array([(e == k).sum() for k in es])
    bound = 2.0 ** -np.array(es) * x.max()
    ratio = (7.0 + np.cumsum(bound * n)) / (10 + np.cumsum(n) * 53.0)
    want = bound[min(ratio.argmax() + 1, len(es) - 1)]
    curve = B.threshold_curve(B.benefit_exponents(cells, "additional", None), 7.0, 10.0, 53.0)
    assert B.threshold(curve).first()[0] == pytest.approx(want)


def test_assembly_benefit(spark):
    rng = np.random.default_rng(2)
    s, widths = rng.random(25), [1, 2, 2, 3, 4, 4, 5, 6, 7, 8]
    bins = spark.createDataFrame([("c", i, float(x), True, False) for i, x in enumerate(s)], "contig string, bin bigint, score double, open_l boolean, open_r boolean")
    pad = widths[-1]
    x = np.zeros(25 + 2 * pad)
    x[pad:-pad], x[:pad] = s, 1
    n = len(x)
    trail = lambda v, w: np.array([v[max(0, i - w + 1) : i + 1].sum() for i in range(n)])
    smu, ben = np.stack([trail(x, 4), trail(x[::-1], 4)]), np.zeros((2, n))
    for k, w in enumerate(widths):
        ben[0, : n - w - 1] += trail(x, w)[w:-1] * (1 - 0.1 * k)
        ben[1, w:-1] += trail(x[::-1], w)[w:-1][::-1] * (1 - 0.1 * k)
    want = np.maximum(ben - smu, 0)[:, pad:-pad]
    for r in B.padded_benefit(bins, ["contig"], tuple(w * 100 for w in widths)).collect():
        assert r.benefit == pytest.approx(want[r.strand, r.bin]) and r.smu_sum == pytest.approx(smu.sum())


def test_distribution_keeps_what_is_off(spark):
    mask = spark.createDataFrame([("c", b, 0, False) for b in (0, 199, 200, 400)], "contig string, bin bigint, strand int, accept boolean")
    buckets = spark.createDataFrame([("c", 0, True), ("c", 1, False)], "contig string, bucket bigint, on boolean")
    before = spark.createDataFrame([("c", 400, 0, False)], "contig string, bin bigint, strand int, accept boolean")
    assert {r.bin: r.accept for r in B.distribute(mask, buckets, before).collect()} == {0: False, 199: False, 200: True, 400: False}


def test_update_plan_runs_end_to_end(spark):
    rng = random.Random(0)
    maps = [("c", "+-"[rng.random() < 0.5], s, s + rng.randrange(100, 3000)) for s in (rng.randrange(37_000) for _ in range(300))]
    u = update_from(spark.createDataFrame(maps, "tname string, strand string, tstart int, tend int").withColumn("cigar", F.lit(None).cast("string")), spark.createDataFrame([("c", 40_050)], "contig string, length int"))
    rows = u.strategy.collect()
    assert len(rows) == 800 and u.bound.first()[0] > 0
    assert u.fhat.agg(F.sum("fhat")).first()[0] == pytest.approx(1)


def test_lookup_defaults(spark):
    maps = spark.createDataFrame([("a", "c", "+", 150, 300), ("b", "c", "-", 0, 100), ("d", "x", "+", 0, 9), ("e", "r", "+", 0, 9)], "qname string, tname string, strand string, tstart int, tend int")
    strategy = spark.createDataFrame([("c", 1, 0, False), ("c", 1, 1, True)], "contig string, bin bigint, strand int, accept boolean")
    contigs = spark.createDataFrame([("c", False), ("r", True)], "contig string, rejected boolean")
    got = lambda default, at="tend - 1": {r.qname: r.accept for r in D.look_up(maps, strategy, contigs, default, at).collect()}
    assert got(False) == {"a": False, "b": False, "d": False, "e": False}
    assert got(True, "tend") == {"a": False, "b": True, "d": True, "e": False}
    reads = spark.createDataFrame([("a", 5), ("b", 5), ("z", 5), ("y", 0), ("w", None)], "read_id string, length int")
    live = {r.read_id: r.decision for r in D.decide_live(reads, D.look_up(maps.unionByName(maps.filter("qname = 'b'")), strategy, contigs, True, "tend")).collect()}
    assert live == {"a": "single_off", "b": "multi_on", "z": "no_map", "y": "no_seq", "w": "no_seq"}


def brute_override(chunks, lo, hi, dry, mid, duplex):
    out, last, decision = [], None, None
    for i, (seen, control, action) in enumerate(chunks):
        own = None
        if control:
            action = "stop_receiving"
        else:
            if seen > hi and action == "proceed":
                action = "unblock"
            if seen < lo and action != "proceed":
                action = "proceed"
        over, previous = False, last
        if duplex and action == "unblock" and last == "stop_receiving" and decision not in ("first", "duplex"):
            action, over, own = "stop_receiving", True, "duplex"
        if mid and last is None:
            action, over, own = "stop_receiving", True, "first"
        sent = action if action != "proceed" else None
        if action == "unblock" and dry:
            sent, over = "stop_receiving", True
        if action != "proceed":
            last, decision = action, own
        out.append((action, previous, sent, over))
    return out


@pytest.fixture
def narrow_partitions(spark):
    """Range partitions stay apart, so that keys run over seams."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_values_carried_over_seams(spark, narrow_partitions):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    placed = spread(df, "k", "i")
    assert placed.filter("k = 'hot'").select(PART).distinct().count() > 1
    got = {r.i: (r.last, r.before) for r in carry(placed, "k", ("i",), last=F.col("v"), before=F.col("i")).collect()}
    last, before, want = {}, {}, {}
    for k, i, v in rows:
        want[i] = (last.get(k), before.get(k))
        before[k] = i
        last[k] = v if v is not None else last.get(k)
    assert got == want
    assert carry(spread(df.limit(0), "k", "i"), "k", ("i",), last=F.col("v")).count() == 0


@pytest.mark.parametrize("dry, mid, duplex", [(False, False, False), (True, True, False), (False, True, True), (True, False, True)])
def test_overrides_against_the_sequence(spark, narrow_partitions, dry, mid, duplex):
    rng = random.Random(7)
    rows, want = [], {}
    for ch in range(12):
        chunks = [(rng.randrange(6), ch % 4 == 0, rng.choice(["proceed", "unblock", "stop_receiving"])) for _ in range(300 if ch == 5 else 30)]
        rows += [(ch, i, *x) for i, x in enumerate(chunks)]
        want |= {(ch, i): x for i, x in enumerate(brute_override(chunks, 1, 4, dry, mid, duplex))}
    df = spark.createDataFrame(rows, "channel int, seq_no int, seen int, control boolean, action string")
    got = D.override_actions(df, 1, 4, dry_run=dry, mid_run=mid, duplex=duplex).collect()
    assert {(r.channel, r.seq_no): (r.final_action, r.previous, r.sent, r.overridden) for r in got} == want


def test_pseudotime_and_dumps(spark):
    reads = spark.createDataFrame([("a", 1000), ("b", 5000), ("c", 300)], "read_id string, length int")
    decided = spark.createDataFrame([("a", True), ("b", False)], "read_id string, accept boolean")
    sim = D.simulate(reads, decided).withColumn("batch", F.lit(1))
    assert {r.read_id: r.seen_length for r in sim.collect()} == {"a": 1000, "b": 400, "c": 300}
    t = D.pseudotime(sim, "batch").first()
    assert (t.control, t.treatment) == (6300 + 900, 1700 + 2 * 300 + 900)
    rng, total, dump, rows, want = random.Random(5), 0, 1, [], {}
    for b in range(60):
        total += rng.choice([0, 1, 5, 40])
        rows.append((b, total))
        want[b] = dump
        dump += total > 10 * dump
    got = D.dump_numbers(spark.createDataFrame(rows, "b int, t int"), "b", "t", 10)
    assert {r.b: r.dump for r in got.collect()} == want


def test_kmers(spark):
    seqs = spark.createDataFrame([("x", "ACGTN"), ("y", ""), ("z", "AC")], "h string, s string")
    got = {(r.h, r.k, r.kmer): r.n for r in S.kmer_counts(seqs, "h", "s").collect()}
    comp = str.maketrans("ATGC", "TACG")
    want = {}
    for h, s in (("x", "ACGTN"), ("y", ""), ("z", "AC")):
        t = s + s.translate(comp)[::-1]
        for k in (2, 3, 4):
            for i in range(len(t) - k - 1):
                if "N" not in t[i : i + k]:
                    want[h, k, t[i : i + k]] = want.get((h, k, t[i : i + k]), 0) + 1
    assert got == want


def test_layers_and_coverage(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    layers = {(r.src, r.dst): (r.layer, r.multiplicity) for r in graph.contain_layers(df).collect()}
    assert layers == {("a", "b"): (0, 2), ("a", "d"): (0, 2), ("b", "c"): (1, 1), ("d", "c"): (1, 1)}
    assert graph.contain_layers(df.filter("src = 'x' or src = 'y'")).count() == 0
    assert graph.contain_layers(df.limit(0)).count() == 0
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1200)] + [("n0005", "side"), ("side", "n0009"), ("r", "n0700")]
    got = {(r.src, r.dst): r.layer for r in graph.contain_layers(spark.createDataFrame(chain, "src string, dst string")).collect()}
    want = {**{(a, b): int(a[1:]) for a, b in chain[:1200]}, ("n0005", "side"): 5, ("side", "n0009"): 6, ("r", "n0700"): 0}
    for i in range(9, 700):
        want[f"n{i:04}", f"n{i + 1:04}"] = 7 + i - 9
    for i in range(700, 1200):
        want[f"n{i:04}", f"n{i + 1:04}"] = 1 + i - 700
    assert got == want
    seqs = {"a": [1.0, 2.0, 3.0], "b": [1.0] * 5, "c": [99.0] * 3}
    cells = spark.createDataFrame([(h, i, v) for h, values in seqs.items() for i, v in enumerate(values)], "header string, at int, value double")
    cont = spark.createDataFrame([("a", "b", 1, 5, 0, 3, True), ("b", "c", 0, 2, 0, 4, False)], "src string, dst string, ostart int, oend int, cstart int, cend int, rev boolean")
    out = {h: [0.0] * len(v) for h, v in seqs.items()}
    for r in graph.pass_coverage(cells, cont).collect():
        out[r.header][r.at] = r.value
    # a lengthened by its last value and turned round: 3 3 2 1 at 1..5 of b; then b cut to two values: 1 4 at 0..2 of c.
    assert out == {"a": [1.0, 2.0, 3.0], "b": [1.0, 4.0, 4.0, 3.0, 2.0], "c": [100.0, 100.0, 99.0]}
    assert graph.pass_coverage(cells, cont.limit(0)).count() == 11 and graph.pass_coverage(cells.limit(0), cont).count() == 0


def test_multiline_containment(spark):
    rows = [("q", 1000, 0, 500, "+", "t", 9000, 1000, 1500), ("q", 1000, 500, 1000, "+", "t", 9000, 1500, 2000), ("p", 1000, 0, 100, "+", "t", 9000, 0, 100), ("p", 1000, 0, 100, "+", "t", 9000, 0, 100)]
    got = graph.multiline_containments(paf(spark, rows)).collect()
    assert [(r.src, r.dst, r.cstart, r.cend, r.ostart, r.oend, r.n) for r in got] == [("q", "t", 0, 900, 1000, 1900, 2)]


def test_graph_small_parts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    ids = spark.createDataFrame([("c",)], "id string")
    assert [tuple(r) for r in graph.without_ids(edges, ids).select("src", "dst").collect()] == [("a", "b")]
    seqs = spark.createDataFrame([("a", "AAAA", 1), ("b", "A", 1), ("c", "A", 5)], "header string, seq string, temperature int")
    cooled = {r.header: (r.temperature, r.frozen) for r in graph.cool_down(graph.reset_temperature(seqs, ids, 60), 3).collect()}
    assert cooled == {"a": (1, False), "b": (0, True), "c": (59, False)}
    reps = spark.createDataFrame([("r", 0, 4), ("r", 1, 3), ("s", 498, 506), ("u", 10, 12)], "tname string, tstart int, tend int")
    assert {r.id for r in graph.repeat_reads(reps).collect()} == {"r", "s"}
    atoms = spark.createDataFrame([("u", 0, False, "x", 2), ("u", 2, True, "y", -1)], "header string, pos int, rev boolean, name string, n int")
    covs = spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("y", [4.0, 5.0])], "header string, cov array<double>")
    assert graph.unitig_coverage(atoms, covs).first().cov == [1.0, 2.0, 5.0, 4.0]


def test_configuration(tmp_path):
    write_template(str(tmp_path / "t.toml"))
    assert read_config(str(tmp_path / "t.toml")) == Config()
    (tmp_path / "a.toml").write_text('[general]\nname = "x"\nref = "r.fa"\nbarcodes = ["barcode01"]\n[optional]\nploidy = 2\n')
    c = read_config(str(tmp_path / "a.toml"))
    assert c.reference_mode and c.optional.ploidy == 2 and c.general.barcodes == ["barcode01"]
    for bad in ('[general]\nname = "a b"', "[general]\nwait = 'x'", "[general]\nnone = 1", "[other]\n", "[optional]\nploidy = 3"):
        (tmp_path / "b.toml").write_text(bad)
        with pytest.raises(ValueError):
            read_config(str(tmp_path / "b.toml"))
    assert DEFAULT_CCL[0] == 1167


def test_routing_and_members(spark):
    rows = [("a", 10_000, 6000, 10_000, "+", "b", 10_000, 0, 4000), ("a", 10_000, 6000, 10_000, "+", "x", 10_000, 0, 4000), ("x", 10_000, 6000, 10_000, "+", "a", 10_000, 0, 4000), ("b", 10_000, 0, 4000, "+", "a", 10_000, 6000, 10_000)]
    acceptors = spark.createDataFrame([("a",), ("b",), ("a",)], "header string")
    records = C.with_class(paf(spark, rows))
    got = {r.line_no: (r.cls, r.kind) for r in graph.route(records, acceptors).collect()}
    assert got == {0: (4, "overlap"), 1: (2, "containment"), 2: (3, "containment"), 3: (5, "overlap")}
    apart = spark.createDataFrame([("a", "b")], "qname string, tname string")
    assert {r.line_no for r in graph.route(records, acceptors, apart).collect()} == {1, 2, 3}
    headers = spark.createDataFrame([("u", "x"), ("u", "y"), ("v", "z")], "header string, name string")
    of = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "2"), ("z", None)], "name string, member string")
    assert {r.header: r.members for r in graph.members(headers, of, with_self=True).collect()} == {"u": ["1", "2", "x", "y"], "v": ["z"]}
    assert [r.k for r in graph.longest(spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, length int"), n=2).collect()] == ["a", "b"]


def test_numbers_and_batches(spark):
    rng = random.Random(3)
    names = [f"r{i:04}" for i in range(500)]
    rng.shuffle(names)
    df = spark.createDataFrame([(n, 1) for n in names], "read_id string, __id int").repartition(7)
    got = {r.read_id: r.number for r in number_rows(df, "read_id").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
    batches = read_batches(df, 40, 10).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in batches} == {b: 40 for b in range(10)}
    a, b = ({r.read_id: r.batch for r in read_batches(df, 40, 10, seed=s).collect()} for s in (1, 2))
    assert a != b and len(a) == len(b) == 400 and a == {r.read_id: r.batch for r in read_batches(df.repartition(3), 40, 10, seed=1).collect()}
    assert number_rows(df.limit(0), "read_id").count() == 0


def test_aligned_parts_by_strand_and_quality(spark):
    maps = spark.createDataFrame(
        [("a", 1, 5, "+", "c", 10, "4M", 1), ("b", 1, 5, "-", "c", 10, "2M1D2M", None), ("z", 0, 1, "+", "c", 0, "1M", 0), ("n", None, 2, "+", "c", 0, "1M", 0)],
        "qname string, qstart int, qend int, strand string, tname string, tstart int, cigar string, barcode int",
    )
    reads = spark.createDataFrame([("a", "TACGTT", "I!I+II"), ("b", "TACGTT", "IIIIII"), ("n", "A", "I")], "read_id string, seq string, qual string")
    assert {r.qname: r.seq for r in S.aligned_parts(maps, reads, 20).collect()} == {"a": "NCNT", "b": "ACGT", "n": None}
    got = {(r.pos, r.barcode): (r.a, r.c, r.g, r.t, r.d) for r in S.increments(maps, reads, 20).collect()}
    assert got == {(11, 1): (0, 1, 0, 0, 0), (13, 1): (0, 0, 0, 1, 0), (10, 0): (1, 0, 0, 0, 0), (11, 0): (0, 1, 0, 0, 0), (12, 0): (0, 0, 0, 0, 1), (13, 0): (0, 0, 1, 0, 0), (14, 0): (0, 0, 0, 1, 0)}
    assert S.increments(maps, reads, 25).filter("d > 0").count() == 0
    twice = S.add_increments(S.increments(maps, reads), S.increments(maps, reads))
    assert {r.n for r in twice.select((F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("d")).alias("n")).collect()} == {2}


def test_trimmed_coverage_and_small_parts(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGTA", [1.0, 2.0, 3.0, 4.0, 5.0])], "header string, seq string, cov array<double>")
    cuts = spark.createDataFrame([("a", 1, 3), ("a", 2, None)], "sid string, trim_start int, trim_stop int")
    assert {(r.seq, tuple(r["cov"])) for r in S.remove_stretches(seqs, cuts, cov="cov").collect()} == {("ATA", (1.0, 4.0, 5.0)), ("AC", (1.0, 2.0))}
    full = spark.createDataFrame([("a", 900, 1), ("b", 800, 2)], "qname string, qlen int, line_no int")
    cut_off = spark.createDataFrame([("a", 400, 1), ("b", 400, 2)], "qname string, qlen int, line_no int")
    decided = spark.createDataFrame([("a", True), ("b", False), ("x", True)], "read_id string, accept boolean")
    mapped = D.full_or_truncated(decided, full, cut_off)
    assert {(r.qname, r.qlen) for r in mapped.collect()} == {("a", 900), ("b", 400)} and D.accepted_mappings(mapped).count() == 1
    assert D.decision_log(spark.createDataFrame([("r", 1)], "read_id string, channel int")).columns == D.LOG_COLUMNS
    reads = spark.createDataFrame([(f"r{i}", i) for i in range(10)], "read_id string, length int")
    batch, records, _ = sampling.batch_with_records(reads, full.withColumn("qname", F.lit("r4")), cut_off, 4, 1)
    assert {r.read_id for r in batch.collect()} == {"r4", "r5", "r6", "r7"} and records.count() == 2
    assert sampling.reads_by_id(reads, reads.filter("length < 2")).count() == 2
    with pytest.raises(ValueError):
        sampling.read_batch(reads, 4, 2)
    with pytest.raises(FileNotFoundError):
        assembly.check_reference(f"{tmp_path}/no.fa")
    toml = tmp_path / "d.toml"
    toml.write_text('[[regions]]\nname = "run"\n')
    assert assembly.check_regions(str(toml), "run") == ["run"]
    with pytest.raises(ValueError):
        assembly.check_regions(str(toml), "other")
    content, at = assembly.reload_if_newer(str(toml), 0.0)
    assert content and assembly.reload_if_newer(str(toml), at) == (None, at)

