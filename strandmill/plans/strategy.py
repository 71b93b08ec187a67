"""Queries of scores, benefit, threshold, strategy and decisions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import scoring
from strandmill.functions.sequences import cigar_pileup as pileup
from strandmill.functions.sequences import increments
from strandmill.model import DEFAULT_CCL
from strandmill.operators import benefit as B
from strandmill.operators import classify as C
from strandmill.operators import coverage, starts
from strandmill.operators import decisions as D
from strandmill.operators.lengths import length_histogram
from strandmill.plans.mapping import _DEPTH, _FQ, _ON, _UNIQUE, GOOD, active_contigs, mappings, on_contigs, unique_reads, unique_started
from strandmill.plans.update import Lengths, Update, observed_lengths, update_from
from strandmill.session import cut, scratch_path, table
from strandmill.sources.fastq import parse_files
from strandmill.streaming.live import LiveRun

PLACE = ["tname", "tstart", "tend", "strand"]
COUNTS = ["a", "c", "g", "t", "d"]


def seen_lengths(spark: SparkSession, d: str) -> Lengths:
    return observed_lengths(length_histogram(unique_reads(spark, d, "length")))


def update(spark: SparkSession, d: str) -> Update:
    return update_from(on_contigs(spark, d), active_contigs(spark, d), seen_lengths(spark, d))


def strategy(spark: SparkSession, d: str) -> DataFrame:
    return cut(update(spark, d).strategy, "strategy")


def read_start_hist(spark, d):
    return starts.start_counts(on_contigs(spark, d), active_contigs(spark, d))


def fhat_pointmass(spark, d):
    f = starts.start_probabilities(read_start_hist(spark, d))
    return f.select("contig", "window", "strand", F.round(F.col("fhat") * 1e6, 6).alias("fhat"))


def fhat_bins(spark, d):
    counts = cut(read_start_hist(spark, d), "starts")
    f = starts.bin_probabilities(starts.start_probabilities(counts), active_contigs(spark, d))
    return f.groupBy("contig", "strand").agg(F.count("*").alias("n"), F.round(F.sum("fhat"), 9).alias("fhat"))


def dirichlet_priors(spark, d):
    p = starts.dirichlet_priors(read_start_hist(spark, d))
    return p.select(F.round("alpha", 6).alias("alpha"), F.round("p_zero", 9).alias("p_zero"))


def bin_depths(spark, d):
    return coverage.bin_sums(coverage.depth_stretches(on_contigs(spark, d), ["tname"]), ["tname"])


def bin_scores(spark, d):
    depth = cut(coverage.pattern_stretches(on_contigs(spark, d).withColumnRenamed("tname", "contig"), ["contig"]), "depth")
    return scoring.bin_scores(depth, active_contigs(spark, d).select("contig", "length"), ["contig"]).withColumn("total", F.col("total").cast("bigint"))


def bucket_switch(spark, d):
    sized = active_contigs(spark, d).select("contig", "length")
    depth = coverage.depth_stretches(on_contigs(spark, d).withColumnRenamed("tname", "contig"), ["contig"])
    return coverage.switch_buckets(coverage.bucket_means(depth, sized, ["contig"]), 1.0).withColumn("mean_depth", F.round("mean_depth", 6))


def benefit_summary(spark, d):
    whole = lambda x: F.sum(F.round(F.col(x) * 20).cast("bigint"))
    return update(spark, d).cells.groupBy("contig", "strand").agg(F.count("*").alias("n"), whole("smu").alias("smu"), whole("expected").alias("expected"), whole("additional").alias("additional"), F.round(F.max("additional"), 3).alias("most"))


def benefit_bins(spark, d):
    return update(spark, d).exponents.select("e", "n", F.round("weight_sum", 7).alias("weight_sum"), F.round("peak", 3).alias("peak"))


def threshold_curve(spark, d):
    return update(spark, d).curve.select("e", F.round("bound", 3).alias("bound"), F.round("ratio", 0).alias("ratio"))


def threshold_value(spark, d):
    return update(spark, d).bound.select(F.round("bound", 3).alias("bound"))


def _accepted(mask: DataFrame) -> DataFrame:
    return mask.groupBy("contig", "strand").agg(F.count("*").alias("n"), F.count_if("accept").alias("n_accept"), F.sum(F.when(F.col("accept"), F.col("bin"))).alias("at"))


def strategy_mask(spark, d):
    return _accepted(update(spark, d).mask)


def distribute_strategy(spark, d):
    return _accepted(update(spark, d).strategy)


def placed_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the FASTQ files laid on four short contigs, with an insertion and a deletion each."""
    reads = parse_files(table(spark, d, "fastq_files")).filter("length >= 40")
    return reads.select(
        F.concat(F.lit("c"), F.col("file_id") % 4).alias("contig"), ((F.col("file_id") * 97 + F.col("ordinal") * 31) % 5000).alias("tstart"),
        F.concat(F.lit("10M2I8M3D"), F.col("length") - 20, F.lit("M")).alias("cigar"), "seq", (F.col("file_id") % 2).cast("int").alias("barcode"),
    )


def cigar_pileup(spark, d):
    return pileup(placed_reads(spark, d))


def pileup_quality(spark, d):
    """Increments from FASTQ reads of either strand, by the bases of quality 20 and more."""
    reads = parse_files(table(spark, d, "fastq_files")).filter("length >= 40").withColumn("read_id", F.concat_ws(":", "file_id", "ordinal"))
    placed = reads.select(
        F.col("read_id").alias("qname"), F.lit(2).alias("qstart"), (F.col("length") - 1).alias("qend"), F.when(F.col("ordinal") % 2 == 1, "-").otherwise("+").alias("strand"),
        F.concat(F.lit("c"), F.col("file_id") % 4).alias("tname"), ((F.col("file_id") * 97 + F.col("ordinal") * 31) % 5000).alias("tstart"),
        F.concat(F.lit("10M2I8M3D"), F.col("length") - 23, F.lit("M")).alias("cigar"), (F.col("file_id") % 2).cast("int").alias("barcode"),
    )
    return increments(placed, reads, 20)


def _scored(spark, d, ploidy=1):
    cov = cigar_pileup(spark, d).withColumn("ref", F.substring(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))
    return scoring.position_scores(cov, COUNTS, "ref", ploidy).withColumn("total", sum((F.col(x) for x in COUNTS), F.lit(0)))


def posterior_scores(spark, d):
    return _scored(spark, d).select("contig", "pos", "barcode", F.round("score", 6).alias("score"), F.round("entropy", 6).alias("entropy"))


def posterior_scores_diploid(spark, d):
    return _scored(spark, d, 2).select("contig", "pos", "barcode", F.round("score", 6).alias("score"), F.round("entropy", 6).alias("entropy"))


def dropout(spark, d):
    s = scoring.drop_out(_scored(spark, d), ["contig"])
    return s.select("contig", "pos", "barcode", F.round("score", 6).alias("score"))


def _assembly(spark, d):
    sized = active_contigs(spark, d).select("contig", "length")
    depth = coverage.depth_stretches(on_contigs(spark, d).withColumnRenamed("tname", "contig"), ["contig"])
    bins = B.dense_bins(coverage.bin_sums(depth, ["contig"]), sized, ["contig"])
    bins = bins.withColumn("score", B.low_coverage_score(F.col("total"), 10)).withColumn("cap_l", F.lit(False)).withColumn("cap_r", F.lit(False))
    return B.contig_ends(bins, ["contig"])


def assembly_score(spark, d):
    return _assembly(spark, d).groupBy("contig").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"), F.count_if(F.col("open_end.left") | F.col("open_end.right")).alias("n_open"))


def _assembly_benefit(spark, d):
    bins = _assembly(spark, d).select("contig", "bin", "score", F.col("open_end.left").alias("open_l"), F.col("open_end.right").alias("open_r"))
    return cut(B.padded_benefit(bins, ["contig"]), "assembly-benefit")


def assembly_benefit(spark, d):
    return _assembly_benefit(spark, d).groupBy("contig", "strand").agg(F.count("*").alias("n"), F.round(F.max("smu_sum"), 1).alias("smu_sum"), F.round(F.sum("benefit"), 1).alias("benefit"))


def assembly_threshold(spark, d):
    cells = _assembly_benefit(spark, d)
    base = cells.groupBy("contig").agg(F.max("smu_sum").alias("s")).agg(F.sum("s")).scalar()
    curve = B.threshold_curve(B.benefit_exponents(cells, "benefit", None), base, 9.0, float((6000 - 700) // 100))
    return B.threshold(curve).select(F.round("bound", 6).alias("bound"))


def _best_on_contigs(spark, d):
    return C.best_mapping(C.keep_mappings(on_contigs(spark, d)), PLACE)


def decision_reference_sim(spark, d):
    return D.look_up(_best_on_contigs(spark, d), strategy(spark, d), table(spark, d, "contigs"), False).select("qname", "accept")


def decision_assembly_sim(spark, d):
    best = C.best_mapping(C.keep_mappings(mappings(spark, d)), PLACE)
    return D.look_up(best, strategy(spark, d), table(spark, d, "contigs"), True).select("qname", "accept")


def decision_live(spark, d):
    looked = D.look_up(mappings(spark, d), strategy(spark, d), table(spark, d, "contigs"), True, "tend")
    return D.decide_live(unique_reads(spark, d, "length"), looked)


def _simulated(spark, d):
    reads = unique_reads(spark, d, "length", "batch_no").select("read_id", F.coalesce("length", F.lit(0)).alias("length"), "batch_no")
    decided = decision_reference_sim(spark, d).select(F.col("qname").alias("read_id"), "accept")
    return D.simulate(reads, decided).join(reads.select("read_id", "batch_no"), "read_id")


def simulated_reads(spark, d):
    return _simulated(spark, d).select("read_id", "seen_length", "mapped", "accepted")


def pseudotime(spark, d):
    return D.pseudotime(_simulated(spark, d), "batch_no")


def accepted_mappings(spark, d):
    """After the decisions on anchors: what is mapped of whole reads.  An anchor's record is the begin of the read's."""
    full = C.best_mapping(C.keep_mappings(on_contigs(spark, d)), ["qlen", "tname", "tstart", "tend", "strand", "line_no"]).drop("qlen").withColumn("qlen", F.col("tend") - F.col("tstart"))
    cut_off = F.least("tend", F.col("tstart") + 400)
    truncated = full.withColumn("tend", F.when(F.col("strand") == "+", cut_off).otherwise(F.col("tend"))).withColumn("qlen", F.lit(400))
    decided = decision_reference_sim(spark, d).withColumnRenamed("qname", "read_id")
    return D.accepted_mappings(D.full_or_truncated(decided, full, truncated)).select("qname", "line_no", "qlen")


def dump_batches(spark, d):
    reads = unique_reads(spark, d, "batch_no", "length").select("batch_no", F.coalesce("length", F.lit(0)).alias("length"), F.col("length").alias("seen_length"), F.lit(True).alias("accepted"))
    times = D.pseudotime(reads, "batch_no")
    return D.dump_numbers(times, "batch_no", "control_total", 300_000)


def _chunks(spark, d):
    """One chunk for each read of a known channel; how many were seen and what is asked for come from length and barcode."""
    reads = unique_started(spark, d).filter("channel is not null and barcode is not null")
    control = table(spark, d, "channels").select("channel", F.coalesce(F.col("condition_name") == "control", F.lit(False)).alias("control"), "condition_name")
    return reads.join(control, "channel").select(
        "read_id", "channel", "started_at", "control", "condition_name", "barcode", "length",
        (F.coalesce("length", F.lit(0)) % 12).alias("seen"),
        F.element_at(F.array(F.lit("proceed"), F.lit("unblock"), F.lit("stop_receiving")), F.col("barcode") % 3 + 1).alias("action"),
    )


def override_actions(spark, d):
    acted = D.override_actions(_chunks(spark, d), 2, 9, duplex=True, order=("started_at", "read_id"))
    return acted.select("read_id", "final_action", "previous", "sent", "overridden")


def decision_log(spark, d):
    """The log of a run that began in mid run and sends no unblocking."""
    acted = D.override_actions(_chunks(spark, d), 2, 9, dry_run=True, mid_run=True, order=("started_at", "read_id"))
    return D.decision_log(
        acted.select(
            "read_id", "channel", F.col("length").alias("seq_length"), F.col("seen").alias("seen_count"), F.col("action").alias("decision"), F.col("final_action").alias("action"),
            F.col("condition_name").alias("condition"), "barcode", F.col("previous").alias("previous_action"), F.col("started_at").alias("timestamp"), F.col("overridden").alias("action_overridden"),
        )
    )


BARCODES = list(range(0, 13))


def decision_barcode(spark, d):
    """By the strategy of each read's barcode; reads of other barcodes are accepted."""
    barcodes = unique_reads(spark, d, "barcode").select(F.col("read_id").alias("qname"), F.coalesce("barcode", F.lit(0)).alias("barcode"))
    placed = on_contigs(spark, d).select("qname", "line_no", *PLACE, "cigar", "is_primary", "blen", "mapq", "align_score").join(barcodes, "qname")
    placed = cut(placed, "placed")
    planned = update_from(placed, active_contigs(spark, d), seen_lengths(spark, d), BARCODES).strategy
    best = C.best_mapping(C.keep_mappings(placed), [*PLACE, "barcode"])
    return D.look_up(best, planned, table(spark, d, "contigs"), True).select("qname", "barcode", "accept")


def _live(spark, d) -> LiveRun:
    """A run over the table's rows in the batches in which they were loaded, one file for every hundred."""
    run, files = LiveRun(active_contigs(spark, d), scratch_path(spark, "live")), scratch_path(spark, "live-files")
    rows = table(spark, d, "alignments").filter(GOOD).select("qname", "qlen", *PLACE, "cigar", F.expr("coalesce(batch_no, 0) div 100").alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(files)
    stream = spark.readStream.schema(rows.drop("part").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(files)
    run.start(stream, scratch_path(spark, "live-checkpoint"), None).awaitTermination()
    return run


def streaming_update(spark, d):
    """The depth of the bins after a stream over several files; the same as ``bin_depths`` makes of the table at once."""
    depth = _live(spark, d).state(spark, "depth").select(F.col("contig").alias("tname"), "s", "e", (F.col("bases") + F.col("dels")).alias("depth"))
    return coverage.bin_sums(depth, ["tname"])


QUERIES = {
    f.__name__: f
    for f in (
        read_start_hist, fhat_pointmass, fhat_bins, dirichlet_priors, bin_depths, bin_scores, bucket_switch, benefit_summary, benefit_bins,
        threshold_curve, threshold_value, strategy_mask, distribute_strategy, cigar_pileup, pileup_quality, posterior_scores,
        posterior_scores_diploid, dropout, assembly_score, assembly_benefit, assembly_threshold, decision_reference_sim,
        decision_assembly_sim, decision_live, decision_barcode, simulated_reads, accepted_mappings, pseudotime, dump_batches, override_actions, decision_log, streaming_update,
    )
}

_WINDOWS = [x // 100 for x in DEFAULT_CCL]
_ACTIVE = "ac AS (SELECT contig, length FROM contigs WHERE length >= 100000 AND NOT rejected)"
_STARTS = f"""{_ON}, {_ACTIVE}, sz AS (SELECT contig, CAST(length // 2000 AS BIGINT) AS nw, length // 100 AS nb FROM ac WHERE length >= 2000),
sp AS (SELECT contig, nw, nb, w, CAST(sd AS INTEGER) AS sd FROM (SELECT contig, nw, nb, unnest(range(0, nw)) AS w FROM sz), (VALUES (0), (1)) v(sd)),
bg AS (SELECT contig, least(x // 2000, nw - 1) AS w, sd, count(*) AS n FROM (SELECT tname, CASE strand WHEN '-' THEN 1 ELSE 0 END AS sd,
  CASE strand WHEN '-' THEN tend ELSE tstart END AS x FROM a) JOIN sz ON contig = tname WHERE x <= nw * 2000 GROUP BY ALL),
sc AS (SELECT sp.contig, sp.w, sp.sd, sp.nw, sp.nb, coalesce(n, 0) AS n FROM sp LEFT JOIN bg ON sp.contig = bg.contig AND sp.w = bg.w AND sp.sd = bg.sd),
fh AS (SELECT *, CASE WHEN n > 0 THEN (1e0 + n) / (k + t) ELSE (1 - 0.1e0 * (k - 1) / (k - 1 + t)) / (k + t) END AS f FROM sc, (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS t FROM sc))"""
_FBINS = f"""{_STARTS}, fb0 AS (SELECT contig, sd, f, unnest(range(w * 20, CASE WHEN w = nw - 1 THEN nb ELSE (w + 1) * 20 END)) AS bin FROM fh),
fb AS (SELECT contig, sd, bin, f / sum(f) OVER () AS f FROM fb0)"""
_BINS = f"""{_DEPTH}, {_ACTIVE}, tb AS (SELECT tname, bin, sum((least(e, (bin + 1) * 100) - greatest(s, bin * 100)) * depth) AS total FROM (
  SELECT *, unnest(range(s // 100, (e - 1) // 100 + 1)) AS bin FROM dp) GROUP BY 1, 2)"""
_BUCKETS = """bk0 AS (SELECT contig, length // 20000 AS fl, unnest(range(0, length // 20000 + 1)) AS bucket FROM ac),
bs AS (SELECT tname, bin // 200 AS b, sum(total) AS t FROM tb GROUP BY 1, 2),
bk AS (SELECT contig, bucket, coalesce(t, 0) / 20000e0 AS mean_depth FROM bk0 LEFT JOIN bs ON tname = contig AND b = least(bucket, fl - 1))"""
_PHI, _PRI = scoring.phi(1), scoring.priors(1)


def _patterns(by: str = "tname", source: str = "a") -> str:
    """pst: stretches by numbers of bases and deletions; spc: the score of each pattern."""
    return f"""dl AS (SELECT line_no, {by}, tstart, tend, CAST(unnest(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)) AS BIGINT) AS n, unnest(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)) AS op,
  generate_subscripts(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1), 1) AS i FROM {source} WHERE cigar LIKE '%D%'),
de AS (SELECT *, tstart + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM dl),
ds AS (SELECT {by}, s, least(s + n, tend) AS e FROM de WHERE op = 'D' AND s < least(s + n, tend)),
es AS (SELECT {by}, p, sum(b) AS b, sum(x) AS x FROM (SELECT {by}, tstart AS p, 1 AS b, 0 AS x FROM {source} UNION ALL SELECT {by}, tend, -1, 0 FROM {source}
  UNION ALL SELECT {by}, s, -1, 1 FROM ds UNION ALL SELECT {by}, e, 1, -1 FROM ds) GROUP BY ALL HAVING sum(b) <> 0 OR sum(x) <> 0),
pst AS (SELECT * FROM (SELECT {by}, CAST(p AS BIGINT) AS s, CAST(lead(p) OVER w AS BIGINT) AS e, CAST(sum(b) OVER w AS BIGINT) AS b, CAST(sum(x) OVER w AS BIGINT) AS x FROM es WINDOW w AS (PARTITION BY {by} ORDER BY p)) WHERE b <> 0 OR x <> 0),
phi(b, g, p) AS (VALUES {", ".join(f"({b}, {g}, {_PHI[b][g]!r}::DOUBLE)" for b in range(5) for g in range(5))}), pri(g, p) AS (VALUES {", ".join(f"({g}, {_PRI[0][g]!r}::DOUBLE)" for g in range(5))}),
pc AS (SELECT row_number() OVER () AS id, b, x FROM (SELECT b, x FROM pst WHERE b + x < 30 UNION SELECT 0, 0)),
ll AS (SELECT id, phi.g, sum(CASE phi.b WHEN 0 THEN pc.b WHEN 4 THEN pc.x ELSE 0 END * ln(phi.p)) + max(ln(pri.p)) AS l FROM pc CROSS JOIN phi JOIN pri ON pri.g = phi.g GROUP BY 1, 2),
pe AS (SELECT id, g, exp(l - max(l) OVER (PARTITION BY id)) AS w FROM ll), pp AS (SELECT id, g, w / sum(w) OVER (PARTITION BY id) AS p FROM pe),
en AS (SELECT id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy FROM pp GROUP BY 1), jo AS (SELECT id, phi.b, pp.p * phi.p AS j FROM pp JOIN phi ON phi.g = pp.g),
af AS (SELECT id, sum(h) AS after FROM (SELECT id, b, sum(j) * ln(sum(j)) - sum(CASE WHEN j > 0 THEN j * ln(j) ELSE 0 END) AS h FROM jo GROUP BY 1, 2) GROUP BY 1),
spc AS (SELECT b, x, entropy - after AS score FROM pc JOIN en USING (id) JOIN af USING (id))"""


_SCORES = f"""{_BINS}, {_patterns()}, me AS (SELECT contig, length, coalesce(n, 0) / length AS mean FROM ac LEFT JOIN (SELECT tname AS contig, sum((b + x) * (e - s)) AS n FROM pst GROUP BY 1) USING (contig)),
mu AS (SELECT *, CASE WHEN mean > 5 THEN 0 ELSE (SELECT score FROM spc WHERE b = 0 AND x = 0) END AS unseen FROM me),
ov AS (SELECT contig, s, e, unseen, CASE WHEN mean > 5 AND pst.b + pst.x <= floor(mean / 8) THEN 0 WHEN pst.b + pst.x >= 30 THEN 2.2250738585072014e-308 ELSE score END AS score
  FROM pst JOIN mu ON contig = tname LEFT JOIN spc ON spc.b = pst.b AND spc.x = pst.x),
os AS (SELECT contig, bin, sum((least(e, (bin + 1) * 100) - greatest(s, bin * 100)) * (score - unseen)) AS more FROM (SELECT *, unnest(range(s // 100, (e - 1) // 100 + 1)) AS bin FROM ov) GROUP BY 1, 2),
db AS (SELECT contig, bin, round((unseen * 100 + coalesce(more, 0)) / 1e-6) AS t FROM (SELECT contig, unseen, unnest(range(0, length // 100)) AS bin FROM mu) LEFT JOIN os USING (contig, bin))"""
_LENGTHS = f"""{_UNIQUE}, hl AS (SELECT list_sort(list(least(length, 999999))) AS h, avg(least(length, 999999)) AS mean_length FROM u WHERE length > 800),
cc AS (SELECT {", ".join(f"h[CAST(ceil(len(h) * {2 * i + 1} / 20) AS BIGINT)] // 100 AS k{i}" for i in range(10))}, floor((mean_length - 700) / 100) AS read_time FROM hl)"""
_CELLS = f"""{_SCORES}, {_LENGTHS},
fr AS (SELECT contig, bin, sum(t) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m0, sum(t) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m1,
  {" + ".join(f"sum(t) OVER (w ROWS BETWEEN CURRENT ROW AND k{i} - 1 FOLLOWING) * {0.95 - 0.1 * i!r}::DOUBLE" for i in range(10))} AS e0,
  {" + ".join(f"sum(t) OVER (w ROWS BETWEEN k{i} - 1 PRECEDING AND CURRENT ROW) * {0.95 - 0.1 * i!r}::DOUBLE" for i in range(10))} AS e1
  FROM db CROSS JOIN cc WINDOW w AS (PARTITION BY contig ORDER BY bin)),
be AS (SELECT contig, bin, 0 AS sd, m0 AS smu, e0 AS expected FROM fr UNION ALL SELECT contig, bin, 1, m1, e1 FROM fr),
ad AS (SELECT *, greatest(expected - smu, 0) AS additional FROM be)"""
_CURVE = f"""{_CELLS}, {_FBINS.removeprefix(_ON + ", " + _ACTIVE + ", ")},
ce AS (SELECT ad.*, fb.f FROM ad JOIN fb ON ad.contig = fb.contig AND ad.bin = fb.bin AND ad.sd = fb.sd),
ex AS (SELECT abs(CAST(floor(log2(additional / peak)) AS BIGINT) + 1) AS e, count(*) AS n, sum(f) AS weight_sum, max(peak) AS peak
  FROM ce, (SELECT max(additional) AS peak FROM ce) WHERE additional > 0 GROUP BY 1),
cv AS (SELECT e, pow(2e0, -e) * peak AS bound, ((SELECT sum(f * additional) FROM ce) + sum(pow(2e0, -e) * peak * weight_sum) OVER w) / (10e0 + sum(weight_sum) OVER w * (SELECT read_time FROM cc)) AS ratio,
  row_number() OVER w AS rn FROM ex WINDOW w AS (ORDER BY e)),
bo AS (SELECT bound FROM cv WHERE rn <= (SELECT rn FROM cv ORDER BY ratio DESC, rn LIMIT 1) + 1 ORDER BY rn DESC LIMIT 1)"""
_STRATEGY = f"""{_CURVE}, {_BUCKETS}, sg AS (SELECT ce.contig, ce.bin, ce.sd, CASE WHEN mean_depth >= 1 THEN additional >= (SELECT bound FROM bo) ELSE true END AS accept
  FROM ce LEFT JOIN bk ON bk.contig = ce.contig AND bk.bucket = ce.bin // 200)"""
# The same with a strategy for each barcode: contigs are named by barcode, too, but for the starts of reads.
_BARCODE = "coalesce(u0.barcode, 0)"
_STRATEGY_B = (
    _STRATEGY.replace(_ON, _ON.replace("a AS (SELECT m", "a0 AS (SELECT m") + f", {_UNIQUE.replace('u AS', 'u0 AS', 1)}, a AS (SELECT a0.* REPLACE (tname || '#' || {_BARCODE} AS tname), {_BARCODE} AS barcode FROM a0 JOIN u0 ON u0.read_id = qname)")
    .replace(_ACTIVE, _ACTIVE.replace("ac AS", "ac0 AS") + ", ac AS (SELECT contig || '#' || bc AS contig, length FROM ac0, range(13) r(bc))")
    .replace("FROM ac WHERE length >= 2000", "FROM ac0 WHERE length >= 2000").replace("AS x FROM a)", "AS x FROM a0 JOIN u0 ON u0.read_id = qname)")
    .replace("JOIN fb ON ad.contig = fb.contig", "JOIN fb ON split_part(ad.contig, '#', 1) = fb.contig")
)
_ACCEPTED = "SELECT contig, CAST(sd AS INTEGER) AS strand, count(*) AS n, count(*) FILTER (accept) AS n_accept, CAST(sum(bin) FILTER (accept) AS BIGINT) AS at"


def _decide(source: str, default: str, end: str) -> str:
    return f"""lk AS (SELECT x.*, CASE WHEN c.rejected THEN false ELSE coalesce(sg.accept, {default}) END AS accept FROM {source} x
  LEFT JOIN sg ON sg.contig = x.tname AND sg.bin = (CASE x.strand WHEN '-' THEN {end} ELSE x.tstart END) // 100 AND sg.sd = CASE x.strand WHEN '-' THEN 1 ELSE 0 END
  LEFT JOIN contigs c ON c.contig = x.tname AND c.rejected)"""


_BEST_A = "ba AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY coalesce(mapq, 0) DESC, coalesce(align_score, 0) DESC, line_no DESC) AS rn FROM a WHERE is_primary AND blen >= 1) WHERE rn = 1)"
_BEST_M = _BEST_A.replace("ba AS", "bm AS").replace("FROM a WHERE", "FROM m WHERE")
_SIM = f"""{_STRATEGY}, {_BEST_A}, {_decide("ba", "false", "x.tend - 1")},
si AS (SELECT read_id, u.batch_no, coalesce(u.length, 0) AS length, lk.qname IS NOT NULL AS mapped, coalesce(lk.accept, false) AS accepted,
  CASE WHEN coalesce(lk.accept, false) THEN coalesce(u.length, 0) ELSE least(coalesce(u.length, 0), 400) END AS seen_length FROM u LEFT JOIN lk ON lk.qname = u.read_id)"""
_PLACED = f"""{_FQ}, pl AS (SELECT concat('c', file_id % 4) AS contig, (file_id * 97 + k * 31) % 5000 AS p0, upper(seq) AS seq, length(seq) AS n, CAST(file_id % 2 AS INTEGER) AS barcode FROM fq WHERE length(seq) >= 40),
ba0 AS (SELECT contig, barcode, p0 + i AS pos, substring(seq, CAST(i + 1 AS INTEGER), 1) AS b FROM pl, range(10) r(i)
  UNION ALL SELECT contig, barcode, p0 + 10 + i, substring(seq, CAST(13 + i AS INTEGER), 1) FROM pl, range(8) r(i)
  UNION ALL SELECT contig, barcode, p0 + 18 + i, '-' FROM pl, range(3) r(i)
  UNION ALL SELECT contig, barcode, p0 + 21 + i, substring(seq, CAST(21 + i AS INTEGER), 1) FROM (SELECT *, unnest(range(0, n - 20)) AS i FROM pl)),
pu AS (SELECT contig, pos, barcode, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b = '-') AS d
  FROM ba0 WHERE b IN ('A', 'C', 'G', 'T', '-') GROUP BY ALL)"""


def _score_sql(ploidy: int) -> str:
    p, pr = scoring.phi(ploidy), scoring.priors(ploidy)
    phi = ", ".join(f"({b}, {g}, {p[b][g]!r}::DOUBLE)" for b in range(5) for g in range(len(p[0])))
    prior = ", ".join(f"('{r}', {g}, {pr[i][g]!r}::DOUBLE)" for i, r in enumerate("ACGT") for g in range(len(p[0])))
    return f"""phi(b, g, p) AS (VALUES {phi}), pri(r, g, p) AS (VALUES {prior}),
pa AS (SELECT DISTINCT a, c, g, t, d, substring('ACGT', CAST(pos % 4 + 1 AS INTEGER), 1) AS ref FROM pu WHERE a + c + g + t + d < 30),
pc AS (SELECT row_number() OVER () AS id, * FROM pa), un AS (SELECT id, ref, b, [a, c, g, t, d][b + 1] AS n FROM pc, range(5) r(b)),
ll AS (SELECT id, ref, phi.g, sum(n * ln(phi.p)) + max(ln(pri.p)) AS l FROM un JOIN phi ON phi.b = un.b JOIN pri ON pri.r = un.ref AND pri.g = phi.g GROUP BY 1, 2, 3),
ps0 AS (SELECT id, g, exp(l - max(l) OVER (PARTITION BY id)) AS w FROM ll), ps AS (SELECT id, g, w / sum(w) OVER (PARTITION BY id) AS p FROM ps0),
en AS (SELECT id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy FROM ps GROUP BY 1),
jo AS (SELECT id, phi.b, ps.p * phi.p AS j FROM ps JOIN phi ON phi.g = ps.g),
af AS (SELECT id, sum(h) AS after FROM (SELECT id, b, sum(j) * ln(sum(j)) - sum(CASE WHEN j > 0 THEN j * ln(j) ELSE 0 END) AS h FROM jo GROUP BY 1, 2) GROUP BY 1),
so AS (SELECT pu.contig, pos, barcode, pu.a + pu.c + pu.g + pu.t + pu.d AS total, CASE WHEN pu.a + pu.c + pu.g + pu.t + pu.d >= 30 THEN 2.2250738585072014e-308 ELSE entropy - after END AS score, entropy
  FROM pu LEFT JOIN pc ON pc.a = pu.a AND pc.c = pu.c AND pc.g = pu.g AND pc.t = pu.t AND pc.d = pu.d AND pc.ref = substring('ACGT', CAST(pos % 4 + 1 AS INTEGER), 1) LEFT JOIN en ON en.id = pc.id LEFT JOIN af ON af.id = pc.id)"""


_ASM = f"""{_BINS}, as0 AS (SELECT contig, bin, coalesce(total, 0) AS total, max(bin) OVER (PARTITION BY contig) AS lb FROM (SELECT contig, unnest(range(0, length // 100 + 1)) AS bin FROM ac)
  LEFT JOIN (SELECT tname AS contig, bin, total FROM tb) y USING (contig, bin)),
as1 AS (SELECT *, bin IN (0, lb) AND total <= 5000 AS op, CASE WHEN bin IN (0, lb) AND total <= 5000 THEN 1 ELSE 1 / (exp(least(floor(total / 100), 100) - 10) + 1) END AS score FROM as0)"""
_PAD = _WINDOWS[-1]
_PADDED = f"""{_ASM}, pn AS (SELECT contig, count(*) AS n, bool_or(op AND bin = 0) AS ol, bool_or(op AND bin = lb) AS o_r FROM as1 GROUP BY 1),
px AS (SELECT contig, n, ol, o_r, unnest(range(0, n + {2 * _PAD})) AS i FROM pn),
pv AS (SELECT px.contig, n, i, n + {2 * _PAD} AS f, coalesce(score, CASE WHEN i < {_PAD} AND ol OR i >= n + {_PAD} AND i < n + {2 * _PAD} - 1 AND o_r THEN 1 ELSE 0 END) AS x
  FROM px LEFT JOIN as1 ON as1.contig = px.contig AND as1.bin = i - {_PAD}),
pw AS (SELECT *, sum(x) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s0, sum(x) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS sa,
  {" + ".join(f"CASE WHEN i <= f - {k + 2} THEN sum(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) * {1.0 - 0.1 * j!r}::DOUBLE ELSE 0 END" for j, k in enumerate(_WINDOWS))} AS b0,
  {" + ".join(f"CASE WHEN i >= {k} AND i <= f - 2 THEN sum(x) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) * {1.0 - 0.1 * j!r}::DOUBLE ELSE 0 END" for j, k in enumerate(_WINDOWS))} AS b1
  FROM pv WINDOW w AS (PARTITION BY contig ORDER BY i)),
py AS (SELECT a.contig, a.i, a.n, a.s0, b.sa AS s1, a.b0, a.b1, sum(a.s0 + b.sa) OVER (PARTITION BY a.contig) AS smu_sum FROM pw a JOIN pw b ON b.contig = a.contig AND b.i = a.f - 1 - a.i),
pb AS (SELECT contig, 0 AS strand, smu_sum, greatest(b0 - s0, 0) AS benefit FROM py WHERE i >= {_PAD} AND i < n + {_PAD}
  UNION ALL SELECT contig, 1, smu_sum, greatest(b1 - s1, 0) FROM py WHERE i >= {_PAD} AND i < n + {_PAD})"""

_CHUNKS = f"""{_UNIQUE}, ch AS (SELECT u.read_id, u.channel, row_number() OVER (PARTITION BY u.channel ORDER BY u.started_at, u.read_id) AS i, coalesce(c.condition_name = 'control', false) AS control, c.condition_name, u.barcode, u.length, u.started_at,
  coalesce(u.length, 0) % 12 AS seen, ['proceed', 'unblock', 'stop_receiving'][u.barcode % 3 + 1] AS action FROM u JOIN channels c ON c.channel = u.channel WHERE u.barcode IS NOT NULL),
a1 AS (SELECT *, CASE WHEN control THEN 'stop_receiving' WHEN seen > 9 AND action = 'proceed' THEN 'unblock' ELSE action END AS a FROM ch),
a2 AS (SELECT * REPLACE (CASE WHEN NOT control AND seen < 2 AND a <> 'proceed' THEN 'proceed' ELSE a END AS a) FROM a1)"""

ORACLE = {
    "read_start_hist": f'WITH {_STARTS} SELECT contig, w AS "window", sd AS strand, n FROM sc',
    "fhat_pointmass": f'WITH {_STARTS} SELECT contig, w AS "window", sd AS strand, round(f * 1e6, 6) AS fhat FROM fh',
    "fhat_bins": f"WITH {_FBINS} SELECT contig, sd AS strand, count(*) AS n, round(sum(f), 9) AS fhat FROM fb GROUP BY 1, 2",
    "dirichlet_priors": f"""WITH {_STARTS}, x AS (SELECT n, n / (SELECT CAST(sum(n) AS DOUBLE) FROM sc) AS x FROM sc)
SELECT round((count(*) - 1) / (var_pop(x) * CAST(count(*) AS DOUBLE) * count(*) * count(*)) - 1e0 / count(*), 6) AS alpha, round(count(*) FILTER (n = 0) / count(*), 9) AS p_zero FROM x""",
    "bin_depths": f"WITH {_BINS} SELECT tname, bin, CAST(total AS BIGINT) AS total FROM tb",
    "bin_scores": f"WITH {_SCORES} SELECT contig, bin, CAST(t AS BIGINT) AS total FROM db",
    "override_actions": f"""WITH {_CHUNKS},
a3 AS (SELECT *, CASE WHEN a = 'unblock' AND lag(a) OVER (PARTITION BY channel ORDER BY i) = 'stop_receiving' THEN 'stop_receiving' ELSE a END AS fin FROM a2 WHERE a <> 'proceed'),
a4 AS (SELECT a2.*, coalesce(a3.fin, 'proceed') AS fin FROM a2 LEFT JOIN a3 ON a3.channel = a2.channel AND a3.i = a2.i)
SELECT read_id, fin AS final_action, last_value(nullif(fin, 'proceed') IGNORE NULLS) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  nullif(fin, 'proceed') AS sent, fin <> a AS overridden FROM a4""",
    "decision_log": f"""WITH {_CHUNKS},
a3 AS (SELECT *, CASE WHEN i = 1 THEN 'stop_receiving' ELSE a END AS fin FROM a2)
SELECT CAST(NULL AS VARCHAR) AS loop_counter, CAST(NULL AS VARCHAR) AS number_reads, read_id, channel, CAST(NULL AS VARCHAR) AS read_number, length AS seq_length, seen AS seen_count,
  action AS decision, fin AS action, condition_name AS condition, barcode,
  last_value(nullif(fin, 'proceed') IGNORE NULLS) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_action,
  started_at AS timestamp, i = 1 OR fin = 'unblock' AS action_overridden FROM a3""",
    "streaming_update": f"WITH {_BINS} SELECT tname, bin, CAST(total AS BIGINT) AS total FROM tb",
    "bucket_switch": f'WITH {_BINS}, {_BUCKETS} SELECT contig, CAST(bucket AS BIGINT) AS bucket, round(mean_depth, 6) AS mean_depth, mean_depth >= 1 AS "on" FROM bk',
    "benefit_summary": f"""WITH {_CELLS} SELECT contig, CAST(sd AS INTEGER) AS strand, count(*) AS n, CAST(sum(CAST(round(smu * 20) AS BIGINT)) AS BIGINT) AS smu, CAST(sum(CAST(round(expected * 20) AS BIGINT)) AS BIGINT) AS expected,
CAST(sum(CAST(round(additional * 20) AS BIGINT)) AS BIGINT) AS additional, round(max(additional), 3) AS most FROM ad GROUP BY 1, 2""",
    "benefit_bins": f"WITH {_CURVE} SELECT e, n, round(weight_sum, 7) AS weight_sum, round(peak, 3) AS peak FROM ex",
    "threshold_curve": f"WITH {_CURVE} SELECT e, round(bound, 3) AS bound, round(ratio, 0) AS ratio FROM cv",
    "threshold_value": f"WITH {_CURVE} SELECT round(bound, 3) AS bound FROM bo",
    "strategy_mask": f"WITH {_CURVE}, mk AS (SELECT *, additional >= (SELECT bound FROM bo) AS accept FROM ce) {_ACCEPTED} FROM mk GROUP BY 1, 2",
    "distribute_strategy": f"WITH {_STRATEGY} {_ACCEPTED} FROM sg GROUP BY 1, 2",
    "cigar_pileup": f"WITH {_PLACED} SELECT * FROM pu",
    "accepted_mappings": f"WITH {_STRATEGY}, {_BEST_A}, {_decide('ba', 'false', 'x.tend - 1')} SELECT qname, line_no, tend - tstart AS qlen FROM lk WHERE accept AND tend - tstart <> 400",
    "pileup_quality": f"""WITH {_FQ}, pl AS (SELECT concat('c', file_id % 4) AS contig, (file_id * 97 + k * 31) % 5000 AS p0, CASE k % 2 WHEN 1 THEN reverse(translate(substring(seq, 3, CAST(length(seq) - 3 AS INTEGER)), 'ACGTacgt', 'TGCAtgca')) ELSE substring(seq, 3, CAST(length(seq) - 3 AS INTEGER)) END AS s,
  CASE k % 2 WHEN 1 THEN reverse(substring(qual, 3, CAST(length(seq) - 3 AS INTEGER))) ELSE substring(qual, 3, CAST(length(seq) - 3 AS INTEGER)) END AS ql, CAST(file_id % 2 AS INTEGER) AS barcode FROM fq WHERE length(seq) >= 40),
ba0 AS (SELECT contig, barcode, p0 + CASE WHEN i < 10 THEN i WHEN i < 20 THEN i - 2 ELSE i + 1 END AS pos, upper(substring(s, CAST(i + 1 AS INTEGER), 1)) AS b
    FROM (SELECT *, unnest(range(0, length(s))) AS i FROM pl) WHERE i NOT IN (10, 11) AND ord(substring(ql, CAST(i + 1 AS INTEGER), 1)) - 33 >= 20
  UNION ALL SELECT contig, barcode, p0 + 18 + i, '-' FROM pl, range(3) r(i))
SELECT contig, pos, barcode, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b = '-') AS d
FROM ba0 WHERE b IN ('A', 'C', 'G', 'T', '-') GROUP BY ALL""",
    "posterior_scores": f"WITH {_PLACED}, {_score_sql(1)} SELECT contig, pos, barcode, round(score, 6) AS score, round(entropy, 6) AS entropy FROM so",
    "posterior_scores_diploid": f"WITH {_PLACED}, {_score_sql(2)} SELECT contig, pos, barcode, round(score, 6) AS score, round(entropy, 6) AS entropy FROM so",
    "dropout": f"""WITH {_PLACED}, {_score_sql(1)}, mn AS (SELECT *, avg(total) OVER (PARTITION BY contig) AS m FROM so)
SELECT contig, pos, barcode, round(CASE WHEN m > 5 AND total <= floor(m / 8) THEN 0 ELSE score END, 6) AS score FROM mn""",
    "assembly_score": f"WITH {_ASM} SELECT contig, count(*) AS n, round(sum(score), 4) AS score, count(*) FILTER (op) AS n_open FROM as1 GROUP BY 1",
    "assembly_benefit": f"WITH {_PADDED} SELECT contig, CAST(strand AS INTEGER) AS strand, count(*) AS n, round(max(smu_sum), 1) AS smu_sum, round(sum(benefit), 1) AS benefit FROM pb GROUP BY 1, 2",
    "assembly_threshold": f"""WITH {_PADDED}, ex AS (SELECT abs(CAST(floor(log2(benefit / peak)) AS BIGINT) + 1) AS e, count(*) AS n, max(peak) AS peak FROM pb, (SELECT max(benefit) AS peak FROM pb) WHERE benefit > 0 GROUP BY 1),
cv AS (SELECT pow(2e0, -e) * peak AS bound, ((SELECT sum(s) FROM (SELECT max(smu_sum) AS s FROM pb GROUP BY contig)) + sum(pow(2e0, -e) * peak * n) OVER w) / (9e0 + sum(n) OVER w * 53e0) AS ratio, row_number() OVER w AS rn FROM ex WINDOW w AS (ORDER BY e))
SELECT round(bound, 6) AS bound FROM cv WHERE rn <= (SELECT rn FROM cv ORDER BY ratio DESC, rn LIMIT 1) + 1 ORDER BY rn DESC LIMIT 1""",
    "decision_reference_sim": f"WITH {_STRATEGY}, {_BEST_A}, {_decide('ba', 'false', 'x.tend - 1')} SELECT qname, accept FROM lk",
    "decision_barcode": f"""WITH {_STRATEGY_B}, {_BEST_A}, lk AS (SELECT ba.qname, ba.barcode, coalesce(sg.accept, true) AS accept FROM ba
  LEFT JOIN sg ON sg.contig = ba.tname AND sg.bin = (CASE strand WHEN '-' THEN tend - 1 ELSE tstart END) // 100 AND sg.sd = CASE strand WHEN '-' THEN 1 ELSE 0 END) SELECT * FROM lk""",
    "decision_assembly_sim": f"WITH {_STRATEGY}, {_BEST_M}, {_decide('bm', 'true', 'x.tend - 1')} SELECT qname, accept FROM lk",
    "decision_live": f"""WITH {_STRATEGY}, {_decide("m", "true", "x.tend")}, hi AS (SELECT qname, bool_or(accept) AS hit, count(*) AS n FROM lk GROUP BY 1)
SELECT read_id, CASE WHEN n IS NULL THEN CASE WHEN coalesce(length, 0) > 0 THEN 'no_map' ELSE 'no_seq' END WHEN n > 1 THEN CASE WHEN hit THEN 'multi_on' ELSE 'multi_off' END WHEN hit THEN 'single_on' ELSE 'single_off' END AS decision
FROM u LEFT JOIN hi ON hi.qname = u.read_id""",
    "simulated_reads": f"WITH {_SIM} SELECT read_id, seen_length, mapped, accepted FROM si",
    "pseudotime": f"""WITH {_SIM}, pt AS (SELECT batch_no, CAST(sum(length) + count(*) * 300 AS BIGINT) AS control, CAST(sum(seen_length) + count(*) FILTER (NOT accepted) * 300 + count(*) * 300 AS BIGINT) AS treatment FROM si GROUP BY 1)
SELECT *, CAST(sum(control) OVER w AS BIGINT) AS control_total, CAST(sum(treatment) OVER w AS BIGINT) AS treatment_total FROM pt WINDOW w AS (ORDER BY batch_no)""",
    "dump_batches": f"""WITH RECURSIVE {_UNIQUE}, pt AS (SELECT batch_no, sum(coalesce(length, 0)) + count(*) * 300 AS c FROM u GROUP BY 1),
tt AS (SELECT batch_no, sum(c) OVER (ORDER BY batch_no) AS t, row_number() OVER (ORDER BY batch_no) AS k FROM pt),
go(k, batch_no, dump, due) AS (SELECT k, batch_no, 1, CASE WHEN t > 300000 THEN 2 ELSE 1 END FROM tt WHERE k = 1
  UNION ALL SELECT tt.k, tt.batch_no, go.due, CASE WHEN tt.t > 300000 * go.due THEN go.due + 1 ELSE go.due END FROM go JOIN tt ON tt.k = go.k + 1)
SELECT batch_no, CAST(dump AS BIGINT) AS dump FROM go""",
}
