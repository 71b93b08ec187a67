"""Queries of reads, mappings and overlaps over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions import sequences as S
from strandmill.model import ANCHOR, TETRAMER_DISTANCE
from strandmill.operators import classify as C
from strandmill.operators import coverage, graph, lengths
from strandmill.operators.decisions import abundance
from strandmill.operators.ordered import carry, spread
from strandmill.operators.rejects import valid_records
from strandmill.operators.sampling import read_batches, reads_by_id, records_by_batch
from strandmill.plans.problems import _LINES
from strandmill.session import table
from strandmill.sources.assembly import keep_channels
from strandmill.sources.fastq import parse_files
from strandmill.sources.paf import paf_line

GOOD = "qname is not null and tname is not null and tname <> '*' and qstart < qend and qend <= qlen and tstart < tend and tend <= tlen"


def mappings(spark: SparkSession, d: str) -> DataFrame:
    """Alignments with a target and sound coordinates."""
    return table(spark, d, "alignments").filter(GOOD)


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_overlaps").filter(GOOD)


def unique_reads(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """``cols`` of each read, once, as it was loaded last."""
    order = F.struct("loaded_at", F.coalesce("length", F.lit(-1)), F.coalesce("channel", F.lit(-1)), F.coalesce("barcode", F.lit(-1)))
    return table(spark, d, "seq_reads").groupBy("read_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("read_id", "r.*")


def active_contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contigs").filter("length >= 100000 and not rejected")


def on_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Sound mappings on active contigs, cut off at the contig's end."""
    contigs = active_contigs(spark, d).select(F.col("contig").alias("tname"), F.col("length").alias("contig_length"))
    return mappings(spark, d).join(contigs, "tname").filter("tend <= contig_length")


def reads_unique(spark, d):
    return unique_reads(spark, d, "length", "channel", "barcode")


def read_filter_channel(spark, d):
    wanted = table(spark, d, "channels").filter("condition_name = 'treatment'")
    return keep_channels(table(spark, d, "seq_reads"), wanted).select("read_id", "length", "channel")


def read_length_filter(spark, d):
    return table(spark, d, "seq_reads").filter("length > 2500").select("read_id", F.least("length", F.lit(999_999)).alias("length"))


def paf_core_filter(spark, d):
    return C.keep_mappings(table(spark, d, "alignments"), 200).select("line_no")


def overlap_filter(spark, d):
    return C.keep_overlaps(overlaps(spark, d)).select("line_no")


def classify_overlaps(spark, d):
    return C.with_class(overlaps(spark, d)).select("line_no", "maplen", "cls", "qside", "tside", "qprox", "tprox")


def trim_coords(spark, d):
    return C.trim_coords(C.with_class(mappings(spark, d)))


def best_mapper(spark, d):
    return C.best_mapping(C.keep_mappings(mappings(spark, d)), ["line_no", "mapq"])


def pair_dedup_s1(spark, d):
    return C.best_of_pair(C.keep_overlaps(overlaps(spark, d)), ["line_no", "s1"])


def multiline_pairs(spark, d):
    return C.repeated_pairs(overlaps(spark, d))


def containment_edges(spark, d):
    return C.containments(C.with_class(C.keep_overlaps(overlaps(spark, d), 500, 50, 500)))


def containment_sources(spark, d):
    edges = containment_edges(spark, d)
    return edges.select(F.col("src").alias("id")).subtract(edges.select("dst"))


def contain_layers(spark, d):
    return graph.contain_layers(containment_edges(spark, d))


def multiline_containments(spark, d):
    return graph.multiline_containments(C.with_class(mappings(spark, d).filter("qname <> tname")).filter("cls = 1"))


def coverage_passing(spark, d):
    """Coverage of contained reads passed on, in cells of 100 bases; each read brings 1 of its own."""
    edges = containment_edges(spark, d)
    named = overlaps(spark, d).select(F.explode(F.array(F.struct(F.col("qname").alias("header"), F.col("qlen").alias("n")), F.struct(F.col("tname").alias("header"), F.col("tlen").alias("n")))).alias("x")).select("x.*")
    reads = named.groupBy("header").agg(F.max("n").alias("n"))
    own = reads.select("header", F.explode(F.sequence(F.lit(0), F.expr("cast(n div 100 as int)"))).alias("at"), F.lit(1.0).alias("value"))
    cells = [F.expr(f"{x} div 100").alias(x) for x in ("ostart", "oend", "cstart", "cend")]
    out = graph.pass_coverage(own, edges.select("src", "dst", "rev", *cells))
    return out.groupBy("header").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def links_without_contained(spark, d):
    links = C.with_class(C.keep_overlaps(overlaps(spark, d))).filter("cls in (4, 5, 6)").select(F.col("qname").alias("src"), F.col("tname").alias("dst"))
    return graph.both_ways(graph.without_ids(links, containment_edges(spark, d), "src"), "src", "dst").distinct()


def routed_overlaps(spark, d):
    """Reads of even channels take overlaps."""
    acceptors = unique_reads(spark, d, "channel").filter("channel % 2 = 0").select(F.col("read_id").alias("header"))
    records = C.with_class(C.keep_overlaps(overlaps(spark, d), 500, 50, 500))
    return graph.route(records, acceptors).select("line_no", "cls", "kind")


def target_members(spark, d):
    """The sources of the reads on each target."""
    reads = unique_reads(spark, d, "source").select(F.col("read_id").alias("name"), F.col("source").alias("member"))
    pairs = mappings(spark, d).select(F.col("tname").alias("header"), F.col("qname").alias("name")).distinct()
    return graph.members(pairs, reads)


def longest_contigs(spark, d):
    return graph.longest(table(spark, d, "contigs").select("contig", "length"))


def repeat_reads(spark, d):
    return graph.repeat_reads(overlaps(spark, d).filter("qname <> tname"), 20_000)


def sequence_temperature(spark, d):
    reads = unique_reads(spark, d, "channel", "length").select(F.col("read_id").alias("header"), (F.coalesce("channel", F.lit(0)) % 4).alias("temperature"), F.expr("repeat('A', cast(coalesce(length, 0) div 100 as int))").alias("seq"))
    warm = overlaps(spark, d).select(F.col("qname").alias("id"))
    return graph.cool_down(graph.reset_temperature(reads, warm, 60), 100).select("header", "temperature", "frozen")


def unmapped_reads(spark, d):
    return table(spark, d, "seq_reads").select("read_id").distinct().join(mappings(spark, d).select(F.col("qname").alias("read_id")), "read_id", "left_anti")


def mapped_active(spark, d):
    names = active_contigs(spark, d).select(F.col("contig").alias("tname"))
    return mappings(spark, d).join(names, "tname", "left_semi").select("line_no", "tname")


def names_apart(spark, d):
    a = table(spark, d, "alignments").select("tname").filter("tname is not null and tname not like 'utg%' and tname <> '*'").distinct()
    b = table(spark, d, "contigs").select(F.col("contig").alias("name"))
    return a.join(b, F.col("tname") == F.col("name"), "full_outer").filter("tname is null or name is null")


def target_abundance(spark, d):
    best = C.best_mapping(C.keep_mappings(mappings(spark, d)), ["tname"])
    total = table(spark, d, "seq_reads").agg(F.count_distinct("read_id")).scalar()
    return abundance(best, total).withColumn("share", F.round("share", 9))


def abundance_by_barcode(spark, d):
    best = C.best_mapping(C.keep_mappings(mappings(spark, d)), ["tname"]).withColumnRenamed("qname", "read_id")
    reads = unique_reads(spark, d, "barcode").select("read_id", F.coalesce("barcode", F.lit(0)).alias("barcode"))
    return best.join(reads, "read_id").groupBy("tname", "barcode").agg(F.count("*").alias("n"))


def length_stats(spark, d):
    return lengths.length_stats(lengths.length_histogram(unique_reads(spark, d, "length")))


def ccl_quantiles(spark, d):
    return lengths.ccl_partition(lengths.length_histogram(unique_reads(spark, d, "length")))


def depth_stretches(spark, d):
    return coverage.depth_stretches(on_contigs(spark, d), ["tname"])


def depth_blocks(spark, d):
    return S.runs_at_least(depth_stretches(spark, d), ["tname"], "s", "e", "depth", 5, 100)


def repeat_limit(spark, d):
    names = active_contigs(spark, d).select(F.col("contig").alias("tname"), "length")
    return coverage.repeat_limit(depth_stretches(spark, d), names, ["tname"])


def fastq_reads(spark, d):
    return parse_files(table(spark, d, "fastq_files")).select("file_id", "read_id", "length", "channel", "barcode", "source")


def truncated_reads(spark, d):
    return parse_files(table(spark, d, "fastq_files")).select("file_id", "ordinal", F.substring("seq", 1, ANCHOR).alias("seq"))


def paf_parse(spark, d):
    """The valid lines, quoted ones among them, that are primary and long enough."""
    records = valid_records(table(spark, d, "paf_lines"), keep=["line_no"])
    return records.filter("is_primary and blen >= 200").select("line_no", "qname", "tlen", "strand", "blen", "align_score", "s1", "cigar")


def batch_numbers(spark, d):
    """Reads and bases of ten sequencing batches each."""
    reads = unique_reads(spark, d, "batch_no", "length")
    return reads.withColumn("batch", F.expr("batch_no div 10")).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.coalesce("length", F.lit(0))).alias("bases"))


def sampled_batches(spark, d):
    return read_batches(unique_reads(spark, d, "length"), 400, None)


def last_action(spark, d):
    order = ("started_at", "read_id")
    acts = spread(unique_started(spark, d).filter("channel is not null").select("read_id", "channel", "barcode", "started_at"), "channel", *order)
    return carry(acts, "channel", order, previous=F.struct("barcode")).select("read_id", "channel", F.col("previous.barcode").alias("previous"))


def unique_started(spark, d):
    order = F.struct("loaded_at", F.coalesce("length", F.lit(-1)), F.coalesce("channel", F.lit(-1)), F.coalesce("barcode", F.lit(-1)))
    cols = F.struct("started_at", "length", "channel", "barcode", "batch_no")
    return table(spark, d, "seq_reads").groupBy("read_id").agg(F.max_by(cols, order).alias("r")).select("read_id", "r.*")


def fastq_seqs(spark, d):
    return parse_files(table(spark, d, "fastq_files")).select(F.concat_ws(":", "file_id", "ordinal").alias("header"), "seq", "file_id", "ordinal")


def revcomp(spark, d):
    return fastq_seqs(spark, d).select("header", S.reverse_complement("seq").alias("rc"))


def kmer_counts(spark, d):
    return S.kmer_counts(fastq_seqs(spark, d), "header", "seq").groupBy("k", "kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_seqs"))


def tetramer_scores(spark, d):
    z = S.tetramer_scores(fastq_seqs(spark, d), "header", "seq")
    return z.select("header", "kmer", "n", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


def tetramer_distance(spark, d):
    """Of neighbouring reads of a file.  Copies of a file number have their reads counted together, and as in SQL each copy
    of a pair holds its part of the shares."""
    reads = fastq_seqs(spark, d).filter("file_id is not null").select("file_id", "ordinal", "seq")
    at = Window.partitionBy("file_id").orderBy("ordinal")
    here, after = (F.collect_list("seq").over(at.rangeBetween(n, n)) for n in (0, 1))
    pairs = reads.select("file_id", "ordinal", here.alias("a"), after.alias("b"), F.lag("ordinal").over(at).alias("before"))
    pairs = pairs.filter("size(b) > 0 and (before is null or before < ordinal)").select(
        F.concat_ws(":", "file_id", "ordinal").alias("h1"), F.concat_ws(":", "file_id", F.col("ordinal") + 1).alias("h2"),
        F.sqrt(F.size("a") * F.size("b")).alias("copies"), "a", "b",
    )
    dist = S.tetramer_distance(pairs, "a", "b")
    return dist.select("h1", "h2", F.round(F.col("distance") / F.col("copies"), 6).alias("distance"))


def same_species(spark, d):
    """Pairs of neighbouring reads whose tetramers are alike enough for an overlap."""
    return tetramer_distance(spark, d).filter(F.col("distance") < TETRAMER_DISTANCE).select("h1", "h2")


def sequence_chunks(spark, d):
    return S.chunks(fastq_seqs(spark, d), "header", "seq", 50)


def paf_of_reads(spark, d):
    """The mappings of the reads of the treated channels."""
    wanted = table(spark, d, "channels").filter("condition_name = 'treatment'")
    ids = keep_channels(unique_reads(spark, d, "channel"), wanted)
    return C.records_of(table(spark, d, "alignments"), ids).select("line_no", "qname")


def strategy_targets(spark, d):
    """Targets, contigs or unitigs, that are long enough for a strategy."""
    targets = mappings(spark, d).groupBy("tname").agg(F.max("tlen").alias("length"))
    return graph.long_enough(targets)


def assembly_totals(spark, d):
    return graph.assembly_totals(mappings(spark, d).groupBy("tname").agg(F.max("tlen").alias("length")))


def reference_sites(spark, d):
    return graph.assembly_totals(active_contigs(spark, d)).select(F.col("n").alias("n_contigs"), F.col("total").alias("n_sites"))


def trim_success(spark, d):
    """Trims of overlaps, and whether the trimmed read is in a proper overlap."""
    classified = C.with_class(overlaps(spark, d))
    return C.trims_by_success(C.trim_coords(classified).select("line_no", "sid"), classified.filter("cls in (4, 5)"))


def requested_reads(spark, d):
    """Random access: the reads that the surest alignments name."""
    ids = mappings(spark, d).filter("mapq >= 60").select(F.col("qname").alias("read_id"))
    return reads_by_id(unique_reads(spark, d, "length", "channel"), ids)


def batch_records(spark, d):
    """Of the reads of every batch the mappings of the whole reads, and those that begin within the anchor."""
    full = C.keep_mappings(mappings(spark, d))
    return records_by_batch(sampled_batches(spark, d), full, full.filter(F.col("qstart") < ANCHOR), "line_no")


def trimmed_reads(spark, d):
    """Reads with a run of five A without the first such run, and what is left of the places 1, 2, 3 .. as their coverage."""
    seqs = fastq_seqs(spark, d).filter("instr(seq, 'AAAAA') > 0").withColumn("cov", F.expr("sequence(1, length(seq))"))
    cuts = seqs.select(F.col("header").alias("sid"), F.expr("instr(seq, 'AAAAA') - 1").alias("trim_start"), F.expr("instr(seq, 'AAAAA') + 4").alias("trim_stop"))
    cut_out = S.remove_stretches(seqs, cuts, cov="cov")
    return cut_out.select("header", "seq", F.expr("aggregate(cov, 0L, (x, y) -> x + y)").alias("cov"))


def paf_text(spark, d):
    return mappings(spark, d).select("line_no", paf_line().alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        reads_unique, read_filter_channel, read_length_filter, paf_core_filter, overlap_filter, classify_overlaps, trim_coords,
        best_mapper, pair_dedup_s1, multiline_pairs, containment_edges, containment_sources, contain_layers,
        multiline_containments, coverage_passing, links_without_contained, routed_overlaps, target_members, longest_contigs, same_species, repeat_reads, sequence_temperature, unmapped_reads,
        mapped_active, names_apart, target_abundance, abundance_by_barcode, length_stats, ccl_quantiles, depth_stretches,
        depth_blocks, repeat_limit, fastq_reads, truncated_reads, paf_parse, batch_numbers, sampled_batches, last_action, revcomp, kmer_counts,
        tetramer_scores, tetramer_distance, sequence_chunks, paf_of_reads, strategy_targets, assembly_totals, reference_sites, trim_success,
        requested_reads, batch_records, trimmed_reads, paf_text,
    )
}

_OVL = f"o AS (SELECT * FROM read_overlaps WHERE {GOOD})"
_MAP = f"m AS (SELECT * FROM alignments WHERE {GOOD})"
_KEEP = "k AS (SELECT * FROM o WHERE qname <> tname AND least(qend - qstart, tend - tstart) >= {0} AND s1 >= {1} AND least(qlen, tlen) >= {2})"
_UNIQUE = """u AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC, coalesce(length, -1) DESC,
  coalesce(channel, -1) DESC, coalesce(barcode, -1) DESC) AS rn FROM seq_reads) WHERE rn = 1)"""


def _classes(source: str) -> str:
    return f"""
x AS (SELECT *, strand = '-' AS rev, least(qend - qstart, tend - tstart) AS maplen, qlen - qend AS qr, tlen - tend AS tr FROM {source}),
y AS (SELECT *, CASE WHEN rev THEN least(qstart, tr) + least(tstart, qr) ELSE least(qstart, tstart) + least(qr, tr) END AS overhang,
  least(qstart, qr) < 1000 AS qn, least(tstart, tr) < 1000 AS tn, least(qstart, qr) < 0.15e0 * qlen AS qw, least(tstart, tr) < 0.15e0 * tlen AS tw FROM x),
z AS (SELECT *, overhang * 100 > 15 * maplen AS internal,
  CASE WHEN rev THEN qstart <= tr AND qr < tstart ELSE qstart <= tstart AND qr < tr END AS in1,
  CASE WHEN rev THEN qstart >= tr AND qr > tstart ELSE qstart >= tstart AND qr > tr END AS in2,
  CASE WHEN NOT rev THEN qstart > tstart WHEN qstart > qr THEN qstart > tr ELSE qlen - qstart > tend END AS four FROM y),
cl AS (SELECT *, CAST(CASE WHEN internal THEN CASE WHEN (qend - qstart) * 2 >= qlen AND qlen > 20000 THEN 2
    WHEN (tend - tstart) * 2 >= tlen AND qlen > 20000 THEN 3
    WHEN qlen > 15000 AND tlen > 15000 AND maplen > 5000 AND (qn AND tw OR NOT qn AND tn AND qw) THEN 6 ELSE 1 END
  WHEN in1 THEN 2 WHEN in2 THEN 3 WHEN (qend - qstart) * 10 >= qlen * 9 THEN 2 WHEN (tend - tstart) * 10 >= tlen * 9 THEN 3
  WHEN four THEN 4 ELSE 5 END AS INTEGER) AS cls FROM z)"""


_BEST = f"""{_MAP}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY coalesce(mapq, 0) DESC, coalesce(align_score, 0) DESC,
  line_no DESC) AS rn FROM m WHERE is_primary AND blen >= 1) WHERE rn = 1)"""
_EDGES = f"""{_OVL}, {_KEEP.format(500, 50, 500)}, {_classes("k")},
e AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY s1 DESC, line_no DESC) AS rn FROM (
  SELECT CASE cls WHEN 2 THEN qname ELSE tname END AS src, CASE cls WHEN 2 THEN tname ELSE qname END AS dst,
    CASE cls WHEN 2 THEN tstart ELSE qstart END AS ostart, CASE cls WHEN 2 THEN tend ELSE qend END AS oend,
    CASE cls WHEN 2 THEN qstart ELSE tstart END AS cstart, CASE cls WHEN 2 THEN qend ELSE tend END AS cend, rev, s1, line_no
  FROM cl WHERE cls IN (2, 3))) WHERE rn = 1)"""
_HIST = f"{_UNIQUE}, h AS (SELECT least(length, 999999) AS length, count(*) AS n FROM u WHERE length > 800 GROUP BY 1)"
_ON = f"{_MAP}, a AS (SELECT m.*, c.length AS contig_length FROM m JOIN contigs c ON tname = contig AND c.length >= 100000 AND NOT rejected WHERE tend <= c.length)"
_DEPTH = f"""{_ON}, st AS (SELECT tname, ps, sum(d) AS d FROM (SELECT tname, CAST(tstart AS BIGINT) AS ps, 1 AS d FROM a UNION ALL SELECT tname, tend, -1 FROM a)
  GROUP BY 1, 2 HAVING sum(d) <> 0),
ti AS (SELECT tname, ps, sum(d) AS d FROM (SELECT tname, ps, d FROM st UNION ALL SELECT tname, unnest(range(65536, max(ps), 65536)), 0 FROM st GROUP BY tname) GROUP BY 1, 2),
sw AS (SELECT tname, ps AS s, lead(ps) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS depth FROM ti WINDOW w AS (PARTITION BY tname ORDER BY ps)),
dp AS (SELECT * FROM sw WHERE depth > 0)"""
_FQ = r"""l AS (SELECT file_id, path, list_filter(regexp_split_to_array(content, '\r\n|\n|\r'), lambda x: trim(x) <> '') AS ls FROM fastq_files WHERE content IS NOT NULL),
r AS (SELECT file_id, path, ls, unnest(range(0, len(ls) // 4)) AS k FROM l),
q AS (SELECT file_id, path, CAST(k AS INTEGER) AS k, ls[4 * k + 1] AS head, ls[4 * k + 2] AS seq, ls[4 * k + 3] AS plus, ls[4 * k + 4] AS qual FROM r),
fq AS (SELECT file_id, path, k, substring(split_part(head, ' ', 1), 2) AS read_id, trim(substring(head, length(split_part(head, ' ', 1)) + 2)) AS comment, seq, qual
  FROM q WHERE head LIKE '@%' AND plus LIKE '+%' AND length(seq) = length(qual)),
s AS (SELECT concat(file_id, ':', k) AS header, file_id, k, seq FROM fq)"""
_KMERS = f"""{_FQ}, s2 AS (SELECT header, seq || reverse(translate(seq, 'ATGC', 'TACG')) AS t FROM s),
kp AS (SELECT header, t, k, unnest(range(1, greatest(length(t) - k, 1))) AS i FROM s2, (VALUES (2), (3), (4)) v(k)),
kc AS MATERIALIZED (SELECT header, k, kmer, count(*) AS n FROM (SELECT header, CAST(k AS INTEGER) AS k, substring(t, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS kmer FROM kp) WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY ALL)"""

_LAYERS = f"""{_EDGES}, bf(n, d) AS (SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, d + 1 FROM bf JOIN e ON e.src = n WHERE d < 60),
la AS (SELECT e.*, d AS layer, count(*) OVER (PARTITION BY e.src) AS multiplicity FROM e JOIN (SELECT n, min(d) AS d FROM bf GROUP BY 1) ON n = e.src)"""


def _passing(layers: int = 12) -> str:
    """One step for each layer (the given tables have fewer)."""
    parts = [f"""{_LAYERS}, hd AS (SELECT header, max(n) // 100 AS hl FROM (SELECT qname AS header, qlen AS n FROM o UNION ALL SELECT tname, tlen FROM o) GROUP BY 1),
lc AS (SELECT *, o1 - o0 AS n, least(c1, hl + 1) - c0 AS sz FROM (SELECT src, dst, rev, layer, multiplicity, ostart // 100 AS o0, oend // 100 AS o1, cstart // 100 AS c0, cend // 100 AS c1 FROM la) JOIN hd ON header = src),
c0 AS (SELECT header, unnest(range(0, hl + 1)) AS ps, 1e0 AS v FROM hd)"""]
    for k in range(layers):
        parts.append(f"""a{k} AS (SELECT dst AS header, o0 + CASE WHEN rev THEN n - 1 - i ELSE i END AS ps, sum(v / multiplicity) AS more
  FROM (SELECT *, unnest(range(0, n)) AS i FROM lc WHERE layer = {k} AND sz > 0 AND n > 0) x JOIN c{k} ON c{k}.header = x.src AND c{k}.ps = c0 + least(i, sz - 1) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT header, ps, CASE WHEN header IN (SELECT dst FROM lc WHERE layer = {k}) THEN least(v + coalesce(more, 0), 100) ELSE v END AS v FROM c{k} LEFT JOIN a{k} USING (header, ps))""")
    return ", ".join(parts) + f" SELECT header, count(*) AS n, round(sum(v), 6) AS total FROM c{layers} GROUP BY 1"


ORACLE = {
    "contain_layers": f"WITH RECURSIVE {_LAYERS} SELECT src, dst, CAST(layer AS INTEGER) AS layer, multiplicity FROM la",
    "coverage_passing": f"WITH RECURSIVE {_passing()}",
    "multiline_containments": f"""WITH {_MAP}, k AS (SELECT * FROM m WHERE qname <> tname), {_classes("k")},
it AS (SELECT *, least(qname, tname) || '-' || greatest(qname, tname) AS pk FROM cl WHERE cls = 1),
pn AS (SELECT *, count(*) OVER w AS n, first_value(qname) OVER w2 AS q, first_value(tname) OVER w2 AS t, first_value(qlen) OVER w2 AS ql, first_value(tlen) OVER w2 AS tl FROM it
  WINDOW w AS (PARTITION BY pk), w2 AS (PARTITION BY pk ORDER BY line_no)),
sd AS (SELECT pk, n, q, t, ql, tl, line_no, CASE WHEN qname = q THEN qstart ELSE tstart END AS qs, CASE WHEN qname = q THEN qend ELSE tend END AS qe,
  CASE WHEN qname = q THEN tstart ELSE qstart END AS ts, CASE WHEN qname = q THEN tend ELSE qend END AS te FROM pn WHERE n BETWEEN 2 AND 10),
qc AS (SELECT pk, count(DISTINCT x) AS nc, min(x) AS lo, max(x) AS hi FROM (SELECT pk, unnest(range(qs // 100, qe // 100)) AS x FROM sd) GROUP BY 1),
tc AS (SELECT pk, count(DISTINCT x) AS nc, min(x) AS lo, max(x) AS hi FROM (SELECT pk, unnest(range(ts // 100, te // 100)) AS x FROM sd) GROUP BY 1),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY least(qe - qs, te - ts) DESC, line_no) AS rn FROM sd) WHERE rn = 1),
ok AS (SELECT bs.*, qc.lo AS q0, qc.hi AS q1, tc.lo AS t0, tc.hi AS t1, coalesce(qc.nc > ql // 100 * 0.9 AND qc.hi - qc.lo > ql // 100 * 0.85, false) AS qok,
  coalesce(tc.nc > tl // 100 * 0.9 AND tc.hi - tc.lo > tl // 100 * 0.85, false) AS tok FROM bs LEFT JOIN qc USING (pk) LEFT JOIN tc USING (pk)),
ou AS (SELECT CASE WHEN qok THEN q ELSE t END AS src, CASE WHEN qok THEN t ELSE q END AS dst, n, CASE WHEN qok THEN q0 ELSE t0 END * 100 AS cstart, CASE WHEN qok THEN q1 ELSE t1 END * 100 AS cend,
  CASE WHEN qok THEN t0 ELSE q0 END * 100 AS o0, CASE WHEN qok THEN t1 ELSE q1 END * 100 AS o1, CASE WHEN qok THEN ts ELSE qs END AS b0, CASE WHEN qok THEN te ELSE qe END AS b1 FROM ok WHERE qok OR tok)
SELECT src, dst, CASE WHEN o1 - o0 > (cend - cstart) * 2.2 THEN b0 ELSE o0 END AS ostart, CASE WHEN o1 - o0 > (cend - cstart) * 2.2 THEN b1 ELSE o1 END AS oend, cstart, cend, n FROM ou""",
    "reads_unique": f"WITH {_UNIQUE} SELECT read_id, length, channel, barcode FROM u",
    "read_filter_channel": "SELECT read_id, length, channel FROM seq_reads WHERE channel IN (SELECT channel FROM channels WHERE condition_name = 'treatment')",
    "read_length_filter": "SELECT read_id, least(length, 999999) AS length FROM seq_reads WHERE length > 2500",
    "paf_core_filter": "SELECT line_no FROM alignments WHERE blen >= 200 AND is_primary",
    "overlap_filter": f"WITH {_OVL}, {_KEEP.format(2000, 200, 2500)} SELECT line_no FROM k",
    "classify_overlaps": f"""WITH {_OVL}, {_classes("o")} SELECT line_no, maplen, cls,
CASE WHEN cls IN (4, 5) THEN CASE WHEN rev THEN CASE WHEN qstart > qr THEN 'R' ELSE 'L' END WHEN four THEN 'R' ELSE 'L' END END AS qside,
CASE WHEN cls IN (4, 5) THEN CASE WHEN rev THEN CASE WHEN qstart > qr THEN 'R' ELSE 'L' END WHEN four THEN 'L' ELSE 'R' END END AS tside,
internal AND qn AS qprox, internal AND NOT qn AND tn AS tprox FROM cl""",
    "trim_coords": f"""WITH {_MAP}, {_classes("m")},
t AS (SELECT line_no, qn AS cut_t, CASE WHEN qn THEN tname ELSE qname END AS sid, CASE WHEN qn THEN qname ELSE tname END AS other,
  CASE WHEN qn THEN tstart ELSE qstart END AS b, CASE WHEN qn THEN tend ELSE qend END AS f, CASE WHEN qn THEN tlen ELSE qlen END AS l,
  CASE WHEN qn THEN qlen ELSE tlen END AS ol, blen FROM cl WHERE cls = 6),
v AS (SELECT *, CASE WHEN b <= l - f THEN 0 ELSE f END AS cut_from, CASE WHEN b <= l - f THEN b END AS cut_to FROM t)
SELECT line_no, CASE WHEN ol - blen < coalesce(cut_to, l) - cut_from THEN '0' ELSE sid END AS sid, cut_from AS trim_start, cut_to AS trim_stop, other FROM v""",
    "best_mapper": f"WITH {_BEST} SELECT qname, line_no, mapq FROM b",
    "pair_dedup_s1": f"""WITH {_OVL}, {_KEEP.format(2000, 200, 2500)}, w AS (SELECT least(qname, tname) || '-' || greatest(qname, tname) AS pair, * FROM k)
SELECT pair, line_no, s1 FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s1 DESC, line_no DESC) AS rn FROM w) WHERE rn = 1""",
    "multiline_pairs": f"WITH {_OVL} SELECT least(qname, tname) || '-' || greatest(qname, tname) AS pair, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1",
    "containment_edges": f"WITH {_EDGES} SELECT * FROM e",
    "containment_sources": f"WITH {_EDGES} SELECT DISTINCT src AS id FROM e WHERE src NOT IN (SELECT dst FROM e)",
    "links_without_contained": f"""WITH {_EDGES}, k2 AS (SELECT * FROM k WHERE least(qend - qstart, tend - tstart) >= 2000 AND s1 >= 200 AND least(qlen, tlen) >= 2500),
li AS (SELECT qname, tname FROM cl WHERE cls IN (4, 5, 6) AND line_no IN (SELECT line_no FROM k2) AND qname NOT IN (SELECT src FROM e) AND tname NOT IN (SELECT src FROM e))
SELECT qname AS src, tname AS dst FROM li UNION SELECT tname, qname FROM li""",
    "routed_overlaps": f"""WITH {_OVL}, {_KEEP.format(500, 50, 500)}, {_classes("k")}, {_UNIQUE}, ac AS (SELECT read_id FROM u WHERE channel % 2 = 0),
ro AS (SELECT line_no, CAST(CASE WHEN cls IN (4, 5) AND tname NOT IN (SELECT read_id FROM ac) THEN 2 WHEN cls IN (4, 5) AND qname NOT IN (SELECT read_id FROM ac) THEN 3 ELSE cls END AS INTEGER) AS cls FROM cl)
SELECT line_no, cls, CASE WHEN cls IN (2, 3) THEN 'containment' WHEN cls IN (4, 5) THEN 'overlap' WHEN cls = 6 THEN 'trim' ELSE 'internal' END AS kind FROM ro""",
    "target_members": f"WITH {_MAP}, {_UNIQUE} SELECT tname AS header, list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)) AS members FROM m JOIN u ON qname = read_id GROUP BY 1",
    "longest_contigs": "SELECT contig, length FROM contigs ORDER BY length DESC, contig LIMIT 10",
    "repeat_reads": f"""WITH {_OVL} SELECT DISTINCT tname AS id FROM (
SELECT tname, sum(greatest(least(tend, 500) - tstart, 0)) AS a, sum(greatest(tend - greatest(tstart, 500), 0)) AS b FROM o WHERE qname <> tname GROUP BY 1) WHERE a > 20000 OR b > 20000""",
    "sequence_temperature": f"""WITH {_OVL}, {_UNIQUE}, t AS (SELECT read_id AS header, coalesce(length, 0) // 100 AS n,
  CASE WHEN read_id IN (SELECT qname FROM o) THEN 60 ELSE coalesce(channel, 0) % 4 END AS temperature FROM u)
SELECT header, CAST(CASE WHEN n < 100 THEN temperature - 1 ELSE temperature END AS INTEGER) AS temperature, n < 100 AND temperature - 1 <= 0 AS frozen FROM t""",
    "unmapped_reads": f"WITH {_MAP} SELECT DISTINCT read_id FROM seq_reads WHERE read_id IS NOT NULL AND read_id NOT IN (SELECT qname FROM m)",
    "mapped_active": f"WITH {_MAP} SELECT line_no, tname FROM m WHERE tname IN (SELECT contig FROM contigs WHERE length >= 100000 AND NOT rejected)",
    "names_apart": """SELECT tname, contig AS name FROM (SELECT DISTINCT tname FROM alignments WHERE tname IS NOT NULL AND tname NOT LIKE 'utg%' AND tname <> '*')
FULL JOIN contigs ON tname = contig WHERE tname IS NULL OR contig IS NULL""",
    "target_abundance": f"WITH {_BEST} SELECT tname, count(*) AS n, round(count(*) / (SELECT count(DISTINCT read_id) FROM seq_reads), 9) AS share FROM b GROUP BY 1",
    "abundance_by_barcode": f"WITH {_BEST}, {_UNIQUE} SELECT tname, coalesce(barcode, 0) AS barcode, count(*) AS n FROM b JOIN u ON qname = read_id GROUP BY ALL",
    "length_stats": f"WITH {_HIST} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sum(length * n) / sum(n) AS mean_length, max(length) AS max_length FROM h",
    "ccl_quantiles": f"WITH {_UNIQUE} SELECT CAST(part AS INTEGER) AS part, quantile_disc(least(length, 999999), (part + 0.5) / 10) AS ccl FROM u, range(10) r(part) WHERE length > 800 GROUP BY part".replace("quantile_disc(least(length, 999999), (part + 0.5) / 10)", "list_sort(list(least(length, 999999)))[CAST(ceil(count(*) * (2 * part + 1) / 20) AS BIGINT)]"),
    "depth_stretches": f"WITH {_DEPTH} SELECT * FROM dp",
    "depth_blocks": f"""WITH {_DEPTH}, i AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS new FROM dp WHERE depth >= 5 WINDOW w AS (PARTITION BY tname ORDER BY s)),
j AS (SELECT *, sum(new) OVER (PARTITION BY tname ORDER BY s) AS no FROM i)
SELECT tname, min(s) AS start, max(e) AS "end" FROM j GROUP BY tname, no HAVING max(e) - min(s) > 100""",
    "repeat_limit": f"""WITH {_DEPTH}, hi AS (SELECT depth, sum(e - s) AS n FROM dp GROUP BY 1),
al AS (SELECT depth, n FROM hi UNION ALL SELECT 0, (SELECT sum(length) FROM contigs WHERE length >= 100000 AND NOT rejected) - (SELECT sum(n) FROM hi)),
cu AS (SELECT depth, sum(n) OVER (ORDER BY depth) AS upto, (sum(n) OVER () - 1) * 0.999e0 AS q FROM al)
SELECT greatest(min(depth) FILTER (upto > floor(q)) + (min(depth) FILTER (upto > ceil(q)) - min(depth) FILTER (upto > floor(q))) * max(q - floor(q)), 3e0) AS limit_depth FROM cu""",
    "fastq_reads": rf"""WITH {_FQ} SELECT file_id, read_id, CAST(length(seq) AS INTEGER) AS length, TRY_CAST(nullif(regexp_extract(comment, '\sch=([0-9]+)', 1), '') AS INTEGER) AS channel,
CAST(CASE regexp_extract(comment, 'barcode=(unclassified|barcode[0-9]+)', 1) WHEN '' THEN 0 WHEN 'unclassified' THEN 99 ELSE TRY_CAST(substring(regexp_extract(comment, 'barcode=(unclassified|barcode[0-9]+)', 1), 8) AS INTEGER) END AS INTEGER) AS barcode,
nullif(split_part(comment, ' ', -1), '') AS source FROM fq""",
    "truncated_reads": f"WITH {_FQ} SELECT file_id, k AS ordinal, substring(seq, 1, 400) AS seq FROM fq",
    "paf_parse": f"""WITH {_LINES}, g AS (SELECT *, tags AS t FROM r WHERE reason IS NULL)
SELECT * FROM (SELECT line_no, p[1] AS qname, CAST(p[7] AS BIGINT) AS tlen, p[5] AS strand, CAST(p[11] AS BIGINT) AS blen,
  coalesce(CAST(substring(list_filter(t, lambda x: x LIKE 'AS:i:%')[1], 6) AS BIGINT), 0) AS align_score,
  coalesce(CAST(substring(list_filter(t, lambda x: x LIKE 's1:i:%')[1], 6) AS BIGINT), 0) AS s1,
  substring(list_filter(t, lambda x: x LIKE 'cg:Z:%')[1], 6) AS cigar
FROM g WHERE coalesce(substring(list_filter(t, lambda x: x LIKE 'tp:A:%')[1], 6) = 'P', false)) WHERE blen >= 200""",
    "batch_numbers": f"WITH {_UNIQUE} SELECT CAST(batch_no // 10 AS BIGINT) AS batch, count(*) AS n, CAST(sum(coalesce(length, 0)) AS BIGINT) AS bases FROM u GROUP BY 1",
    "sampled_batches": f"WITH {_UNIQUE} SELECT read_id, length, CAST((row_number() OVER (ORDER BY read_id) - 1) // 400 AS BIGINT) AS batch FROM u",
    "last_action": f"WITH {_UNIQUE} SELECT read_id, channel, lag(barcode) OVER (PARTITION BY channel ORDER BY started_at, read_id) AS previous FROM u WHERE channel IS NOT NULL",
    "revcomp": f"WITH {_FQ} SELECT header, reverse(translate(seq, 'ATGC', 'TACG')) AS rc FROM s",
    "kmer_counts": f"WITH {_KMERS} SELECT k, kmer, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_seqs FROM kc GROUP BY 1, 2",
    "tetramer_scores": f"""WITH {_KMERS}, t AS (SELECT a.header, a.kmer, a.n, b.n AS x, c.n AS y, d.n AS z0, CAST(b.n AS DOUBLE) * c.n / d.n AS ex FROM kc a
  JOIN kc b ON b.header = a.header AND b.kmer = substring(a.kmer, 1, 3) JOIN kc c ON c.header = a.header AND c.kmer = substring(a.kmer, 2, 3)
  JOIN kc d ON d.header = a.header AND d.kmer = substring(a.kmer, 2, 2) WHERE a.k = 4)
SELECT header, kmer, n, round(ex, 6) AS expected, round((n - ex) / nullif(sqrt(ex * (z0 - x) * (z0 - y) / (CAST(z0 AS DOUBLE) * z0)), 0), 6) AS z FROM t""",
    "tetramer_distance": f"""WITH {_KMERS}, pr AS (SELECT a.header AS h1, b.header AS h2 FROM s a JOIN s b ON a.file_id = b.file_id AND a.k + 1 = b.k),
sh AS (SELECT h1, h2, x.n AS na, y.n AS nb FROM pr JOIN kc x ON x.header = h1 AND x.k = 4 JOIN kc y ON y.header = h2 AND y.k = 4 AND y.kmer = x.kmer),
nr AS (SELECT h1, h2, na / CAST(sum(na) OVER w AS DOUBLE) - nb / CAST(sum(nb) OVER w AS DOUBLE) AS f FROM sh WINDOW w AS (PARTITION BY h1, h2))
SELECT h1, h2, round(sqrt(sum(f * f)), 6) AS distance FROM nr GROUP BY 1, 2""",
    "same_species": f"""WITH {_KMERS}, pr AS (SELECT a.header AS h1, b.header AS h2 FROM s a JOIN s b ON a.file_id = b.file_id AND a.k + 1 = b.k),
sh AS (SELECT h1, h2, x.n AS na, y.n AS nb FROM pr JOIN kc x ON x.header = h1 AND x.k = 4 JOIN kc y ON y.header = h2 AND y.k = 4 AND y.kmer = x.kmer),
nr AS (SELECT h1, h2, na / CAST(sum(na) OVER w AS DOUBLE) - nb / CAST(sum(nb) OVER w AS DOUBLE) AS f FROM sh WINDOW w AS (PARTITION BY h1, h2))
SELECT h1, h2 FROM nr GROUP BY 1, 2 HAVING round(sqrt(sum(f * f)), 6) < 0.036""",
    "paf_of_reads": f"WITH {_UNIQUE} SELECT line_no, qname FROM alignments WHERE qname IN (SELECT read_id FROM u WHERE channel IN (SELECT channel FROM channels WHERE condition_name = 'treatment'))",
    "strategy_targets": f"WITH {_MAP} SELECT tname, max(tlen) AS length FROM m GROUP BY 1 HAVING max(tlen) > 10000",
    "assembly_totals": f"WITH {_MAP}, t AS (SELECT tname, max(tlen) AS length FROM m GROUP BY 1) SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total, max(length) AS longest FROM t",
    "reference_sites": "SELECT count(*) AS n_contigs, CAST(sum(length) AS BIGINT) AS n_sites FROM contigs WHERE length >= 100000 AND NOT rejected",
    "trim_success": f"""WITH {_OVL}, {_classes("o")},
t AS (SELECT line_no, CASE WHEN qn THEN tname ELSE qname END AS sid, CASE WHEN qn THEN tstart ELSE qstart END AS b, CASE WHEN qn THEN tend ELSE qend END AS f,
  CASE WHEN qn THEN tlen ELSE qlen END AS l, CASE WHEN qn THEN qlen ELSE tlen END AS ol, blen FROM cl WHERE cls = 6),
v AS (SELECT *, CASE WHEN b <= l - f THEN 0 ELSE f END AS cut_from, CASE WHEN b <= l - f THEN b END AS cut_to FROM t),
w AS (SELECT line_no, CASE WHEN ol - blen < coalesce(cut_to, l) - cut_from THEN '0' ELSE sid END AS sid FROM v),
nm AS (SELECT qname AS n FROM cl WHERE cls IN (4, 5) UNION SELECT tname FROM cl WHERE cls IN (4, 5))
SELECT line_no, sid, sid IN (SELECT n FROM nm) AS success FROM w""",
    "requested_reads": f"WITH {_MAP}, {_UNIQUE} SELECT read_id, length, channel FROM u WHERE read_id IN (SELECT qname FROM m WHERE mapq >= 60)",
    "batch_records": f"""WITH {_MAP}, {_UNIQUE}, bt AS (SELECT read_id, CAST((row_number() OVER (ORDER BY read_id) - 1) // 400 AS BIGINT) AS batch FROM u),
fu AS (SELECT batch, line_no, qstart FROM m JOIN bt ON read_id = qname WHERE is_primary AND blen >= 1)
SELECT batch, 'full' AS kind, line_no FROM fu UNION ALL SELECT batch, 'truncated', line_no FROM fu WHERE qstart < 400""",
    "trimmed_reads": f"""WITH {_FQ}, cu AS (SELECT header, seq, instr(seq, 'AAAAA') AS i, length(seq) AS l FROM s WHERE instr(seq, 'AAAAA') > 0)
SELECT header || '%' AS header, substring(seq, 1, i - 1) || substring(seq, i + 5) AS seq, CAST(l * (l + 1) // 2 - (5 * i + 10) AS BIGINT) AS cov FROM cu""",
    "paf_text": f"""WITH {_MAP} SELECT line_no, concat_ws(chr(9), qname, coalesce(qlen, 0), qstart, qend, coalesce(strand, '*'), tname, coalesce(tlen, 0), tstart, tend,
  coalesce(num_matches, 0), coalesce(blen, 0), coalesce(mapq, 255), 's1:i:' || s1) AS line FROM m""",
    "sequence_chunks": f"WITH {_FQ}, ch AS (SELECT header, seq, unnest(range(0, length(seq), 50)) AS start FROM s) SELECT header, CAST(start AS BIGINT) AS start, substring(seq, CAST(start + 1 AS INTEGER), 50) AS piece FROM ch",
}
