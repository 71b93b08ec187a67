"""One update of the strategy in reference mode, from mappings to the accept mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.scoring import bin_scores
from strandmill.model import ANCHOR, BIN, BUCKET, DEFAULT_CCL, REJECT, START_WINDOW
from strandmill.operators import benefit as B
from strandmill.operators import coverage, lengths, starts
from strandmill.session import cut

MEAN_LENGTH = 6000.0  # of reads, until lengths have been seen


@dataclass(frozen=True)
class Update:
    """The tables of one update; the cells are written, the rest is lazy.  ``by`` is contig, or contig and barcode."""

    bins: DataFrame  # by, bin, total: the score of each bin
    buckets: DataFrame  # by, bucket, mean_depth, on
    fhat: DataFrame  # contig, bin, strand, fhat
    cells: DataFrame  # by, bin, strand, smu, expected, additional, fhat
    exponents: DataFrame
    curve: DataFrame
    bound: DataFrame
    mask: DataFrame  # by, bin, strand, accept
    strategy: DataFrame  # the mask in the buckets that are switched on


@dataclass(frozen=True)
class Lengths:
    """What read lengths tell an update: ten parts of their distribution, and the mean."""

    ccl: tuple[int, ...] = DEFAULT_CCL
    mean: float = MEAN_LENGTH


def observed_lengths(histogram: DataFrame) -> Lengths:
    """From (length, n); the defaults where no read has been seen.  Ten numbers and a mean come to the driver."""
    ccl = [r["ccl"] for r in lengths.ccl_partition(histogram).orderBy("part").collect()]
    return Lengths(tuple(ccl), lengths.length_stats(histogram).first()["mean_length"]) if ccl else Lengths()


def measure(mappings: DataFrame, contigs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``by``, s, e, bases, dels) and (contig, window, strand, n) of ``mappings`` (tname, tstart, tend, strand, cigar, and what
    ``by`` names beside contig)."""
    spans = mappings.withColumnRenamed("tname", "contig").select(*by, "tstart", "tend", "cigar")
    return coverage.pattern_stretches(spans, by), starts.start_counts(mappings, contigs.select("contig", "length"))


def by_barcode(contigs: DataFrame, barcodes: list[int]) -> DataFrame:
    """(contig, length, barcode): each contig for each barcode of the run, of which there are some dozens."""
    return contigs.select("contig", "length", F.explode(F.array(*[F.lit(b) for b in barcodes])).alias("barcode"))


def switched(depth: DataFrame, sized: DataFrame, by: list[str], threshold: float = 1.0, before: DataFrame | None = None) -> DataFrame:
    """(``by``, bucket, mean_depth, on): buckets whose mean depth reaches the threshold, or that were on before."""
    total = depth.select(*by, "s", "e", (F.col("bases") + F.col("dels")).alias("depth"))
    return coverage.switch_buckets(coverage.bucket_means(total, sized, by, BUCKET), threshold, before, tuple(by))


def plan_update(
    depth: DataFrame, counts: DataFrame, contigs: DataFrame, seen: Lengths = Lengths(), by: tuple[str, ...] = ("contig",), ploidy: int = 1,
    bucket_threshold: float = 1.0, buckets_before: DataFrame | None = None, strategy_before: DataFrame | None = None, base_from_smu: bool = False,
) -> Update:
    """``depth`` and ``counts`` as ``measure`` makes them (both written tables, as they are read several times), ``contigs``
    (``by``, length).

    The score of a position is what one more observation is expected to tell (see ``scoring``); bins sum it.
    ``base_from_smu``: the benefit of rejecting all reads sums the anchors' instead of the additional benefit (which
    is what the published model does).  Frames run in windows of one contig, bounded by its bins; the threshold
    works on at most two thousand exponents.
    """
    keys = list(by)
    sized = contigs.select(*keys, "length")
    bins = bin_scores(depth, sized, keys, ploidy)
    buckets = switched(depth, sized, keys, bucket_threshold, buckets_before)
    lengths_once = contigs.select("contig", "length").distinct()
    begins = starts.start_probabilities(counts)
    fhat = starts.bin_probabilities(begins, lengths_once)
    # The cells are asked several times (greatest benefit, base, exponents, mask): written once, in bins, not positions.
    benefit = B.additional_benefit(bins, keys, seen.ccl).join(lengths_once.select("contig", F.expr(f"length div {START_WINDOW}").alias("__n")).filter("__n > 0"), "contig")
    benefit = benefit.withColumn("window", F.least(F.expr(f"bin div {START_WINDOW // BIN}"), F.col("__n") - 1)).drop("__n")
    windows = starts.window_probabilities(begins, lengths_once).drop("n_windows")
    cells = cut(benefit.join(windows, ["contig", "window", "strand"]).drop("window"), "cells")
    # Greatest benefit and base in one pass.
    known = cells.agg(F.max("additional").alias("peak"), F.sum(F.col("fhat") * F.col("smu" if base_from_smu else "additional")).alias("base")).first()
    exponents = B.benefit_exponents(cells, "additional", "fhat", known["peak"])
    read_time = float((seen.mean - ANCHOR - REJECT) // BIN)
    curve = B.threshold_curve(exponents, known["base"] or 0.0, 10.0, read_time)
    bound = B.threshold(curve)
    mask = B.accept_mask(cells, "additional", bound.scalar()).select(*keys, "bin", "strand", "accept")
    return Update(bins, buckets, fhat, cells, exponents, curve, bound, mask, B.distribute(mask, buckets, strategy_before, by))


def update_from(mappings: DataFrame, contigs: DataFrame, seen: Lengths = Lengths(), barcodes: list[int] | None = None, **options) -> Update:
    """The update from all ``mappings`` at once; with ``barcodes``, for each of them apart (a null barcode is 0)."""
    by = ["contig"] if barcodes is None else ["contig", "barcode"]
    depth, counts = measure(mappings, contigs, by)
    sized = contigs if barcodes is None else by_barcode(contigs, barcodes)
    return plan_update(cut(depth, "depth"), cut(counts, "starts"), sized, seen, tuple(by), **options)
