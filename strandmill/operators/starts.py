"""Where reads begin: counts by window and strand, and the probability of a read to begin there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.model import START_WINDOW


def start_counts(mappings: DataFrame, contigs: DataFrame, size: int = START_WINDOW) -> DataFrame:
    """(contig, window, strand, n) for the whole windows of every contig, those without reads among them.

    Forward reads begin at ``tstart``, reverse ones (strand 1) at ``tend``.  Beyond the whole windows nothing
    counts, but a begin at their very end belongs to the last.
    """
    at = F.when(F.col("strand") == "-", F.col("tend")).otherwise(F.col("tstart")).cast("bigint")
    sized = contigs.select(F.col("contig"), F.expr(f"cast(length div {size} as bigint)").alias("n_windows")).filter("n_windows > 0")
    begins = mappings.select(F.col("tname").alias("contig"), (F.col("strand") == "-").cast("int").alias("strand"), at.alias("at")).join(sized, "contig")
    begins = begins.filter(F.col("at") <= F.col("n_windows") * size)
    counted = begins.groupBy("contig", F.least(F.expr(f"at div {size}"), F.col("n_windows") - 1).alias("window"), "strand").agg(F.count("*").alias("n"))
    spine = sized.select("contig", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1)).alias("window"))
    spine = spine.withColumn("strand", F.explode(F.array(F.lit(0), F.lit(1))))
    return spine.join(counted, ["contig", "window", "strand"], "left").select("contig", "window", "strand", F.coalesce("n", F.lit(0)).alias("n"))


def start_probabilities(counts: DataFrame, p_zero: float = 0.1) -> DataFrame:
    """Adds ``fhat``, with a point mass at zero (alpha = 1, where the beta functions have a closed form)."""
    cells, reads = counts.agg(F.count("*")).scalar(), counts.agg(F.sum("n")).scalar()
    seen = (1 + F.col("n")) / (cells + reads)
    unseen = (1 - p_zero * (cells - 1) / (cells - 1 + reads)) / (cells + reads)
    return counts.withColumn("fhat", F.when(F.col("n") > 0, seen).otherwise(unseen))


def bin_probabilities(fhat: DataFrame, contigs: DataFrame, bin_size: int = 100, size: int = START_WINDOW) -> DataFrame:
    """(contig, bin, strand, fhat) for bins 0 .. length div ``bin_size`` - 1; the bins behind the last whole window repeat
    it; all sum to 1."""
    per = size // bin_size
    sized = contigs.select("contig", F.expr(f"length div {bin_size}").alias("n_bins"), F.expr(f"length div {size}").alias("n_windows")).filter("n_windows > 0")
    last = F.col("window") == F.col("n_windows") - 1
    end = F.when(last, F.col("n_bins")).otherwise((F.col("window") + 1) * per)
    bins = fhat.join(sized, "contig").select("contig", "strand", "fhat", F.explode(F.sequence(F.col("window") * per, end - 1)).alias("bin"))
    return bins.select("contig", "bin", "strand", (F.col("fhat") / bins.agg(F.sum("fhat")).scalar()).alias("fhat"))


def window_probabilities(fhat: DataFrame, contigs: DataFrame, bin_size: int = 100, size: int = START_WINDOW) -> DataFrame:
    """(contig, window, strand, n_windows, fhat): ``bin_probabilities`` by window, for joins that need no row for each bin: bin b
    has the window min(b div (``size`` / ``bin_size``), n_windows - 1)."""
    per = size // bin_size
    sized = contigs.select("contig", F.expr(f"length div {bin_size}").alias("n_bins"), F.expr(f"length div {size}").alias("n_windows")).filter("n_windows > 0")
    wide = F.when(F.col("window") == F.col("n_windows") - 1, F.col("n_bins") - F.col("window") * per).otherwise(per)
    placed = fhat.join(sized, "contig").withColumn("wide", wide)
    return placed.select("contig", "window", "strand", "n_windows", (F.col("fhat") / placed.agg(F.sum(F.col("fhat") * F.col("wide"))).scalar()).alias("fhat"))


def dirichlet_priors(counts: DataFrame) -> DataFrame:
    """(alpha, p_zero) by moments: alpha = (m - 1) / (var m^3) - 1 / m over the m cells' shares, p_zero the share of cells at zero."""
    reads = counts.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    shares = counts.select("n", (F.col("n") / reads).alias("x"))
    m = F.count("*")
    alpha = (m - 1) / (F.greatest(F.var_pop("x"), F.lit(1e-30)) * m * m * m) - 1 / m
    return shares.agg(F.greatest(alpha, F.lit(1e-30)).alias("alpha"), F.greatest(F.count_if(F.col("n") == 0) / m, F.lit(1e-30)).alias("p_zero"))
