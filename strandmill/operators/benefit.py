"""From scores in bins to the benefit of reading on, the threshold and the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.model import ANCHOR, BIN, BUCKET, DEFAULT_CCL


def dense_bins(totals: DataFrame, lengths: DataFrame, by: list[str], default: float = 0.0, size: int = BIN) -> DataFrame:
    """(``by``, bin, total) for every bin 0 .. length div ``size``; bins without a row get ``default``."""
    spine = lengths.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"cast(length div {size} as bigint)"))).alias("bin"))
    return spine.join(totals, [*by, "bin"], "left").withColumn("total", F.coalesce("total", F.lit(default)))


def _sliding(prefix: str, by: list[str], width: int, total: str) -> tuple[Column, Column]:
    """Sums of ``width`` bins from here on, and up to here, from running sums: ``prefix`` is the sum up to and with a bin."""
    w = Window.partitionBy(*by).orderBy("bin")
    p, before = F.col(prefix), F.col(prefix) - F.col(total)
    ahead = F.coalesce(F.lead(prefix, width - 1).over(w), F.col("__all")) - before
    behind = p - F.coalesce(F.lag(prefix, width).over(w), F.lit(0.0))
    return ahead, behind


def additional_benefit(bins: DataFrame, by: list[str], ccl: tuple[int, ...] = DEFAULT_CCL, anchor: int = ANCHOR, size: int = BIN) -> DataFrame:
    """(``by``, bin, strand, smu, expected, additional) from (``by``, bin, total) without missing bins.

    ``smu`` is what the anchor covers, ``expected`` what a read covers on average: the ten parts of the length
    distribution weigh 0.95, 0.85 .. 0.05.  Strand 0 looks ahead, strand 1 back; at the ends frames are cut off.
    All widths come from one running sum, so the cost of a bin does not grow with the width.
    """
    w = Window.partitionBy(*by).orderBy("bin")
    run = bins.withColumn("__run", F.sum("total").over(w)).withColumn("__all", F.sum("total").over(Window.partitionBy(*by)))
    smu = _sliding("__run", by, anchor // size, "total")
    expected = [F.lit(0.0), F.lit(0.0)]
    for i, length in enumerate(ccl):
        if length // size:
            for s, part in enumerate(_sliding("__run", by, length // size, "total")):
                expected[s] = expected[s] + part * (0.95 - 0.1 * i)
    both = [F.struct(F.lit(s).alias("strand"), smu[s].alias("smu"), expected[s].alias("expected")) for s in (0, 1)]
    out = run.select(*by, "bin", *[b.alias(f"__{s}") for s, b in enumerate(both)])
    out = out.select(*by, "bin", F.explode(F.array("__0", "__1")).alias("x")).select(*by, "bin", "x.*")
    return out.withColumn("additional", F.greatest(F.col("expected") - F.col("smu"), F.lit(0.0)))


def benefit_exponents(cells: DataFrame, benefit: str, weight: str | None, peak: float | None = None) -> DataFrame:
    """(e, n, weight_sum, peak): cells of positive benefit by the distance of their binary exponent from that of the greatest.

    The greatest itself falls in with [1/4, 1/2).  ``weight`` null: each cell weighs 1.  ``peak`` is the greatest
    benefit, where it is known already.
    """
    positive = cells.filter(F.col(benefit) > 0)
    peak = positive.agg(F.max(benefit)).scalar() if peak is None else F.lit(peak)
    e = F.abs(F.floor(F.log2(F.col(benefit) / F.col("peak"))) + 1).cast("bigint")
    value = F.lit(1.0) if weight is None else F.col(weight)
    return positive.withColumn("peak", peak).groupBy(e.alias("e")).agg(F.count("*").alias("n"), F.sum(value).alias("weight_sum"), F.max("peak").alias("peak"))


def threshold_curve(exponents: DataFrame, base_benefit: float | Column, base_time: float, read_time: float | Column) -> DataFrame:
    """(e, bound, ratio, rn) with e rising: expected benefit by expected time if all bins up to e were accepted.

    There are at most some two thousand exponents, so this needs no partition.
    """
    w = Window.orderBy("e")
    bound = F.pow(F.lit(2.0), -F.col("e")) * F.col("peak")
    gained = F.sum(F.col("bound") * F.col("weight_sum")).over(w)
    spent = F.sum(F.col("weight_sum")).over(w) * read_time
    return exponents.withColumn("bound", bound).select("e", "bound", ((base_benefit + gained) / (base_time + spent)).alias("ratio"), F.row_number().over(w).alias("rn"))


def threshold(curve: DataFrame) -> DataFrame:
    """(bound): that of the exponent after the one of the highest ratio (the first of equals), or of the last."""
    best = curve.agg(F.max_by("rn", F.struct("ratio", -F.col("rn")))).scalar()
    return curve.filter(F.col("rn") <= best + 1).agg(F.max_by("bound", "rn").alias("bound"))


def accept_mask(cells: DataFrame, benefit: str, bound: Column) -> DataFrame:
    return cells.withColumn("accept", F.col(benefit) >= bound)


def distribute(mask: DataFrame, buckets: DataFrame, before: DataFrame | None = None, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """The mask where buckets are switched on; elsewhere what it was before (``by``, bin, strand, accept), at first all true."""
    per = BUCKET // BIN
    state = buckets.select(*by, "bucket", "on")
    joined = mask.withColumn("bucket", F.expr(f"bin div {per}")).join(state, [*by, "bucket"], "left")
    old = F.lit(True)
    if before is not None:
        joined = joined.join(before.select(*by, "bin", "strand", F.col("accept").alias("__old")), [*by, "bin", "strand"], "left")
        old = F.coalesce("__old", F.lit(True))
    accept = F.when(F.coalesce("on", F.lit(False)), F.col("accept")).otherwise(old)
    return joined.select(*by, "bin", "strand", accept.alias("accept"))


def low_coverage_score(chunk_sum: Column, lowcov: float = 10, size: int = BIN) -> Column:
    """Logistic score of the mean coverage of a chunk, at most 100: 1 / (exp(coverage - lowcov) + 1)."""
    return 1 / (F.exp(F.least(F.floor(chunk_sum / size), F.lit(100)) - lowcov) + 1)


def contig_ends(bins: DataFrame, by: list[str], limit: float = 50.0, size: int = BIN) -> DataFrame:
    """First and last chunk of a contig: where coverage is low and the end is not capped, the score is 1 and the end open.

    Needs (``by``, bin, total, score, cap_l, cap_r); adds ``open_end``.
    """
    last = F.max("bin").over(Window.partitionBy(*by))
    low = F.col("total") <= limit * size
    left = (F.col("bin") == 0) & low & ~F.coalesce("cap_l", F.lit(False))
    right = (F.col("bin") == last) & low & ~F.coalesce("cap_r", F.lit(False))
    out = bins.withColumn("open_end", F.struct(left.alias("left"), right.alias("right")))
    return out.withColumn("score", F.when(F.col("open_end.left") | F.col("open_end.right"), 1.0).otherwise(F.col("score")))


def padded_benefit(bins: DataFrame, by: list[str], ccl: tuple[int, ...] = DEFAULT_CCL, anchor: int = ANCHOR, size: int = BIN) -> DataFrame:
    """(``by``, bin, strand, smu_sum, benefit) of assembled contigs from (``by``, bin, score, open_l, open_r).

    The contig is lengthened by the longest part on both sides, with 1 where the end is open, else 0 (the very last bin
    stays 0).  Ahead, frames begin behind the bin; back, they end with it; frames that would leave the lengthened
    contig count 0.  The anchor sums are those of both directions in reading order.  Parts weigh 1.0, 0.9 .. 0.1.
    """
    widths = [x // size for x in ccl]
    pad, m = widths[-1], anchor // size
    sized = bins.groupBy(*by).agg(F.count("*").alias("__n"), F.bool_or("open_l").alias("__l"), F.bool_or("open_r").alias("__r"))
    spine = sized.select(*by, "__n", "__l", "__r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") + 2 * pad - 1)).alias("bin"))
    inner = bins.select(*by, (F.col("bin") + pad).alias("bin"), "score")
    full = F.col("__n") + 2 * pad
    value = F.coalesce(
        F.col("score"),
        F.when((F.col("bin") < pad) & F.col("__l"), 1.0).when((F.col("bin") >= F.col("__n") + pad) & (F.col("bin") < full - 1) & F.col("__r"), 1.0).otherwise(0.0),
    )
    long = spine.join(inner, [*by, "bin"], "left").withColumn("total", value).withColumn("__full", full)
    w = Window.partitionBy(*by).orderBy("bin")
    run = long.withColumn("__run", F.sum("total").over(w)).withColumn("__all", F.sum("total").over(Window.partitionBy(*by)))
    behind = _sliding("__run", by, m, "total")[1]
    # The second row of anchor sums is taken from the other end and not turned back.
    ahead = _sliding("__run", by, m, "total")[0]
    run = run.withColumn("__smu0", behind).withColumn("__ahead", ahead).withColumn("__mirror", F.col("__full") - 1 - F.col("bin"))
    mirrored = run.select(*by, F.col("__mirror").alias("bin"), F.col("__ahead").alias("__smu1"))
    fwd, rev, p = F.lit(0.0), F.lit(0.0), F.col("__run")
    for i, k in enumerate(widths):
        weight = 1.0 - 0.1 * i
        fwd = fwd + F.when(F.col("bin") <= F.col("__full") - k - 2, (F.lead("__run", k).over(w) - p) * weight).otherwise(0.0)
        rev = rev + F.when((F.col("bin") >= k) & (F.col("bin") <= F.col("__full") - 2), (p - F.coalesce(F.lag("__run", k).over(w), F.lit(0.0))) * weight).otherwise(0.0)
    out = run.withColumn("__f", fwd).withColumn("__v", rev).join(mirrored, [*by, "bin"])
    smu_sum = F.sum(F.col("__smu0") + F.col("__smu1")).over(Window.partitionBy(*by))
    both = F.array(F.struct(F.lit(0).alias("strand"), F.greatest(F.col("__f") - F.col("__smu0"), F.lit(0.0)).alias("benefit")), F.struct(F.lit(1).alias("strand"), F.greatest(F.col("__v") - F.col("__smu1"), F.lit(0.0)).alias("benefit")))
    out = out.withColumn("smu_sum", smu_sum).filter((F.col("bin") >= pad) & (F.col("bin") < F.col("__n") + pad))
    return out.select(*by, (F.col("bin") - pad).alias("bin"), "smu_sum", F.explode(both).alias("x")).select(*by, "bin", "smu_sum", "x.strand", "x.benefit")
