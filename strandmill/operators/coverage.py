"""Depth of targets, and sums of it over bins and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.model import BIN, BUCKET

TILE = 1 << 16


def sweep(spans: DataFrame, by: list[str], measures: list[str], tile: int = TILE) -> DataFrame:
    """(``by``, s, e, ``measures``): stretches ``[s, e)`` over which the sums of all ``measures`` of the spans are the same, and
    not all 0.  ``spans``: (``by``, s, e, ``measures``).

    Spans are cut at tile borders, so that the sweep runs in windows of one tile of one target, of at most ``tile``
    rows, however hot the target; begins and ends at one place are summed before the shuffle.
    """
    valid = spans.select(*by, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), *measures).filter("s < e")
    cut = valid.select(*by, "s", "e", *measures, F.explode(F.sequence(F.expr(f"s div {tile}"), F.expr(f"(e - 1) div {tile}"))).alias("tile"))
    cut = cut.select(*by, "tile", F.greatest("s", F.col("tile") * tile).alias("s"), F.least("e", (F.col("tile") + 1) * tile).alias("e"), *measures)
    begin = F.struct(F.col("s").alias("at"), *measures)
    end = F.struct(F.col("e").alias("at"), *[(-F.col(m)).alias(m) for m in measures])
    steps = cut.select(*by, "tile", F.explode(F.array(begin, end)).alias("x"))
    steps = steps.groupBy(*by, "tile", F.col("x.at").alias("at")).agg(*[F.sum(f"x.{m}").alias(m) for m in measures])
    steps = steps.filter(" or ".join(f"{m} <> 0" for m in measures))
    w = Window.partitionBy(*by, "tile").orderBy("at")
    swept = steps.select(*by, F.col("at").alias("s"), F.lead("at").over(w).alias("e"), *[F.sum(m).over(w).alias(m) for m in measures])
    return swept.filter(" or ".join(f"{m} <> 0" for m in measures))


def depth_stretches(spans: DataFrame, by: list[str], start: str = "tstart", end: str = "tend", tile: int = TILE) -> DataFrame:
    """(``by``, s, e, depth): stretches of equal depth above 0 (see ``sweep``)."""
    return sweep(spans.select(*by, F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).alias("depth")), by, ["depth"], tile)


# Where a record's CIGAR deletes reference bases; it is written along the target.
_DELETED = """aggregate(zip_with(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1), (n, op) -> struct(try_cast(n as bigint) as n, op as op)),
struct(cast(tstart as bigint) as at, cast(array() as array<struct<s:bigint,e:bigint>>) as out), (acc, x) -> struct(
acc.at + if(x.op in ('M', 'D', 'N', '=', 'X'), x.n, 0) as at, if(x.op = 'D', concat(acc.out, array(struct(acc.at as s, acc.at + x.n as e))), acc.out) as out), acc -> acc.out)"""


def pattern_stretches(mappings: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """(``by``, s, e, bases, dels): stretches of equal numbers of aligned bases and of deletions.

    ``mappings``: (``by``, tstart, tend, cigar).  Without a CIGAR all of a span is aligned bases.
    """
    whole = mappings.select(*by, F.col("tstart").cast("bigint").alias("s"), F.col("tend").cast("bigint").alias("e"), F.lit(1).alias("bases"), F.lit(0).alias("dels"))
    holes = mappings.filter("contains(cigar, 'D')").select(*by, F.col("tend").cast("bigint").alias("tend"), F.explode(F.expr(_DELETED)).alias("x"))
    holes = holes.select(*by, F.col("x.s").alias("s"), F.least("x.e", "tend").alias("e"), F.lit(-1).alias("bases"), F.lit(1).alias("dels"))
    return sweep(whole.unionByName(holes), by, ["bases", "dels"], tile)


def bin_sums(stretches: DataFrame, by: list[str], value: str = "depth", size: int = BIN) -> DataFrame:
    """(``by``, bin, total): the sum of ``value`` over the positions of each bin that stretches ``[s, e)`` touch."""
    bins = stretches.select(*by, "s", "e", value, F.explode(F.sequence(F.expr(f"s div {size}"), F.expr(f"(e - 1) div {size}"))).alias("bin"))
    overlap = F.least("e", (F.col("bin") + 1) * size) - F.greatest("s", F.col("bin") * size)
    return bins.select(*by, "bin", (overlap * F.col(value)).alias("x")).groupBy(*by, "bin").agg(F.sum("x").alias("total"))


def bucket_means(stretches: DataFrame, lengths: DataFrame, by: list[str], size: int = BUCKET) -> DataFrame:
    """(``by``, bucket, mean_depth) for every bucket 0 .. length div ``size``; the partial last one takes the mean of the
    one before it (0 where there is none).  ``lengths`` holds (``by``, length)."""
    sums = bin_sums(stretches, by, size=size).withColumnRenamed("bin", "bucket")
    spine = lengths.select(*by, F.expr(f"length div {size}").alias("full")).select(*by, "full", F.explode(F.sequence(F.lit(0).cast("bigint"), "full")).alias("bucket"))
    source = spine.select(*by, "bucket", F.least("bucket", F.col("full") - 1).alias("__from"))
    joined = source.join(sums.withColumnRenamed("bucket", "__from"), [*by, "__from"], "left")
    return joined.select(*by, "bucket", (F.coalesce("total", F.lit(0)) / size).alias("mean_depth"))


def switch_buckets(means: DataFrame, threshold: float, before: DataFrame | None = None, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Adds ``on``: the mean depth reaches ``threshold``, or the bucket was on before (``before``: ``by``, bucket, on)."""
    now = F.col("mean_depth") >= threshold
    if before is None:
        return means.withColumn("on", now)
    old = before.select(*by, "bucket", F.col("on").alias("__was"))
    return means.join(old, [*by, "bucket"], "left").withColumn("on", now | F.coalesce("__was", F.lit(False))).drop("__was")


def repeat_limit(stretches: DataFrame, lengths: DataFrame, by: list[str], quantile: float = 0.999, floor: float = 3.0) -> DataFrame:
    """(limit_depth): the ``quantile`` (linear) of the depth of all positions, those of depth 0 among them, at least ``floor``.

    Works on a histogram of depths, whose size does not grow with the rows.
    """
    covered = stretches.groupBy("depth").agg(F.sum(F.col("e") - F.col("s")).alias("n"))
    seen = covered.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    zero = lengths.agg(F.sum("length").alias("length")).select(F.lit(0).cast("bigint").alias("depth"), (F.col("length") - seen).alias("n"))
    hist = covered.unionByName(zero).filter("n > 0")
    ranked = hist.withColumn("upto", F.sum("n").over(Window.orderBy("depth"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = (F.col("all") - 1) * quantile
    low = F.min(F.when(F.col("upto") > F.floor(at), F.col("depth")))
    high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("depth")))
    part = F.max(at - F.floor(at))
    return ranked.agg(F.greatest(low + (high - low) * part, F.lit(floor)).alias("limit_depth"))
