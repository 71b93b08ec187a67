"""Information that one more observation of a position is expected to give.

Error model ``phi`` (observed base by genotype) and ``priors`` (reference base by genotype) are small tables.  Scores are
made for each distinct pattern of counts, in Arrow batches, and joined to positions or stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.model import BIN, DELETION, DELETION_RATIO, FULL_DEPTH, MIN_POSITIVE, MISSED_DELETION, SUBSTITUTION, THETA
from strandmill.operators.coverage import bin_sums

DROP_MEAN, DROP_SHARE = 5, 8  # fixed values: mean depth above which positions drop out, and the share of it they reach
CAP = 990  # counts above it do not change a posterior


def genotypes(ploidy: int = 1, deletions: bool = True) -> list[str]:
    """Haploid: bases and the gap.  Diploid: pairs of bases, then each base with a gap, then two gaps."""
    if ploidy == 1:
        return list("ACGT-") if deletions else list("ACGT")
    pairs = ["".join(p) for p in combinations_with_replacement("ACGT", 2)]
    return [*pairs, *[f"{b}-" for b in "ACGT"], "--"] if deletions else pairs


def phi(ploidy: int = 1, deletions: bool = True) -> list[list[float]]:
    """P(observed | genotype), a row for each observed base (and the gap)."""
    s, d, m = SUBSTITUTION, DELETION, MISSED_DELETION
    right = 1 - s - d if deletions else 1 - s

    def one(seen: str, g: str) -> float:
        if g.strip("-") == "":
            return 1 - m if seen == "-" else m / 4
        gaps = g.count("-")
        if seen == "-":
            return (1 - m) / 2 + d / 2 if gaps else d
        copies = g.count(seen)
        if ploidy == 1:
            return right if copies else s / 3
        if gaps:
            return right / 2 + m / 8 if copies else s / 6 + m / 8
        return (s / 3, right / 2 + s / 6, right)[copies]

    return [[one(seen, g) for g in genotypes(ploidy, deletions)] for seen in ("ACGT-" if deletions else "ACGT")]


def priors(ploidy: int = 1, deletions: bool = True) -> list[list[float]]:
    """P(genotype | reference base).  Diploid rows do not sum to 1; posteriors are normalised all the same."""
    ratio = DELETION_RATIO if deletions else 0.0
    weights = [1 / i for i in range(1, 1001)]
    both = sum(w * (i / 1000) ** 2 for i, w in enumerate(weights, 1))
    one = sum(w * 2 * (1000 - i) * i / 1e6 for i, w in enumerate(weights, 1))
    p_both = both / (both + one)

    def entry(ref: str, g: str) -> float:
        copies, gaps = g.count(ref), g.count("-")
        if ploidy == 1:
            return 1 - THETA * (1 + ratio) if copies else THETA * ratio if gaps else THETA / 3
        if gaps == 2:
            return p_both * ratio * THETA
        if gaps:
            return (1 - p_both) * ratio * THETA
        return (p_both * THETA / 3, (1 - p_both) * THETA / 3, 1 - THETA * (1 + ratio))[copies]

    return [[entry(ref, g) for g in genotypes(ploidy, deletions)] for ref in "ACGT"]


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def pattern_scores(counts: np.ndarray, ref: np.ndarray, ploidy: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior by genotype, entropy, score) of rows of counts, in natural logarithms; ``ref`` numbers A, C, G and T."""
    deletions = counts.shape[1] == 5
    p, prior = np.array(phi(ploidy, deletions)), np.array(priors(ploidy, deletions))
    logs = np.log(prior)[ref] + np.minimum(counts, CAP) @ np.log(p)
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    posterior = weights / weights.sum(axis=1, keepdims=True)
    entropy = -_x_log_x(posterior).sum(axis=1)
    joint = posterior[:, None, :] * p[None, :, :]  # by observed base and genotype
    after = (_x_log_x(joint.sum(axis=2)) - _x_log_x(joint).sum(axis=2)).sum(axis=1)
    return posterior, entropy, entropy - after


def with_posterior(patterns: DataFrame, counts: list[str], ref: str, ploidy: int = 1) -> DataFrame:
    """Adds ``posterior`` (by genotype), ``entropy`` and ``score`` (see ``pattern_scores``).

    ``counts`` are the columns of A, C, G, T and, if there is a fifth, deletions; ``ref`` is the reference base; other
    letters than A, C, G, T are taken for A.  Null counts are 0.
    """
    row = F.greatest(F.instr(F.lit("ACGT"), F.upper(F.coalesce(F.col(ref), F.lit("A")))) - 1, F.lit(0))
    source = patterns.select("*", row.alias("__row"), *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(f"__{i}") for i, x in enumerate(counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.num_columns - len(counts) - 1
            table = np.stack([batch.column(kept + 1 + i).to_numpy() for i in range(len(counts))], axis=1)
            posterior, entropy, score = pattern_scores(table, batch.column(kept).to_numpy(), ploidy)
            ends = pa.array(np.arange(0, posterior.size + 1, posterior.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(posterior.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], lists, pa.array(entropy), pa.array(score)], [*batch.schema.names[:kept], "posterior", "entropy", "score"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in patterns.dtypes)
    return source.mapInArrow(run, f"{kinds}, posterior array<double>, entropy double, score double")


def position_scores(coverage: DataFrame, counts: list[str], ref: str, ploidy: int = 1) -> DataFrame:
    """``coverage`` with ``score`` and ``entropy``; positions at full depth get the least positive score.

    Scores are made once for each distinct pattern of counts and reference base and joined back.
    """
    total = sum((F.col(x) for x in counts), F.lit(0))
    patterns = coverage.filter(total < FULL_DEPTH).select(*counts, ref).distinct()
    scored = with_posterior(patterns, counts, ref, ploidy).drop("posterior")
    joined = coverage.join(scored, [*counts, ref], "left")
    return joined.withColumn("score", F.when(total >= FULL_DEPTH, F.lit(MIN_POSITIVE)).otherwise(F.col("score")))


def drop_out(scores: DataFrame, by: list[str], total: str = "total") -> DataFrame:
    """Positions far below the mean depth of their group have no score: with a mean over 5, totals up to int(mean / 8)."""
    means = scores.groupBy(*by).agg(F.avg(total).alias("__mean"))
    out = scores.join(means, by)
    low = (F.col("__mean") > DROP_MEAN) & (F.col(total) <= F.floor(F.col("__mean") / DROP_SHARE))
    return out.withColumn("score", F.when(low, 0.0).otherwise(F.col("score"))).drop("__mean")


#: Scores are summed in whole millionths, so that sums are exact in any order.
UNIT = 1e-6


def bin_scores(stretches: DataFrame, lengths: DataFrame, by: list[str], ploidy: int = 1, size: int = BIN) -> DataFrame:
    """(``by``, bin, total): the sum of the scores of all positions of each whole bin, in units of UNIT.

    ``stretches``: (``by``, s, e, bases, dels), ``lengths``: (``by``, length).  An aligned base counts as the reference's (the
    score is the same for each of the four).  Positions without any have the score of no observation.  Positions far
    below the mean depth of their target have none (see ``drop_out``).
    """
    # All patterns below full depth, less than FULL_DEPTH squared: small enough to broadcast, whatever the input.
    pairs = np.array([(a, d) for a in range(FULL_DEPTH) for d in range(FULL_DEPTH - a)], float)
    counts = np.zeros((len(pairs), 5))
    counts[:, [0, 4]] = pairs
    scores = pattern_scores(counts, np.zeros(len(pairs), int), ploidy)[2].tolist()
    grid = stretches.sparkSession.createDataFrame([(int(a), int(d), x) for (a, d), x in zip(pairs.tolist(), scores)], "a bigint, d bigint, score double")
    scored = stretches.select(*by, "s", "e", F.col("bases").alias("a"), F.col("dels").alias("d")).join(F.broadcast(grid), ["a", "d"], "left")
    scored = scored.withColumn("score", F.when(F.col("a") + F.col("d") >= FULL_DEPTH, F.lit(MIN_POSITIVE)).otherwise(F.col("score")))
    means = stretches.groupBy(*by).agg(F.sum((F.col("bases") + F.col("dels")) * (F.col("e") - F.col("s"))).alias("n"))
    means = lengths.join(means, by, "left").select(*by, (F.coalesce("n", F.lit(0)) / F.col("length")).alias("mean"))
    unseen = F.when(F.col("mean") > DROP_MEAN, 0.0).otherwise(F.lit(scores[0]))
    low = (F.col("mean") > DROP_MEAN) & (F.col("a") + F.col("d") <= F.floor(F.col("mean") / DROP_SHARE))
    extra = scored.join(means, by).withColumn("more", F.when(low, 0.0).otherwise(F.col("score")) - unseen)
    sums = bin_sums(extra, by, "more", size)
    spine = lengths.join(means, by).filter(F.col("length") >= size)
    spine = spine.select(*by, (unseen * size).alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"cast(length div {size} as bigint) - 1"))).alias("bin"))
    total = F.round((F.col("all") + F.coalesce("total", F.lit(0.0))) / UNIT)
    return spine.join(sums, [*by, "bin"], "left").select(*by, "bin", total.alias("total"))
