"""PAF text to alignment columns, without leaving the JVM (see ``operators.rejects`` for checked reading)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "num_matches", "blen", "mapq")
TEXT = {"qname", "strand", "tname"}


def paf_columns(line: Column) -> list[Column]:
    """The twelve core columns, and align_score (``AS``, else 0), s1 (else 0), is_primary (``tp`` is P), cigar (``cg``).

    Names stay strings, also those of digits; numbers that are none are null; of a tag that occurs twice the first counts.
    """
    parts = F.split(line, "\t")
    core = [parts[i] if n in TEXT else parts[i].try_cast("int") for i, n in enumerate(CORE)]

    def tag(prefix: str) -> Column:
        found = F.filter(F.slice(parts, 13, F.greatest(F.size(parts) - 12, F.lit(0))), lambda t: F.startswith(t, F.lit(prefix)))
        return F.substring(F.get(found, F.lit(0)), len(prefix) + 1, 2**31 - 1)

    return [
        *[col.alias(n) for col, n in zip(core, CORE)],
        F.coalesce(tag("AS:i:").try_cast("int"), F.lit(0)).alias("align_score"),
        F.coalesce(tag("s1:i:").try_cast("int"), F.lit(0)).alias("s1"),
        F.coalesce(tag("tp:A:") == "P", F.lit(False)).alias("is_primary"),
        tag("cg:Z:").alias("cigar"),
    ]


def read_paf(spark: SparkSession, paths: str | list[str], min_len: int = 1) -> DataFrame:
    """Primary records of at least ``min_len`` aligned bases of PAF files; lines with fewer than 12 columns are left out."""
    lines = spark.read.text(paths).filter(F.size(F.split("value", "\t")) >= 12)
    return lines.select(*paf_columns(F.col("value"))).filter((F.col("blen") >= min_len) & F.col("is_primary"))


def paf_line(core: tuple[str, ...] = CORE) -> Column:
    """A record as a line; a null mapq is 255 (missing), other null numbers are 0 and null texts ``*``, so that no field is lost."""
    null = {"mapq": "255", "qname": "*", "tname": "*", "strand": "*"}
    return F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit(null.get(x, "0"))) for x in core], F.concat(F.lit("s1:i:"), F.col("s1")))
