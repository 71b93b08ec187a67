"""FASTA and GFA text, and the channel table."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.model import MIN_CONTIG


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig, seq, length): names are the first word, sequences in capitals.  A record is split at ``>``, so that
    files are read in pieces; it is one row and has to fit into a task."""
    records = spark.read.option("lineSep", "\n>").text(paths)
    text = F.regexp_replace("value", r"^>|\r", "")
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s+", ""))
    out = records.filter(F.trim("value") != "").select(F.split(F.trim(head), r"\s+")[0].alias("contig"), seq.alias("seq"))
    return out.withColumn("length", F.length("seq"))


def reference_contigs(fasta: DataFrame, rejected: list[str] | None = None, min_len: int = MIN_CONTIG) -> DataFrame:
    """Contigs of at least ``min_len`` bases; the sequence of rejected ones is replaced by a stub."""
    bad = F.col("contig").isin(rejected) if rejected else F.lit(False)
    out = fasta.filter(F.col("length") >= min_len).withColumn("rejected", bad)
    return out.withColumn("seq", F.when(F.col("rejected"), "ACGT").otherwise(F.col("seq"))).withColumn("length", F.length("seq"))


def read_gfa(spark: SparkSession, path: str) -> DataFrame:
    """(unitig, seq, circular, cap_l, cap_r, atoms array<struct<pos, rev, name, n>>) of a GFA file's S, A and x lines.

    Every line names its unitig, so lines need no order.  ``n`` of an atom is the distance to the next, -1 for the last.
    A unitig is circular if its name ends in ``c``; an end is capped if its count in the x line is not 0.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).withColumn("kind", F.col("p")[0])
    segments = lines.filter("kind = 'S'").select(F.col("p")[1].alias("unitig"), F.col("p")[2].alias("seq"))
    atoms = lines.filter("kind = 'A'").select(
        F.col("p")[1].alias("unitig"), F.struct(F.col("p")[2].try_cast("int").alias("pos"), (F.col("p")[3] == "-").alias("rev"), F.col("p")[4].alias("name")).alias("a")
    )
    ordered = atoms.groupBy("unitig").agg(F.sort_array(F.collect_list("a")).alias("a"))
    following = F.expr("transform(a, (x, i) -> struct(x.pos as pos, x.rev as rev, x.name as name, coalesce(get(a, i + 1).pos - x.pos, -1) as n))")
    caps = lines.filter("kind = 'x'").select(
        F.col("p")[1].alias("unitig"), (F.get("p", F.lit(4)).try_cast("int") > 0).alias("cap_l"), (F.get("p", F.lit(5)).try_cast("int") > 0).alias("cap_r")
    )
    out = segments.join(ordered.select("unitig", following.alias("atoms")), "unitig", "left").join(caps, "unitig", "left")
    no = F.lit(False)
    return out.select("unitig", "seq", F.endswith("unitig", F.lit("c")).alias("circular"), F.coalesce("cap_l", no).alias("cap_l"), F.coalesce("cap_r", no).alias("cap_r"), "atoms")


def read_channels(path: str, condition: str) -> set[int]:
    """Channels of the condition of a channels.toml; empty if there is one condition only; ValueError if it is unknown."""
    conditions = tomllib.loads(Path(path).read_text())["conditions"]
    if len(conditions) == 1:
        return set()
    for c in conditions.values():
        if c.get("name") == condition:
            return set(c["channels"])
    raise ValueError(f"no condition is named {condition}")


def keep_channels(reads: DataFrame, channels: DataFrame) -> DataFrame:
    """Reads whose channel is in ``channels`` (channel); a null channel is dropped."""
    return reads.join(channels.select("channel").distinct(), "channel", "left_semi")


def check_reference(path: str) -> str:
    """``path`` if it is a FASTA file (.fa or .fasta, also compressed); else ``FileNotFoundError`` or ``ValueError``."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"there is no reference {path}")
    if not {".fa", ".fasta"} & set(Path(path).suffixes):
        raise ValueError("a reference is a .fa or .fasta file")
    return path


def check_regions(path: str, name: str) -> list[str]:
    """The region names of a decision TOML; ``ValueError`` if it has no array of regions or none is called ``name``."""
    regions = tomllib.loads(Path(path).read_text()).get("regions")
    if not isinstance(regions, list):
        raise ValueError("regions must be an array")
    names = [r["name"] for r in regions]
    if name not in names:
        raise ValueError(f"no region is named {name}")
    return names


def reload_if_newer(path: str, seen: float) -> tuple[dict | None, float]:
    """(content of a TOML file, its time) if it was written after ``seen``; (None, ``seen``) if not, or if it cannot be read yet."""
    try:
        at = Path(path).stat().st_mtime
        return (tomllib.loads(Path(path).read_text()), at) if at > seen else (None, seen)
    except (OSError, tomllib.TOMLDecodeError):
        return None, seen
