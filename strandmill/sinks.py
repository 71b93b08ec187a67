"""Published results: snapshots that readers find complete or not at all, sequences, links and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.decisions import decision_log


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, folder: str, version: int) -> str:
    """Write ``df`` as ``folder/v=<version>``; once written it is never changed, so a replay of a batch changes nothing."""
    spark, target = df.sparkSession, f"{folder}/v={version:010d}"
    fs, path = _fs(spark, target)
    if fs.exists(path):
        return target
    staging = f"{folder}/.staging-{version:010d}"
    df.write.mode("overwrite").parquet(staging)
    if not fs.rename(_fs(spark, staging)[1], path) and not fs.exists(path):
        raise OSError(f"{target} cannot be written")
    return target


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete snapshot (older than ``before``), or None."""
    found = [v for v in versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/v={found[-1]:010d}") if found else None


def fasta_text(sequences: DataFrame, name: str = "header", seq: str = "seq") -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(sequences: DataFrame, path: str, name: str = "header", seq: str = "seq") -> None:
    fasta_text(sequences, name, seq).write.mode("overwrite").text(path)


def write_links(lines: DataFrame, path: str, line: str = "line") -> None:
    """PAF lines, each once."""
    lines.select(F.col(line).alias("value")).distinct().write.mode("overwrite").text(path)


def append_decisions(log: DataFrame, path: str) -> None:
    """The 14 columns of ``decisions.decision_log``, tab-separated."""
    decision_log(log).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_dumps(reads: DataFrame, path: str) -> None:
    """Reads (condition, dump, read_id, seq) as FASTA folders by condition and dump; each id gets a suffix of its own."""
    mark = F.substring(F.md5(F.concat_ws(":", "condition", "dump", "read_id")), 1, 20)
    text = F.concat(F.lit(">"), F.col("read_id"), F.lit("."), mark, F.lit("\n"), F.col("seq"))
    reads.select("condition", "dump", text.alias("value")).write.mode("overwrite").partitionBy("condition", "dump").text(path)
