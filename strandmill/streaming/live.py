"""The live run: micro-batches of mappings update depth, start counts, read lengths, buckets and the published strategy.

State lies in versioned tables, one version for each micro-batch.  A batch builds on the newest version before its
own number and never rewrites one, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.operators.coverage import sweep
from strandmill.operators.lengths import length_histogram
from strandmill.plans.update import by_barcode, measure, observed_lengths, plan_update, switched
from strandmill.sinks import latest, publish


def merge_counts(before: DataFrame | None, delta: DataFrame, by: list[str], value: str) -> DataFrame:
    both = delta if before is None else before.select(*by, value).unionByName(delta.select(*by, value))
    return both.groupBy(*by).agg(F.sum(value).alias(value))


class LiveRun:
    """Keeps under ``folder``, by version: ``depth`` (contig, s, e, bases, dels), ``starts`` (contig, window, strand, n), ``reads``
    (contig, n), ``lengths`` (length, n), ``bases`` (n), ``buckets`` (contig, bucket, mean_depth, on; once on they stay on), and the published
    ``strategy`` (contig, bin, strand, accept), with ``barcode`` in all but starts and lengths where ``barcodes`` are given."""

    def __init__(self, contigs: DataFrame, folder: str, barcodes: list[int] | None = None, ploidy: int = 1, bucket_threshold: float = 1.0, data_wait: float = 0.0):
        self.contigs, self.folder, self.barcodes = contigs.select("contig", "length"), folder, barcodes
        self.by = ["contig"] if barcodes is None else ["contig", "barcode"]
        self.ploidy, self.bucket_threshold, self.data_wait = ploidy, bucket_threshold, data_wait

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` (qname, qlen, tname, tstart, tend, strand, cigar, and barcode where barcodes are told apart).

        An empty batch publishes the state as it was.  No strategy is planned before ``data_wait`` million bases were read and a
        bucket is on: all is accepted.
        """
        spark = batch.sparkSession
        before = lambda name: latest(spark, f"{self.folder}/{name}", batch_id)
        put = lambda df, name: spark.read.parquet(publish(df, f"{self.folder}/{name}", batch_id))
        if "barcode" in self.by:
            batch = batch.withColumn("barcode", F.coalesce("barcode", F.lit(0)))
        known = batch.join(self.contigs.select(F.col("contig").alias("tname"), F.col("length").alias("__l")), "tname").filter("tstart < tend and tend <= __l").drop("__l")
        delta, counts = measure(known, self.contigs, self.by)
        old = before("depth")
        depth = put(delta if old is None else sweep(old.unionByName(delta), self.by, ["bases", "dels"]), "depth")
        starts = put(merge_counts(before("starts"), counts, ["contig", "window", "strand"], "n"), "starts")
        per = known.withColumnRenamed("tname", "contig").groupBy(*self.by).agg(F.count("*").alias("n"))
        put(merge_counts(before("reads"), per, self.by, "n"), "reads")
        once = batch.groupBy("qname").agg(F.max("qlen").alias("length"))
        histogram = put(merge_counts(before("lengths"), length_histogram(once), ["length"], "n"), "lengths")
        sized = self.contigs if self.barcodes is None else by_barcode(self.contigs, self.barcodes)
        buckets = put(switched(depth, sized, self.by, self.bucket_threshold, before("buckets")), "buckets")
        bases = merge_counts(before("bases"), once.select(F.lit(0).alias("all"), F.coalesce("length", F.lit(0)).cast("bigint").alias("n")), ["all"], "n")
        read = put(bases, "bases").agg(F.sum("n")).first()[0] or 0
        if read < self.data_wait * 1e6 or buckets.filter("on").isEmpty():
            if before("strategy") is not None:
                put(before("strategy"), "strategy")
            return
        planned = plan_update(
            depth, starts, sized, observed_lengths(histogram), tuple(self.by), self.ploidy, self.bucket_threshold, before("buckets"), before("strategy")
        )
        put(planned.strategy, "strategy")

    def state(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The newest ``name``; of ``strategy`` null until a bucket is on, which ``decisions.look_up`` takes for accepting all."""
        return latest(spark, f"{self.folder}/{name}")

    def start(self, mappings: DataFrame, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
        """``mappings`` is a stream; ``every`` None takes all there is and ends.  Files are read once: their names are in ``checkpoint``."""
        writer = mappings.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def new_files(spark: SparkSession, folder: str, schema, pattern: str = "*", files: int | None = None) -> DataFrame:
    """A stream of the parquet files that come into a folder tree."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def new_fastq(spark: SparkSession, folder: str, patterns: str = "*.{fq,fastq,fq.gz,fastq.gz}") -> DataFrame:
    """A stream of (path, content) of the FASTQ files that come into a folder tree; ``sources.fastq.parse_files`` reads them."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", patterns).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
