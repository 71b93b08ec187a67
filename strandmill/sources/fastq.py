"""FASTQ text to reads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_END = re.compile(r"\r\n|\n|\r")


def complete_records(content: str | None) -> list[tuple[str, str, str, str]]:
    """(read_id, comment, sequence, quality) of each complete record, in the order of the file.

    Complete: a header with ``@`` and a name, a sequence, a ``+`` line and a quality of the same length, not empty.
    Blank lines and any of the three line ends may stand between lines; after a record that is cut off or broken,
    reading goes on at the next line that can be a header.
    """
    lines = [x for x in LINE_END.split(content or "") if x.strip()]
    out, i, n = [], 0, len(lines)
    while i + 3 < n:
        head, seq, plus, qual = lines[i : i + 4]
        if head[0] == "@" and plus[0] == "+" and len(seq) == len(qual):
            name, _, comment = head[1:].partition(" ")
            if name.strip():
                out.append((name.strip(), comment.strip(), seq, qual))
            i += 4
        else:
            i += 1
    return out


READ = pa.list_(pa.struct([("read_id", pa.string()), ("comment", pa.string()), ("seq", pa.string()), ("qual", pa.string())]))
READ_TYPE = "array<struct<read_id:string,comment:string,seq:string,qual:string>>"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in READ.value_type]
    for batch in batches:
        content = batch.column(batch.num_columns - 1).to_pylist()
        records = pa.array([[dict(zip(names, r)) for r in complete_records(c)] for c in content], READ)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], records], [*batch.schema.names[:-1], "records"])


def comment_columns(comment: Column) -> dict[str, Column]:
    """channel (null where ``ch=`` is missing), barcode (0 none, 99 unclassified, else its number) and source (last word)."""
    barcode = F.regexp_extract(comment, r"barcode=(unclassified|barcode[0-9]+)", 1)
    return {
        # The first word of a comment follows no white space and is not looked at.
        "channel": F.nullif(F.regexp_extract(comment, r"\sch=([0-9]+)", 1), F.lit("")).cast("int"),
        "barcode": F.when(barcode == "", 0).when(barcode == "unclassified", 99).otherwise(F.substring(barcode, 8, 10).cast("int")),
        "source": F.nullif(F.element_at(F.split(comment, " "), -1), F.lit("")),
    }


def parse_files(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id", "path")) -> DataFrame:
    """One row for each complete record of each file: ``keep``, ordinal, read_id, seq, qual, length, channel, barcode, source.

    Null, empty and blank contents give no rows.  A record that occurs twice comes out twice.
    """
    kinds = dict(files.dtypes)
    source = files.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{content}`").cast("string").alias("__content"))
    parsed = source.mapInArrow(_parse_batches, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], f"records {READ_TYPE}"]))
    flat = parsed.select(*keep, F.posexplode("records").alias("ordinal", "r"))
    return flat.select(*keep, "ordinal", "r.read_id", "r.seq", "r.qual", F.length("r.seq").alias("length"), *[c.alias(n) for n, c in comment_columns(F.col("r.comment")).items()])


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTQ files, plain or gzipped, in a folder tree; each is read whole by one task."""
    files = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    files = files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    return parse_files(files, keep=("path",))


def last_copy(records: DataFrame, by: str = "path") -> DataFrame:
    """Each read once: of its records, that of the last file by ``by``, and there the last one."""
    rest = [c for c in records.columns if c != "read_id"]
    best = records.groupBy("read_id").agg(F.max_by(F.struct(*rest), F.struct(by, "ordinal")).alias("r"))
    return best.select("read_id", "r.*")
