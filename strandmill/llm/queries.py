"""Queries of the problems p3, p5, p7, p8 and p9 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.abuse import THRESHOLD, excluded_pages, rates, score_pages
from strandmill.llm.components import components
from strandmill.llm.leaks import find_leaks
from strandmill.llm.tokenizer import decode_ids, default_vocabulary, encode_texts
from strandmill.llm.topn import top_n
from strandmill.session import table

REPEAT = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "num_matches", "blen", "mapq", "align_score", "s1", "is_primary", "cigar"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    def read(c: str):
        name = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
        return F.when(name.isin("*", ""), None).otherwise(name)

    pairs = table(spark, d, "read_overlaps").select(read("qname").alias("a"), read("tname").alias("b"))
    return components(pairs, "a", "b").withColumnRenamed("id", "read_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "alignments").filter("tname is not null and tname <> '*'")
    return top_n(rows, "qname", ["s1", "mapq"], "line_no", 3, REPEAT)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), default_vocabulary(spark))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return decode_ids(p7_ids(spark, d), default_vocabulary(spark))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "test_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return excluded_pages(score_pages(table(spark, d, "documents"))).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_pages(table(spark, d, "documents"), keep=("source",)).withColumn("excluded", F.col("peak") >= THRESHOLD)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(score_pages(table(spark, d, "documents"), keep=("source",)), "source")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p7_ids, p7_roundtrip, p8_found, p9_found, p9_scores, p9_rates)}

ORACLE = {
    "p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": r"""
WITH RECURSIVE r AS (
  SELECT nullif(nullif(regexp_replace(qname, '^\s+|\s+$', '', 'g'), '*'), '') AS a,
         nullif(nullif(regexp_replace(tname, '^\s+|\s+$', '', 'g'), '*'), '') AS b FROM read_overlaps),
n AS (SELECT a AS id FROM r WHERE a IS NOT NULL UNION SELECT b FROM r WHERE b IS NOT NULL),
e AS (SELECT a, b FROM r WHERE a <> b UNION SELECT b, a FROM r WHERE a <> b),
reach(id, seen) AS (SELECT id, id FROM n UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.seen = e.a)
SELECT id AS read_id, min(seen) AS group_id FROM reach GROUP BY id""",
    "p5_found": f"""
WITH u AS (SELECT {", ".join(REPEAT)}, min(line_no) AS line_no FROM alignments
           WHERE tname IS NOT NULL AND tname <> '*' AND qname IS NOT NULL GROUP BY ALL)
SELECT qname, rnk, line_no FROM (
  SELECT qname, line_no, row_number() OVER (PARTITION BY qname ORDER BY coalesce(s1, 0) DESC, coalesce(mapq, 0) DESC, line_no) AS rnk FROM u)
WHERE rnk <= 3""",
}
