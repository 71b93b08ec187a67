"""Queries of the general data problems (p1, p2, p4, p6) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.compaction import compact_to_scratch
from strandmill.operators.intervals import periods_and_gaps
from strandmill.operators.rejects import rejected_rows, valid_records
from strandmill.operators.skewed import key_figures
from strandmill.session import table
from strandmill.sources.fastq import last_copy, parse_files

HAS_TARGET = "tname is not null and tname <> '*'"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_rows(table(spark, d, "paf_lines"), keep=["line_no"])


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    records = valid_records(table(spark, d, "paf_lines"), keep=["line_no", "file_name"])
    return records.withColumn("beyond", F.array_join(F.array_sort(F.map_keys("beyond")), ","))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "alignments").filter(HAS_TARGET), "tname", "tstart", "tend")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    figures = key_figures(table(spark, d, "alignments").filter(HAS_TARGET), "tname", "qname", "line_no", "s1")
    return figures.select("tname", "n_rows", F.col("n_members").alias("n_reads"), F.col("best_order").alias("best_line"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    reads = last_copy(parse_files(table(spark, d, "fastq_files")))
    return compact_to_scratch(reads, "reads").select("read_id", "file_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p4_found, p6_found)}

# No record of the given files is broken but the last, so that lines can be counted off in fours here.
_RECORDS = r"""l AS (SELECT file_id, path, list_filter(regexp_split_to_array(content, '\r\n|\n|\r'), lambda x: trim(x) <> '') AS ls FROM fastq_files WHERE content IS NOT NULL),
r AS (SELECT file_id, path, ls, unnest(range(0, len(ls) // 4)) AS k FROM l),
q AS (SELECT file_id, path, substring(split_part(ls[4 * k + 1], ' ', 1), 2) AS read_id FROM r
      WHERE ls[4 * k + 1] LIKE '@%' AND ls[4 * k + 3] LIKE '+%' AND length(ls[4 * k + 2]) = length(ls[4 * k + 4]))"""
_HAS_TARGET = "tname IS NOT NULL AND tname <> '*'"
_FIELD = r'''(?:"(?:[^"]|"")*"|[^"\t]*)'''
_LINES = rf"""t AS (SELECT line_no, file_name, coalesce(regexp_replace(line, '^\s+|\s+$', '', 'g'), '') AS l FROM paf_lines),
f AS (SELECT line_no, file_name, regexp_full_match(l, '{_FIELD}(?:\t{_FIELD})*') AS well, list_transform(regexp_extract_all(chr(9) || l, '\t{_FIELD}'),
  lambda x: CASE WHEN x[2] = '"' THEN replace(substring(x, 3, length(x) - 3), '""', '"') ELSE substring(x, 2) END) AS p FROM t),
c AS (SELECT *, list_transform([2, 3, 4, 7, 8, 9, 10, 11, 12], lambda i: CASE WHEN regexp_full_match(p[i], '[0-9]+') THEN TRY_CAST(p[i] AS HUGEINT) END) AS n, p[13:] AS tags FROM f),
r AS (SELECT *, CASE WHEN NOT well THEN 'quoting'
  WHEN len(p) < 12 OR len(list_filter(tags, lambda x: NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9]:[AifZ]:'))) > 0 THEN 'columns'
  WHEN len(list_filter(n, lambda x: x IS NULL)) > 0 OR p[5] NOT IN ('+', '-') OR trim(p[1]) = '' OR trim(p[6]) = '' OR NOT (n[2] < n[3] AND n[3] <= n[1])
    OR NOT (n[5] < n[6] AND n[6] <= n[4]) OR n[7] > n[8] OR n[9] > 255
    OR len(list_filter(tags, lambda x: x[4] = 'i' AND NOT regexp_full_match(substring(x, 6), '[+-]?[0-9]+') OR x[4] = 'f' AND NOT regexp_full_match(substring(x, 6), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))) > 0
  THEN 'value' END AS reason FROM c)"""


def _tag(prefix: str) -> str:
    return f"substring(list_filter(tags, lambda x: x LIKE '{prefix}%')[1], 6)"


ORACLE = {
    "p1_found": f"WITH {_LINES} SELECT line_no, reason FROM r WHERE reason IS NOT NULL",
    "p1_records": f"""WITH {_LINES} SELECT line_no, file_name, p[1] AS qname, CAST(n[1] AS BIGINT) AS qlen, CAST(n[2] AS BIGINT) AS qstart, CAST(n[3] AS BIGINT) AS qend, p[5] AS strand, p[6] AS tname,
CAST(n[4] AS BIGINT) AS tlen, CAST(n[5] AS BIGINT) AS tstart, CAST(n[6] AS BIGINT) AS tend, CAST(n[7] AS BIGINT) AS num_matches, CAST(n[8] AS BIGINT) AS blen, CAST(n[9] AS BIGINT) AS mapq,
CAST(coalesce({_tag("AS:i:")}, '0') AS BIGINT) AS align_score, CAST(coalesce({_tag("s1:i:")}, '0') AS BIGINT) AS s1, coalesce({_tag("tp:A:")} = 'P', false) AS is_primary, {_tag("cg:Z:")} AS cigar, CAST(NULL AS VARCHAR) AS beyond
FROM r WHERE reason IS NULL""",
    "p6_found": f"""WITH {_RECORDS}
SELECT read_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY path DESC) AS rn FROM q) WHERE rn = 1""",
    "p2_found": f"""
WITH s AS (SELECT tname, CAST(tstart AS BIGINT) AS s, CAST(tend AS BIGINT) AS e FROM alignments
           WHERE {_HAS_TARGET} AND tstart < tend),
f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY tname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s
                     THEN 0 ELSE 1 END AS head FROM s),
g AS (SELECT *, sum(head) OVER (PARTITION BY tname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM f),
p AS (SELECT tname, no, min(s) AS pstart, max(e) AS pend FROM g GROUP BY tname, no)
SELECT tname, 'period' AS kind, pstart, pend FROM p
UNION ALL
SELECT tname, 'gap', pend, nxt FROM (SELECT tname, pend, lead(pstart) OVER (PARTITION BY tname ORDER BY pstart) AS nxt FROM p)
WHERE nxt IS NOT NULL""",
    "p4_found": f"""
SELECT tname, count(*) AS n_rows, count(DISTINCT qname) AS n_reads,
       (array_agg(line_no ORDER BY coalesce(s1, 0) DESC, line_no))[1] AS best_line
FROM alignments WHERE {_HAS_TARGET} GROUP BY tname""",
}
