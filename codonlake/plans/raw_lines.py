"""Queries on raw lines (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.plans.registry import query
from codonlake.session import read_table
from codonlake.sources import raw_lines

_READ = r"""
WITH heads AS (
  SELECT file_name, CASE WHEN lower(file_name) LIKE '%.tsv' THEN chr(9) ELSE ',' END AS sep,
         string_split(regexp_replace(replace(line, chr(65279), ''), '\r$', ''),
                      CASE WHEN lower(file_name) LIKE '%.tsv' THEN chr(9) ELSE ',' END) AS names
  FROM dev_lines WHERE line_no = 1
), bare AS (
  SELECT line_id, file_name, line_no, sep, len(names) AS k, list_position(names, 'sequence') AS si, list_position(names, 'label') AS li,
         CASE WHEN sep = ',' THEN l ELSE replace(replace(l, ',', chr(1)), chr(9), ',') END AS n
  FROM (SELECT line_id, file_name, line_no, regexp_replace(line, '\r$', '') AS l FROM dev_lines
        WHERE line_no <> 1 AND regexp_replace(line, '\s', '', 'g') <> '') JOIN heads USING (file_name)
), parts AS (
  SELECT *, regexp_full_match(n, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS legal,
         regexp_replace(n, '"([^"]|"")*"', 'Q', 'g') AS flat,
         regexp_extract_all(n, '("(?:[^"]|"")*"|[^",]*)(?:,|$)', 1) AS f
  FROM bare
), vals AS (
  SELECT *, len(flat) - len(replace(flat, ',', '')) + 1 AS c, f[si] AS s0, f[li] AS l0 FROM parts
), read AS (
  SELECT *, trim(replace(replace(CASE WHEN s0[1] = '"' THEN replace(s0[2:-2], '""', '"') ELSE s0 END, ',', CASE WHEN sep = ',' THEN ',' ELSE chr(9) END), chr(1), ','), ' ' || chr(9)) AS s,
         trim(replace(replace(CASE WHEN l0[1] = '"' THEN replace(l0[2:-2], '""', '"') ELSE l0 END, ',', CASE WHEN sep = ',' THEN ',' ELSE chr(9) END), chr(1), ','), ' ' || chr(9)) AS b
  FROM vals
), judged AS (
  SELECT *, CASE WHEN NOT legal THEN 'quoting' WHEN c <> k THEN 'column_count'
                 WHEN NOT regexp_full_match(s, '[ACGTNacgtn]+') THEN 'sequence_value'
                 WHEN b NOT IN ('0', '1') THEN 'label_value' END AS reason
  FROM read
)
"""


@query("p4_found", _READ + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return raw_lines.rejected(raw_lines.parse_lines(read_table(spark, sf, "dev_lines"))).select("line_id", "reason")


@query("p4_loaded", _READ + "SELECT line_id, file_name, line_no, s AS sequence, b::int AS label FROM judged WHERE reason IS NULL")
def p4_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return raw_lines.loaded(raw_lines.parse_lines(read_table(spark, sf, "dev_lines")))


@query("p4_edits")
def p4_edits(spark: SparkSession, sf: str) -> DataFrame:
    return raw_lines.rejected(raw_lines.parse_lines(read_table(spark, sf, "dev_lines")))


@query("p4_reasons", _READ + "SELECT file_name, reason, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL")
def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    found = raw_lines.rejected(raw_lines.parse_lines(read_table(spark, sf, "dev_lines")))
    return found.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n_lines"))
