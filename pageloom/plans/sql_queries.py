"""Queries driven by SQL texts: table functions by LATERAL, native operators as functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.bind import spread
from pageloom.plans import page_queries, table_functions


def sql_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of made pages by a table function."""
    table_functions.register(spark)
    return spark.sql("SELECT c_custkey, l.pos, l.href, l.text, l.type, l.domain, l.original_href FROM {pages}, LATERAL page_links_of(html, url) AS l", pages=page_queries._made(spark, sf_dir))


def sql_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table for each customer, with a header over two columns and a cell over two rows."""
    table_functions.register(spark)
    html = F.concat(F.lit("<table><tr><th>K<th colspan=2>"), "c_mktsegment", F.lit("<tr><td rowspan=2>"), "c_name", F.lit("<td>1<td>2<tr><td>"), F.col("c_nationkey").cast("string"), F.lit("<td> </table>"))
    made = spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", html.alias("html"))
    return spark.sql("SELECT c_custkey, c.row_idx, c.col_idx, c.is_header, c.text FROM {made}, LATERAL cells_of(html) AS c", made=made)


def sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of made pages by a table function, counted with their depths."""
    table_functions.register(spark)
    return spark.sql(
        """WITH l AS (SELECT c_custkey, count(*) AS n_lines, max(length(line)) AS longest FROM {pages}, LATERAL page_lines_of(html) GROUP BY c_custkey),
        d AS (SELECT c_custkey, max(depth) AS deepest, sum(n) AS n_elements FROM {pages}, LATERAL page_depths_of(html) GROUP BY c_custkey)
        SELECT c_custkey, n_lines, longest, deepest, n_elements FROM l JOIN d USING (c_custkey)""",
        pages=page_queries._made(spark, sf_dir),
    )


def sql_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native operators in a SQL text over the orders."""
    table_functions.register(spark)
    return spark.sql(
        """SELECT o_orderkey,
          detect_template(concat(CASE o_orderkey % 3 WHEN 0 THEN 'https://github.com/o/r' WHEN 1 THEN 'https://jobs.lever.co/' ELSE 'https://none.test/' END, o_orderkey)) AS template,
          safe_href(concat(CASE WHEN o_orderkey % 2 = 0 THEN ' java\\tscript:' ELSE ' /p/' END, o_orderkey)) AS href,
          iso_date(concat(date_format(o_orderdate, 'yyyy-MM-dd'), CASE WHEN o_orderkey % 2 = 0 THEN ' 23:30:00 UTC' ELSE '' END)) AS day,
          join_location(o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE ' ' END, o_orderstatus) AS place,
          is_remote(CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'on-site' WHEN 2 THEN 'hybrid' END) AS remote,
          array_join(tag_list(concat(o_orderpriority, ', ,', o_orderstatus)), '|') AS tags, array_join(text_tokens(concat('Running orders ', o_orderkey)), ' ') AS tokens,
          compare_at_price(CASE WHEN o_orderkey % 2 = 0 THEN '0.00' ELSE concat(o_orderkey, '.50') END) AS was,
          page_verdict('u', CASE WHEN o_orderkey % 5 = 0 THEN 'Just a moment...' ELSE 'Shop' END, o_orderpriority, '', CASE WHEN o_orderkey % 7 = 0 THEN 404 ELSE 200 END).success AS fine,
          round(page_similarity(array('a', o_orderstatus), map(1, 2), array('a'), map(1, 1)), 6) AS alike
        FROM {orders}""",
        orders=spark.read.parquet(f"{sf_dir}/orders.parquet"),
    )


QUERIES = {f.__name__: f for f in (sql_links, sql_cells, sql_lines, sql_native)}

SQL = {
    "sql_links": page_queries.SQL["lnk1_made_links"],
    "sql_cells": """
SELECT c_custkey, x.row_idx AS row_idx, x.col_idx AS col_idx, x.row_idx = 0 AS is_header, x.text AS text FROM (SELECT c_custkey, unnest([
  {'row_idx': 0, 'col_idx': 0, 'text': 'K'}, {'row_idx': 0, 'col_idx': 1, 'text': trim(c_mktsegment)}, {'row_idx': 0, 'col_idx': 2, 'text': trim(c_mktsegment)}, {'row_idx': 1, 'col_idx': 0, 'text': trim(c_name)}, {'row_idx': 1, 'col_idx': 1, 'text': '1'}, {'row_idx': 1, 'col_idx': 2, 'text': '2'},
  {'row_idx': 2, 'col_idx': 0, 'text': trim(c_name)}, {'row_idx': 2, 'col_idx': 1, 'text': c_nationkey::VARCHAR}, {'row_idx': 2, 'col_idx': 2, 'text': ''}]) AS x FROM customer)""",
    "sql_lines": f"""
WITH t AS ({page_queries.SQL["txt1_made_pages"]}), s AS ({page_queries.SQL["str1_made_pages"]})
SELECT c_custkey, len(string_split(text, chr(10))) AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::INT AS longest, len(string_split(depths, ' '))::INT AS deepest, list_sum(list_transform(string_split(depths, ' '), lambda x: x::BIGINT))::BIGINT AS n_elements
FROM t JOIN s USING (c_custkey)""",
    "sql_native": """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'github-repo' WHEN 1 THEN 'lever-postings' END AS template, CASE WHEN o_orderkey % 2 = 1 THEN '/p/' || o_orderkey END AS href,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T23:30:00.000Z' ELSE '' END AS day, trim(o_orderpriority) || ', ' || o_orderstatus AS place, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS remote,
  trim(o_orderpriority) || '|' || o_orderstatus AS tags, 'runn order ' || CASE WHEN length(o_orderkey::VARCHAR) > 4 THEN o_orderkey::VARCHAR ELSE o_orderkey::VARCHAR END AS tokens, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey || '.50' END AS was,
  o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS fine, 0.5::DOUBLE AS alike FROM orders""",
}
