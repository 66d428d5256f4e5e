"""Pages made of a table's rows, whose text, links and structure SQL can state: misnested tags, parts of tables that are left out, links of all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.bind import bind, spread
from pageloom.operators import dom, similar


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven shapes of markup in turn; names and texts are the customers'."""
    k, name, text = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        cat("<p><b>", name, "<p>", text),
        cat('<a href="/one">', name, '<div>x<a href="/two">', text, "</a></div>"),
        cat("<table>", name, "<tr><td>", text, "</table>"),
        cat("<p>1<b>", name, "<i>3</b>", text, "</i>5</p>"),
        cat("<table><tr><td><b>", name, "<td>", text, "</table>end"),
        cat("<ul><li>", name, "<ul><li>", text, "</ul><li>z</ul>"),
        cat('<base href="/b/"><a href="m?', name, '">in</a> <a href="https://other.example/">out</a><a href="#f">f</a><a href="mailto:a@b.c">m</a>'),
    ]
    html = F.coalesce(*[F.when(k % len(shapes) == i, s) for i, s in enumerate(shapes)])
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", html.alias("html"), cat("https://shop.example/c/", k.cast("string")).alias("url"))


def _read(spark: SparkSession, sf_dir: str, *keep: Column) -> DataFrame:
    return bind(_made(spark, sf_dir), p=dom.projections("html", "url")).select("c_custkey", *keep)


def txt1_made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, F.col("p.text").alias("text"))


def str1_made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, and how many elements stand at each depth, from html downwards."""
    depths = F.array_join(F.transform(F.array_sort(F.map_entries("p.depths")), lambda e: e["value"].cast("string")), " ")
    return _read(spark, sf_dir, F.array_join("p.tags", " ").alias("tags"), depths.alias("depths"))


def lnk1_made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, F.posexplode("p.links").alias("pos", "link"))
    return found.select("c_custkey", "pos", *[F.col(f"link.{c}").alias(c) for c in ("href", "text", "type", "domain", "original_href")])


def lnk2_made_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lnk1_made_links(spark, sf_dir).groupBy("type", "domain").agg(F.count(F.lit(1)).alias("n"))


def _structures(html: DataFrame, key: str) -> DataFrame:
    return bind(html, p=dom.projections("html", "url")).select(F.col(key).alias("page_id"), "p.tags", "p.depths")


def str2_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages have each page's structure, and how many others one that is similar by 0.9 or more."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", "url")
    return similar.similar_pages(_structures(pages, "page_id")).select("page_id", "n_equal", "n_links")


def str2_made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages made of parts, whose structures SQL can state."""
    k = F.col("p_partkey")
    html = F.concat(F.expr("repeat('<p>x</p>', p_size)"), F.lit("<div>"), F.expr("repeat('<span>y</span>', cast(p_partkey % 7 as int))"), F.lit("</div>"), F.when(k % 3 == 0, "<hr>").otherwise(""))
    pages = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", html.alias("html"), F.lit("https://a.test/").alias("url"))
    return similar.similar_pages(_structures(pages, "p_partkey")).select("page_id", "n_equal", "n_links")


QUERIES = {f.__name__: f for f in (txt1_made_pages, str1_made_pages, lnk1_made_links, lnk2_made_types, str2_page_links, str2_made_links)}

_LINKS = """
WITH l AS (
  SELECT c_custkey, unnest(CASE c_custkey % 7
    WHEN 1 THEN [{'pos': 0, 'href': 'https://shop.example/one', 'text': c_name || 'x', 'type': 'internal', 'domain': 'shop.example', 'original_href': '/one'}, {'pos': 1, 'href': 'https://shop.example/two', 'text': c_mktsegment, 'type': 'internal', 'domain': 'shop.example', 'original_href': '/two'}]
    WHEN 6 THEN [{'pos': 0, 'href': 'https://shop.example/b/m?' || c_name, 'text': 'in', 'type': 'internal', 'domain': 'shop.example', 'original_href': 'm?' || c_name}, {'pos': 1, 'href': 'https://other.example/', 'text': 'out', 'type': 'external', 'domain': 'other.example', 'original_href': 'https://other.example/'},
      {'pos': 2, 'href': 'mailto:a@b.c', 'text': 'm', 'type': 'other', 'domain': NULL, 'original_href': 'mailto:a@b.c'}] ELSE [] END) AS x FROM customer
), m AS (
  -- The first link goes on inside the division, as a second element with the same address, which counts once.
  SELECT c_custkey, x.pos AS pos, x.href AS href, CASE WHEN c_custkey % 7 = 1 AND x.pos = 0 THEN left(x.text, length(x.text) - 1) ELSE x.text END AS text, x.type AS type, x.domain AS domain, x.original_href AS original_href FROM l
)
"""
SQL = {
    "txt1_made_pages": r"""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_name || chr(10) || c_mktsegment WHEN 1 THEN c_name || chr(10) || 'x' || chr(10) || c_mktsegment WHEN 2 THEN c_name || chr(10) || c_mktsegment WHEN 3 THEN '1' || c_name || '3' || c_mktsegment || '5'
  WHEN 4 THEN c_name || ' ' || c_mktsegment || chr(10) || 'end' WHEN 5 THEN c_name || chr(10) || c_mktsegment || chr(10) || 'z' ELSE 'in out' || chr(10) || 'f' || chr(10) || 'm' END AS text FROM customer""",
    "str1_made_pages": """
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'b body head html p' WHEN 1 THEN 'a body div head html' WHEN 2 THEN 'body head html table tbody td tr' WHEN 3 THEN 'b body head html i p' WHEN 4 THEN 'b body head html table tbody td tr' WHEN 5 THEN 'body head html li ul' ELSE 'a base body head html' END AS tags,
  CASE c_custkey % 7 WHEN 0 THEN '1 2 2 2' WHEN 1 THEN '1 2 2 2' WHEN 2 THEN '1 2 1 1 1 1' WHEN 3 THEN '1 2 1 2 1' WHEN 4 THEN '1 2 1 1 1 2 1' WHEN 5 THEN '1 2 1 2 1 1' ELSE '1 2 5' END AS depths FROM customer""",
    "lnk1_made_links": _LINKS + "SELECT c_custkey, pos, href, text, type, domain, original_href FROM m",
    "str2_made_links": """
WITH p AS (SELECT p_partkey, p_size + 1 + (p_partkey % 3 = 0)::INT AS d3, p_partkey % 7 AS d4, (p_partkey % 7 > 0)::INT AS span, (p_partkey % 3 = 0)::INT AS hr FROM part),
c AS (SELECT d3, d4, span, hr, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT a.d3, a.d4, a.span, a.hr, sum(b.n) AS n_links FROM c a JOIN c b ON (a.d3, a.d4, a.span, a.hr) <> (b.d3, b.d4, b.span, b.hr)
  AND ((5 + a.span * b.span + a.hr * b.hr) / (5.0 + greatest(a.span, b.span) + greatest(a.hr, b.hr)) + (3 + least(a.d3, b.d3) + least(a.d4, b.d4)) / (3.0 + greatest(a.d3, b.d3) + greatest(a.d4, b.d4))) / 2 >= 0.9 - 1e-12 GROUP BY ALL)
SELECT p_partkey AS page_id, c.n - 1 AS n_equal, coalesce(n_links, 0)::BIGINT AS n_links FROM p JOIN c USING (d3, d4, span, hr) LEFT JOIN l USING (d3, d4, span, hr)""",
    "lnk2_made_types": _LINKS + "SELECT type, domain, count(*) AS n FROM m GROUP BY type, domain",
}
