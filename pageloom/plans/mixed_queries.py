"""A crawl of all kinds at once: bodies made of five tables, mixed, read by the registry in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.bind import spread
from pageloom.operators.registry import Registry
from pageloom.plans import record_queries as R

REGISTRY = Registry()

#: Boards' addresses by nation.
_BOARD_URLS = {
    "greenhouse-jobs": "https://boards.greenhouse.io/n{}", "lever-postings": "https://jobs.lever.co/n{}", "ashby-jobs": "https://jobs.ashbyhq.com/n{}", "workable-jobs": "https://apply.workable.com/n{}",
    "recruitee-offers": "https://n{}.recruitee.com/", "teamtailor-jobs": "https://n{}.teamtailor.com/jobs.rss",
}


def _url(pattern: str, key: Column) -> Column:
    before, after = pattern.split("{}")
    return F.concat(F.lit(before), key.cast("string"), F.lit(after))


def mixed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, body, url of shop products, packages, vehicles, posts, repositories, boards, and addresses that nothing reads."""
    part, k = spread(R._read(spark, sf_dir, "part")), F.col("p_partkey")
    vehicle = R._object(Results=F.array(F.create_map(F.lit("VIN"), k.cast("string"), F.lit("Make"), F.col("p_type"), F.lit("ErrorCode"), F.lit("0"))))
    package = F.struct(F.concat(F.lit("pkg"), k.cast("string")).alias("name"), R._object(latest="1.0.0").alias("dist-tags"), F.create_map(F.lit("1.0.0"), R._object(description=F.col("p_name"), license="MIT")).alias("versions"))
    of_part = [
        ("shop", F.to_json(R._object(product=R._product())), "https://s.test/products/h{}"),
        ("npm", F.when(k % 10 == 0, '{"error":"not_found"}').when(k % 10 == 1, "{'name':'single'}").otherwise(F.to_json(package)), "https://www.npmjs.com/package/pkg{}"),
        ("vin", F.when(k % 9 == 0, '{"Results":[],"message":"none"}').otherwise(F.to_json(vehicle)), "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/{}?format=json"),
        ("none", F.col("p_name"), "https://none.test/{}"),
        ("gone", F.col("p_name"), "https://x.com/a/status/{}"),
    ]
    # One scan of part: a row for each kind that is made of it.
    rows = part.select(k.alias("id"), F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), body.alias("body"), _url(at, k).alias("url")) for kind, body, at in of_part])).alias("r")).select("r.kind", "id", "r.body", "r.url")
    orders = spread(R._read(spark, sf_dir, "orders")).select(F.lit("post").alias("kind"), F.col("o_orderkey").alias("id"), R._posts().alias("body"), _url("https://www.reddit.com/r/URGENT/comments/{}", F.col("o_orderkey")).alias("url"))
    c = F.col("c_custkey")
    page = F.when(c % 4 == 0, F.concat(F.lit("<p>"), F.col("c_name"), F.lit("</p>"))).otherwise(F.concat(F.lit('<html><body><a class="topic-tag">'), F.lower("c_mktsegment"), F.lit('</a><article class="markdown-body"><p>'), F.col("c_name"), F.lit("</p></article></body></html>")))
    customers = spread(R._read(spark, sf_dir, "customer")).select(F.lit("repo").alias("kind"), c.alias("id"), page.alias("body"), _url("https://github.com/o/r{}", c).alias("url"))
    boards = [df.select(F.lit(name).alias("kind"), F.col("s_nationkey").cast("long").alias("id"), "body", _url(_BOARD_URLS[name], F.col("s_nationkey")).alias("url")) for name, df in R._boards(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, [rows, orders, customers, *boards])


def reg6_mixed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bodies through `run_all`: which template read each, what it found or why it didn't."""
    out = REGISTRY.run_all(mixed_bodies(spark, sf_dir))
    text = lambda path: F.try_variant_get("data", path, "string")
    return out.select("kind", "id", "template", "mode", "error", F.coalesce(text("$.title"), text("$.name"), text("$.make"), text("$.items[0].source")).alias("says"), F.try_variant_get("data", "$.count", "long").alias("n_items"), F.size(F.coalesce("warnings", F.array())).cast("long").alias("n_warnings"))


def reg7_mixed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of all boards among the mixed bodies, in their common shape, out of the same single pass."""
    out = REGISTRY.run_all(mixed_bodies(spark, sf_dir), params={"ashby-jobs": {"descriptions": True}}).where("mode = 'list' and error is null")
    job = "struct<id:string,title:string,url:string,location:string,department:string,remote:boolean,published_at:string,description:string,source:string>"
    items = out.select("id", F.explode(F.try_variant_get("data", "$.items", f"array<{job}>")).alias("job"))
    return items.select(F.col("id").alias("s_nationkey"), *[F.col(f"job.{c}").alias(c) for c in ("id", "title", "url", "location", "department", "remote", "published_at", "description", "source")])


QUERIES = {"reg6_mixed_bodies": reg6_mixed_bodies, "reg7_mixed_jobs": reg7_mixed_jobs}

_EMPTY = "matched the page but extracted no data — every field came back empty. The server likely answered with an interstitial (captcha, consent or bot wall) or the site changed its layout. This is an extraction failure, not a page with nothing on it."
_GONE = "x.com/robots.txt disallows every path for generic agents, and the keyless embed endpoints (cdn.syndication.twimg.com, publish.x.com/oembed) are disallowed by their own robots.txt, so a tweet cannot be read without X API credentials."

SQL = {
    "reg6_mixed_bodies": f"""
WITH p AS (
  SELECT 'shop' AS kind, p_partkey AS id, 'shopify-product' AS template, 'entity' AS mode, NULL AS error, p_name AS says, NULL::BIGINT AS n_items FROM part
  UNION ALL SELECT 'npm', p_partkey, 'npm-package', 'entity', CASE p_partkey % 10 WHEN 0 THEN 'No npm package at https://www.npmjs.com/package/pkg' || p_partkey || ': not_found.'
    WHEN 1 THEN 'Not an npm registry document: https://www.npmjs.com/package/pkg' || p_partkey || ' did not return JSON. This template reads the npm registry API.' END, 'pkg' || p_partkey, NULL FROM part
  UNION ALL SELECT 'vin', p_partkey, 'nhtsa-vin', 'entity', CASE WHEN p_partkey % 9 = 0 THEN 'Not a vPIC decode response: https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/' || p_partkey || '?format=json returned none. This template reads the NHTSA vPIC DecodeVinValues API.' END, trim(p_type), NULL FROM part
  UNION ALL SELECT 'none', p_partkey, NULL, NULL, 'No template reads https://none.test/' || p_partkey || '.', NULL, NULL FROM part
  UNION ALL SELECT 'gone', p_partkey, NULL, NULL, '{_GONE}', NULL, NULL FROM part
), o AS (
  SELECT 'post' AS kind, o_orderkey AS id, 'reddit-thread' AS template, 'entity' AS mode, CASE WHEN o_orderkey % 11 = 0 THEN 'No Reddit post at https://www.reddit.com/r/URGENT/comments/' || o_orderkey || ': the Arctic Shift archive has no record of it.'
    WHEN o_orderkey % 13 = 0 THEN 'Arctic Shift error: slow down' WHEN o_orderkey % 17 = 0 THEN 'Not an Arctic Shift document: https://www.reddit.com/r/URGENT/comments/' || o_orderkey || ' did not return JSON. This template reads the Arctic Shift archive, not reddit.com.' END AS error,
    o_orderpriority AS says, NULL::BIGINT AS n_items FROM orders
), c AS (
  SELECT 'repo' AS kind, c_custkey AS id, 'github-repo' AS template, 'entity' AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'Template "github-repo" {_EMPTY}' END AS error, 'r' || c_custkey AS says, NULL::BIGINT AS n_items FROM customer
), b AS (
  SELECT source AS kind, s_nationkey::BIGINT AS id, source AS template, 'list' AS mode, NULL AS error, source AS says, count(*) AS n_items
  FROM supplier, (SELECT unnest(['greenhouse-jobs', 'lever-postings', 'ashby-jobs', 'workable-jobs', 'recruitee-offers', 'teamtailor-jobs']) AS source) GROUP BY source, s_nationkey
), a AS (SELECT * FROM p UNION ALL SELECT * FROM o UNION ALL SELECT * FROM c UNION ALL SELECT * FROM b)
SELECT a.kind, id, template, mode, error, CASE WHEN error IS NULL THEN says END AS says, n_items, CASE WHEN a.kind = 'post' AND error IS NULL AND lower(regexp_replace(says, '[^A-Za-z]', '', 'g')) <> 'urgent' THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM a""",
    "reg7_mixed_jobs": " UNION ALL ".join(f"({R._board_sql(b)})" for b in _BOARD_URLS),
}
