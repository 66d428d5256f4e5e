"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import urls, verdict
from pageloom.operators import dom, pii
from pageloom.plans import cases, made_queries, mixed_queries, page_queries, ranking_queries, record_queries, sql_queries


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are documents, as redacted text by lines with their link and tag counts."""
    p = dom.projections("html", "url")
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html", p.alias("p"))
    good = pages.where(verdict.verdict(F.col("url"), F.col("p.title"), F.col("p.text"), F.col("html"), F.lit(200))["success"])
    return good.select("page_id", "p.title", pii.redact_pii(F.col("p.text")).alias("r"), F.size("p.links").alias("n_links"), F.size("p.tags").alias("n_tags")).select("page_id", "title", "r.text", F.col("r.count").alias("n_redacted"), "n_links", "n_tags")


def txt1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", dom.projections("html", "url").alias("p"))
    return p.select("page_id", "p.title", "p.text", (F.size(F.split("p.text", "\n"))).alias("n_lines"))


def lnk1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", dom.projections("html", "url")["links"].alias("links"))
    return p.select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.*")


def lnk2_link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lnk1_links(spark, sf_dir).groupBy("type", "domain").agg(F.count(F.lit(1)).alias("n"))


def str1_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", dom.projections("html", "url").alias("p"))
    return p.select("page_id", F.array_join("p.tags", ",").alias("tags"), F.explode("p.depths").alias("depth", "n"))


def blk2_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made from customers: every vendor's marker, error statuses, error titles and plain pages occur."""
    k = F.col("c_custkey")
    marks = F.array(*[F.lit(m) for m in ("cf-chl-", 'action="/errors/validateCaptcha', "dd.captcha", "px-captcha", "errors.edgesuite.net", "_vercel/challenge", "window.gokuProps =", "The requested URL was rejected. Please consult with your administrator", "/_fs-ch-a1/", "", "", "")])
    titles = F.array(*[F.lit(t) for t in ("", "Just a moment...", "Not Found", "403 - Forbidden", "Shop", "Oops! no", "Access denied")])
    pages = _read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("https://x.test/"), k.cast("string")).alias("url"), F.element_at(titles, (k % 7 + 1).cast("int")).alias("title"), F.element_at(marks, (k % 12 + 1).cast("int")).alias("html"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "An error occurred").otherwise(F.col("c_name")).alias("text"), F.when(k % 11 == 0, 404).when(k % 11 == 1, 503).otherwise(200).alias("status"),
    )
    v = verdict.verdict(*[F.col(c) for c in ("url", "title", "text", "html", "status")])
    return pages.select("c_custkey", v.alias("v")).select("c_custkey", "v.success", "v.status", "v.error", F.col("v.blocked.vendor").alias("vendor"), F.col("v.blocked.evidence").alias("evidence"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _blk2_sql() -> str:
    """What each body must give follows from which marker, title, text and status it was made with; no pattern is asked."""
    short = ["a Cloudflare challenge script", None, "a DataDome captcha frame", "a PerimeterX / HUMAN challenge element", "an Akamai access-denied page", "a Vercel Security Checkpoint page", "an AWS WAF challenge interstitial", 'an F5 "Request Rejected" blocking page', "a Fastly client challenge script"]
    names = ["cloudflare", "amazon", "datadome", "perimeterx", "akamai", "vercel", "aws-waf", "f5", "fastly"]
    marked = [f"WHEN m = {i} THEN {{'vendor': '{n}', 'evidence': {_q(f'{e} on a ')} || length(text) || '-character page'}}" if e else f"WHEN m = {i} THEN {{'vendor': '{n}', 'evidence': 'the validateCaptcha form'}}" for i, (n, e) in enumerate(zip(names, short, strict=True))]
    titled = lambda i, n: f"WHEN t = {i} THEN {{'vendor': '{n}', 'evidence': 'title \"' || title || '\"'}}"
    case = " ".join([titled(1, "cloudflare"), *marked[:4], titled(6, "akamai"), *marked[4:]])
    retry = " — a soft block or an application error. Retry later, or with a longer wait_for if the site paints content after a placeholder."
    script = " — the page's script failed. Retry later, or with a longer wait_for if the site paints content after a placeholder."
    return f"""
WITH p AS (SELECT c_custkey, 'https://x.test/' || c_custkey AS url, c_custkey % 7 AS t, c_custkey % 12 AS m, c_custkey % 5 AS x,
  (['', 'Just a moment...', 'Not Found', '403 - Forbidden', 'Shop', 'Oops! no', 'Access denied'])[c_custkey % 7 + 1] AS title,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'An error occurred' ELSE c_name END AS text,
  CASE c_custkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status FROM customer),
b AS (SELECT *, CASE {case} END AS w FROM p),
e AS (SELECT *, CASE WHEN w IS NOT NULL THEN w.vendor || ' served a challenge page instead of the content (' || w.evidence || '); the stealth browser did not pass it.'
  WHEN status >= 400 THEN 'HTTP ' || status || ': ' || url || ' answered with an error page' || CASE WHEN title <> '' THEN ' titled "' || title || '"' ELSE '' END || ', not the resource; the content returned is that page. ' || CASE status WHEN 404 THEN 'The site says the URL does not exist — check the path.' ELSE 'Retry later; the server, not the page, failed.' END
  WHEN t = 0 AND x = 0 THEN 'The stealth browser reached ' || url || ' but the document rendered no title and no text after 0ms of extra wait (0 bytes of HTML). A JavaScript-rendered page needs a longer wait_for; an empty document means the server sent nothing to render.'
  WHEN t IN (2, 3, 5) THEN url || ' rendered an error page titled "' || title || '" (' || length(text) || ' characters of text) instead of the resource' || {_q(retry)}
  WHEN x = 1 THEN url || ' rendered an application error message ("' || text || '") under the title "' || title || '" instead of the resource' || {_q(script)} END AS error FROM b)
SELECT c_custkey, error IS NULL AS success, status, error, w.vendor AS vendor, w.evidence AS evidence FROM e
"""


_URLS = ["https://shop.test/products/mug", "https://shop.test/collections/all", "https://www.amazon.com/dp/B0", "https://github.com/a/b", "https://youtu.be/x1", "https://www.reddit.com/r/a/comments/1b2/", "https://news.ycombinator.com/", "https://www.producthunt.com/products/x", "https://stackoverflow.com/questions/1/x", "https://www.npmjs.com/package/x", "https://boards.greenhouse.io/a", "https://jobs.lever.co/a", "https://jobs.ashbyhq.com/a", "https://apply.workable.com/a", "https://a.recruitee.com/", "https://a.teamtailor.com/jobs", "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVin/1", "https://npiregistry.cms.hhs.gov/api/", "https://x.com/a/status/1", "http://none.test/"]


def reg3_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.element_at(F.array(*[F.lit(u) for u in _URLS]), (F.col("p_partkey") % len(_URLS) + 1).cast("int")), F.when(F.col("p_partkey") % 3 == 0, F.lit("?q=1")).otherwise(F.lit("")))
    return _read(spark, sf_dir, "part").select("p_partkey", made.alias("url")).select("p_partkey", "url", urls.detect(F.col("url")).alias("template"), urls.retired(F.col("url")).alias("retired"))


#: What reads each of _URLS, written by hand.
_READ_BY = ["shopify-product", "shopify-collection", "amazon-product", "github-repo", "youtube-video", "reddit-thread", "hacker-news-front-page", "producthunt-launch", "stackoverflow-question", "npm-package", "greenhouse-jobs", "lever-postings", "ashby-jobs", "workable-jobs", "recruitee-offers", "teamtailor-jobs", "nhtsa-vin", "npi-provider", None, None]


def _reg3_sql() -> str:
    named = ", ".join("NULL" if n is None else _q(n) for n in _READ_BY)
    return f"""WITH u AS (SELECT p_partkey, p_partkey % {len(_URLS)} AS i, ([{', '.join(map(_q, _URLS))}])[p_partkey % {len(_URLS)} + 1] || CASE WHEN p_partkey % 3 = 0 THEN '?q=1' ELSE '' END AS url FROM part)
SELECT p_partkey, url, ([{named}])[i + 1] AS template, CASE WHEN i = 18 THEN 'tweet' END AS retired FROM u"""


def url1_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    made = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" java\tscript:"), u)).when(F.col("page_id") % 4 == 1, F.concat(u, F.lit("/"))).otherwise(u)
    return _read(spark, sf_dir, "pages").select("page_id", made.alias("raw")).select("page_id", urls.safe_href(F.col("raw")).alias("href"), urls.dedupe_key(F.col("raw")).alias("key"))


def pii4_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "documents").select("doc_id", pii.redact_pii(F.col("text"), ["EMAIL"]).alias("r"))
    return r.select("doc_id", "r.text", F.col("r.count").cast("long").alias("n"))


def pii1_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "documents").select("doc_id", pii.redact_pii(F.col("text")).alias("r"))
    return r.select("doc_id", "r.text", F.col("r.count").alias("n"), *[F.coalesce(F.element_at("r.entities", e), F.lit(0)).alias(f"n_{e.lower()}") for e in pii.ENTITIES])


def pii9_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "documents").select(F.explode(pii.redact_pii(F.col("text"))["entities"]).alias("entity", "n"))
    return r.groupBy("entity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship, "txt1_page_text": txt1_page_text, "lnk1_links": lnk1_links, "lnk2_link_types": lnk2_link_types, "str1_structure": str1_structure,
    "blk2_verdict": blk2_verdict, "reg3_detect": reg3_detect, "url1_hrefs": url1_hrefs, "pii4_email": pii4_email, "pii1_redact": pii1_redact, "pii9_entity_counts": pii9_entity_counts,
}
SQL: dict[str, str] = {
    "blk2_verdict": _blk2_sql(),
    "reg3_detect": _reg3_sql(),
    "pii4_email": r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b', '<EMAIL>', 'g') AS text, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\b')) AS n FROM documents",
    "url1_hrefs": r"""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' java' || chr(9) || 'script:' || url WHEN 1 THEN url || '/' ELSE url END AS raw FROM pages),
c AS (SELECT *, trim(regexp_replace(raw, '[\x00-\x1f\x7f]', '', 'g')) AS v FROM r)
SELECT page_id, CASE WHEN v <> '' AND (NOT regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR regexp_matches(v, '^(?i)https?://')) THEN v END AS href,
CASE page_id % 4 WHEN 0 THEN 'javascript:' || regexp_extract(raw, 'script:([^#]*)', 1) ELSE regexp_replace(regexp_replace(raw, '#.*$', ''), '^([a-z][a-z0-9+.-]*://[^/?]*/[^?]*[^?])/(\?.*)?$', '\1\2') END AS key FROM c""",
}
QUERIES |= cases.QUERIES | record_queries.QUERIES | made_queries.QUERIES | mixed_queries.QUERIES | page_queries.QUERIES | ranking_queries.QUERIES | sql_queries.QUERIES
SQL |= cases.SQL | record_queries.SQL | made_queries.SQL | mixed_queries.SQL | page_queries.SQL | ranking_queries.SQL | sql_queries.SQL
