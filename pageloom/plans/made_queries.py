"""Pages, texts and JSON made of tables' rows, read back by the operators; the SQL computes the same from the rows.

Shapes of markup or of values take turns by key, so that each operator meets all of its forms with other data in every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import scalars as S
from pageloom.functions import urls, verdict
from pageloom.functions.bind import bind, spread
from pageloom.operators import embedded, highlights, pages, pii, registry, tables
from pageloom.sources import body, requests


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _turn(key: Column, *shapes: Column | str | None) -> Column:
    """The shape whose turn it is."""
    return F.coalesce(*[F.when(key % len(shapes) == i, s if isinstance(s, Column) else F.lit(s)) for i, s in enumerate(shapes) if s is not None])


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


# --- State that pages carry ------------------------------------------------------------------------------------------------------------


def emb_made_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carrier of each kind in turn; a row for each source that is found."""
    k, n = F.col("p_partkey"), F.col("p_name")
    shapes = [
        _cat('<script id="__NEXT_DATA__" type="application/json">{"k": ', k, ', "n": "', n, '"}</script>'),
        _cat('<script>window.__APP_STATE__ = {"k":', k, ',"u":undefined,"n":"', n, '"};</script>'),
        _cat("<script>__INITIAL_STATE__ = {k: ", k, ", 'n': '", n, "', l: [1,,", k, "]}</script>"),
        _cat('<script type="application/json" id="__NUXT_DATA__">[{"k":1,"n":2,"s":3},', k, ',"', n, '",["Set",2,2]]</script>'),
        _cat("<script>__sveltekit_1x = {};kit.start(app, el, {data: [null, {type: 'data', data: {k: ", k, ', n: "', n, '"}}]});</script>'),
        _cat('<div data-page="{&quot;component&quot;:&quot;', n, "&quot;,&quot;k&quot;:", k, '}"></div>'),
        _cat('<script>var meta = {"product":{"id":', k, '}};for (var attr in meta) {window.ShopifyAnalytics.meta[attr] = meta[attr];}ShopifyAnalytics.meta.currency = "USD";</script>'),
        _cat('<script>(window[Symbol.for("ApolloSSRDataTransport")] ??= []).push({"k":', k, ',"u":undefined})</script>'),
        _cat('<script>self.__next_f.push([1,"1:{\\"x\\":\\"$2\\",\\"k\\":', k, '}\\n"])</script><script>self.__next_f.push([1,"2:{\\"n\\":\\"', n, '\\"}\\n"])</script>'),
        _cat('<script type="application/json" id="z">{"k":', k, "}</script>"),
        _cat("<div id=q data-props='{\"k\":", k, ',"pad":"', F.lit("x" * 2100), "\"}'></div>"),
        _cat("<p>", n, "</p><script>window.__STATE__ = f(", k, ");</script>"),
    ]
    made = _rows(spark, sf_dir, "part").select("p_partkey", _turn(k, *shapes).alias("html"))
    found = bind(made, s=embedded.embedded_state(F.col("html"))).select("p_partkey", F.explode_outer("s.sources").alias("x"), F.array_join("s.warnings", ";").alias("warnings"))
    return found.select("p_partkey", "x.name", F.col("x.json").alias("json"), F.col("x.bytes").cast("long").alias("bytes"), "warnings")


_STATES = """
WITH s AS (
  SELECT p_partkey, CASE p_partkey % 12
    WHEN 0 THEN [('next_data', '{"k":' || p_partkey || ',"n":"' || p_name || '"}')]
    WHEN 1 THEN [('app_state', '{"k":' || p_partkey || ',"u":null,"n":"' || p_name || '"}')]
    WHEN 2 THEN [('initial_state', '{"k":' || p_partkey || ',"n":"' || p_name || '","l":[1,null,' || p_partkey || ']}')]
    WHEN 3 THEN [('nuxt_data', '{"k":' || p_partkey || ',"n":"' || p_name || '","s":["' || p_name || '","' || p_name || '"]}')]
    WHEN 4 THEN [('sveltekit_data', '[null,{"type":"data","data":{"k":' || p_partkey || ',"n":"' || p_name || '"}}]')]
    WHEN 5 THEN [('inertia_page', '{"component":"' || p_name || '","k":' || p_partkey || '}')]
    WHEN 6 THEN [('shopify', '{"meta":{"product":{"id":' || p_partkey || '},"currency":"USD"}}')]
    WHEN 7 THEN [('apollo_ssr_transport', '[{"k":' || p_partkey || ',"u":null}]')]
    WHEN 8 THEN [('next_f', '{"1":{"x":{"n":"' || p_name || '"},"k":' || p_partkey || '},"2":{"n":"' || p_name || '"}}'),
      ('data_rows', '[{"id":"1","bytes":' || (octet_length(encode(p_name)) + 19 + length(p_partkey::VARCHAR)) || ',"keys":["x","k"],"length":null},{"id":"2","bytes":' || (octet_length(encode(p_name)) + 8) || ',"keys":["n"],"length":null}]')]
    WHEN 9 THEN [('json_scripts', '[{"id":"z","data":{"k":' || p_partkey || '}}]')]
    WHEN 10 THEN [('json_attributes', '[{"tag":"div","attribute":"data-props","id":"q","data":{"k":' || p_partkey || ',"pad":"' || repeat('x', 2100) || '"}}]')]
    ELSE [(NULL, NULL)] END AS found FROM part
), u AS (SELECT p_partkey, unnest(found) AS x FROM s)
SELECT p_partkey, x[1] AS name, x[2] AS json, octet_length(encode(x[2]))::BIGINT AS bytes, CASE WHEN p_partkey % 12 = 11 THEN '__STATE__ is present but its value is not a JSON or JavaScript literal (it calls code or reads other variables); not parsed.' ELSE '' END AS warnings FROM u"""


# --- Records of pages ------------------------------------------------------------------------------------------------------------------


def _record(spark: SparkSession, sf_dir: str, html: Column, url: Column, read: Callable[[Column, Column], Column]) -> DataFrame:
    made = _rows(spark, sf_dir, "part").select("p_partkey", html.alias("html"), url.alias("url"))
    return bind(made, r=read(F.col("html"), F.col("url")))


def tpl3_made_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as texts for screen readers, without their separator, or in visible parts; of other products, of none; captchas."""
    k, cents = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    whole = F.col("p_size").cast("string")
    host = _turn(k, "www.amazon.com", "www.amazon.de", "www.amazon.se")
    price = _turn(
        k,
        _cat('<span class="a-price"><span class="a-offscreen">$', whole, ".", cents, "</span></span>"),
        _cat('<span class="a-price"><span class="a-offscreen">', whole, ",", cents, " €</span></span>"),
        _cat('<span class="a-price"><span class="a-offscreen">', whole, ",", cents, " kr</span></span>"),
        _cat('<span class="a-price"><span class="a-price-symbol">$</span><span class="a-price-whole">', whole, '.</span><span class="a-price-fraction">', cents, "</span></span>"),
        _cat('<div class="a-carousel"><span class="a-price"><span class="a-offscreen">$1.00</span></span></div><span class="a-price"><span class="a-price-whole">', whole, '</span><span class="a-price-fraction">', cents, '</span><span class="a-price-symbol">€</span></span>'),
        "",
    )
    byline = _turn(k, _cat("Brand: ", F.col("p_brand")), _cat("Visit the ", F.col("p_brand"), " Store"), _cat("by ", F.col("p_brand"), " (Author)"), F.col("p_brand"))
    page = _cat('<link rel="canonical" href="https://', host, '/dp/1"><span id="productTitle">\n ', F.col("p_name"), ' </span><div id="corePrice_feature_div">', price, '</div><a id="bylineInfo">', byline, '</a><span id="acrPopover" title="', k % 5, ".", k % 10, ' out of 5 stars"></span><span id="acrCustomerReviewText">', F.format_number(k * 7, 0), " ratings</span>")
    html = F.when(k % 10 == 9, '<form action="/errors/validateCaptcha">').otherwise(page)
    r = _record(spark, sf_dir, html, _cat("https://", host, "/dp/1"), pages.amazon_product)
    return r.select("p_partkey", F.substring("r.error", 1, 20).alias("error"), "r.data.title", "r.data.price", "r.data.currency", "r.data.rating", "r.data.review_count", "r.data.brand")


_TPL3 = """
WITH p AS (SELECT *, p_partkey % 10 = 9 AS bad, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS cents, p_partkey % 5 || '.' || p_partkey % 10 AS stars FROM part),
q AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN '$' || p_size || '.' || cents WHEN 1 THEN p_size || ',' || cents || ' €' WHEN 2 THEN p_size || ',' || cents || ' kr' WHEN 3 THEN '$' || p_size || '.' || cents WHEN 4 THEN p_size || CASE p_partkey % 3 WHEN 1 THEN ',' WHEN 2 THEN ',' ELSE '.' END || cents || '€' END AS price FROM p)
SELECT p_partkey, CASE WHEN bad THEN 'Amazon answered with' END AS error, CASE WHEN NOT bad THEN trim(p_name) END AS title, CASE WHEN NOT bad THEN price END AS price,
  CASE WHEN NOT bad THEN CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'SEK' WHEN 3 THEN 'USD' WHEN 4 THEN 'EUR' END END AS currency, CASE WHEN NOT bad THEN CASE WHEN stars::DOUBLE = 5 THEN 5.0 ELSE stars::DOUBLE END END AS rating,
  CASE WHEN NOT bad THEN p_partkey * 7 END AS review_count, CASE WHEN NOT bad THEN trim(p_brand) END AS brand FROM q"""


def tpl4_made_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    html = _turn(
        k,
        _cat('<script data-target="react-app.embeddedData">{"payload":{"sidebarAbout":{"description":" ', F.col("p_name"), ' ","stargazerCount":', k, ',"forksCount":"1,234","repo":{"license":{"spdxId":"NOASSERTION","name":"Own"}},"website":"javascript:x"}}}</script>'),
        _cat('<p class="f4 my-3"> ', F.col("p_name"), ' </p><span id="repo-stars-counter-star" title="', F.format_number(k, 0), '"></span><a class="topic-tag">', F.col("p_brand"), '</a><article class="markdown-body"><p> </p><p>', F.col("p_type"), " <b>x</b></p></article>"),
        "<p>nothing</p>",
    )
    r = _record(spark, sf_dir, html, _cat("https://github.com/o/r", k, ".git"), pages.github_repo)
    return r.select("p_partkey", "r.data.name", "r.data.description", "r.data.stars", "r.data.forks", "r.data.license", "r.data.homepage", F.array_join("r.data.topics", ",").alias("topics"), "r.data.readme_summary")


_TPL4 = """
SELECT p_partkey, CASE WHEN t < 2 THEN 'r' || p_partkey END AS name, CASE WHEN t < 2 THEN trim(p_name) END AS description, CASE WHEN t < 2 THEN p_partkey END AS stars, CASE WHEN t = 0 THEN 1234::BIGINT END AS forks, CASE WHEN t = 0 THEN 'Own' END AS license, NULL AS homepage,
  CASE WHEN t = 1 THEN trim(p_brand) ELSE '' END AS topics, CASE WHEN t = 1 THEN trim(p_type) || ' x' END AS readme_summary FROM (SELECT *, p_partkey % 3 AS t FROM part)"""


def tpl5_made_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    stat = lambda kind, n: _cat(f'<div itemprop="interactionStatistic"><meta itemprop="interactionType" content="https://schema.org/{kind}"><meta itemprop="userInteractionCount" content="', n, '"></div>')
    html = _cat('<meta name="title" content="', F.col("p_name"), '"><link rel="canonical" href="https://www.youtube.com/watch?v=v', k, '">', F.when(k % 2 == 0, stat("LikeAction", k * 3)).otherwise(""), stat("WatchAction", k), '<meta itemprop="datePublished" content="2024-01-02">')
    r = _record(spark, sf_dir, html, F.lit("u"), pages.youtube_video)
    return r.select("p_partkey", "r.data.title", "r.data.views", "r.data.likes", "r.data.published", "r.data.video_id")


_TPL5 = "SELECT p_partkey, p_name AS title, p_partkey AS views, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 3 END AS likes, '2024-01-02' AS published, 'v' || p_partkey AS video_id FROM part"


def tpl7_made_front_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A front page for each brand: its first parts by key are the stories, of which 30 count.

    A page lists twice as many as count, so that it is still the operator that leaves some out. The rows that come first are found in each
    task before they meet, since a brand has more parts than a page, or a task, can hold.
    """
    k = F.col("p_partkey")
    talk = _turn(k, "discuss", _cat(k, "&nbsp;comments"), "1&nbsp;comment")
    story = _cat('<tr class="athing" id="', k, '"><td><span class="titleline"><a href="item?id=', k, '">', F.col("p_name"), '</a></span></td></tr><tr><td class="subtext"><span class="score">', k, ' points</span> <a class="hnuser">u', k, '</a> <span class="age"><a href="item?id=1">1 hour ago</a></span> <a href="item?id=', k, '">', talk, '</a></td></tr><tr class="spacer"></tr>')
    place = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey", "p_name"))
    told = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey is not null and p_name is not null").select("p_brand", "p_partkey", "p_name", place.alias("place")).where(F.col("place") <= 60)
    made = told.groupBy("p_brand").agg(_cat("<table>", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", story.alias("s")))), lambda x: x["s"]), ""), "</table>").alias("html"))
    r = bind(made, r=pages.hacker_news(F.col("html"), F.lit("u"))).select("p_brand", F.posexplode("r.data.stories").alias("pos", "s"))
    return r.select("p_brand", "pos", "s.id", "s.title", "s.url", "s.score", "s.author", "s.comments")


_TPL7 = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT p_brand, pos::INT AS pos, p_partkey::VARCHAR AS id, trim(p_name) AS title, 'https://news.ycombinator.com/item?id=' || p_partkey AS url, p_partkey AS score, 'u' || p_partkey AS author, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN p_partkey ELSE 1 END AS comments FROM r WHERE pos < 30"""


def tpl8_made_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    state = _cat('<script>(window[Symbol.for("ApolloSSRDataTransport")] ??= []).push({"r":[{"__typename":"Product","name":"x"},{"__typename":"Product","name":"', F.col("p_name"), '","tagline":"', F.col("p_type"), '","followersCount":', k, ',"reviewsRating":4,"categories":[{"name":"', F.col("p_brand"), '"},{}]}]})</script>')
    html = _cat('<meta property="og:title" content="', F.col("p_name"), ' | Product Hunt"><a data-test="visit-website-button" href="https://x.test/?ref=producthunt&amp;k=', k, '">v</a>', F.when(k % 2 == 0, state).otherwise(""))
    r = _record(spark, sf_dir, html, _cat("https://www.producthunt.com/products/", k), pages.producthunt)
    return r.select("p_partkey", "r.data.name", "r.data.tagline", "r.data.website", "r.data.url", F.array_join("r.data.topics", ",").alias("topics"), "r.data.followers", "r.data.reviews_rating")


_TPL8 = """
SELECT p_partkey, p_name AS name, CASE WHEN t THEN p_type END AS tagline, 'https://x.test/?&k=' || p_partkey AS website, 'https://www.producthunt.com/products/' || p_partkey AS url, CASE WHEN t THEN p_brand END AS topics, CASE WHEN t THEN p_partkey END AS followers, CASE WHEN t THEN 4.0::DOUBLE END AS reviews_rating
FROM (SELECT *, p_partkey % 2 = 0 AS t FROM part)"""


def tpl19_made_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    offer = lambda price, state: _cat('{"@type":"Offer","price":"', price, '","priceCurrency":"EUR","availability":"https://schema.org/', state, '"}')
    one = _cat('{"@graph":[{"@type":"Product","name":"', F.col("p_name"), ' &amp; co","sku":"', k, '","brand":{"name":"', F.col("p_brand"), '"},"offers":', offer(_cat("1,", F.lpad((k % 1000).cast("string"), 3, "0"), ".50"), "InStock"), "}]}")
    group = _cat('{"@type":"ProductGroup","name":"', F.col("p_name"), '","variesBy":["https://schema.org/size"],"hasVariant":[{"@type":"Product","size":"S","offers":', offer(k, "SoldOut"), '},{"@type":"Product","sku":"b","offers":', offer(k + 1, F.when(k % 2 == 0, "InStock").otherwise("OutOfStock")), "}]}")
    html = F.when(k % 3 == 2, _cat("<p>", F.col("p_name"), "</p>")).otherwise(_cat('<script type="application/ld+json">', _turn(k % 3, one, group), "</script>"))
    made = _rows(spark, sf_dir, "part").select("p_partkey", html.alias("html"), _cat("https://a.test/products/p", k).alias("url"))
    r = bind(made, r=pages.json_ld_product(F.col("html"), F.col("url")))
    return r.select("p_partkey", "r.reason", "r.data.title", "r.data.vendor", "r.data.price_min", "r.data.price_max", "r.data.currency", "r.data.available", "r.data.handle", F.size("r.data.variants").cast("long").alias("n_variants"), F.array_join("r.data.options", ",").alias("options"))


_TPL19 = """
WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE p_partkey % 3 % 2 END AS t FROM part)
SELECT p_partkey, CASE WHEN t = 2 THEN 'https://a.test/products/p' || p_partkey || ' carries no schema.org Product JSON-LD' END AS reason, CASE t WHEN 0 THEN p_name || ' & co' WHEN 1 THEN p_name END AS title, CASE WHEN t = 0 THEN p_brand END AS vendor,
  CASE t WHEN 0 THEN printf('%.2f', 1000.5 + p_partkey % 1000) WHEN 1 THEN printf('%.2f', p_partkey::DOUBLE) END AS price_min, CASE t WHEN 0 THEN printf('%.2f', 1000.5 + p_partkey % 1000) WHEN 1 THEN printf('%.2f', p_partkey + 1.0::DOUBLE) END AS price_max, CASE WHEN t < 2 THEN 'EUR' END AS currency,
  CASE t WHEN 0 THEN true WHEN 1 THEN p_partkey % 2 = 0 END AS available, CASE WHEN t < 2 THEN 'p' || p_partkey END AS handle, CASE t WHEN 0 THEN 1::BIGINT WHEN 1 THEN 2::BIGINT END AS n_variants, CASE t WHEN 0 THEN '' WHEN 1 THEN 'size' END AS options FROM p"""


# --- Tables, addresses, JSON, texts ----------------------------------------------------------------------------------------------------


def tbl1_made_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    html = _turn(
        k,
        _cat("<table><tr><th>A</th><th>", b, "</th></tr><tr><td rowspan=2>", n, "</td><td>1</td></tr><tr><td>", k, "</td></tr></table>"),
        _cat("<table><tr><td>", n, "</td></tr><tr><td>2</td></tr></table>"),
        _cat("<table><tr><th colspan=2>", b, "</th></tr><tr><th>x</th><th>y</th></tr><tr><td>", n, "</td><td><p>", k, "</p>z</td></tr></table>"),
    )
    return _rows(spark, sf_dir, "part").select("p_partkey", tables.grid_tables(html).alias("grid"))


_TBL1 = """
SELECT p_partkey, '<html><head></head><body><table>' || CASE p_partkey % 3 WHEN 0 THEN '<thead><tr><th>A</th><th>' || p_brand || '</th></tr></thead><tbody><tr><td>' || p_name || '</td><td>1</td></tr><tr><td>' || p_name || '</td><td>' || p_partkey || '</td></tr></tbody>'
  WHEN 1 THEN '<tbody><tr><td>' || p_name || '</td></tr><tr><td>2</td></tr></tbody>'
  ELSE '<thead><tr><th>' || p_brand || ' x</th><th>' || p_brand || ' y</th></tr></thead><tbody><tr><td>' || p_name || '</td><td><span>' || p_partkey || '</span> z</td></tr></tbody>' END || '</table></body></html>' AS grid FROM part"""


def url2_made_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    html = _turn(k, _cat('<a href="x y', k, '">l</a><img src="/i', k, '.png"><a href="#f', k, '">f</a>'), _cat('<base href="/b', k, '/"><a href="../c?q=', k, '">l</a>'), _cat('<a href="http://[bad', k, '">l</a>'))
    return _rows(spark, sf_dir, "part").select("p_partkey", tables.absolute_urls(html, _cat("https://a.test/d", k, "/p")).alias("html"))


_URL2 = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<html><head></head><body><a href="https://a.test/d' || p_partkey || '/x%20y' || p_partkey || '">l</a><img src="https://a.test/i' || p_partkey || '.png"><a href="#f' || p_partkey || '">f</a></body></html>'
  WHEN 1 THEN '<html><head><base href="/b' || p_partkey || '/"></head><body><a href="https://a.test/c?q=' || p_partkey || '">l</a></body></html>' ELSE '<html><head></head><body><a href="http://[bad' || p_partkey || '">l</a></body></html>' END AS html FROM part"""


def jsn_made_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by path and by name, previews, objects of linked data."""
    k, n = F.col("p_partkey"), F.col("p_name")
    text = _cat('{"a":{"b":[', k, ',{"Id":"', n, '"}]},"id":', k, ',"@graph":[{"x":', k, '},[{"y":1}]]}')
    made = bind(_rows(spark, sf_dir, "part").select("p_partkey", text.alias("j")), s=embedded.json_select(F.col("j"), "a.b[1].Id"), f=embedded.find_json_paths(F.col("j"), "ID"), p=embedded.preview_json(F.col("j"), 12), g=embedded.flatten_ld(F.col("j")), m=embedded.json_select(F.col("j"), "a.c"))
    return made.select("p_partkey", "s.value", F.array_join(F.transform("f.matches", lambda m: F.concat_ws("=", m["path"], m["preview"])), ";").alias("found"), F.col("f.total").alias("total"), F.col("p").alias("preview"), F.size("g").cast("long").alias("n_objects"), F.get("g", F.lit(1)).alias("second"), F.col("m.error").alias("error"))


_JSN = """
SELECT p_partkey, '"' || p_name || '"' AS value, 'a.b.1.Id="' || p_name || '";id=' || p_partkey AS found, 2::BIGINT AS total, left('{"a":{"b":[' || p_partkey || ',{"Id":', 12) AS preview, 3::BIGINT AS n_objects, '{"x":' || p_partkey || '}' AS second,
  'Path "a.c" not found: "a" has no "c" (available keys: b)' AS error FROM part"""


def _check_digit(digits: Column) -> Column:
    """Luhn's digit after 15 digits."""
    value = F.transform(F.split(digits, ""), lambda x, i: F.when(i % 2 == 0, (x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10)).otherwise(x.cast("int")).cast("int"))
    return ((10 - F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("int")


def pii_made_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, cards with right and wrong check digits, account and phone numbers, secrets; tagged, masked, removed."""
    k = F.col("c_custkey")
    digits = _cat("4", F.lpad(k.cast("string"), 14, "1"))
    text = _turn(
        k,
        _cat("write a", k, "@port.example, please"),
        _cat("card ", digits, _check_digit(digits), " ok"),
        _cat("card ", digits, (_check_digit(digits) + 1) % 10, " no"),
        _cat("call +351 21 555 ", F.lpad((k % 10000).cast("string"), 4, "0")),
        _cat("IBAN GB82WEST12345698765432. Order ", k),
        _cat("password: p", k, "x and Bearer t", k),
        F.col("c_mktsegment"),
    )
    made = _rows(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))
    made = bind(made, tag=pii.redact_pii(F.col("t")), mask=pii.redact_pii(F.col("t"), replace_style="mask"), remove=pii.redact_pii(F.col("t"), ["EMAIL", "PHONE"], "remove"))
    return made.select("c_custkey", F.col("tag.text").alias("tagged"), F.col("tag.count").cast("long").alias("n"), F.col("mask.text").alias("masked"), F.col("remove.text").alias("removed"))


_PII = """
WITH d AS (SELECT *, '4' || lpad(c_custkey::VARCHAR, 14, '1') AS digits FROM customer),
c AS (SELECT *, (10 - list_sum(list_transform(string_split(digits, ''), lambda x, i: CASE WHEN i % 2 = 1 THEN (x::INT * 2) % 10 + (x::INT * 2) // 10 ELSE x::INT END)) % 10) % 10 AS digit, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS tail FROM d)
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'write <EMAIL>, please' WHEN 1 THEN 'card <FINANCIAL> ok' WHEN 2 THEN 'card ' || digits || (digit + 1) % 10 || ' no' WHEN 3 THEN 'call <PHONE>' WHEN 4 THEN 'IBAN <FINANCIAL>. Order ' || c_custkey WHEN 5 THEN 'password: <SECRET> and Bearer <SECRET>' ELSE c_mktsegment END AS tagged,
  CASE c_custkey % 7 WHEN 2 THEN 0 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 1 END::BIGINT AS n,
  CASE c_custkey % 7 WHEN 0 THEN 'write [REDACTED], please' WHEN 1 THEN 'card [REDACTED] ok' WHEN 2 THEN 'card ' || digits || (digit + 1) % 10 || ' no' WHEN 3 THEN 'call [REDACTED]' WHEN 4 THEN 'IBAN [REDACTED]. Order ' || c_custkey WHEN 5 THEN 'password: [REDACTED] and Bearer [REDACTED]' ELSE c_mktsegment END AS masked,
  CASE c_custkey % 7 WHEN 0 THEN 'write , please' WHEN 1 THEN 'card ' || digits || digit || ' ok' WHEN 2 THEN 'card ' || digits || (digit + 1) % 10 || ' no' WHEN 3 THEN 'call ' WHEN 4 THEN 'IBAN GB82WEST12345698765432. Order ' || c_custkey WHEN 5 THEN 'password: p' || c_custkey || 'x and Bearer t' || c_custkey ELSE c_mktsegment END AS removed FROM c"""


def hlt1_made_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading, two sentences (one with a false stop), a row of a table and a line of code for each customer."""
    k = F.col("c_custkey")
    text = _cat("# Head ", k, "\nDr. Ann met ", F.col("c_name"), ". It was ", k, "!\n\n| k |\n|---|\n| ", k, " |\n\n```\nrun ", k, "\n```")
    made = _rows(spark, sf_dir, "customer").select("c_custkey", F.explode(highlights.segment_units(text)).alias("u"))
    return made.select("c_custkey", "u.kind", "u.text", "u.offset", "u.length", "u.heading")


_HLT1 = """
WITH t AS (SELECT c_custkey, length(c_custkey::VARCHAR) AS d, length(c_name) AS n, c_name FROM customer),
u AS (SELECT c_custkey, unnest([
  {'kind': 'sentence', 'text': 'Dr. Ann met ' || c_name || '.', 'offset': 8 + d}, {'kind': 'sentence', 'text': 'It was ' || c_custkey || '!', 'offset': 22 + d + n}, {'kind': 'table_row', 'text': '| k |', 'offset': 32 + 2 * d + n},
  {'kind': 'table_row', 'text': '| ' || c_custkey || ' |', 'offset': 44 + 2 * d + n}, {'kind': 'code_block', 'text': 'run ' || c_custkey, 'offset': 54 + 3 * d + n}]) AS x FROM t)
SELECT c_custkey, x.kind AS kind, x.text AS text, x.offset::INT AS "offset", length(x.text)::INT AS length, 'Head ' || c_custkey AS heading FROM u"""


def src_made_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charsets of headers and meta elements, texts in them, addresses of requests, joined addresses, challenges, readers that are gone."""
    k, n = F.col("c_custkey"), F.col("c_name")
    kind = _turn(k, "text/html; charset=ISO-8859-1", "text/html", "")
    raw = _turn(k, F.concat(F.unhex(F.lit("E9")), F.encode(n, "utf-8")), F.encode(_cat('<meta charset="utf-16">', n), "utf-8"), F.concat(F.unhex(F.lit("C3A9FF")), F.encode(n, "utf-8")))
    made = _rows(spark, sf_dir, "customer").select("c_custkey", "c_name", kind.alias("kind"), raw.alias("raw")).withColumn("charset", body.detect_charset(F.col("kind"), F.col("raw")))
    template = _turn(k, "npm-package", "lever-postings", "github-repo", "ashby-jobs")
    page = _turn(k, _cat("https://www.npmjs.com/package/p", k, "/v/1"), _cat("https://jobs.lever.co/c", k, "/x"), _cat("https://github.com/o/r", k, "/tree/main"), _cat("https://jobs.ashbyhq.com/c", k))
    return made.select(
        "c_custkey", "charset", F.when(k % 3 != 1, body.decode_body(F.col("raw"), F.col("charset"))).alias("text"), requests.resolve_url(template, page).alias("request"),
        urls.absolute_url(_turn(k, _cat("/a b", k), _cat("?q=", k), _cat("../z", k), "http://exa mple/"), F.lit("https://u.test/x/y/w")).alias("address"),
        verdict.challenge(_turn(k, "Just a moment...", "Shop"), _turn(k, "", "px-captcha"), n)["vendor"].alias("vendor"), registry.retired_template(_turn(k, _cat("https://x.com/a/status/", k), "tweet", _cat("https://www.linkedin.com/in/", k), "https://a.test/"))["id"].alias("gone"),
    )


_SRC = """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'iso-8859-1' WHEN 1 THEN 'utf-16' ELSE 'utf-8' END AS charset, CASE c_custkey % 3 WHEN 0 THEN 'é' || c_name WHEN 2 THEN 'é' || chr(65533) || c_name END AS text,
  CASE c_custkey % 4 WHEN 0 THEN 'https://registry.npmjs.org/p' || c_custkey WHEN 1 THEN 'https://api.lever.co/v0/postings/c' || c_custkey || '?mode=json' WHEN 2 THEN 'https://github.com/o/r' || c_custkey ELSE 'https://api.ashbyhq.com/posting-api/job-board/c' || c_custkey END AS request,
  CASE c_custkey % 4 WHEN 0 THEN 'https://u.test/a%20b' || c_custkey WHEN 1 THEN 'https://u.test/x/y/w?q=' || c_custkey WHEN 2 THEN 'https://u.test/x/z' || c_custkey END AS address,
  CASE c_custkey % 2 WHEN 0 THEN 'cloudflare' ELSE 'perimeterx' END AS vendor, CASE c_custkey % 4 WHEN 0 THEN 'tweet' WHEN 1 THEN 'tweet' WHEN 2 THEN 'linkedin-profile' END AS gone FROM customer"""


def scl_made_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars over parts: numbers, dates, states, counts and names as sites write them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    opt = lambda c: c.cast("string")
    return _rows(spark, sf_dir, "part").select(
        "p_partkey", S.epoch_iso((k * 86400).cast("double")).alias("epoch"), opt(S.ld_number(_turn(k, _cat("1,", F.lpad((k % 1000).cast("string"), 3, "0"), ".25"), _cat(size, ",50 €"), _cat("USD ", k)))).alias("number"),
        S.availability(_turn(k, "https://schema.org/InStock", "SoldOut", "")).alias("available"), S.points(_cat(k, " points")).alias("points"), S.comments(_turn(k, "discuss", _cat(k, " comments"), "x")).alias("comments"), S.exact_count(_turn(k, F.format_number(k, 0), _cat(k, ".5k"))).alias("exact"),
        S.npi_name(_turn(k, F.col("p_brand"), "--", ""), F.lit("Dr."), F.lit("Ann"), F.lit(""), F.col("p_name"), F.lit(None).cast("string")).alias("provider"), S.npi_yes_no(_turn(k, "YES", "NO", "X")).alias("sole"), F.array_join(S.vin_error_codes(_turn(k, "0", _cat("1, ", k, ",0"))), ",").alias("codes"),
        S.full_size_image(_turn(k, _cat("https://i.test/I/", k, "._AC_SX300_.jpg"), _cat("https://i.test/transparent-pixel", k, ".gif"))).alias("image"), S.reddit_post_id(_cat("https://www.reddit.com/r/a/comments/", k, "/x")).alias("post"), S.github_repo_name(_cat("https://github.com/o/r", k, ".git")).alias("repo"),
        S.fixed2(F.col("p_retailprice")).alias("fixed"), S.tidy(_cat("  ", F.col("p_name"), " \n\t ", k)).alias("tidy"), S.query_int(_cat("https://a.test/?limit=", k, "&skip=x"), "limit").alias("page_limit"), highlights.is_reference(_cat("see [", k, "](#cite_ref-1)"), F.lit(None).cast("string")).alias("cited"), highlights.visible(_cat("see [the ", k, "](http://x.y/z_(", k, ")) now")).alias("visible"),
    )


_SCL = """
SELECT p_partkey, strftime(make_timestamp(p_partkey * 86400 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS epoch, CASE p_partkey % 3 WHEN 0 THEN (1000.25 + p_partkey % 1000)::DOUBLE WHEN 1 THEN (p_size + 0.5)::DOUBLE ELSE p_partkey::DOUBLE END::VARCHAR AS number, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available,
  p_partkey AS points, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN p_partkey END AS comments, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS exact, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 2 THEN 'Dr. Ann ' || p_name END AS provider, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sole,
  CASE p_partkey % 2 WHEN 0 THEN '' ELSE '1,' || p_partkey END AS codes, CASE p_partkey % 2 WHEN 0 THEN 'https://i.test/I/' || p_partkey || '.jpg' END AS image, p_partkey::VARCHAR AS post, 'r' || p_partkey AS repo, printf('%.2f', p_retailprice) AS fixed, p_name || ' ' || p_partkey AS tidy, p_partkey AS page_limit,
  true AS cited, 'see the ' || p_partkey || ' now' AS visible FROM part"""

def src4_made_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all nine connectors with parameters out of the customers, good ones and bad ones."""
    k, company = F.col("c_custkey"), _cat("c o/", F.col("c_custkey"))
    lists = ["shopify-collection", "greenhouse-jobs", "lever-postings", "ashby-jobs", "workable-jobs", "recruitee-offers", "teamtailor-jobs", "nhtsa-vin", "npi-provider", "github-repo"]
    given = lambda **named: F.create_map(*[x for n, v in named.items() for x in (F.lit(n), (v if isinstance(v, Column) else F.lit(v)).cast("string"))])
    shapes = [
        given(store="shop.test", collection=_cat("c ", k), limit=k % 300, page="2"), given(company=company, content="true"), given(company=company, skip=k % 7, limit="5"), given(company=F.when(k % 20 != 3, company)), given(company=company, details="true"), given(company=_cat("c", k)),
        given(company=_cat("c", k), per_page=k % 9), given(vin=_cat(" V*", k, " "), modelYear="2011"), given(last_name=F.col("c_name"), limit=(k % 400).cast("string"), state="NY"), given(company=company),
    ]
    made = bind(_rows(spark, sf_dir, "customer").select("c_custkey", _turn(k, *lists).alias("t"), _turn(k, *shapes).alias("p")), r=requests.list_urls(F.col("t"), F.col("p")))
    return made.select("c_custkey", "r.url", "r.error")


_SRC4 = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 300 AS lim, c_custkey % 400 AS npi, c_name FROM customer),
e AS (SELECT *, CASE k % 10 WHEN 0 THEN CASE WHEN lim NOT BETWEEN 1 AND 250 THEN 'shopify-collection "limit" must be an integer from 1 to 250, got ' || lim || '.' END
  WHEN 3 THEN CASE WHEN k % 20 = 3 THEN 'ashby-jobs listUrl requires a "company" parameter — the jobs page name in https://jobs.ashbyhq.com/<name>.' END
  WHEN 8 THEN CASE WHEN npi NOT BETWEEN 1 AND 200 THEN 'npi-provider "limit" must be an integer between 1 and 200. The NPI registry silently caps anything larger instead of reporting it. Got: ' || npi END
  WHEN 9 THEN 'Template "github-repo" has no list of its own.' END AS error FROM c)
SELECT k AS c_custkey, CASE WHEN error IS NULL THEN CASE k % 10 WHEN 0 THEN 'https://shop.test/collections/c%20' || k || '/products.json?limit=' || lim || '&page=2' WHEN 1 THEN 'https://boards-api.greenhouse.io/v1/boards/c%20o%2F' || k || '/jobs?content=true'
  WHEN 2 THEN 'https://api.lever.co/v0/postings/c%20o%2F' || k || '?mode=json&skip=' || k % 7 || '&limit=5' WHEN 3 THEN 'https://api.ashbyhq.com/posting-api/job-board/c%20o%2F' || k WHEN 4 THEN 'https://www.workable.com/api/accounts/c%20o%2F' || k || '?details=true'
  WHEN 5 THEN 'https://c' || k || '.recruitee.com/api/offers/' WHEN 6 THEN 'https://c' || k || '.teamtailor.com/jobs.rss?per_page=' || k % 9 WHEN 7 THEN 'https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/V*' || k || '?format=json&modelyear=2011'
  WHEN 8 THEN 'https://npiregistry.cms.hhs.gov/api/?version=2.1&last_name=' || replace(c_name, '#', '%23') || '&state=NY&limit=' || npi END END AS url, error FROM e"""


def scl5_made_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' dates in seven ways to write them."""
    k, at = F.col("o_orderkey"), lambda form: F.date_format("o_orderdate", form)
    clock = _cat(F.lpad((k % 12).cast("string"), 2, "0"), ":", F.lpad((k % 60).cast("string"), 2, "0"), ":07")
    text = _turn(k, at("MMMM d, yyyy"), at("M/d/yyyy"), at("yyyy/MM/dd"), _cat(at("EEE, dd MMM yyyy "), clock, " EST"), _cat(at("d MMM yyyy "), clock, " +0000 (x)"), _cat(at("yyyy-MM-dd"), "T", clock, "-01:00"), _cat(at("yyyy-MM-dd"), " nor ", k))
    return _rows(spark, sf_dir, "orders").select("o_orderkey", S.iso_date(text).alias("iso"))


_SCL5 = """
WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d, to_hours(o_orderkey % 12) + to_minutes(o_orderkey % 60) + to_seconds(7) AS clock FROM orders)
SELECT o_orderkey, strftime(CASE o_orderkey % 7 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d + clock + INTERVAL 5 HOUR WHEN 4 THEN d + clock WHEN 5 THEN d + clock + INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM o"""

QUERIES = {
    f.__name__: f
    for f in (emb_made_states, tpl3_made_products, tpl4_made_repos, tpl5_made_videos, tpl7_made_front_pages, tpl8_made_launches, tpl19_made_products, tbl1_made_grids, url2_made_addresses, jsn_made_walks, pii_made_texts, hlt1_made_units, src_made_bodies, scl_made_values, scl5_made_dates, src4_made_requests)
}
SQL = {
    "emb_made_states": _STATES, "tpl3_made_products": _TPL3, "tpl4_made_repos": _TPL4, "tpl5_made_videos": _TPL5, "tpl7_made_front_pages": _TPL7, "tpl8_made_launches": _TPL8, "tpl19_made_products": _TPL19, "tbl1_made_grids": _TBL1, "url2_made_addresses": _URL2, "jsn_made_walks": _JSN,
    "pii_made_texts": _PII, "hlt1_made_units": _HLT1, "src_made_bodies": _SRC, "scl_made_values": _SCL, "scl5_made_dates": _SCL5, "src4_made_requests": _SRC4,
}
