"""Queries whose inputs are texts dealt over a table's rows, with the values that must come out, written by hand.

Each of them runs its operator on every row of its table; the SQL states what the row's text must give.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import scalars as S
from pageloom.functions import urls, verdict
from pageloom.functions.bind import spread
from pageloom.operators import dom, embedded, highlights, markup, pages, pii, records, registry, tables
from pageloom.sources import body, requests

#: name: (function of the texts of a row, [(texts of a row ..., expected text or None)]).
Case = tuple[Callable[..., Column], list[tuple]]


def _text(c: Column) -> Column:
    return c.cast("string")


def _json(c: Column) -> Column:
    return F.to_json(c)


def _pages(f: Callable, *fields: str) -> Callable[..., Column]:
    def run(*args: Column) -> Column:
        r = f(*args)
        return F.coalesce(r["error"], F.concat_ws("|", *[F.coalesce(r["data"][x].cast("string"), F.lit("-")) for x in fields]))

    return run


_OFFER = '"offers":{"@type":"Offer","price":"1,299.00","priceCurrency":"EUR","availability":"https://schema.org/InStock"}'
_NXT = '<script>self.__next_f.push([1,"1:{\\"x\\":\\"$2\\",\\"y\\":\\"$2:k\\"}\\n"])</script><script>self.__next_f.push([1,"2:{\\"k\\":[1,2]}\\n"])</script>'
_GRID = "<table><tr><th>A</th><th>B</th></tr><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>"

CASES: dict[str, Case] = {
    # Bodies and addresses.
    "src2_charset": (
        lambda t, b: body.detect_charset(t, F.encode(b, "utf-8")),
        [("text/html; charset=ISO-8859-2", "<meta charset=utf-8>", "iso-8859-2"), ("text/html", "<head><meta charset='Windows-1251'>", "windows-1251"), ("", '<meta http-equiv="Content-Type" content="text/html; charset=gbk">', "gbk"), ("text/html", "<p>plain</p>", "utf-8"), ('x; charset="Big5"', "", "big5")],
    ),
    "src1_decode": (
        lambda hexed, label: body.decode_body(F.unhex(hexed), label),
        [("C3A9", "utf-8", "é"), ("E9", "iso-8859-1", "é"), ("93FA967B", "shift_jis", "日本"), ("80", "latin1", "€"), ("EFBBBF61", "utf-8", "a"), ("41", "no-such-label", "A"), ("C4E3", "gb2312", "你"), ("FF", "utf-8", "�")],
    ),
    "src5_resolve_url": (
        requests.resolve_url,
        [
            ("shopify-product", "https://a.test/collections/x/products/mug?variant=1#r", "https://a.test/collections/x/products/mug.json"),
            ("shopify-collection", "https://a.test/collections/all/products?page=2&x=1&limit=9", "https://a.test/collections/all/products.json?limit=9&page=2"),
            ("github-repo", "https://github.com/o/r/tree/main/docs", "https://github.com/o/r"),
            ("youtube-video", "https://youtu.be/abc123?t=3", "https://www.youtube.com/watch?v=abc123"),
            ("reddit-thread", "https://www.reddit.com/r/a/comments/1b2/title/", "https://arctic-shift.photon-reddit.com/api/posts/ids?ids=1b2"),
            ("stackoverflow-question", "https://stackoverflow.com/questions/42/x", "https://api.stackexchange.com/2.3/questions/42?site=stackoverflow&filter=!20aKG._8Oscv*6djs8Pgm"),
            ("npm-package", "https://www.npmjs.com/package/@a/b/v/1", "https://registry.npmjs.org/@a/b"),
            ("greenhouse-jobs", "https://job-boards.greenhouse.io/acme/jobs/1", "https://boards-api.greenhouse.io/v1/boards/acme/jobs"),
            ("lever-postings", "https://jobs.lever.co/acme", "https://api.lever.co/v0/postings/acme?mode=json"),
            ("ashby-jobs", "https://jobs.ashbyhq.com/acme", "https://api.ashbyhq.com/posting-api/job-board/acme"),
            ("workable-jobs", "https://acme.workable.com/jobs?details=true", "https://www.workable.com/api/accounts/acme?details=true"),
            ("recruitee-offers", "https://acme.recruitee.com/o/x", "https://acme.recruitee.com/api/offers/"),
            ("teamtailor-jobs", "https://acme.teamtailor.com/jobs/", "https://acme.teamtailor.com/jobs.rss"),
            ("nhtsa-vin", "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVin/1HG?format=xml", "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/1HG?format=json"),
            ("amazon-product", "https://www.amazon.com/dp/1", "https://www.amazon.com/dp/1"),
        ],
    ),
    "url1_safe_href": (
        urls.safe_href,
        [("javascript:alert(1)", None), (" javascript:alert(1)", None), ("﻿data:x", None), (" java\tscript:x", None), ("//cdn.test/a.js", "//cdn.test/a.js"), ("HTTPS://A.test", "HTTPS://A.test"), ("\x01/a b ", "/a b"), ("", None), ("mailto:a@b.c", None), ("a/b", "a/b")],
    ),
    "url3_dedupe_key": (
        urls.dedupe_key,
        [("https://a.test/x/#top", "https://a.test/x"), ("https://a.test/", "https://a.test/"), ("https://a.test", "https://a.test/"), ("HTTPS://A.TEST/p/", "https://a.test/p"), ("https://a.test//", "https://a.test/"), ("https://a.test/p/?q=1#f", "https://a.test/p?q=1"), ("https://a.test/p//", "https://a.test/p/")],
    ),
    "url4_resolve": (
        lambda u, base: urls.absolute_url(u, base),
        [
            ("/a b", "https://a.test/x/y", "https://a.test/a%20b"), ("é?é#é", "https://a.test/x/y", "https://a.test/x/%C3%A9?%C3%A9#%C3%A9"), ("https://é.com/", "https://a.test/", "https://xn--9ca.com/"), ("https://u:p@e.com/x", "https://a.test/", "https://u:p@e.com/x"),
            ("http://[::1]/x", "https://a.test/", "http://[::1]/x"), ("a\\b", "https://a.test/x/y", "https://a.test/x/a/b"), ("../../z", "https://a.test/x/y/", "https://a.test/z"), ("//B.test:443/q", "https://a.test/", "https://b.test/q"), ("?q", "https://a.test/x?y#z", "https://a.test/x?q"), ("#f", "https://a.test/x?y", "https://a.test/x?y#f"),
            ("http://a.test:99999/", "https://a.test/", None), ("http://exa mple/", "https://a.test/", None), ("mailto:a@b.c", "https://a.test/", "mailto:a@b.c"), ("http://0x7f.1/", "https://a.test/", "http://127.0.0.1/"), ("./", "https://a.test/x/y", "https://a.test/x/"),
        ],
    ),
    "url5_npm_repository": (
        urls.npm_repository_url,
        [("git+https://github.com/a/b.git", "https://github.com/a/b"), ("a/b", "https://github.com/a/b"), ("git@github.com:a/b.git", "https://github.com/a/b"), ("git://github.com/a/b", "https://github.com/a/b"), ("ssh://git@github.com/a/b", "https://github.com/a/b"), ("git+ssh://git@h.test/a.git", "https://h.test/a"), ("https://git@h.test/a", "https://h.test/a"), ("", None)],
    ),
    "url6_front_page_url": (lambda u: urls.absolute_url(u, F.lit("https://news.ycombinator.com/")), [("item?id=1", "https://news.ycombinator.com/item?id=1"), ("https://a.test/x", "https://a.test/x"), ("/newest", "https://news.ycombinator.com/newest")]),
    "url7_full_size_image": (S.full_size_image, [("https://i.test/I/71x._AC_SX300_.jpg", "https://i.test/I/71x.jpg"), ("https://i.test/x-locale/common/a.png", None), ("https://i.test/transparent-pixel.gif", None), ("https://i.test/a.png", "https://i.test/a.png"), ("", None)]),
    "url8_ids": (
        lambda u: F.concat_ws("|", F.coalesce(S.reddit_post_id(u), F.lit("-")), F.coalesce(S.github_repo_name(u), F.lit("-"))),
        [("https://www.reddit.com/r/a/comments/1B2c/x", "1B2c|a"), ("https://github.com/o/r.git", "-|r"), ("https://github.com/o", "-|-"), ("nothing", "-|-")],
    ),
    # Text.
    "txt1_lines": (
        lambda h: dom.projections(h, F.lit("https://a.test/"))["text"],
        [("<h2>T</h2><p>a<br>b</p>", "T\na\nb"), ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"), ('<a href="/x">one</a> <a href="/y">two</a>', "one two"), ('<a href="/x">one</a><!--c--><a href="/y">two</a>', "one\ntwo"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("x  ﻿ y<script>z</script>", "x y"), ("a\x1cb", "a\x1cb")],
    ),
    "txt3_html_text": (markup.html_text, [("<p>a &amp; b</p>\n<b>c</b>", "a & b c"), ("", None), (" plain  text ", "plain text"), ("a<br>b", "ab"), ("<div>x</div>", "xx"), ("&lt;p&gt;", "<p>")]),
    "txt4_escaped_text": (lambda t: markup.html_text(t, escaped=True), [("&lt;p&gt;Hello &amp;amp; bye&lt;/p&gt;", "Hello & bye"), ("", None), ("plain", "plain")]),
    "txt5_tidy": (S.tidy, [("  a \n\t b ", "a b"), (" 　", None), ("", None), ("a b", "a b")]),
    "txt6_selectors": (
        lambda h: _json(F.struct(_selected(h)["t"].alias("t"), _selected(h)["l"].alias("l"))),
        [('<div id="x" class="a b"><p>1</p><p title="q">2</p></div><p>3</p>', '{"t":"1","l":["1","2"]}'), ("<p>x</p>", '{"l":[]}')],
    ),
    # Structure.
    "str_similarity": (
        lambda a, b: _text(F.round(_alike(a, b), 6)),
        [("<p>a</p>", "<p>b</p><p>c</p>", "0.9"), ("<p>a</p>", "<p>a</p>", "1.0"), ("<div><p>a</p></div>", "<p>a</p>", "0.8")],
    ),
    # Verdicts and choice of templates.
    "blk1_challenge": (
        lambda title, html: _json(verdict.challenge(title, html, F.lit("short text"))),
        [
            ("Just a moment...", "", '{"vendor":"cloudflare","evidence":"title \\"Just a moment...\\""}'), ("Shop", '<form action="/errors/validateCaptcha">', '{"vendor":"amazon","evidence":"the validateCaptcha form"}'),
            ("x", "geo.captcha-delivery.com", '{"vendor":"datadome","evidence":"a DataDome captcha frame on a 10-character page"}'), ("x", "px-captcha", '{"vendor":"perimeterx","evidence":"a PerimeterX / HUMAN challenge element on a 10-character page"}'), ("Shop", "<p>fine</p>", None),
            ("Request Rejected", "", '{"vendor":"f5","evidence":"title \\"Request Rejected\\""}'), ("Vercel Security Checkpoint", "", '{"vendor":"vercel","evidence":"title \\"Vercel Security Checkpoint\\""}'),
        ],
    ),
    "reg8_retired": (lambda u: registry.retired_template(u)["id"], [("tweet", "tweet"), ("https://x.com/a/status/1", "tweet"), ("https://www.linkedin.com/in/a", "linkedin-profile"), ("https://a.test/", None)]),
    "reg3_detect_literal": (
        urls.detect,
        [
            ("https://shop.test/products/mug", "shopify-product"), ("https://shop.test/collections/all", "shopify-collection"), ("https://www.amazon.com/products/x", "amazon-product"), ("https://github.com/a/b", "github-repo"), ("https://youtu.be/x1", "youtube-video"), ("https://www.reddit.com/r/a/comments/1b2/", "reddit-thread"),
            ("https://news.ycombinator.com/newest", "hacker-news-front-page"), ("https://www.producthunt.com/products/x", "producthunt-launch"), ("https://stackoverflow.com/questions/1/x", "stackoverflow-question"), ("https://registry.npmjs.org/x", "npm-package"), ("https://boards.greenhouse.io/a", "greenhouse-jobs"),
            ("https://jobs.lever.co/a", "lever-postings"), ("https://jobs.ashbyhq.com/a", "ashby-jobs"), ("https://apply.workable.com/a", "workable-jobs"), ("https://a.recruitee.com/", "recruitee-offers"), ("https://a.teamtailor.com/jobs.rss", "teamtailor-jobs"), ("https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/1", "nhtsa-vin"),
            ("https://npiregistry.cms.hhs.gov/api/?version=2.1", "npi-provider"), ("https://a.test/", None),
        ],
    ),
    # Tables.
    "tbl1_grid": (
        tables.grid_tables,
        [(_GRID, "<html><head></head><body><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>x</td><td>1</td></tr><tr><td>x</td><td>2</td></tr></tbody></table></body></html>"), ("<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", "<html><head></head><body><table><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table></body></html>")],
    ),
    "tbl2_cells": (
        lambda h: F.array_join(F.transform(tables.table_cells(h), lambda c: F.concat_ws(":", c["row_idx"].cast("string"), c["col_idx"].cast("string"), c["is_header"].cast("string"), c["text"])), ","),
        [(_GRID, "0:0:true:A,0:1:true:B,1:0:false:x,1:1:false:1,2:0:false:x,2:1:false:2"), ("<p>none</p>", ""), ("<table><tr><th colspan=2>H</th></tr><tr><td>1</td><td>2</td></tr></table>", "0:0:true:H,0:1:true:H,1:0:false:1,1:1:false:2")],
    ),
    "url2_absolute_urls": (
        lambda h: tables.absolute_urls(h, F.lit("https://a.test/d/p")),
        [('<a href="x y">l</a><img src="/i.png"><a href="#f">f</a>', '<html><head></head><body><a href="https://a.test/d/x%20y">l</a><img src="https://a.test/i.png"><a href="#f">f</a></body></html>'), ('<base href="/b/"><a href="c">l</a>', '<html><head><base href="/b/"></head><body><a href="https://a.test/b/c">l</a></body></html>')],
    ),
    # JSON.
    "jsn2_select": (
        lambda j: _json(embedded.json_select(j, "a.b[1]")),
        [('{"a":{"b":[1,{"x":2}]}}', '{"value":"{\\"x\\":2}"}'), ('{"a":{"b":[1]}}', '{"error":"Path \\"a.b[1]\\" not found: \\"a.b\\" has no \\"1\\" (array of length 1)"}'), ('{"a":{"c":1}}', '{"error":"Path \\"a.b[1]\\" not found: \\"a\\" has no \\"b\\" (available keys: c)"}'), ("{", '{"error":"not JSON"}')],
    ),
    "jsn3_find": (
        lambda j: _json(embedded.find_json_paths(j, "Id", limit=2, preview_chars=8)),
        [('{"id":1,"x":[{"ID":{"a":[1,2,3]}}]}', '{"matches":[{"path":"id","preview":"1","addressable":true},{"path":"x.0.ID","preview":"{\\"a\\":[1,","addressable":true}],"total":2,"truncated":false}'), ('{"a.b":{"id":"u"}}', '{"matches":[{"path":"a.b.id","preview":"\\"u\\"","addressable":false}],"total":1,"truncated":false}'), ('[1,2]', '{"matches":[],"total":0,"truncated":false}')],
    ),
    "jsn4_preview": (lambda j: embedded.preview_json(j, 7), [('{"a": [1, 2, 3]}', '{"a":[1'), ("[1]", "[1]"), ('"abcdefghij"', '"abcdef'), ("x", None)]),
    "jsn5_flatten_ld": (lambda j: F.array_join(embedded.flatten_ld(j), ";"), [('{"@graph":[{"a":1},{"b":2}]}', '{"@graph":[{"a":1},{"b":2}]};{"a":1};{"b":2}'), ('[{"a":1}]', '{"a":1}'), ("3", "")]),
    # State that pages carry.
    "emb0_sources": (
        lambda h: F.array_join(F.transform(embedded.embedded_state(h)["sources"], lambda s: F.concat_ws(":", s["name"], s["bytes"].cast("string"), s["json"])), ";"),
        [
            ('<script id="__NEXT_DATA__" type="application/json">{"a": [1, "é"]}</script>', 'next_data:14:{"a":[1,"é"]}'), ("<p>none</p>", ""), (_NXT, 'next_f:49:{"1":{"x":{"k":[1,2]},"y":[1,2]},"2":{"k":[1,2]}};data_rows:103:[{"id":"1","bytes":27,"keys":["x","y"],"length":null},{"id":"2","bytes":11,"keys":["k"],"length":null}]'),
            ('<script type="application/json" id="z">{"b":1}</script><script>window.__APP_STATE__ = {"u": undefined};</script>', 'app_state:10:{"u":null};json_scripts:27:[{"id":"z","data":{"b":1}}]'), ("<!-- <script>window.__STATE__={}</script> -->", ""),
        ],
    ),
    "emb0_warnings": (
        lambda h: F.array_join(embedded.embedded_state(h)["warnings"], ";"),
        [('<script type="application/json">{</script>', 'A <script type="application/json"> block is not valid JSON; skipped.'), ("<script>window.__STATE__ = f();</script>", "__STATE__ is present but its value is not a JSON or JavaScript literal (it calls code or reads other variables); not parsed."), ("<script>__NUXT__={}</script>", "__NUXT__ is present but assigned an empty object; the page fills it in from a later statement this tool does not evaluate."), ("<p>x</p>", "")],
    ),
    "emb3_apollo": (lambda h: F.array_join(embedded.apollo_transport(h), ";"), [('(window[Symbol.for("ApolloSSRDataTransport")] ??= []).push({"a":undefined,"b":[1]})', '{"a":null,"b":[1]}'), ("nothing", "")]),
    "emb9_flight_rows": (
        lambda t: F.array_join(F.transform(embedded.flight_rows(t), lambda r: F.concat_ws("=", r["id"], r["value"])), ";"),
        [('1:{"a":1}\n2:T5,héll3:"x"\n', '1={"a":1};2="héll";3="x"'), ("a:I[1]\nnoise\nb:E{\"m\":1}\n", 'a="I[1]";b={"$error":{"m":1}}'), ("", "")],
    ),
    "emb10_flight_resolve": (
        lambda t: _json(embedded.flight_resolved(t)),
        [('1:{"a":"$2","b":"$$x"}\n2:[1]\n', '{"rows":"{\\"1\\":{\\"a\\":[1],\\"b\\":\\"$x\\"},\\"2\\":[1]}","resolved":1,"cycles":0,"over_budget":0}'), ('1:{"a":"$1"}\n', '{"rows":"{\\"1\\":{\\"a\\":{\\"$ref\\":\\"1\\"}}}","resolved":0,"cycles":1,"over_budget":0}')],
    ),
    "emb11_size": (lambda j: _text(embedded.serialized_size(j)), [('{"a": "é"}', "10"), ("[1, 2]", "5"), ("null", "4"), ("x", None)]),
    "emb12_data_rows": (lambda t: _json(embedded.flight_data_rows(t)), [('1:["$","div",null,{}]\n2:{"k":[1,2]}\n3:[1,2,3,4,5,6]\n', '[{"id":"3","bytes":13,"length":6},{"id":"2","bytes":11,"keys":["k"]}]'), ('1:"x"\n', "[]")]),
    "emb13_nuxt": (
        lambda j: embedded.nuxt_data(j)["value"],
        [('[{"a":1,"b":2},"x",[1,1]]', '{"a":"x","b":["x","x"]}'), ('[["Set",1,2],"a","b"]', '["a","b"]'), ('[["Date","2020-01-01T00:00:00.000Z"]]', '"2020-01-01T00:00:00.000Z"'), ('[["ShallowReactive",1],{"s":2},["EmptyRef",3],"_"]', '{"s":null}'), ('[{"self":0}]', '{"self":{"$ref":""}}'), ('[["Map",1,2],"k",-1]', '{"k":-1}'), ('[["Map",1,-1],"k"]', '{"k":null}'), ("{}", None)],
    ),
    "emb16_sveltekit": (lambda h: embedded.sveltekit_data(h)["value"], [("<script>__sveltekit_1x = {};kit.start(app, el, {node_ids: [0], data: [null, {type: 'data', data: {n: 1e3, d: new Date(0)}}]});</script>", '[null,{"type":"data","data":{"n":1000,"d":"1970-01-01T00:00:00.000Z"}}]'), ("<script>x</script>", None)]),
    "emb17_inertia": (lambda h: embedded.inertia_page(h)["value"], [('<div data-page="{&quot;component&quot;:&quot;A&quot;}"></div>', '{"component":"A"}'), ('<script data-page type="application/json">{"component":"B"}</script>', '{"component":"B"}'), ('<div data-page="3"></div>', None)]),
    "emb18_shopify": (lambda h: embedded.shopify_state(h)["value"], [('<script>var meta = {"product":{"id":1}};for (var attr in meta) {window.ShopifyAnalytics.meta[attr] = meta[attr];}ShopifyAnalytics.meta.currency = "USD";</script>', '{"meta":{"product":{"id":1},"currency":"USD"}}'), ('<script type="application/json" data-product-json>{"p":1}</script>', '{"product_json":[{"p":1}]}'), ("<p>x</p>", None)]),
    "emb19_attributes": (lambda h: _json(embedded.json_attributes(h, 8)), [("<div id=q data-props='{\"a\": [1, 2]}'>", '[{"tag":"div","attribute":"data-props","id":"q","data":"{\\"a\\":[1,2]}"}]'), ('<p data-x="{&quot;k&quot;:&quot;v&quot;}">', '[{"tag":"p","attribute":"data-x","data":"{\\"k\\":\\"v\\"}"}]'), ("<p data-y='[1]'>", "[]")]),
    "emb20_literal": (
        lambda t: F.coalesce(embedded.script_literal(t)["value"], embedded.script_literal(t)["reason"]),
        [
            ("{a: 1, 'b': [void 0, !0, -2.5,, `t`], 3: null}", '{"3":null,"a":1,"b":[null,true,-2.5,null,"t"]}'), ("(function(a,b){return {x:a,y:[b,a]}}(1,\"z\"))", '{"x":1,"y":["z",1]}'), ("new RegExp('a','g')", '"/a/g"'), ("10n", '"10"'), ("'a' + 'b'", '"ab"'), ("f()", "not a literal: a function call"), ("{a}", 'not a literal: a shorthand property "a"'),
            ("[...x]", "not a literal: a spread element"), ("{[k]: 1}", "not a literal: a computed key"), ("x", 'not a literal: the identifier "x"'), ("1 - 2", 'not a literal: the binary operator "-"'), ("new Foo(1)", "not a literal: a constructor call"), ("NaN", "null"),
        ],
    ),
    # Units and their ranking.
    "hlt1_units": (
        lambda t: F.array_join(F.transform(highlights.segment_units(t), lambda u: F.concat_ws("|", u["kind"], u["offset"].cast("string"), u["length"].cast("string"), F.coalesce(u["heading"], F.lit("-")), u["text"])), ";"),
        [
            ("# H\nOne two. Three four!", "sentence|4|8|H|One two.;sentence|13|11|H|Three four!"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table_row|0|9|-|| a | b |;table_row|20|9|-|| 1 | 2 |"), ("```\ncode. x\n```\nend", "code_block|4|7|-|code. x;sentence|16|3|-|end"), ("- item one\n> quoted", "sentence|2|8|-|item one;sentence|13|6|-|quoted"),
            ("Dr. Who is no. Next", "sentence|0|19|-|Dr. Who is no. Next"), ("你好。世界", "sentence|0|3|-|你好。;sentence|3|2|-|世界"), ("😀 hi. yo", "sentence|0|6|-|😀 hi.;sentence|7|2|-|yo"), ("---\n<!-- x -->\n![i](u)", ""), ("Pay $3.50 now. v1.2 ok", "sentence|0|14|-|Pay $3.50 now.;sentence|15|7|-|v1.2 ok"),
        ],
    ),
    "hlt4_tokens": (lambda t: F.array_join(highlights.tokenize(t), " "), [("Running Classes, used boxes", "runn class used box"), ("日本語 テスト", "日本 本語 テス スト"), ("house houses", "hous hous"), ("", "")]),
    "hlt5_stem": (highlights.stem, [("running", "runn"), ("classes", "class"), ("used", "used"), ("houses", "hous"), ("created", "creat"), ("create", "creat"), ("cats", "cats"), ("boxed", "box")]),
    "hlt6_visible": (highlights.visible, [("see [the site](http://x.y/z_(1)) now", "see the site now"), ("![alt](i.png)", "alt"), ("a[\\[1\\]](#cite_note-1)b", "a b"), ("[![i](a.png)](b)", "i"), ("plain", "plain")]),
    "hlt9_reference": (lambda t: _text(highlights.is_reference(t, t)), [("References", "true"), ("Notes and references", "true"), ("See also", "false"), ("x [a](#cite_ref-1)", "true"), ("Works cited", "true")]),
    "hlt7_rank": (
        lambda t: F.array_join(F.transform(highlights.rank_units(highlights.segment_units(t), "blue whale", max_units=2), lambda u: F.concat_ws("|", u["offset"].cast("string"), u["score"].cast("string"))), ";"),
        [("A blue whale swims. Red fish swim here. Blue sky today.", "0|2.176;40|0.47"), ("Nothing at all here.", ""), ("", "")],
    ),
    # Redaction.
    "pii_kinds": (
        lambda t: _json(F.struct(pii.redact_pii(t)["text"].alias("t"), pii.redact_pii(t)["count"].alias("n"))),
        [("Bearer abc", '{"t":"Bearer <SECRET>","n":1}'), ("password: hunter2 x", '{"t":"password: <SECRET> x","n":1}'), ("write a.b@c.example now", '{"t":"write <EMAIL> now","n":1}'), ("(212) 555-0147", '{"t":"<PHONE>","n":1}'), ("4111 1111 1111 1111", '{"t":"<FINANCIAL>","n":1}'), ("nothing", '{"t":"nothing","n":0}')],
    ),
    # Scalars.
    "scl2_compare_at": (S.compare_at_price, [("0.00", None), ("12.50", "12.50"), ("", None), ("abc", "abc")]),
    "scl1_money": (S.money, [("", None), ("19.90", "19.90"), ("0", "0")]),
    "scl4_tags": (lambda t: _json(S.tags(t)), [("a, b ,,c", '["a","b","c"]'), ('["x","y"]', '["x","y"]'), ("", "[]")]),
    "scl5_iso_date": (S.iso_date, [("2024-03-05", "2024-03-05"), ("2024-03-05 10:20:30 UTC", "2024-03-05T10:20:30.000Z"), ("2024-03-05T10:20:30-05:00", "2024-03-05T15:20:30.000Z"), ("Tue, 05 Mar 2024 10:20:30 +0100", "2024-03-05T09:20:30.000Z"), ("soon", None), ("", None), ("Tue, 05 Mar 2024 10:20:30 GMT", "2024-03-05T10:20:30.000Z")]),
    "scl5_epoch": (lambda t: S.epoch_iso(t.cast("double")), [("0", "1970-01-01T00:00:00.000Z"), ("1709634030", "2024-03-05T10:20:30.000Z")]),
    "scl6_remote": (lambda t: _text(S.is_remote(t)), [("Remote", "true"), ("Fully Remote", None), ("on-site", "false"), ("ON_SITE", "false"), ("hybrid", None), ("", None), ("telecommuting", "true"), (" office ", "false")]),
    "scl7_location": (S.join_location, [("Paris", "", "France", "Paris, France"), ("Rome", "Rome", " Italy ", "Rome, Italy"), ("", " ", "", None)]),
    "scl9_vin": (lambda t: _json(F.struct(S.vin_value(t).alias("v"), S.vin_error_codes(t).alias("c"))), [("0", '{"v":"0","c":[]}'), ("1, 4,0", '{"v":"1, 4,0","c":["1","4"]}'), (" ", '{"c":[]}')]),
    "scl10_npi": (
        lambda o, f, m, x: F.concat_ws("|", F.coalesce(S.npi_name(o, F.lit("Dr."), f, m, x), F.lit("-")), F.coalesce(_text(S.npi_yes_no(x)), F.lit("-"))),
        [("ACME LLC", "A", "B", "C", "ACME LLC|-"), ("", "Ann", "--", "YES", "Dr. Ann YES|true"), ("--", "A", "", "NO", "-|false")],
    ),
    "scl11_paging": (lambda u: F.concat_ws("|", F.coalesce(_text(S.query_int(u, "limit")), F.lit("10")), F.coalesce(_text(S.query_int(u, "skip")), F.lit("0"))), [("https://a.test/?limit=5&skip=20", "5|20"), ("https://a.test/?limit=x", "10|0"), ("https://a.test/", "10|0")]),
    "scl12_ld_number": (lambda t: S.fixed2(S.ld_number(t)), [("1,299.00", "1299.00"), ("12,50 €", "12.50"), ("USD 7", "7.00"), ("", None), ("1,234,567", "1234567.00")]),
    "scl13_availability": (lambda t: _text(S.availability(t)), [("https://schema.org/InStock", "true"), ("SoldOut", "false"), ("", None), ("PreOrder", "true"), ("Unknown", None)]),
    "scl16_rating_count": (lambda t: F.concat_ws("|", F.coalesce(_text(S.rating(t)), F.lit("-")), F.coalesce(_text(S.count_of(t)), F.lit("-"))), [("4.6 out of 5 stars", "4.6|465"), ("4,7 von 5 Sternen", "4.7|475"), ("none", "-|-"), ("1,234 ratings", "1.234|1234"), ("5 von 5", "5.0|55")]),
    "scl17_points": (lambda t: F.concat_ws("|", F.coalesce(_text(S.points(t)), F.lit("-")), F.coalesce(_text(S.comments(t)), F.lit("-"))), [("12 points", "12|-"), ("1 point", "1|-"), ("discuss", "-|0"), ("34 comments", "-|34"), ("", "-|-")]),
    "scl18_counts": (lambda t: _text(S.exact_count(t)), [("1,234", "1234"), ("32.4k", None), (" 7 ", "7"), ("", None)]),
    "scl19_npm": (
        lambda t: F.concat_ws("|", F.coalesce(records.npm_license(t), F.lit("-")), F.coalesce(records.npm_bugs_url(t), F.lit("-"))),
        [("MIT", "MIT|MIT"), ('{"type":"ISC","url":"https://a.test"}', "ISC|https://a.test"), ('[{"type":"MIT"},"BSD"]', 'MIT, BSD|[{"type":"MIT"},"BSD"]'), ("", "-|-"), ('{"email":"a@b.c"}', "-|a@b.c")],
    ),
    # Pages.
    "tpl3_amazon": (
        _pages(pages.amazon_product, "title", "price", "currency", "rating", "review_count", "brand", "images"),
        [
            ('<link rel="canonical" href="https://www.amazon.de/dp/1"><span id="productTitle"> Mug </span><div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">12,99 €</span></span></div><a id="bylineInfo">Brand: Acme</a><span id="acrPopover" title="4,5 von 5 Sternen"></span><span id="acrCustomerReviewText">1.234 Bewertungen</span><img id="landingImage" src="https://i.test/a._SX1_.jpg">', "u", "Mug|12,99 €|EUR|4.5|1234|Acme|[https://i.test/a.jpg]"),
            ('<form action="/errors/validateCaptcha">', "u", "Amazon answered with a captcha interstitial (an HTTP 200 robot check), not the product page. The product data is not in this response — retry later or from a different IP."),
        ],
    ),
    "tpl4_github": (
        _pages(pages.github_repo, "name", "description", "stars", "topics", "license", "readme_summary"),
        [('<script data-target="react-app.embeddedData">{"payload":{"sidebarAbout":{"description":" A  tool ","stargazerCount":1234,"repo":{"license":{"spdxId":"MIT"}}}}}</script><a class="topic-tag">x</a><article class="markdown-body"><p> </p><p>First para.</p></article>', "https://github.com/o/r.git", "r|A tool|1234|[x]|MIT|First para."), ("<p>x</p>", "https://github.com/o/r", "-|-|-|[]|-|-")],
    ),
    "tpl5_youtube": (
        _pages(pages.youtube_video, "title", "views", "likes", "video_id"),
        [('<meta name="title" content="T"><link rel="canonical" href="https://www.youtube.com/watch?v=abc"><div itemprop="interactionStatistic"><meta itemprop="interactionType" content="https://schema.org/WatchAction"><meta itemprop="userInteractionCount" content="42"></div>', "u", "T|42|-|abc"), ("", "u", "-|-|-|-")],
    ),
    "tpl7_hacker_news": (
        _pages(pages.hacker_news, "stories"),
        [('<table><tr class="athing" id="1"><td><span class="titleline"><a href="item?id=1">Ask</a></span></td></tr><tr><td class="subtext"><span class="score">5 points</span> <a class="hnuser">bob</a> <span class="age"><a href="item?id=1">1 hour ago</a></span> <a href="item?id=1">3&nbsp;comments</a></td></tr></table>', "u", "[{1, Ask, https://news.ycombinator.com/item?id=1, null, 5, bob, 1 hour ago, 3}]"), ("", "u", "[]")],
    ),
    "tpl8_producthunt": (
        _pages(pages.producthunt, "name", "tagline", "followers", "website"),
        [('<meta property="og:title" content="X | Product Hunt"><script>(window[Symbol.for("ApolloSSRDataTransport")] ??= []).push({"r":{"__typename":"Product","name":"Xyz","tagline":"t","followersCount":7,"websiteUrl":"https://x.test"}})</script>', "https://p.test", "Xyz|t|7|https://x.test"), ('<meta property="og:title" content="X | Product Hunt"><a data-test="visit-website-button" href="https://x.test/?ref=producthunt">v</a>', "u", "X|-|-|https://x.test/")],
    ),
    "tpl19_json_ld": (
        lambda h: F.coalesce(pages.json_ld_product(h, F.lit("https://a.test/products/mug"))["reason"], F.concat_ws("|", *[F.coalesce(pages.json_ld_product(h, F.lit("https://a.test/products/mug"))["data"][c].cast("string"), F.lit("-")) for c in ("title", "vendor", "price", "price_max", "currency", "available", "handle", "options")])),
        [
            ('<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"A &amp; B","brand":{"name":"Acme"},' + _OFFER + "}]}</script>", "A & B|Acme|1299.00|1299.00|EUR|true|mug|[]"), ("<p>x</p>", "https://a.test/products/mug carries no schema.org Product JSON-LD"),
            ('<script type="application/ld+json">{"@type":"ProductGroup","name":"G","variesBy":["https://schema.org/size"],"hasVariant":[{"@type":"Product","sku":"1",' + _OFFER + '},{"@type":"Product","offers":{"price":5,"availability":"OutOfStock"}}]}</script>', "G|-|5.00|1299.00|EUR|true|mug|[size]"),
        ],
    ),
}


def _selected(h: Column) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        trees = [markup.parse(x).root for x in s]
        return pd.DataFrame({"t": [r.first_text("#x.a > p") for r in trees], "l": [r.texts("div.b p, p[title^=q]") for r in trees]})

    return F.pandas_udf(run, "struct<t: string, l: array<string>>")(h)


def _alike(a: Column, b: Column) -> Column:
    x, y = (dom.projections(c, F.lit("https://a.test/")) for c in (a, b))
    return highlights.let(F.struct(x.alias("x"), y.alias("y")), lambda p: dom.similarity(p["x"]["tags"], p["x"]["depths"], p["y"]["tags"], p["y"]["depths"]))  # one parse of each page


def _lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    f, rows = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (F.col("p_partkey") % len(rows) + 1).cast("int")
        texts = [F.element_at(F.array(*[F.lit(r[i]) for r in rows]), at).alias(f"t{i}") for i in range(len(rows[0]) - 1)]
        made = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select("p_partkey", *texts)
        return made.select("p_partkey", f(*[F.col(f"t{i}") for i in range(len(texts))]).alias("result"))

    return run


def _sql(name: str) -> str:
    rows = CASES[name][1]
    return f"SELECT p_partkey, ([{', '.join(_lit(r[-1]) for r in rows)}]::VARCHAR[])[p_partkey % {len(rows)} + 1] AS result FROM part"


QUERIES = {name: _query(name) for name in CASES}
SQL = {name: _sql(name) for name in CASES}
