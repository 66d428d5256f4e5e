"""Golden values of the document operators."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls, verdict
from pageloom.operators import dom, pii

ALL = frozenset(pii.ENTITIES)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<h1>Hi</h1><p>there</p>", "Hi\nthere"),
        ("<section>\n <h3>Ports</h3> <p>Lisbon<br>Porto</p><ol><li>north<li>south</ol></section>", "Ports\nLisbon\nPorto\nnorth\nsouth"),
        ('<dd><a href="#n">north</a><!--gap--><a href="#s">south</a> side</dd>', "north\nsouth side"),
        ('<li><a href="pier">Pier</a> &amp; <a href="quay">Quay</a></li>', "Pier & Quay"),
        ("<div><i>Spring<p>Tides rise.</p><p>Boats leave.</p></i></div>", "Spring\nTides rise.\nBoats leave."),
        ("", ""),
        ("<script>var a='</p>'</script><p>x", "x"),
    ],
)
def test_page_text(html, text):
    assert dom.page_text(dom.parse(html).body) == text


def test_links():
    page = "https://harbour.example/tides/today"
    (one,) = dom.links(dom.parse('<a title="When" href="../boats?x=1" rel="next"> Boats\t<b>due</b> </a>'), page)
    assert one == {"href": "https://harbour.example/boats?x=1", "text": "Boats due", "type": "internal", "domain": "harbour.example", "rel": "next", "original_href": "../boats?x=1", "title": "When"}
    many = "".join(f'<a href="{h}">x</a>' for h in ("/a/", "/a", "/a#top", "/b?q=1", "/b?q=2"))
    assert [x["original_href"] for x in dom.links(dom.parse(many), page)] == ["/a/", "/b?q=1", "/b?q=2"]
    other = "".join(f'<a href="{h}">x</a>' for h in ("mailto:a@b.c", "tel:1", "javascript:x()", "java\tscript:y()", "data:z"))
    assert [(x["type"], x["href"] is not None) for x in dom.links(dom.parse(other), page)] == [("other", True)] * 2 + [("other", False)] * 3


def test_structure(spark):
    assert dom.signature(dom.parse("<main><h2>Tides</h2><ol><li>low<li>high</ol></main>")) == (["body", "h2", "head", "html", "li", "main", "ol"], {1: 1, 2: 2, 3: 1, 4: 2, 5: 2})
    rows = [(["a"], {1: 1}, ["a"], {1: 1}), ([], {}, [], {}), (["a"], {1: 1}, [], {}), (None, None, ["a"], {1: 1}), (["a", "b"], {1: 2}, ["a"], {1: 1})]
    df = spark.createDataFrame(rows, "a array<string>, x map<int,int>, b array<string>, y map<int,int>")
    got = [r[0] for r in df.select(dom.similarity(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0, 0.5]


@pytest.mark.parametrize(
    ("text", "out", "counts"),
    [
        ("Ask harbour.master+2@port.example, please", "Ask <EMAIL>, please", {"EMAIL": 1}),
        ("run --api-key: zz9-plural", "run --api-key: <SECRET>", {"SECRET": 1}),
        ("Bearer\u00a0q1w2", "Bearer\u00a0<SECRET>", {"SECRET": 1}),
        ("card 5555-5555-5555-4444 ok", "card <FINANCIAL> ok", {"FINANCIAL": 1}),
        ("card 5555-5555-5555-4445 no", "card 5555-5555-5555-4445 no", {}),
        ("call +351 21 555 0199", "call <PHONE>", {"PHONE": 1}),
        ("IBAN GB82WEST12345698765432.", "IBAN <FINANCIAL>.", {"FINANCIAL": 1}),
        ("", "", {}),
    ],
)
def test_redact(text, out, counts):
    got = pii.redact(text, ALL)
    assert (got["text"], got["entities"], got["count"]) == (out, counts, sum(counts.values()))


def test_redact_styles_and_nulls(spark):
    assert pii.redact("a@b.co", ALL, "mask")["text"] == "[REDACTED]"
    assert pii.redact("a@b.co", ALL, "remove")["text"] == ""
    assert pii.wanted(["email"]) == {"EMAIL"} and pii.wanted(["x"]) == frozenset() and pii.wanted([]) == ALL
    rows = spark.createDataFrame([(None,), ("plain",), ("a@b.co",)], "t string").select(pii.redact_pii(F.col("t")).alias("r")).select("r.text", "r.count").collect()
    assert [tuple(r) for r in rows] == [(None, 0), ("plain", 0), ("<EMAIL>", 1)]


def test_urls(spark):
    rows = spark.createDataFrame([("javascript:alert(1)",), ("mailto:a@b.com",), ("//cdn.example.com/a.js",), ("HTTPS://Example.com",), (None,)], "u string")
    assert [r[0] for r in rows.select(urls.safe_href(F.col("u"))).collect()] == [None, None, "//cdn.example.com/a.js", "HTTPS://Example.com", None]
    found = spark.createDataFrame([("https://github.com/a/b",), ("https://www.amazon.com/products/x",), ("https://a.b/",)], "u string").select(urls.detect(F.col("u")))
    assert [r[0] for r in found.collect()] == ["github-repo", "amazon-product", None]


def test_verdict(spark):
    rows = [("u", "Just a moment...", "", "", 200), ("u", "Page not found", "x", "", 404), ("u", "Shop", "hello", "", 200), ("u", None, None, None, None), ("u", "Error", "y" * 2000, "", 200)]
    df = spark.createDataFrame(rows, "url string, title string, text string, html string, status int")
    got = [r[0] for r in df.select(verdict.verdict(*[F.col(c) for c in ("url", "title", "text", "html", "status")])).collect()]
    assert [g["success"] for g in got] == [False, False, True, False, True]
    assert got[0]["blocked"]["vendor"] == "cloudflare"
    assert got[1]["error"].startswith('HTTP 404: u answered with an error page titled "Page not found", not the resource')
