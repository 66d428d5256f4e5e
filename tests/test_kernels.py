"""Plain functions: hostile sizes stay linear, nothing recurses away, awkward values have defined results."""

import json
import time

import pytest

from pageloom.functions.weburl import try_parse
from pageloom.kernels import devalue, flight, jsliteral, jsonquery, jsontext, pagestate, units
from pageloom.operators import dom, markup, tables
from pageloom.sources.requests import list_url


def within(seconds, f):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


def test_json_is_strict_and_deep():
    for bad in ("NaN", "[1,]", "{'a':1}", '"\n"', "", "1 2", '{"a" 1}'):
        with pytest.raises(ValueError):
            jsontext.loads(bad)
    deep = jsontext.loads("[" * 100_000 + "]" * 100_000)
    assert jsontext.size(deep) == 200_000
    assert jsontext.dumps(jsontext.loads('{"b":1.0,"2":1e3,"1":null,"é":"\\ud83d\\ude00"}')) == '{"1":null,"2":1000,"b":1,"é":"😀"}'
    with pytest.raises(ValueError):
        jsontext.loads("[" * 100_000)


def test_find_goes_through_a_deep_payload():
    found = within(20, lambda: jsonquery.find(jsontext.loads('{"a":' * 100_000 + '{"Key":1}' + "}" * 100_000), "key"))
    assert found["total"] == 1 and found["matches"][0]["path"].endswith("a.Key")
    assert jsonquery.find({"k": [{"k": 1}] * 9}, "K", limit=3)["truncated"]
    assert jsonquery.find([0] * 50, "x", max_nodes=10)["truncated"]


def test_flight_stays_linear():
    stream = "".join(f"{i:x}:T5,héll" for i in range(40_000))
    assert len(within(9, lambda: flight.parse_rows(stream))) == 40_000
    doubling = {f"{i:x}": [f"${i + 1:x}"] * 2 for i in range(60)} | {"3c": [1]}
    assert within(3, lambda: flight.resolve_rows(doubling))["over_budget"] > 0
    chain = {f"{i:x}": {"n": f"${i + 1:x}"} for i in range(100_000)}
    assert len(within(60, lambda: flight.resolve_rows(chain))["rows"]) == 100_000
    assert flight.resolve_rows({"1": {"a": "$2"}, "2": {"b": "$1"}})["cycles"] == 1


def test_literals_are_bounded():
    source = "1"
    for _ in range(10):
        source = f"(function(a){{return [a,a,a,a,a,a,a,a,a,a]}}({source}))"
    ok, reason, _ = within(9, lambda: jsliteral.evaluate(source))
    assert not ok and "budget" in reason
    assert jsliteral.evaluate("[" * 100_000)[0] is False
    assert jsliteral.evaluate("{bad: 'a', __proto__: 1} trailing")[:2] == (True, {"bad": "a", "__proto__": 1})
    assert jsliteral.evaluate(r"'\x41B\u{43}\n\
d'")[1] == "ABC\nd"


def test_devalue_budgets_and_unknown_types():
    value, said = devalue.decode([["Strange", 1], {"a": 2}, "x"])
    assert value == {"a": "x"} and "Strange" in said[0]
    assert devalue.decode([])[0] is None and devalue.decode([{"a": 9}])[0] is None
    deep = [[i + 1] for i in range(600)] + ["x"]
    assert any("512" in w for w in devalue.decode(deep)[1])


def test_pages_with_unclosed_tags():
    html = "<div data-x='" * 100_000
    page = pagestate.Page(html)
    assert within(6, page.json_attributes) == []
    within(9, lambda: list(page.everything()))


def test_trees_are_linear():
    many = "".join(f'<a href="/p{i}">x</a>' for i in range(40_000))
    b = within(12, lambda: markup.parse(many))
    assert len(within(12, lambda: dom.links(b, "https://a.test/"))) == 40_000
    within(9, lambda: dom.page_text(b.body))
    nested = within(12, lambda: markup.parse("<div>" * 50_000 + "x"))
    assert within(9, lambda: dom.page_text(nested.body)) == "x"
    assert max(dom.signature(nested)[1]) == 50_002


def test_links():
    page = "https://a.test/d/p"
    b = markup.parse('<base href="https://b.test/x/"><a href="y z" title=" t ">l</a><a href="#q">m</a><a href="tel:1">c</a>')
    one, tel = dom.links(b, page)
    assert (one["href"], one["type"], one["domain"], one["title"], one["original_href"]) == ("https://b.test/x/y%20z", "external", "b.test", "t", "y z")
    assert (tel["type"], tel["href"], tel["original_href"]) == ("other", "tel:1", "tel:1")
    assert dom.links(b, page, base_url="https://c.test/")[0]["href"] == "https://c.test/y%20z"
    assert [x["type"] for x in dom.links(b, page, include_anchors=True)] == ["external", "anchor", "other"]
    assert [x["type"] for x in dom.links(markup.parse('<a href="a/b">x</a><a href="javascript:x">y</a>'), None)] == ["relative", "other"]
    scoped = dom.signature(markup.parse("<div><ul><li>a<li>b</ul></div>"), markup.parse("<div><ul><li>a<li>b</ul></div>").root.one("ul"))
    assert scoped == (["li"], {5: 2})


def test_units_are_slices():
    text = "# Töne 😀\n\n* eins. zwei!\n\n> drei\n~~~\ncode\n~~\n~~~\n|a|\nDr. No. 5 left. e.g. this\n" * 3
    flat = text.encode("utf-16-le")
    found = units.segment(text)
    assert len(found) > 12
    for u in found:
        assert flat[2 * u["offset"] : 2 * (u["offset"] + u["length"])].decode("utf-16-le") == u["text"]
    assert units.segment(None) == units.segment("") == units.segment(" \n") == []


def test_tables_keep_what_is_no_grid():
    nested = "<table><tr><th>a</th></tr><tr><td><table><tr><td>x</td></tr></table></td></tr></table>"
    assert tables.grid_html(nested).count("<table") == 2
    wide = tables.grid_html('<table><caption>C</caption><tr><th rowspan="9">A<br>b</th><th colspan="2">B</th></tr><tr><th>c</th><th>d</th></tr><tr><td>1</td><td>2</td><td><p>3</p></td></tr></table>')
    assert "<caption>C</caption>" in wide


def test_request_addresses():
    assert list_url("shopify-collection", {"store": "s.test", "collection": "a b", "limit": 9}) == "https://s.test/collections/a%20b/products.json?limit=9"
    assert list_url("lever-postings", {"company": "acme", "skip": 5}) == "https://api.lever.co/v0/postings/acme?mode=json&skip=5"
    assert list_url("nhtsa-vin", {"vin": "5UX*", "modelYear": 2011}) == "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVinValues/5UX*?format=json&modelyear=2011"
    assert list_url("npi-provider", {"city": "New York", "limit": 5}) == "https://npiregistry.cms.hhs.gov/api/?version=2.1&city=New+York&limit=5"
    for name, params in (("shopify-collection", {"store": "s"}), ("shopify-collection", {"store": "s", "collection": "c", "limit": 251}), ("greenhouse-jobs", {}), ("npi-provider", {}), ("npi-provider", {"city": "x", "skip": 1001}), ("nhtsa-vin", {"vin": " "})):
        with pytest.raises(ValueError):
            list_url(name, params)


def test_addresses_that_are_none():
    for bad in ("", "/x", "http://", "http://[::1", "http://a b/", "http://1.2.3.999/", "http://a.test:70000/"):
        assert try_parse(bad) is None
    assert json.dumps(try_parse("HTTP://A.Test:80/%7Ea/../b?q=é#f").href) == '"http://a.test/b?q=%C3%A9#f"'
