"""Trees of misnested markup as the HTML standard builds them, and building in linear time."""

import time

import pytest

from pageloom.operators import dom
from pageloom.operators.markup import MOST_REOPENED, inner_html, parse


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<p><b>x<p>y", "<p><b>x</b></p><p><b>y</b></p>"),
        ("<em>q<p>r</em>s</p>", "<em>q</em><p><em>r</em>s</p>"),
        ("<p>q<i>r<u>s</i>t</u>v</p>", "<p>q<i>r<u>s</u></i><u>t</u>v</p>"),
        ("<a href=k>q<div>r<a href=l>s", '<a href="k">q</a><div><a href="k">r</a><a href="l">s</a></div>'),
        ("<table>q<tr>r<td>s</table>t", "qr<table><tbody><tr><td>s</td></tr></tbody></table>t"),
        ("<table><i><tr><td>q</td></tr>r</table>s", "<i></i><i>r</i><table><tbody><tr><td>q</td></tr></tbody></table><i>s</i>"),
        ("<table><tr><td><b>q<td>r</table>s", "<table><tbody><tr><td><b>q</b></td><td>r</td></tr></tbody></table>s"),
        ("<i><p>q</i>r", "<i></i><p><i>q</i>r</p>"),
        ("<u><div><s>q</u>r</s></div>", "<u></u><div><u><s>q</s></u><s>r</s></div>"),
        ("<tr><td>q", "q"),
        ("<table><col><td>q", "<table><colgroup><col></colgroup><tbody><tr><td>q</td></tr></tbody></table>"),
        ("<table><tr><td>q<table><tr><td>r</table>s", "<table><tbody><tr><td>q<table><tbody><tr><td>r</td></tr></tbody></table>s</td></tr></tbody></table>"),
        ("<h2>q<h3>r</h2>s", "<h2>q</h2><h3>r</h3>s"),
        ("<li>q<div>r<li>s", "<li>q<div>r</div></li><li>s</li>"),
        ("<ul><li>q<ul><li>r</ul><li>s</ul>", "<ul><li>q<ul><li>r</li></ul></li><li>s</li></ul>"),
        ("<svg><path/><g/>q</svg>r", "<svg><path></path><g></g>q</svg>r"),
        ("<span>q<div>r</span>s", "<span>q<div>rs</div></span>"),
        ("<form>q<form>r</form>s", "<form>qr</form>s"),
        ("<nobr>q<nobr>r", "<nobr>q</nobr><nobr>r</nobr>"),
        ("q</p>r</br>s", "q<p></p>r<br>s"),
        ("<b>q</i>r</b></b>s", "<b>qr</b>s"),
        ("<object><b>q</object>r", "<object><b>q</b></object>r"),
        ("<table> <tr> <td>q</td> </tr> </table>", "<table> <tbody><tr> <td>q</td> </tr> </tbody></table>"),
        ("<!-- c --><p>q<!-- d -->", "<p>q<!-- d --></p>"),
        ("", ""),
    ],
)
def test_trees(html, tree):
    assert inner_html(parse(html).body) == tree


def test_identical_elements_are_opened_three_times_at_most():
    assert inner_html(parse("<p><b><b><b><b><b>q<p>r").body) == "<p><b><b><b><b><b>q</b></b></b></b></b></p><p><b><b><b>r</b></b></b></p>"


def test_reopening_is_bounded():
    tags = "".join(f"<font color={i}>" for i in range(MOST_REOPENED + 10))
    depths = dom.signature(parse(f"<p>{tags}<p>x"))[1]
    assert sum(depths.values()) == 3 + 2 + 2 * MOST_REOPENED + 10


@pytest.mark.parametrize(
    "html",
    ["<b>", "<p><b>", "<a href=x>y", "<a><div>", "<div>", "<table><tr><td>", "<table>" + "<tr><td>x", "<i><div>", "<b><i>x</b>y</i>", "<p>row</p>", "<span><b></span>", "<ul><li>", "</b></div>"],
)
def test_many_elements_take_linear_time(html):
    parse(html * 100)
    begun = time.process_time()
    b = parse(html * 40_000)
    dom.page_text(b.body)
    dom.signature(b)
    assert time.process_time() - begun < 25


@pytest.mark.parametrize("html", ["<i>" + "<div>" * 40_000 + "</i>" * 40_000, "<x><div>" + "<span>" * 40_000 + "</x>" * 40_000, "<table>" + "x<b>" * 40_000, "".join(f"<font c={i}>" for i in range(40_000)), "<ul><li>" + "<div>" * 40_000 + "<li>" * 40_000])
def test_hostile_nesting_takes_linear_time(html):
    begun = time.process_time()
    dom.signature(parse(html))
    assert time.process_time() - begun < 25


def test_a_page_of_rows_in_one_go():
    page = "<html><body>" + "<p>row <a href='/r'>link</a></p>" * 40_000 + "</body></html>"
    begun = time.process_time()
    b = parse(page)
    assert dom.page_text(b.body).count("\n") == 39_999 and len(dom.links(b, "https://a.test/")) == 1
    assert time.process_time() - begun < 25
