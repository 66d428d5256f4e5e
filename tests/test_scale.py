"""What grows with the input: tasks of rows that much is made of, walks of a page, memory of a worker."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import bind
from pageloom.operators import dom, highlights, markup, pages
from pageloom.plans import registry

SF = "/root/testdata/sf0.001"
MADE = ["tpl3_amazon", "tpl4_github", "tbl1_grid", "str_similarity", "tpl3_made_products", "tpl4_made_repos", "tpl5_made_videos", "tbl1_made_grids", "str1_made_pages", "sql_links", "sql_cells", "tpl10_npm"]


@pytest.mark.parametrize("name", MADE)
def test_rows_of_a_small_file_are_dealt_over_all_cores(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_mixed_bodies_are_dealt_over_all_cores(spark):
    from pageloom.plans.mixed_queries import mixed_bodies

    assert mixed_bodies(spark, SF).rdd.getNumPartitions() >= 12 * spark.sparkContext.defaultParallelism


def test_a_page_is_walked_once_for_all_selectors(monkeypatch):
    walked, walk = [], markup.Node.walk
    monkeypatch.setattr(markup.Node, "walk", lambda n: walked.append(n.name) or walk(n))
    page = markup.parse('<span id="productTitle">x</span><span class="a-price"><span class="a-offscreen">$1.00</span></span>').root
    assert pages._amazon(page, "u")["price"] == "$1.00"
    assert walked.count("#document") == 1


def test_selected_elements_come_in_order_and_once():
    page = markup.parse('<p class="b a b">1</p><div id=x><p title=q>2</p></div><p class=a>3</p>').root
    assert page.texts("p.a, [title], #x p, *.b") == ["1", "2", "3"]
    assert [n.name for n in page.all("#x, [TITLE], p")] == ["p", "div", "p", "p"]
    assert page.one("#y") is None


def test_plain_fragments_read_as_by_the_parser():
    parts = ["<p>", "</p>", "<b>", "</b>", '<a href="&gt;">', "</a>", "<li>", "<ul>", "</ul>", "<br>", "<h1>", "</h2>", "&amp;", "&lt", "&am", " x ", "\n", "y", ">", '"', "<dd>"]
    rnd = random.Random(1)
    for _ in range(500):
        h = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        whole = "".join(n.text() for n in markup.parse(f"<div>{h}</div>").root.walk() if n.name == "div")
        assert markup.text_of(h) == (markup.collapse(whole) or None), h


def test_plain_fragments_need_no_tree(monkeypatch):
    monkeypatch.setattr(markup, "parse", None)
    assert markup.text_of("<p>a &amp; <b>b</b></p>") == "a & b"
    assert markup.text_of("<p>&lt;b&gt;x", escaped=True) == "x"


def test_workers_hold_a_piece_of_a_batch(spark):
    def size(s):
        return s.map(lambda _, n=len(s): n)

    sizes = spark.range(0, 3000, 1, 1).select(bind.piecewise(size, "long", 1)("id").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == bind.PIECE and sizes.count() == 3000
    pages_ = spark.createDataFrame([("<p>a</p>", "u")], "html string, url string")
    for c in (dom.projections("html", "url"), highlights.segment_units(F.col("html"))):
        assert ", 204" in pages_.select(c)._jdf.queryExecution().executedPlan().toString()  # by iterator


def test_pieces_keep_rows_apart(spark):
    texts = [None, "", *[f"One {i}. Two." for i in range(700)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", highlights.segment_units(F.col("t"))["text"].alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: [f"One {i - 2}.", "Two."] if i > 1 else [] for i in range(len(texts))}


def test_a_unit_is_scored_once(spark):
    """Filters on a score must not bring copies of it along."""
    plan = registry.QUERIES["hlt8_orders"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(lower(") == 1
