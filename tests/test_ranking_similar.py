"""Ranking with a table of queries against ranking one query at a time; similar pages against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import highlights, similar
from pageloom.operators.ranking import query_terms, rank_queries
from pageloom.plans import page_queries

TEXTS = [
    "# Python\nThe designer of Python, Guido van Rossum, began in 1989. It was released in February 1991. Snakes sleep.\n\n## References\n* [Who created it](http://a.test/x) by Ann Lee\n* notes",
    "Blue whales swim. A blue whale is big! Whales, whales and blue fish. Nothing else here.",
    "東京は日本の首都です。京都は古い都です。Tokyo is a city.",
    "| year | what |\n|---|---|\n| 1999 | launch of the boat |\n| 2001 | boat sold |",
    "", None, "the of and", "no match here at all",
]
QUERIES = ["Who created Python and when was it released?", " blue whale ", "首都", "the", "", None, "when did the boat launch", "which year", "x" * 50, "blue  whale"]


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return df.select("doc_id", highlights.segment_units(F.col("text")).alias("units"), F.lit("x").alias("rank")).cache()


@pytest.mark.parametrize("most", [2, 10])
def test_a_table_of_queries_gives_what_single_queries_give(spark, documents, most):
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    got = {}
    for r in rank_queries(documents, queries, max_units=most).collect():
        got.setdefault((r.query_id, r.doc_id), []).append((r["rank"], r["offset"], r["text"], r["score"]))
    want = {}
    for i, q in enumerate(QUERIES):
        for r in documents.select("doc_id", highlights.rank_units(F.col("units"), q or "", max_units=most).alias("r")).collect():
            if r.r:
                want[i, r.doc_id] = [(k + 1, u["offset"], u["text"], u["score"]) for k, u in enumerate(r.r)]
    assert len(want) > 8
    assert {k: sorted(v) for k, v in got.items()} == want


def test_min_score_and_empty_tables(spark, documents):
    queries = spark.createDataFrame([(1, "blue whale")], "query_id long, query string")
    every = [r.score for r in rank_queries(documents, queries).collect()]
    assert [r.score for r in rank_queries(documents, queries, min_score=min(every)).collect()] == [s for s in every if s > min(every)]
    assert rank_queries(documents.limit(0), queries).count() == 0
    assert rank_queries(documents, queries.limit(0)).count() == 0


def test_native_terms_are_those_of_the_driver(spark):
    rng = random.Random(4)
    words = ["creating", "released", "wrote", "houses", "the", "who", "Ünïcode", "日本語", "x1", "mañana", "O'Neil", "a-b", "ﬁne", "co-founder", "classes", "ー々", "한국어", "été"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    got = {}
    for r in query_terms(df).collect():
        got.setdefault(r.query_id, {}).setdefault(r["place"], {})[r["token"]] = r["weight"]
    for i, t in enumerate(texts):
        want = highlights.terms_of(t.lower())
        assert [{k for k, w in got[i][p].items() if w == 1.0} for p in sorted(got[i])] == [{t} for t in want]
        assert [{k for k, w in got[i][p].items() if w != 1.0} for p in sorted(got[i])] == [set(o) for o in want.values()]


def pairs_of(rows, threshold):
    def weighted(x, y):
        keys = {*x, *y}
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys) if keys else 1.0

    def alike(a, b):
        if not a[1] or not b[1]:
            return float(not a[1] and not b[1])
        s, t = set(a[1]), set(b[1])
        return (len(s & t) / len(s | t) + weighted(a[2], b[2])) / 2

    return {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if alike(a, b) >= threshold - 1e-12}


def links_of(spark, rows, threshold):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, tags array<string>, depths map<int,int>, class string").drop("class")
    members, _, links = similar.similar_structures(df, threshold=threshold)
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], []).append(r["page_id"])
    got = {tuple(sorted(p)) for ids in of.values() for p in itertools.combinations(ids, 2)}
    return got | {tuple(sorted(p)) for r in links.collect() for p in itertools.product(of[r.a], of[r.b])}, df


@pytest.mark.parametrize("threshold", [0.8, 0.9, 1.0])
def test_similar_structures_find_all_pairs(spark, threshold):
    rng = random.Random(8)
    base = [(["a", "b", "html", "p", *rng.sample("cdefghijk", 4)], {d: rng.randint(1, 60) for d in range(1, 8)}) for _ in range(12)]
    rows = []
    for i in range(260):
        tags, depths = rng.choice(base)
        depths = {d: max(1, c + rng.choice([0, 0, 0, 1, -1, 3])) for d, c in depths.items()}
        rows.append((i, sorted(tags if rng.random() < 0.7 else [*tags, "z"]), depths))
    rows += [(900, [], {}), (901, [], {}), (902, None, None), (903, ["html"], {1: 1}), (904, ["html"], {1: 1})]
    want = pairs_of([r for r in rows if r[1] is not None], threshold)
    got, df = links_of(spark, rows, threshold)
    assert len(want) > 1 and got == want
    per = {r.page_id: r.n_equal + r.n_links for r in similar.similar_pages(df, threshold=threshold).collect()}
    assert per == {r[0]: sum(r[0] in p for p in want) for r in rows if r[1] is not None}


def test_similar_pages_of_a_table_find_all_pairs(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.tags, r.depths) for r in page_queries._structures(pages, "page_id").collect()]
    assert links_of(spark, rows, 0.9)[0] == pairs_of(rows, 0.9)


def test_thresholds_and_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, tags array<string>, depths map<int,int>")
    assert similar.similar_pages(df).collect() == []
    with pytest.raises(ValueError, match="above 0.5"):
        similar.similar_structures(df, threshold=0.5)


def test_minima_agree_as_the_index_says():
    a, b = {1: 40, 2: 60}, {1: 50, 2: 50}
    share = (similar.minima(a, 4000) == similar.minima(b, 4000)).mean()
    assert abs(share - 90 / 110) < 0.03
    assert (similar.minima({1: 10_000}, 8) == np.minimum(similar.minima({1: 5000}, 8), similar.minima({1: 10_000}, 8))).all()


def test_a_pair_is_parsed_once_a_page(spark):
    from pageloom.plans import cases

    plan = cases.QUERIES["str_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 2
