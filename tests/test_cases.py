"""Every literal case against its operator, in one pass over its texts; plans that parse a page once; registered SQL for what SQL can say."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import dom
from pageloom.plans import cases, registry


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, name):
    f, rows = cases.CASES[name]
    n = len(rows[0]) - 1
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"t{k} string" for k in range(n))).coalesce(1)
    got = {r.i: r.result for r in df.select("i", f(*[F.col(f"t{k}") for k in range(n)]).alias("result")).collect()}
    assert got == {i: r[-1] for i, r in enumerate(rows)}


def test_a_page_is_parsed_once(spark):
    for query in (registry.flagship, registry.lnk1_links, registry.lnk2_link_types, registry.str1_structure, registry.txt1_page_text):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("PythonUDF") <= 2 and plan.count("run(html") == 1, plan


def test_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("<p>a</p>", "<div><p>b</p></div>"), ("", "<table><tr><td>x")], "a string, b string")
    p, q = (dom.projections(c, F.lit("u")) for c in ("a", "b"))
    df = df.select(p.alias("p"), q.alias("q"))
    s = lambda x, y: dom.similarity(F.col(f"{x}.tags"), F.col(f"{x}.depths"), F.col(f"{y}.tags"), F.col(f"{y}.depths"))
    for r in df.select(s("p", "q").alias("pq"), s("q", "p").alias("qp"), s("p", "p").alias("pp")).collect():
        assert r.pq == r.qp and r.pp == 1.0
