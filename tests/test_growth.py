"""What must not grow with a group's size: pages, bodies, what the driver holds."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.functions.bind import bind
from pageloom.operators import similar
from pageloom.plans import made_queries, page_queries, record_queries


@pytest.fixture
def one_brand(spark, tmp_path):
    """1,000 parts of one brand (one has no name) and 3 of none."""
    k = F.col("id")
    rows = spark.range(1003).select(k.alias("p_partkey"), F.when(k != 5, F.concat(F.lit("n"), k.cast("string"))).alias("p_name"), F.when(k < 1000, "B").alias("p_brand"), F.lit("T").alias("p_type"), (k % 50 + 1).cast("int").alias("p_size"), (k + 0.5).alias("p_retailprice"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_a_front_page_holds_what_comes_first(spark, one_brand):
    df = made_queries.tpl7_made_front_pages(spark, one_brand)
    assert "WindowGroupLimit [p_brand" in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.p_brand or "", r.pos, int(r.id)) for r in df.collect())
    assert got == [("", i, 1000 + i) for i in range(3)] + [("B", i, i + (i >= 5)) for i in range(30)]


def test_a_collection_comes_in_bodies_of_bounded_size(spark, one_brand, monkeypatch):
    bodies, run = [], record_queries.REGISTRY.run_list
    monkeypatch.setattr(record_queries.REGISTRY, "run_list", lambda df, name: bodies.append(df) or run(df, name))
    got = record_queries.tpl2_shopify_collection(spark, one_brand).collect()
    each = [len(json.loads(r.body)["products"]) for r in bodies[0].collect()]
    assert sum(each) == 1003 and len(each) == 5 and max(each) < 400
    assert sorted((r.p_brand or "", int(r.product_id), r["count"], r.limit, r.has_more) for r in got) == [("", i, 3, 3, True) for i in range(1000, 1003)] + [("B", i, 1000, 1000, True) for i in range(1000)]


def test_pages_of_a_small_file_dont_go_through_the_driver(spark, one_brand):
    """Only what a stage has shown to be small may be broadcast, not what a file's size lets Spark guess."""
    assert "BroadcastExchange" not in page_queries.str2_made_links(spark, one_brand)._jdf.queryExecution().executedPlan().toString()


def test_pages_are_parsed_once_for_classes_and_members(spark, one_brand):
    """All that is made of the pages reads the same exchange."""
    counted = spark.sparkContext.accumulator(0)

    def structure(ids):
        for s in ids:
            counted.add(len(s))
            yield pd.DataFrame({"tags": [["a"] * (1 + i % 3) for i in s], "depths": [{1: 1 + i % 7} for i in s]})

    read = F.pandas_udf(structure, "struct<tags: array<string>, depths: map<int,int>>", functionType=F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    pages = bind(spark.range(500), p=read("id")).select(F.col("id").alias("page_id"), "p.tags", "p.depths")
    assert similar.similar_pages(pages).count() == 500 and counted.value == 500
