"""Bodies of all kinds in one pass, and how often a plan parses them."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom.operators.registry import Registry, Template
from pageloom.plans import mixed_queries, record_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(autouse=True, scope="module")
def whole_plans(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(2**28))
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")


@pytest.mark.parametrize("name", ["tpl1_shopify_product", "tpl2_shopify_collection", "tpl6_reddit_thread", "tpl9_stackoverflow", "tpl10_npm", "tpl17_nhtsa_vin", "tpl18_npi", "tpl11_greenhouse", "tpl15_recruitee"])
def test_a_body_is_parsed_once(spark, name):
    text = plan(record_queries.QUERIES[name](spark, SF))
    assert text.count("parseJson") == 1 and text.count("try_variant_get") == 1


def test_a_feed_is_parsed_once(spark):
    assert plan(record_queries.QUERIES["tpl16_teamtailor"](spark, SF)).count("from_xml") == 1


def test_all_kinds_are_read_in_one_pass(spark, tmp_path):
    mixed_queries.mixed_bodies(spark, SF).write.parquet(f"{tmp_path}/bodies")
    text = plan(Registry().run_all(spark.read.parquet(f"{tmp_path}/bodies")))
    assert text.count("Relation [") == 1 and text.count("parseJson") == 1 and "Join" not in text and "Aggregate" not in text


def test_rows_keep_their_columns_and_tell_what_went_wrong(spark):
    board = json.dumps({"jobs": [{"id": 7, "title": " T "}]})
    rows = [
        (1, board, "https://boards.greenhouse.io/acme", "f"), (2, "{", "https://boards.greenhouse.io/acme", None), (3, None, "https://boards.greenhouse.io/acme", None), (4, "x", "https://none.test/", None), (5, "x", None, None),
        (6, "x", "https://x.com/a/status/1", None), (7, "<p>x</p>", "https://github.com/o/r", "https://github.com/o/r"), (8, '<a class="topic-tag">t</a>', "https://github.com/o/r", "https://github.com/o/r/x"), (9, None, "https://github.com/o/r", None),
    ]
    df = spark.createDataFrame([(*r, "kept", "kept") for r in rows], "id int, body string, url string, at string, _template string, other string").drop("_template")
    got = {r.id: r for r in Registry().run_all(df, fetched_url="at", as_of=F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    assert len(got) == 9 and all(r.other == "kept" and r.extracted_at == "2024-01-02T03:04:05.000Z" for r in got.values())
    assert (got[1].template, got[1]["mode"], got[1].error, got[1].fetched_url) == ("greenhouse-jobs", "list", None, "f")
    assert json.loads(got[1].data.toJson())["items"][0]["title"] == "T"
    assert "did not return JSON" in got[2].error and "did not return JSON" in got[3].error and got[2].data is None
    assert got[4].error == "No template reads https://none.test/." and got[5].error == "No template reads an unknown address."
    assert "robots.txt" in got[6].error and got[6].template is None
    assert "extracted no data" in got[7].error and got[7].fetched_url is None
    assert got[8].error is None and json.loads(got[8].data.toJson())["topics"] == ["t"] and got[8].fetched_url == "https://github.com/o/r/x"
    assert "extracted no data" in got[9].error


def test_one_pass_gives_what_single_runs_give(spark):
    bodies = mixed_queries.mixed_bodies(spark, SF).where("kind in ('npm', 'post')")
    r = Registry()
    for kind, name in (("npm", "npm-package"), ("post", "reddit-thread")):
        one = r.run(bodies.where(F.col("kind") == kind), name).select("id", "error", F.to_json("data").alias("data"), "warnings")
        all_ = r.run_all(bodies.where(F.col("kind") == kind)).select("id", "error", F.to_json("data").alias("data"), "warnings")
        load = lambda df: {x.id: (x.error, {k: v for k, v in json.loads(x.data).items() if v is not None} if x.data else None, x.warnings) for x in df.collect()}
        assert load(one) == load(all_)


def test_injected_templates_take_part(spark):
    own = Template("own", "Own", "A test's reader.", r"own\.test", lambda b, u, p: F.struct(F.struct(F.upper(b).alias("text")).alias("data"), F.lit(None).cast("string").alias("error")))
    df = spark.createDataFrame([("abc", "https://own.test/products/x"), ("", "https://own.test/y")], "body string, url string")
    a, b = Registry([own]).run_all(df).collect()
    assert json.loads(a.data.toJson()) == {"text": "ABC"} and "extracted no data" in b.error


def test_no_rows(spark):
    assert Registry().run_all(spark.createDataFrame([], "body string, url string")).collect() == []


def test_texts_of_times_are_in_utc(spark):
    from pageloom.functions.scalars import epoch_iso, iso_date, iso_instant

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(
            epoch_iso(F.lit(-0.5)).alias("a"), iso_date(F.lit("2024-03-10 02:30:00 UTC")).alias("b"), iso_instant(F.expr("timestamp_millis(1709634030123)")).alias("c"), iso_date(F.lit("Tue, 05 Mar 2024 10:20:30 -0500")).alias("d"), epoch_iso(F.lit(None).cast("double")).alias("e")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("1969-12-31T23:59:59.500Z", "2024-03-10T02:30:00.000Z", "2024-03-05T10:20:30.123Z", "2024-03-05T15:20:30.000Z", None)
