"""DataFrame interfaces: registry runs, bodies from files, streams against tables, SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom.operators.registry import TEMPLATES, Registry, Template, items
from pageloom.plans import functions
from pageloom.sources import body
from pageloom.streaming import pipelines


def test_runs_give_envelopes_and_errors_as_rows(spark):
    rows = [("<p>x</p>", "https://github.com/o/r", "https://github.com/o/r/x"), ('<span itemprop="programmingLanguage">C</span>', "https://github.com/o/r", "https://github.com/o/r"), (None, None, None)]
    df = spark.createDataFrame(rows, "body string, url string, fetched string")
    out = Registry().run(df, "github-repo", fetched_url="fetched", as_of=F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()
    assert "extracted no data" in out[0].error and out[0].data is None and out[0].fetched_url == "https://github.com/o/r/x"
    assert out[1].error is None and out[1].data.name == "r" and out[1].fetched_url is None and out[1].extracted_at == "2024-01-02T03:04:05.000Z"
    assert out[2].error is not None
    with pytest.raises(ValueError, match="Unknown template"):
        Registry().run(df, "nope")
    with pytest.raises(ValueError, match="returns a list"):
        Registry().run(df, "ashby-jobs")
    with pytest.raises(ValueError, match="single entity"):
        Registry().run_list(df, "github-repo")


def test_templates_can_be_injected(spark):
    own = Template("own", "Own", "A test's reader.", r"own\.test", lambda b, u, p: F.struct(F.struct(F.upper(b).alias("text")).alias("data"), F.lit(None).cast("string").alias("error")), requires_api_key=True, credential_ref="OWN_KEY")
    r = Registry([own, *TEMPLATES])
    df = spark.createDataFrame([("abc", "https://own.test/products/x")], "body string, url string")
    assert r.run(df, "own").first().data.text == "ABC"
    assert df.select(r.detect(F.col("url"))).first()[0] == "own"
    assert r.list(spark).where("requires_api_key").first().credential_ref == "OWN_KEY"


def test_lists_and_empty_tables(spark):
    board = json.dumps({"jobs": [{"id": 7, "title": " T ", "offices": None, "content": None}], "meta": {"total": 9}})
    df = spark.createDataFrame([(board, "u"), ("{", "u"), ("{}", "u"), (None, "u"), ('{"jobs": []}', "u")], "body string, url string")
    out = Registry().run_list(df, "greenhouse-jobs")
    rows = out.collect()
    assert rows[0].data.total_available == 9 and rows[0].data["items"][0]["id"] == "7" and rows[0].data["items"][0]["title"] == "T"
    assert ["did not return JSON" in (r.error or "") for r in rows] == [False, True, False, True, False]
    assert rows[4].data["count"] == 0 and rows[4].error is None
    assert items(out.where("error is null")).count() == 1
    assert Registry().run_list(df.limit(0), "npi-provider").count() == 0


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<meta charset="windows-1252">caf\xe9'.encode("latin-1"))
    (tmp_path / "b.html").write_bytes(b"x" * 100)
    rows = {r.path.rsplit("/", 1)[1]: r for r in body.read_files(spark, str(tmp_path), max_bytes=99).collect()}
    assert rows["a.html"].text.endswith("café") and rows["a.html"].error is None
    assert rows["b.html"].text is None and rows["b.html"].error.size == 100
    df = spark.createDataFrame([(bytearray(b"ab"), {"Content-Length": "500"}), (bytearray(b"ab"), {"content-type": "text/html; charset=utf-16"}), (None, None)], "body binary, headers map<string,string>")
    got = body.read_body(df, max_bytes=2).collect()
    assert got[0].error.size == 500 and got[0].text is None
    assert (got[1].error, got[1].charset) == (None, "utf-16") and got[2].text is None


def test_streams_give_what_tables_give(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = pipelines.documents(pipelines.read_stream(spark, f"{tmp_path}/in", pages.schema, files_per_trigger=1), "page_id")
    pipelines.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination(120)
    want = pipelines.documents(pages, "page_id")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    counts = pipelines.windowed_counts(pages.withColumn("at", F.timestamp_seconds(F.col("page_id") * 60)).withColumn("k", F.lit("x")), "at", "k")
    assert counts.agg(F.sum("n")).first()[0] == pages.count()


def test_sql_functions(spark):
    assert "page_text" in functions.register(spark)
    row = spark.sql("""SELECT page_text('<p>a</p>b') AS t, html_text('<b>x</b>') AS h, size(page_links('<a href="/q">l</a>', 'https://a.test/')) AS n, absolute_url('x', 'https://a.test/') AS u,
        size(segment_units('One. Two.')) AS s, json_select('{"a":[1]}', 'a[0]') AS j, embedded_state('<script>__STATE__={"a":1}</script>').sources[0].json AS e, redact_pii('a@b.example') AS r, page_text(NULL) AS z""").first()
    assert (row.t, row.h, row.n, row.u, row.s, row.j, row.e, row.r, row.z) == ("a\nb", "x", 1, "https://a.test/x", 2, "1", '{"a":1}', "<EMAIL>", None)
