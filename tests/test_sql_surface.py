"""Table functions against the columns that give the same as arrays, native SQL functions against their operators."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import dom, embedded, highlights, tables
from pageloom.plans import cases, table_functions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    return table_functions.register(spark)


@pytest.fixture(scope="module")
def texts(spark):
    rows = sorted({r[0] for _, rows in cases.CASES.values() for r in rows if isinstance(r[0], str)})
    return spark.createDataFrame([*((i, t, rows[-1 - i]) for i, t in enumerate(rows)), (-1, None, None)], "i int, t string, o string").repartition(2).cache()


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_rows_of_pages(spark, names):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html", "url")
    read = pages.select("page_id", dom.projections("html", "url").alias("p"))
    got = spark.sql("SELECT page_id, l.* FROM {p}, LATERAL page_links_of(html, url) AS l", p=pages)
    same(got, read.select("page_id", F.posexplode("p.links").alias("pos", "l")).select("page_id", "pos", "l.*"))
    assert got.count() > 100
    got = spark.sql("SELECT page_id, depth, n FROM {p}, LATERAL page_depths_of(html)", p=pages)
    same(got, read.select("page_id", F.explode("p.depths").alias("depth", "n")))
    got = spark.sql("SELECT page_id, c.* FROM {p}, LATERAL cells_of(html) AS c", p=pages)
    same(got, pages.select("page_id", F.explode(tables.table_cells(F.col("html"))).alias("c")).select("page_id", "c.*"))
    got = spark.sql("SELECT page_id, s.* FROM {p}, LATERAL state_of(html) AS s", p=pages)
    same(got, pages.select("page_id", F.explode(embedded.embedded_state(F.col("html"))["sources"]).alias("s")).select("page_id", "s.name", "s.variable", "s.json", "s.bytes", "s.note"))


def test_rows_of_texts(spark, names):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = spark.sql("SELECT doc_id, u.* FROM {d}, LATERAL units_of(text) AS u", d=documents)
    same(got, documents.select("doc_id", F.explode(highlights.segment_units(F.col("text"))).alias("u")).select("doc_id", "u.*"))
    spans = spark.sql("SELECT doc_id, substring(text, start + 1, stop - start) AS said, entity FROM {d}, LATERAL redactions_of(text)", d=documents)
    assert spans.where("entity = 'EMAIL' AND NOT contains(said, '@')").isEmpty() and spans.count() > 0


def test_rows_of_json_and_streams(spark, names):
    assert [tuple(r) for r in spark.sql("""SELECT * FROM json_paths_of('{"a":{"Id":1},"b":[{"id":[2]}]}', 'id', 9)""").collect()] == [("a.Id", "1", True), ("b.0.id", "[2]", True)]
    assert [tuple(r) for r in spark.sql("""SELECT * FROM stream_rows_of('1:{"a":1}\n2:T2,hi')""").collect()] == [("1", '{"a":1}'), ("2", '"hi"')]
    assert spark.sql("SELECT * FROM units_of(NULL)").count() == 0 and spark.sql("SELECT * FROM json_paths_of('{', 'a', 1)").count() == 0


@pytest.mark.parametrize("name", sorted(n for n, (_, kinds) in table_functions.NATIVE_FUNCTIONS.items() if set(kinds) <= {"STRING", "BINARY"} and len(kinds) <= 3))
def test_native_functions_are_their_operators(spark, names, texts, name):
    f, kinds = table_functions.NATIVE_FUNCTIONS[name]
    of = ["t", "o", "t"][: len(kinds)]
    typed = [f"cast({c} AS BINARY)" if k == "BINARY" else c for c, k in zip(of, kinds, strict=True)]
    want = texts.select("i", f(*[F.expr(x) for x in typed]).alias("r"))
    same(spark.sql(f"SELECT i, {name}({', '.join(typed)}) AS r FROM {{texts}}", texts=texts), want)


def test_other_native_functions(spark, names):
    row = spark.sql("SELECT epoch_iso(0.5D) AS e, npi_name('', 'Dr.', 'Ann', '--', 'Lee', '') AS n, page_verdict('u', 'Not Found', 'x', '', 200).success AS v, depth_similarity(map(1, 1), map(1, 2)) AS d").first()
    assert tuple(row) == ("1970-01-01T00:00:00.500Z", "Dr. Ann Lee", False, 0.5)


def test_a_native_function_is_compiled_with_its_query(spark, names):
    plan = spark.sql("SELECT safe_href(t) FROM VALUES ('x') AS v(t)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_quoted_texts_stay_as_they_are():
    assert table_functions._OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", r"CASE WHEN and(=(a, 'x=(\'or('), !(b)) THEN <=(c, 1) END") == r"CASE WHEN `and`(`=`(a, 'x=(\'or('), `!`(b)) THEN `<=`(c, 1) END"
