"""Many queries against many texts: documents with the benchmark's items, orders with questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import highlights
from pageloom.operators.ranking import rank_queries


def _unit(text: Column, offset: Column) -> Column:
    return F.struct(text.alias("text"), F.lit("sentence").alias("kind"), offset.alias("offset"), F.char_length(text).alias("length"), F.lit(None).cast("string").alias("heading"))


def _longest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about the longest word of each benchmark item."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")
    longest = F.array_min(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))["w"]
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Who wrote "), longest, F.lit(", and when?")).alias("query"))


def hlt7_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best lines of every document for a question about each benchmark item."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _unit), lambda u: F.regexp_like(u["text"], F.lit("[a-zA-Z]")))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", lines.alias("units"))
    return rank_queries(documents, _longest_words(spark, sf_dir), max_units=2).select("query_id", "doc_id", "rank", "offset", "score")


def hlt7_benchmark_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the texts' own units, cut by the segmenter."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", highlights.segment_units(F.col("text")).alias("units"))
    return rank_queries(documents, _longest_words(spark, sf_dir), max_units=2).select("query_id", "doc_id", "rank", "kind", "offset", "score")


def hlt8_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for a maker or a time about the orders of each customer; the answers are told in other words, with names and years or without."""
    k = F.col("o_orderkey")
    verb = F.element_at(F.array(*[F.lit(w) for w in ("designed", "launched", "invented", "released", "drawn", "published")]), (k % 6 + 1).cast("int"))
    tail = F.when(k % 3 == 0, " by Anna van Vale.").when(k % 3 == 1, F.concat(F.lit(" in "), F.year("o_orderdate").cast("string"), F.lit("."))).otherwise(" by nobody.")
    text = F.concat(F.lit("Order "), (k % 50).cast("string"), F.lit(" was "), verb, tail)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.struct(k.alias("k"), text.alias("text")).alias("x"))
    units = F.transform(F.array_sort(F.collect_list("x")), lambda x, i: _unit(x["text"], i))
    documents = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(units.alias("units"))
    n = F.col("n_nationkey")
    question = F.when(n % 3 == 0, F.concat(F.lit("Who created order "), n.cast("string"), F.lit("?"))).when(n % 3 == 1, F.concat(F.lit(" When was order "), n.cast("string"), F.lit(" released? "))).otherwise(F.lit("which year was it"))
    queries = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.cast("long").alias("query_id"), question.alias("query"))
    return rank_queries(documents, queries, max_units=3).select("query_id", "doc_id", "rank", "offset", "score")


QUERIES = {f.__name__: f for f in (hlt7_benchmark, hlt7_benchmark_units, hlt8_orders)}

_STEM = "CASE WHEN length({x}) <= 4 THEN {x} ELSE CASE WHEN length(regexp_replace({x}, '(?:ing|ed|es|s)$', '')) > 4 THEN regexp_replace(regexp_replace({x}, '(?:ing|ed|es|s)$', ''), 'e$', '') ELSE regexp_replace({x}, '(?:ing|ed|es|s)$', '') END END"
_TOKENS = "list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: " + _STEM.format(x="x") + ")"
_MAKE = "'create','creator','creation','design','designer','conceive','invent','inventor','develop','developer','found','founder','author','wrote','written'"
_RELEASE = "'release','launch','publish','debut','appear','introduce','unveil'"


def _ranked(units: str, queries: str, most: int) -> str:
    """units: doc_id, pos, t; queries: query_id, query."""
    forms = lambda words: f"list_distinct(list_transform(flatten(list_transform([{words}], lambda w: [w, w || 'd', w || 'ed'])), lambda x: {_STEM.format(x='x')}))"
    return rf"""
WITH units AS ({units}), queries AS ({queries}),
u AS (SELECT doc_id, pos, t, {_TOKENS.format(t='t')} AS toks FROM units),
d AS (SELECT *, greatest(len(toks), 4)::DOUBLE AS dl, count(*) OVER w AS n, avg(greatest(len(toks), 4)::DOUBLE) OVER w AS mean FROM u WINDOW w AS (PARTITION BY doc_id)),
k AS (SELECT doc_id, pos, t, dl, n, mean, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, pos, t, dl, n, mean, unnest(toks) AS token FROM d) GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS df FROM k),
q AS (SELECT query_id, trim(lower(query)) AS phrase, list_filter({_TOKENS.format(t='query')}, lambda x: NOT list_contains(['a','an','and','are','as','at','be','been','by','can','did','do','does','for','from','had','has','have','how','i','in','is','it','its','me','of','on','or','that','the','their','ther','this','to','was','were','what','when','wher','which','who','whom','whos','why','will','with','you','your'], x)) AS kept FROM queries),
g AS (SELECT query_id, phrase, unnest(kept) AS term FROM q),
s AS (SELECT query_id, phrase, term, term AS token, 1.0::DOUBLE AS weight FROM g
  UNION ALL SELECT query_id, phrase, term, o AS token, 0.5 FROM (SELECT query_id, phrase, term, unnest(CASE WHEN list_contains({forms(_MAKE)}, term) THEN {forms(_MAKE)} WHEN list_contains({forms(_RELEASE)}, term) THEN {forms(_RELEASE)} END) AS o FROM g) WHERE o <> term),
p AS (SELECT query_id, phrase, doc_id, pos, t, term, max(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS part FROM s JOIN f USING (token) GROUP BY ALL),
m AS (SELECT query_id, phrase, doc_id, pos, t, sum(part) AS total FROM p GROUP BY ALL),
r AS (SELECT query_id, doc_id, pos, floor(total * CASE WHEN regexp_matches(phrase, '\bwho(?:m|se)?\b') AND regexp_matches(t, '(?:^|[^A-Za-z0-9_])\p{{Lu}}\p{{Ll}}+(?:\s+(?:(?:van|von|de|der|den|da|di|du|le|la|bin|al)\s+)?\p{{Lu}}\p{{Ll}}+)+') THEN 1.3 ELSE 1 END
  * CASE WHEN regexp_matches(phrase, '\bwhen\b|\b(?:what|which) year\b') AND regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])(?:(?:1[5-9][0-9][0-9]|20[0-9][0-9])s?|january|february|march|april|may|june|july|august|september|october|november|december)(?:$|[^A-Za-z0-9_])') THEN 1.3 ELSE 1 END
  * CASE WHEN contains(lower(t), phrase) THEN 1.5 ELSE 1 END * 1000 + 0.5) / 1000 AS score FROM m),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pos) AS rank FROM r WHERE score > 0)
SELECT query_id, doc_id, rank::INT AS rank, pos::INT AS "offset", score FROM z WHERE rank <= {most}"""


SQL = {
    "hlt7_benchmark": _ranked(
        "SELECT * FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents) WHERE regexp_matches(t, '[a-zA-Z]')",
        "SELECT item_id AS query_id, 'Who wrote ' || list_min(list_transform(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: {'n': -length(w), 'w': w})).w || ', and when?' AS query FROM benchmark", 2,
    ),
    "hlt8_orders": _ranked(
        """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 'Order ' || o_orderkey % 50 || ' was ' || (['designed', 'launched', 'invented', 'released', 'drawn', 'published'])[o_orderkey % 6 + 1]
          || CASE o_orderkey % 3 WHEN 0 THEN ' by Anna van Vale.' WHEN 1 THEN ' in ' || year(o_orderdate) || '.' ELSE ' by nobody.' END AS t FROM orders""",
        "SELECT n_nationkey::BIGINT AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'Who created order ' || n_nationkey || '?' WHEN 1 THEN ' When was order ' || n_nationkey || ' released? ' ELSE 'which year was it' END AS query FROM nation", 3,
    ),
}
