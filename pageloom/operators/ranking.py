"""Ranking with a table of queries: the units of every document that answer each query best.

Tokens are rows. A document's statistics (how many units, their mean length) are taken while its units are still one array; then every token
that some query asks for becomes a row per document with the list of the units that hold it, so that a document's own frequency of a token is
the size of a list. Query terms meet these lists on the token; scores of a unit are summed where the unit's text is, since both are dealt by
document and unit; the best units of each document and query are a window that needs its k first rows only.

What grows: rows are (query, unit) pairs that share a term, which is the result before it is cut to the best. Tokens that no query asks for are
dropped by a semi join before anything is shuffled, where Spark finds the queries' terms small enough to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.bind import bind
from pageloom.functions.scalars import strip
from pageloom.operators import highlights as H


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, phrase, wants (patterns of the answers asked for), place, token, weight: the terms of each query in their order, and the words that stand for them.

    Stop words are terms only where there is nothing else. Blank queries have no terms, nor have null ones.
    """
    phrase = F.lower(strip(F.col("query")))
    stop = F.array(*[F.lit(w) for w in sorted({H._stem(w) for w in H.STOPWORDS})])
    groups = [sorted({H._stem(v) for w in g for v in (w, f"{w}d", f"{w}ed")}) for g in H.SYNONYMS]
    every = F.array_distinct(H.tokenize(F.col("phrase")))
    kept = F.array_except(F.col("every"), stop)
    others = lambda t: F.coalesce(*[F.when(t.isin(g), F.array(*[F.lit(w) for w in g])) for g in groups], F.array().cast("array<string>"))
    pair = lambda at, t, w: F.struct(at.alias("place"), t.alias("token"), F.lit(w).alias("weight"))
    one = lambda t, i: F.concat(F.array(pair(i, t, 1.0)), F.transform(F.array_remove(others(t), t), lambda o: pair(i, o, H.SYNONYM_WEIGHT)))
    who, when = F.col("phrase").rlike(r"\bwho(?:m|se)?\b"), F.col("phrase").rlike(r"\bwhen\b|\b(?:what|which) year\b")
    wants = F.array_compact(F.array(F.when(who, H.PERSON), F.when(when, H.DATE)))
    said = queries.select("query_id", phrase.alias("phrase")).withColumn("every", every).withColumn("terms", F.when(F.size(kept) > 0, kept).otherwise(F.col("every")))
    return said.select("query_id", "phrase", wants.alias("wants"), F.explode(F.flatten(F.transform("terms", one))).alias("t")).select("query_id", "phrase", "wants", "t.*")


def _tokens(documents: DataFrame) -> DataFrame:
    """A row per unit and token: doc_id, unit, token, tf and held; a heading's token counts by half, and not as held. With them go the document's number of units, their mean length and the unit's. Each unit is cut into tokens once."""

    def read(u: Column) -> Column:
        own = H.tokenize(H.visible(F.coalesce(u["text"], F.lit(""))))
        above = F.array_distinct(H.tokenize(H.visible(F.coalesce(u["heading"], F.lit("")))))
        return F.struct(own.alias("own"), F.array_except(above, own).alias("above"))

    length = lambda x: F.greatest(F.size(x["own"]) + H.HEADING_WEIGHT * F.size(x["above"]), F.lit(H.MIN_LENGTH))
    cut = bind(documents.select("doc_id", "units"), read=F.transform("units", read)).select("doc_id", "read", F.transform("read", length).alias("lengths"))
    mean = F.aggregate("lengths", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("lengths"), F.lit(0))
    rows = cut.select("doc_id", F.size("read").alias("n"), mean.alias("mean"), "lengths", F.posexplode("read").alias("unit", "r"))
    said = lambda c, tf, held: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(tf).alias("tf"), F.lit(held).alias("held")))
    every = F.concat(said("r.own", 1.0, 1), said("r.above", H.HEADING_WEIGHT, 0))
    return rows.select("doc_id", "unit", "n", "mean", F.get("lengths", F.col("unit")).alias("length"), F.explode(every).alias("t")).select("doc_id", "unit", "n", "mean", "length", "t.*")


def _lists(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, token, n, mean, df, holding: the units that hold a token, of the tokens that are asked for."""
    counted = tokens.join(asked, "token", "left_semi").groupBy("doc_id", "unit", "n", "mean", "length", "token").agg(F.sum("tf").alias("tf"), F.max("held").alias("held"))
    return counted.groupBy("doc_id", "token").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum("held").alias("df"), F.collect_list(F.struct("unit", "tf", "length")).alias("holding"))


def rank_queries(documents: DataFrame, queries: DataFrame, *, max_units: float = 10, min_score: float = 0) -> DataFrame:
    """query_id, doc_id, rank, and a unit's text, kind, offset, length, heading, score: the best units of each document for each query.

    documents: doc_id (unique, null is an id like others) and units, as `segment_units` gives them; queries: query_id (unique) and query.
    Scores are those of `rank_units`: BM25 over the document's own units, words that stand for a term at half its weight, more for units
    with the kind of answer that is asked for or with the whole phrase, less for references; rounded to three places before they are held
    against min_score. Ties go to the smaller offset.
    """
    limit = max(1, math.floor(max_units)) if math.isfinite(max_units) else 10
    floor = min_score if math.isfinite(min_score) else 0
    terms = query_terms(queries)
    lists = _lists(_tokens(documents), terms.select("token").distinct())
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = terms.join(lists, "token").select("query_id", "phrase", "wants", "place", "weight", "doc_id", "mean", idf.alias("idf"), F.explode("holding").alias("h"))
    tf, length = F.col("h.tf"), F.col("h.length")
    part = F.col("weight") * F.col("idf") * (tf * (H.K1 + 1)) / (tf + H.K1 * (1 - H.B + H.B * length / F.col("mean")))
    parts = found.select("query_id", "phrase", "wants", "doc_id", F.col("h.unit").alias("unit"), F.struct("place", part.alias("part")).alias("p"))
    # A unit has as many parts for a query as the query has words, so they can be gathered. Sorted, a term's last part is its best; these are summed in the order of the terms.
    begin = F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("part"), F.lit(0.0).alias("total"))
    add = lambda s, p: F.struct(p["place"].alias("place"), p["part"].alias("part"), F.when(s["place"] == p["place"], s["total"]).otherwise(s["total"] + s["part"]).alias("total"))
    total = F.aggregate(F.array_sort(F.collect_list("p")), begin, add, lambda s: s["total"] + s["part"])
    dealt = parts.repartition("doc_id", "unit").groupBy("doc_id", "unit", "query_id").agg(F.first("phrase").alias("phrase"), F.first("wants").alias("wants"), total.alias("total"))
    texts = documents.select("doc_id", F.posexplode("units").alias("unit", "u"))
    both = dealt.withColumnRenamed("doc_id", "_doc").withColumnRenamed("unit", "_unit")
    both = both.join(texts, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_unit") == F.col("unit")))
    shown = H.visible(F.coalesce(F.col("u.text"), F.lit("")))
    # Patterns are literals, so that they are compiled once, and a score is bound: filters on it would each bring a copy of it along.
    answers = lambda p: F.when(F.array_contains("wants", F.lit(p)) & F.col("shown").rlike(p), H.ANSWER_BOOST).otherwise(1.0)
    score = F.col("total") * (answers(H.PERSON) * answers(H.DATE))
    score = score * F.when(F.contains(F.lower("shown"), F.col("phrase")), H.PHRASE_BOOST).otherwise(1.0)
    score = score * F.when(H.is_reference(F.coalesce(F.col("u.text"), F.lit("")), F.col("u.heading")), H.REFERENCE_WEIGHT).otherwise(1.0)
    rounded = F.floor(score * 1000 + 0.5) / 1000
    scored = bind(bind(both, shown=shown), score=rounded).select("query_id", "doc_id", "u", "score").where((F.col("score") > 0) & (F.col("score") > floor))
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "u.offset"))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank", "u.text", "u.kind", "u.offset", "u.length", "u.heading", "score")
