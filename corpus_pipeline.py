"""The corpus pipeline: quality classifier, near-duplicate removal, substring dedup, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but
the last return the columns of `documents`. A null doc_id is a document without a number: near copies of it are found, in the other stages
it is kept and linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm._common import stage, table, tune, written
from pageloom.llm.cotrain import classify
from pageloom.llm.jaccard import jaccard_components
from pageloom.llm.packing import pack, pieces
from pageloom.llm.queries import vocabulary
from pageloom.llm.substring import drop_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    tune(spark)
    return classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("keep").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (a null id is the largest); of rows that repeat it, one.

    A document is a doc_id with a text (null is the empty text), known by their 64-bit hash: rows of one id with texts that aren't linked all stay.
    """
    tune(spark)
    rows = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("node"), *COLUMNS)
    if not rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        one = rows.groupBy("node").agg(F.min(F.struct(*COLUMNS)).alias("r"))  # a task merges its own rows first, so that a hot id is dealt out as a row per task
        rows = written(one.select("node", "r.*"), "rows")
    groups = jaccard_components(rows.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = rows.select("node", "doc_id").join(groups, "node").groupBy("component_id").agg(F.min(order).alias("r")).select("r.node")
    return rows.join(first, "node", "left_semi").select(*COLUMNS)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier document's window of 50 words go; texts without such words stay as they are. Documents of which the last word so goes, go, too; empty and null texts stay."""
    tune(spark)
    out = drop_repeats(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return out.where("n_removed = 0 or n_removed < n_words").select(
        "doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece with its place."""
    tune(spark)
    return pack(pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [("quality_classifier", quality), ("jaccard_join", near_duplicates), ("substring_dedup", substrings), ("best_fit_packing", packing)]

#: A trained classifier and online packing are no SQL: the tests hold the stages against brute force, the classifier against its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir), f"stage-{name}")
    return docs
