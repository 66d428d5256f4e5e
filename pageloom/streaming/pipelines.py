"""Structured Streaming around the document operators.

All of them work on a row at a time and keep no state, so that a stream is the same plan as a table. Only what counts over time keeps state:
windows of event time behind a watermark, which drops what is later than it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pageloom.functions import verdict
from pageloom.operators import dom, pii


def read_stream(spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def documents(pages: DataFrame, *keep: str, html: str = "html", url: str = "url", status: Column | None = None) -> DataFrame:
    """Pages that are documents and not walls, as redacted text. Works on tables and on streams."""
    p = pages.select(*keep, url, html, dom.projections(html, url).alias("p"))
    good = p.where(verdict.verdict(F.col(url), F.col("p.title"), F.col("p.text"), F.col(html), F.lit(200) if status is None else status)["success"])
    return good.select(*keep, url, "p.title", pii.redact_pii(F.col("p.text")).alias("r")).select(*keep, url, "title", "r.text", F.col("r.count").alias("n_redacted"))


def windowed_counts(rows: DataFrame, time: str, key: str, *, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows by key and window of event time; rows later than the watermark don't count in a stream."""
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return rows.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Rows to Parquet, each batch exactly once."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
