"""Helpers shared by the training-data operators: the shared folder, Arrow batches, heavy hitters."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts can be long, so that a batch of these stays well below 100 MB.
ROWS_PER_BATCH = 256


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory doesn't depend on the longest texts of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders and tables that the stage under way writes for itself, and those of the stage before it.
_NOTED: list[list[tuple[str, str | None]]] = []
_LEFT: list[tuple[str, str | None]] = []


def noted(at: str, name: str | None = None) -> None:
    if _NOTED:
        _NOTED[-1].append((at, name))


def delete(spark: SparkSession, at: str, name: str | None = None) -> None:
    """Deletes a folder of the shared folder, and the catalog's entry of its table."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage: when it begins, the result of the stage before is stored, so that what that one wrote for itself goes."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for at, name in _LEFT:
            delete(spark, at, name)
        _LEFT.clear()
        gc.collect()
        spark._jvm.System.gc()  # Spark drops the shuffle files of plans that are gone
        _NOTED.append([])
        try:
            return f(spark, docs, sf_dir)
        finally:
            _LEFT.extend(_NOTED.pop())

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/pageloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    noted(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """The values as Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def frequent_terms(texts: DataFrame, split: Callable[[str], list[str]], *, keep: int, per_task: int = 8192, at_least: int = 8, window: int = 400_000) -> dict[str, int]:
    """The `keep` most frequent terms of all texts (one string column) with their counts.

    Every text is read whole. A task counts its terms; whenever more than `window` distinct ones are held, those seen once
    since go (a lossy count, so memory is bounded), and at its end it emits at most `per_task` (term, count) rows. The sums
    are taken by Spark, and the driver receives `keep` rows at most. The result only steers caches: no answer depends on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) > window:
                seen = Counter(dict(seen.most_common(window // 4)))
        top = [(t, n) for t, n in seen.most_common(per_task) if n >= at_least and len(t) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["term", "n"])

    rows = texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.orderBy(F.desc("n"), "term").limit(keep).collect()}
