"""Pages of like structure: all pairs whose similarity reaches a threshold, as links between classes of equal structure.

Pages with the same tags and the same elements per depth are one class, so that copies of a template cost nothing. A similarity of t or more
is the mean of two indexes, so the depths' weighted Jaccard index is 2 t - 1 or more: candidates are classes that agree in one of BANDS bands of
ROWS weighted min-hashes of their (depth, count) pairs, and whose numbers of elements differ by no more than that index allows. The latter
is part of the join's key, in steps of that ratio, which also splits the bands that many classes share. Candidates are verified by their whole
structures. The share of pairs at the limit that no band shows is (1 - (2 t - 1) ** ROWS) ** BANDS, 4e-10 for t = 0.9.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.bind import bind
from pageloom.operators import dom

BANDS, ROWS = 48, 4
#: Elements that are hashed at a time.
_CHUNK = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x changes half of the result's bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def minima(depths: dict[int, int], n: int) -> np.ndarray:
    """n min-hashes of the multiset of depths: an element is a depth with its number there, so that a share of minima agrees as the weighted Jaccard index says."""
    d, c = np.array(list(depths), np.uint64), np.array(list(depths.values()), np.int64)
    seeds = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.full(n, 2**64 - 1, np.uint64)
    of = np.repeat(d, c)
    number = (np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
    keys = _mixed((of << np.uint64(40)) + number + np.uint64(1))
    for i in range(0, len(keys), _CHUNK):
        np.minimum(out, _mixed(keys[i : i + _CHUNK, None] ^ seeds).min(0), out=out)
    return out


def band_keys(depths: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """A number for each band of the min-hashes."""

    def run(s: pd.Series) -> pd.Series:
        def one(m: dict | list) -> list[int]:
            h = minima(dict(m), bands * rows).reshape(bands, rows)
            key = np.zeros(bands, np.uint64)
            for r in range(rows):
                key = _mixed(key ^ h[:, r]) + np.uint64(r)
            return key.view(np.int64).tolist()

        return s.map(one)

    return F.pandas_udf(run, "array<bigint>")(depths)


def classes_of(pages: DataFrame) -> DataFrame:
    """pages with class, the digest of their structure; null where there is none."""
    entries = F.array_sort(F.map_entries("depths"))
    return pages.withColumn("class", F.md5(F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct("tags")), ","), F.to_json(entries))))


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _moved(side: DataFrame) -> DataFrame:
    """A side of a join that is dealt to tasks by the key, as the other one is, and neither goes through the driver.

    Pages that are made of keys come from a file of a few megabytes, and Spark takes what is made of its rows for as small: it would broadcast
    every page's class.
    """
    return side.hint("merge")


def similar_structures(pages: DataFrame, *, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links) of pages: page_id, tags, depths.

    members: page_id, class. classes: class, n_pages. links: a, b (a < b by class), similarity, of all pairs of different classes that reach
    the threshold. Pages without a structure (null tags or depths) belong to no class. The threshold must be above a half, since the depths
    alone have to be alike.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must lie above 0.5")
    least = 2 * threshold - 1
    # Dealt once and read again by all that follows, which names every column, so that Spark sees the same exchange: pages are parsed once.
    dealt = classes_of(pages.where("tags is not null and depths is not null").select("page_id", "tags", "depths")).repartition(_tasks(pages), "page_id", "class")
    members = bind(dealt, **{c: F.col(c) for c in ("page_id", "class", "tags", "depths")})
    classes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n_pages"), F.first("tags").alias("tags"), F.first(F.map_entries("depths")).alias("depths"))
    classes = bind(classes, n_pages=F.col("n_pages"), tags=F.col("tags"), depths=F.map_from_entries("depths"))
    total = F.aggregate(F.map_values("depths"), F.lit(0).cast("long"), lambda s, x: s + x)
    step = F.lit(0) if least >= 1 else F.floor(F.log(F.greatest(F.col("total"), F.lit(1))) / math.log(1 / least) + F.lit(1e-9)).cast("int")
    sized = bind(classes.select("class", "depths", total.alias("total")), keys=band_keys(F.col("depths"))).select("class", "total", step.alias("step"), F.posexplode("keys").alias("band", "key"))
    left = sized.select(F.col("class").alias("a"), F.col("total").alias("total_a"), "band", "key", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    right = sized.select(F.col("class").alias("b"), F.col("total").alias("total_b"), "band", "key", "step")
    fits = F.least("total_a", "total_b") >= F.lit(least - 1e-9) * F.greatest("total_a", "total_b")
    pairs = left.join(_moved(right), ["band", "key", "step"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    own = lambda x: classes.select(F.col("class").alias(x), F.col("tags").alias(f"tags_{x}"), F.col("depths").alias(f"depths_{x}"))
    both = pairs.join(_moved(own("a")), "a").join(_moved(own("b")), "b")
    alike = dom.similarity(F.col("tags_a"), F.col("depths_a"), F.col("tags_b"), F.col("depths_b"))
    links = bind(both, similarity=alike).where(F.col("similarity") >= F.lit(threshold - 1e-12)).select("a", "b", "similarity")
    return members.select("page_id", "class"), classes.select("class", "n_pages"), links


def similar_pages(pages: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    """A row per page: page_id, class, n_equal (other pages of its class) and n_links (pages of other classes that are similar to it)."""
    members, classes, links = similar_structures(pages, threshold=threshold)
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("e")).select("e.*")
    counts = ends.join(_moved(classes.select(F.col("class").alias("other"), "n_pages")), "other").groupBy("class").agg(F.sum("n_pages").alias("n_links"))
    found = classes.join(counts, "class", "left").select("class", (F.col("n_pages") - 1).alias("n_equal"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.join(_moved(found), "class").select("page_id", "class", "n_equal", "n_links")
