"""Exact top-k search by block-at-a-time pruning.

The rows are laid out by the nearest of PIVOTS rows and by their likeness to it, so that a document-range block holds rows of one region.
A block is a forward index of its rows' integers with the largest and smallest value of each component (the terms' maxima, for weights of
either sign). For a query the blocks of a group are ordered by their summed maxima; they are scored in waves of 1, 1, 2, 4, ... blocks of
that order until the next bound is below the k-th score in hand. The k-th score starts with that among the query's own block, so that no
group begins from nothing. Blocks whose bound equals the k-th score are opened, since ties go to the smaller id.

PIVOTS rows, the first by hash of their ids, are what the driver sees of the vectors; they steer the layout only, no answer depends on them.
Defined cases are those of `vectors`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from ._common import written

PIVOTS = 64
_FOUND = "query_key long, query_id long, vec_id long, key long, score long"


def laid_out(rows: DataFrame, groups: int) -> DataFrame:
    """Rows (id, v) in groups of neighbours."""
    found = rows.select("id", "v").orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(PIVOTS).collect()
    pivots = V.matrix(pa.array([r["v"] for r in found], pa.list_(pa.int64()))).astype(np.float64)
    norms = np.maximum(np.sqrt((pivots**2).sum(1)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = V.matrix(batch.column("v")).astype(np.float64)
            dim = max(m.shape[1], pivots.shape[1])
            near = V.fit(m, dim) @ V.fit(pivots, dim).T / norms
            at = near.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(-near[np.arange(len(at)), at])], names=["id", "v", "pivot", "far"])

    return V.dealt(rows.select("id", "v").mapInArrow(run, "id long, v array<long>, pivot int, far double"), groups, "pivot", "far", "id")


def _described(m: np.ndarray) -> tuple[str, bytes, np.ndarray, np.ndarray]:
    """A block's forward index and its terms' maxima and minima."""
    return *V.dump(m), m.max(0, initial=V.LEAST), m.min(0, initial=V.MOST)


def _tiles(index: DataFrame, every: int, k: int) -> DataFrame:
    """Tiles of the rows whose id is divisible by `every`: a has their keys, b the k-th score among their own block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            dim = max(len(v) for _, v, _, _ in held)
            form, data = V.dump(np.stack([np.pad(v, (0, dim - len(v))) for _, v, _, _ in held]))
            keys, floors = ([x[i] for x in held] for i in (2, 3))
            return V.tile_rows([{"grp": 0, "kind": 1, "seq": held[0][2], "ids": [x[0] for x in held], "labels": None, "dim": dim, "form": form, "data": data, "a": keys, "b": floors}])

        for batch in batches:
            for row in batch.to_pylist():
                asked = np.array([i for i, x in enumerate(row["ids"]) if x is not None and x % every == 0], np.int64)
                if not len(asked):
                    continue
                m = V.load(row["data"], row["form"], row["dim"], len(row["ids"]))
                kind = V.number_type(V.magnitude(m) ** 2 * max(row["dim"], 1))
                scores = V.clipped(m[asked].astype(kind) @ m.T.astype(kind))
                keys = V.row_key(row["grp"], row["seq"], asked)
                for j, i in enumerate(asked):
                    others = np.delete(scores[j], i)
                    held.append((row["ids"][i], m[i], keys[j], int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else V.LEAST))
                    if len(held) == V.BLOCK:
                        yield tile()
                        held = []
        if held:
            yield tile()

    return index.mapInArrow(run, V.SCHEMA)


class _Group:
    """A group's blocks, ready to be asked."""

    def __init__(self, blocks: list[dict]) -> None:
        self.dim = max(b["dim"] for b in blocks)
        self.rows = [V.fit(V.load(b["data"], b["form"], b["dim"], len(b["ids"])), self.dim) for b in blocks]
        self.most = max(map(V.magnitude, self.rows))
        self.high, self.low = (np.stack([np.pad(np.array(b[c], np.int64), (0, self.dim - b["dim"])) for b in blocks]) for c in "ab")
        self.ids, self.none = map(list, zip(*(V.id_arrays(b["ids"]) for b in blocks), strict=True))
        self.keys = [V.row_key(b["grp"], b["seq"], np.arange(len(b["ids"]))) for b in blocks]


def _scored(k: int):  # noqa: ANN202
    def score(g: _Group, tile: dict) -> Iterator[pa.RecordBatch]:
        n = len(tile["ids"])
        dim = max(g.dim, tile["dim"])
        q = V.fit(V.load(tile["data"], tile["form"], tile["dim"], n), dim)
        kind = V.number_type(V.magnitude(q) * g.most * max(dim, 1))
        q = q.astype(kind)
        bounds = np.maximum(q, 0) @ V.fit(g.high, dim).T.astype(kind) + np.minimum(q, 0) @ V.fit(g.low, dim).T.astype(kind)
        bounds = V.clipped(bounds)
        order = np.argsort(~bounds, axis=1, kind="stable")  # ~x falls as x rises, and never overflows
        mine, kth = np.array(tile["a"], np.int64), np.array(tile["b"], np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query, score, null id, id, key
        at, width = 0, 1
        while at < len(g.rows):
            wave, at, width = order[:, at : at + width], at + width, at + width
            if not (np.take_along_axis(bounds, wave, 1) >= kth[:, None]).any():
                break
            got = [held]
            for b in np.unique(wave):
                ask = np.flatnonzero((wave == b).any(1) & (bounds[:, b] >= kth))
                if not len(ask):
                    continue
                s = V.clipped(q[ask] @ V.fit(g.rows[b], dim).T.astype(kind))
                i, j = np.nonzero((s >= kth[ask, None]) & (g.keys[b][None, :] != mine[ask, None]))
                got.append([ask[i], s[i, j], g.none[b][j], g.ids[b][j], g.keys[b][j]])
            held = [np.concatenate(x) for x in zip(*got, strict=True)]
            keep = V.best(*held, k)
            held = [x[keep] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=n) == k)
            last = np.searchsorted(held[0], full, side="right") - 1  # held is in order of queries, the k-th score is each one's last
            kth[full] = np.maximum(kth[full], held[1][last])
        own, s, none, ids, keys = held
        if len(own):
            names = np.array(tile["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mine[own]), pa.array(names[own]), pa.array(ids, mask=none), pa.array(keys), pa.array(s)], names=["query_key", "query_id", "vec_id", "key", "score"])

    return score


def top_k(rows: DataFrame, *, vec_id: str = "vec_id", vector: Column, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product with each row whose id is divisible by `every`.

    vector: the column of integers (array<long>, null where a row takes no part). All rows but the query itself are candidates; fewer than k
    rows give all of them, an empty table none. Other columns of `rows` aren't read.
    """
    sound = rows.select(F.col(vec_id).cast("long").alias("id"), vector.alias("v")).where("v is not null")
    groups = V.group_count(sound)
    index = written(V.pack(laid_out(sound, groups).withColumn("label", F.lit(None).cast("int")), _described), "forward-index")
    tiles = written(_tiles(index, every, k), "query-tiles")
    found = V.grid(index, V.everywhere(tiles, groups), groups, _Group, _scored(k), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
