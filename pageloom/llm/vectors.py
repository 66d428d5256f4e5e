"""Integer vectors in blocks, and the grid that holds a stated set of query rows against all blocks.

Rows are dealt into ordered ranges (groups), a group's rows are packed into blocks of BLOCK rows. Query rows travel in tiles: `grid` sends
every tile to the groups that it is meant for, a task holds one group (16,384 rows or some more) and streams the tiles past it, so no task
holds more than a group and a tile, and no pair of rows is ever a row of Spark's unless it is an answer's candidate.

Defined cases: a vector that is null or has a null or non-finite component takes no part; shorter vectors count as filled up with zeros;
integers and scores beyond a long stop at its ends; a null id is a row like others, after all ids in ties; repeated rows are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
GROUP = 16_384
#: A block or a tile: where it goes, its rows' ids (and labels), its integers in rows of `dim`, and two arrays that an operator adds.
SCHEMA = "grp int, kind int, seq long, ids array<long>, labels array<int>, dim int, form string, data binary, a array<long>, b array<long>"
_ARROW = pa.schema(
    [("grp", pa.int32()), ("kind", pa.int32()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("dim", pa.int32()), ("form", pa.string()), ("data", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]
)
LEAST, MOST = -(2**63), 2**63 - 1


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x as double; null where the vector takes no part."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def group_count(rows: DataFrame) -> int:
    """Groups of GROUP rows, more (down to a block each) where the cluster's cores would be idle otherwise."""
    n = rows.count()
    return max(1, min(math.ceil(n / BLOCK), max(math.ceil(n / GROUP), 3 * rows.sparkSession.sparkContext.defaultParallelism)))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of long as rows of a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def fit(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def dump(m: np.ndarray) -> tuple[str, bytes]:
    """The narrowest form that holds the integers, and their bytes."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    form = next(f for f in ("<i2", "<i4", "<i8") if np.iinfo(f).min <= low and high <= np.iinfo(f).max)
    return form, m.astype(form).tobytes()


def load(data: bytes, form: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, form).reshape(n, dim).astype(np.int64)


def magnitude(m: np.ndarray) -> int:
    return max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))


def number_type(bound: int) -> type:
    """Sums of products below 2**53 are exact in doubles; beyond that, Python's integers are taken."""
    return np.float64 if bound < 2**53 else object


def clipped(scores: np.ndarray) -> np.ndarray:
    """Whole numbers of any type as longs, those beyond at its ends."""
    return np.array([min(max(int(x), LEAST), MOST) for x in scores.ravel()], np.int64).reshape(scores.shape) if scores.dtype == object else scores.astype(np.int64)


def dealt(rows: DataFrame, groups: int, *order: str) -> DataFrame:
    """Rows in `groups` ordered ranges; rows that are equal in all of `order` are dealt out, too."""
    rows = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    return rows.repartitionByRange(groups, *order, "_salt").sortWithinPartitions(*order, "_salt")


def pack(rows: DataFrame, describe: Callable[[np.ndarray], tuple[str, bytes, np.ndarray | None, np.ndarray | None]]) -> DataFrame:
    """Blocks of rows (id, label, v) in the order in which they lie in their partitions, which are the groups. describe: form, data, a, b of a block's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            m = matrix(t.column("v"))
            form, data, a, b = describe(m)
            return pa.RecordBatch.from_pylist([{"grp": grp, "kind": 0, "seq": seq, "ids": t.column("id").to_pylist(), "labels": t.column("label").to_pylist(), "dim": m.shape[1], "form": form, "data": data, "a": a, "b": b}], _ARROW)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                t = pa.Table.from_batches(held)
                for i in range(0, n - BLOCK + 1, BLOCK):
                    yield block(t.slice(i, BLOCK))
                    seq += 1
                held, n = t.slice(n - n % BLOCK).to_batches(), n % BLOCK
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.select("id", "label", "v").mapInArrow(run, SCHEMA)


def row_key(grp: int, seq: int, place: np.ndarray) -> np.ndarray:
    """A number for each row of an index."""
    return (np.int64(grp) << 32) + seq * BLOCK + place


def tile_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def everywhere(tiles: DataFrame, groups: int) -> DataFrame:
    """Each tile once for each group."""
    return tiles.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def grid(blocks: DataFrame, tiles: DataFrame, groups: int, prepare: Callable[[list[dict]], object], score: Callable[[object, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """score(prepare(a group's blocks), tile) of every tile at the group that its grp names."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, blocks_, ready = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != grp:
                    grp, blocks_, ready = row["grp"], [], None
                if row["kind"] == 0:
                    blocks_.append(row)
                else:
                    if ready is None:
                        ready = prepare(blocks_)
                        blocks_ = []
                    yield from score(ready, row)

    rows = blocks.select(*columns).unionByName(tiles.select(*columns))
    return rows.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "kind", "seq").mapInArrow(run, schema)


def best(owner: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k first by score, then id (null ids last), then key; in that order."""
    order = np.lexsort((keys, ids, none, -score, owner))
    own = owner[order]
    start = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1] if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k]


def id_arrays(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for null, and which are null."""
    return np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], bool)
