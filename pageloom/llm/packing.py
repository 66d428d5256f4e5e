"""Best-fit packing with a bounded number of open bins.

Each task packs its pieces online: a piece goes into the open bin with the least free space that still holds it; free spaces are
the positions of set bits of one integer, so the search is a shift and a lowest-bit test. Beyond `open_bins` the fullest bin closes.
Bins that a task leaves open, with what they hold, are the items of the next round over fewer partitions (`fan_in` to one), until
one partition is left, whose bins all close. So the waste of many tasks doesn't add up, and no task holds more than its bins.

Defined results. A null or empty text is one piece, the end token alone. A document of more than `size` tokens is cut into pieces of
`size`, the last one shorter; full pieces are sequences of their own. Equal rows are packed each for itself; a null doc_id is kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import strings, written
from .bpe import as_bytes, word_split, worker_encoder


class Bins:
    """Open bins by free space."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.most, self.count, self.bits = size, open_bins, 0, 0
        self.by_free: dict[int, list[list]] = defaultdict(list)

    def _take(self, free: int) -> list:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def add(self, item: object, length: int) -> list[tuple[int, list]]:
        """Puts the item into a bin; gives the bins (used, items with their offsets) that close."""
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            free, held = self.size, []
            if self.count >= self.most and self.bits:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self.size - fullest, self._take(fullest)))
        held.append((item, self.size - free))
        left = free - length
        if left == 0:
            closed.append((self.size, held))
        else:
            self.by_free[left].append(held)
            self.bits |= 1 << left
            self.count += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [(self.size - free, b) for free in sorted(self.by_free) for b in self.by_free[free]]


def pieces(docs: DataFrame, path: str, *, size: int = 4096, end_id: int = 1, doc: str = "doc_id", text: str = "text", lexicon: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length int, ids_crc32 long (and ids binary, little-endian unsigned 32-bit). A lexicon saves merges, where one is at hand; the ids don't depend on it."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, word_split, shared.value, as_bytes)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * size
        for batch in batches:
            rows, parts = [], []
            for i, words in enumerate(encoder.texts(strings(batch.column(1)))):
                raw = b"".join(words) + end
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    parts.append(part)
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            at, *cols = list(zip(*rows, strict=True)) or [[]] * 5
            out = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(parts, pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(items: DataFrame, *, size: int = 4096, open_bins: int = 512, fan_in: int = 16, columns: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """columns, length long, sequence_id long, offset long. `items` has columns and `length` (1 to size)."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    held = ", ".join(f"`{c}`: {kinds[c]}" for c in (*columns, "length"))
    schema = f"closed boolean, sequence_id long, used int, at array<int>, items array<struct<{held}>>"

    def run(level: int, last: bool):  # noqa: ANN202
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            bins, made, base = Bins(size, open_bins), [0], (level << 56) + (TaskContext.get().partitionId() << 28)

            def out(closed: bool, bins_: list[tuple[int, list]]) -> pa.RecordBatch:
                flat = [[(x, off + a) for (xs, offs), off in b for x, a in zip(xs, offs, strict=True)] for _, b in bins_]
                ids = list(range(base + made[0], base + made[0] + len(bins_)))
                made[0] += len(bins_)
                return pa.RecordBatch.from_arrays(
                    [pa.array([closed] * len(bins_), pa.bool_()), pa.array(ids, pa.int64()), pa.array([u for u, _ in bins_], pa.int32()), pa.array([[a for _, a in f] for f in flat], pa.list_(pa.int32())), pa.array([[x for x, _ in f] for f in flat], item_kind[0])],
                    names=["closed", "sequence_id", "used", "at", "items"],
                )

            item_kind: list[pa.DataType] = []
            for batch in batches:
                item_kind[:] = [batch.schema.field("items").type]
                done: list[tuple[int, list]] = []
                for used, at, rows in zip(batch.column("used").to_pylist(), batch.column("at").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    done += bins.add((rows, at), used)
                if done:
                    yield out(True, done)
            if item_kind and (rest := bins.rest()):
                for i in range(0, len(rest), 256):
                    yield out(last, rest[i : i + 256])

        return packed

    todo = items.select(F.col("length").cast("int").alias("used"), F.array(F.lit(0)).alias("at"), F.array(F.struct(*columns, "length")).alias("items"))
    n, level, closed = todo.rdd.getNumPartitions(), 0, None
    while True:
        rounds = written(todo.mapInArrow(run(level, n == 1), schema), f"packed-{level}")
        closed = rounds.where("closed") if closed is None else closed.unionByName(rounds.where("closed"))
        if n == 1:
            break
        n, level = max(1, n // fan_in), level + 1
        todo = rounds.where("not closed").select("used", "at", "items").coalesce(n) if n > 1 else rounds.where("not closed").select("used", "at", "items").repartition(1)
    flat = closed.select("sequence_id", F.explode(F.arrays_zip("at", "items")).alias("z"))
    return flat.select(*[F.col(f"z.items.{c}").alias(c) for c in columns], F.col("z.items.length").cast("long").alias("length"), "sequence_id", F.col("z.at").cast("long").alias("offset"))
