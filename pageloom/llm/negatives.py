"""Hard-negative mining by bit-sliced integer products.

A block holds its rows' integers as bit planes in two's complement. A candidate's product with an anchor is summed up from the sign plane
downwards: after each plane the lower planes can add at least (2**j - 1) times the anchor's negative components and at most as many times its
positive ones, so the score lies in an interval that halves with every plane. A pair is dropped as soon as its interval can't qualify:

* positives: its upper end is below the k-th largest of exact scores and lower ends of the anchor's label in hand;
* negatives: for each of the anchor's positives, its interval misses [low % of the positive's score, high % of it], or its upper end is below
  the k-th exact score that qualified for that positive.

While many pairs are alive a plane is one product of matrices; when few are, only theirs are taken up. Rows are laid out by label, so that
the search for positives visits the groups that hold an anchor's label, and no others.

Defined cases are those of `vectors`; a row without a label takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from ._common import written

#: Rows of a group that are worked on at a time; a share of alive pairs below which planes are taken pair by pair.
CHUNK, SPARSE = 2048, 0.2
_POSITIVES = "anchor_key long, anchor_id long, id long, key long, score long"
_NEGATIVES = "anchor_key long, anchor_id long, place int, id long, key long, score long"


def planes(m: np.ndarray) -> tuple[str, bytes]:
    """The bit planes of the integers' two's complement, the sign's first; the form is their number."""
    width = max(int(m.max(initial=0)).bit_length(), int(~m.min(initial=0)).bit_length()) + 1
    bits = (m[None].astype(np.int64) >> np.arange(width - 1, -1, -1)[:, None, None]) & 1
    return str(width), np.packbits(bits.astype(np.uint8).reshape(width, -1), axis=1).tobytes()


def plane_bits(data: bytes, form: str, dim: int, n: int) -> np.ndarray:
    """planes x rows x components of 0 and 1."""
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(int(form), -1), axis=1)[:, : n * dim].reshape(int(form), n, dim) if n * dim else np.zeros((int(form), n, dim), np.uint8)


def whole(bits: np.ndarray) -> np.ndarray:
    """The integers of bit planes."""
    weight = 1 << np.arange(len(bits) - 1, -1, -1, dtype=np.int64)
    weight[0] = -weight[0]
    return np.tensordot(weight, bits.astype(np.int64), 1)


class _Chunk:
    """Bit planes of up to CHUNK rows, widened to one number of planes."""

    def __init__(self, blocks: list[dict]) -> None:
        bits = [plane_bits(b["data"], b["form"], b["dim"], len(b["ids"])) for b in blocks]
        self.dim, self.width = max(b.shape[2] for b in bits), max(len(b) for b in bits)
        parts = []
        for b in bits:
            b = np.pad(b, ((0, 0), (0, 0), (0, self.dim - b.shape[2])))
            parts.append(np.concatenate([np.repeat(b[:1], self.width - len(b), axis=0), b]))  # more planes of the sign mean the same integers
        self.bits = np.concatenate(parts, axis=1)
        self.ids, self.none = map(np.concatenate, zip(*(V.id_arrays(b["ids"]) for b in blocks), strict=True))
        self.labels = np.concatenate([np.array(b["labels"], np.int64) for b in blocks])
        self.keys = np.concatenate([V.row_key(b["grp"], b["seq"], np.arange(len(b["ids"]))) for b in blocks])


def _chunks(blocks: list[dict]) -> list[_Chunk]:
    step = CHUNK // V.BLOCK
    return [_Chunk(blocks[i : i + step]) for i in range(0, len(blocks), step)]


def sliced(q: np.ndarray, chunk: _Chunk, alive: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Anchors' places, rows' places and exact scores of the pairs that stay alive to the last plane.

    q: the anchors' integers; alive: pairs to look at; narrow(i, j, low, high): which of the pairs (i, j) may stay, given their intervals;
    i and j are None while all pairs are looked at, then the ends are matrices.
    """
    dim = max(q.shape[1], chunk.dim)
    q = V.fit(q, dim)
    kind = V.number_type((V.magnitude(q) + 1) * max(dim, 1) << chunk.width)
    q = q.astype(kind)
    up, down = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    total, i, j = np.zeros(alive.shape, kind), None, None
    for p in range(chunk.width):
        bits = chunk.bits[p]
        if bits.shape[1] < dim:
            bits = np.pad(bits, ((0, 0), (0, dim - bits.shape[1])))
        rest = 2 ** (chunk.width - 1 - p)
        weight = -rest if p == 0 else rest
        if i is None:
            total = total + weight * (q @ bits.T.astype(kind))
            alive = alive & narrow(None, None, total + (rest - 1) * down[:, None], total + (rest - 1) * up[:, None])
            if alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                total = total[i, j]
        else:
            total = total + weight * (q[i] * bits[j]).sum(1)
            stay = narrow(i, j, total + (rest - 1) * down[i], total + (rest - 1) * up[i])
            i, j, total = i[stay], j[stay], total[stay]
    if i is None:
        i, j = np.nonzero(alive)
        total = total[i, j]
    return i, j, V.clipped(total)


def _anchors(tile: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(tile["ids"])
    return V.load(tile["data"], tile["form"], tile["dim"], n), np.array(tile["ids"], np.int64), np.array(tile["labels"], np.int64), np.array(tile["a"], np.int64)


def _positives(k: int):  # noqa: ANN202
    def score(chunks: list[_Chunk], tile: dict) -> Iterator[pa.RecordBatch]:
        q, names, labels, mine = _anchors(tile)
        kth, held = np.full(len(q), V.LEAST), [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 2
        for c in chunks:
            alike = (labels[:, None] == c.labels[None, :]) & (mine[:, None] != c.keys[None, :])
            if not alike.any():
                continue

            def narrow(i, j, low, high, alike=alike):  # noqa: ANN001, ANN202
                if i is None and alike.shape[1] >= k and low.dtype != object:
                    ends = np.where(alike, low, float(V.LEAST))
                    np.maximum(kth, np.partition(ends, ends.shape[1] - k, axis=1)[:, ends.shape[1] - k].astype(np.int64), out=kth)
                bar = kth.astype(high.dtype)
                return high >= (bar[:, None] if i is None else bar[i])

            i, j, s = sliced(q, c, alike, narrow)
            held = [np.concatenate(x) for x in zip(held, [i, s, c.none[j], c.ids[j], c.keys[j]], strict=True)]
            held = [x[keep] for keep in [V.best(*held, k)] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) == k)
            kth[full] = np.maximum(kth[full], held[1][np.searchsorted(held[0], full, side="right") - 1])
        own, s, none, ids, keys = held
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(mine[own]), pa.array(names[own]), pa.array(ids, mask=none), pa.array(keys), pa.array(s)], names=["anchor_key", "anchor_id", "id", "key", "score"])

    return score


def bounds(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer score s with low * positive <= 100 * s <= high * positive."""
    p = positive.astype(object)
    return V.clipped(-((-low * p) // 100)), V.clipped(high * p // 100)


def _negatives(k: int, low: int, high: int):  # noqa: ANN202
    def score(chunks: list[_Chunk], tile: dict) -> Iterator[pa.RecordBatch]:
        q, names, labels, mine = _anchors(tile)
        wanted = np.array(tile["b"], np.int64).reshape(-1, 3).T  # for each positive: the anchor's place in the tile, the positive's place at the anchor, its score
        owner, place = wanted[0], wanted[1]
        least, most = bounds(wanted[2], low, high)
        floor = least.copy()  # rises to the k-th score of each positive
        turns = [np.flatnonzero(place == x) for x in np.unique(place)]
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 2
        for c in chunks:
            other = labels[:, None] != c.labels[None, :]
            if not other.any():
                continue
            by_turn = []  # of the n-th positives: which anchors have a range left, its floor and its end
            for t in turns:
                has, f, m = np.zeros(len(q), bool), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
                has[owner[t]], f[owner[t]], m[owner[t]] = floor[t] <= most[t], floor[t], most[t]
                by_turn.append((has, f, m))

            def narrow(i, j, a, b, by_turn=by_turn):  # noqa: ANN001, ANN202
                out = np.zeros(a.shape, bool)
                for has, f, m in by_turn:
                    has, f, m = ((x[:, None] if i is None else x[i]) for x in (has, f.astype(a.dtype), m.astype(a.dtype)))
                    out |= has & (b >= f) & (a <= m)
                return out

            i, j, s = sliced(q, c, other, narrow)
            got = [held]
            for t in turns:
                at = np.full(len(q), -1)
                at[owner[t]] = t
                w = at[i]
                ok = (w >= 0) & (s >= floor[w]) & (s <= most[w])
                got.append([w[ok], s[ok], c.none[j[ok]], c.ids[j[ok]], c.keys[j[ok]]])
            held = [np.concatenate(x) for x in zip(*got, strict=True)]
            held = [x[keep] for keep in [V.best(*held, k)] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(owner)) == k)
            floor[full] = np.maximum(floor[full], held[1][np.searchsorted(held[0], full, side="right") - 1])
        w, s, none, ids, keys = held
        if len(w):
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine[owner[w]]), pa.array(names[owner[w]]), pa.array(place[w].astype(np.int32)), pa.array(ids, mask=none), pa.array(keys), pa.array(s)], names=["anchor_key", "anchor_id", "place", "id", "key", "score"]
            )

    return score


def _described(m: np.ndarray) -> tuple[str, bytes, None, None]:
    return *planes(m), None, None


def _tiles(index: DataFrame, every: int) -> DataFrame:
    """Tiles of anchors of one label each; a has their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            dim = max(len(x[2]) for x in held)
            form, data = V.dump(np.stack([np.pad(x[2], (0, dim - len(x[2]))) for x in held]))
            return V.tile_rows([{"grp": 0, "kind": 1, "seq": held[0][3], "ids": [x[0] for x in held], "labels": [x[1] for x in held], "dim": dim, "form": form, "data": data, "a": [x[3] for x in held], "b": None}])

        for batch in batches:
            for row in batch.to_pylist():
                asked = np.array([i for i, x in enumerate(row["ids"]) if x is not None and x % every == 0], np.int64)
                if not len(asked):
                    continue
                m = whole(plane_bits(row["data"], row["form"], row["dim"], len(row["ids"])))
                for i, key in zip(asked, V.row_key(row["grp"], row["seq"], asked), strict=True):
                    if held and (len(held) == V.BLOCK or held[0][1] != row["labels"][i]):
                        yield tile()
                        held = []
                    held.append((row["ids"][i], row["labels"][i], m[i], int(key)))
        if held:
            yield tile()

    return index.mapInArrow(run, V.SCHEMA)


def _with_positives(tiles: DataFrame, positives: DataFrame) -> DataFrame:
    """Tiles whose b says which scores their anchors' positives have; anchors without positives have none to mine for."""
    at = tiles.select("seq", F.posexplode("a").alias("at", "anchor_key")).join(positives.select("anchor_key", "place", "score"), "anchor_key")
    triple = F.array(F.col("at").cast("long"), F.col("place").cast("long"), "score")
    return tiles.drop("b").join(at.groupBy("seq").agg(F.flatten(F.collect_list(triple)).alias("b")), "seq")


def hard_negatives(rows: DataFrame, *, vec_id: str = "vec_id", label: Column, vector: Column, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`, their positives the first `positives` other rows of their label by integer inner
    product (ties by id), and each positive's negatives the first `negatives` rows of other labels whose score lies between `low` and `high`
    hundredths of the positive's; fewer give all of them. Other columns of `rows` aren't read.
    """
    sound = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("int").alias("label"), vector.alias("v")).where("v is not null and label is not null")
    groups = V.group_count(sound)
    index = written(V.pack(V.dealt(sound, groups, "label", "id"), _described), "bit-planes")
    tiles = written(_tiles(index, every), "anchor-tiles")
    homes = index.select("grp", F.explode("labels").alias("home")).distinct()
    near = tiles.withColumn("home", F.element_at("labels", 1)).drop("grp").join(homes, "home").drop("home")
    found = V.grid(index, near, groups, _chunks, _positives(positives), _POSITIVES)
    order = Window.partitionBy("anchor_key").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    first = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    asked = written(_with_positives(tiles, first), "mining-tiles")
    mined = V.grid(index, V.everywhere(asked, groups), groups, _chunks, _negatives(negatives, low, high), _NEGATIVES)
    order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = first.select("anchor_key", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_key", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
