"""Removal of long repeated passages by recompression.

A text is a sequence of words. Rounds of recompression name stretches of it: the first names maximal runs of 2 to 4 equal words, each later
one names pairs of neighbouring symbols of which the left has class 0 and the right class 1 (a bit of their names). A name is a hash of what
it stands for, so that equal stretches have equal names in every task and no naming table is needed; in the interior of equal substrings the
symbols are the same. Spark rounds go from the highest symbols to the lowest, and each looks only at windows that no round before decided:

1. texts: equal texts are one symbol. Only the smallest document of a text takes part in the next rounds; the others lose every window;
2. high: after 14 rounds a symbol has some 50 words. The windows that start in it form one class, named by the symbol and verified by the
   words under these windows. Where a smaller document has the class, all of them are repeats: a long repeat costs a few rows;
3. low: after three rounds a symbol has 8 words at most and depends on 12 words on either side. Within a window of 50 words the symbols that
   begin at its words 12 to 30 are therefore the same wherever the window occurs; the one of least priority is the window's anchor. Its
   windows are consecutive. The class is named by the 32 words that they share and verified by all words under them;
4. windows: where a key of round 3 has several classes, the windows are named one by one.

The smallest document that has a window never has it decided, so that it takes part in every round: each window is decided exactly, but
for collisions (two independent 64-bit hashes of each word, one in the names, the other in what verifies them).

A round works by blocks. A task numbers the classes of a block of documents (bounded by `BLOCK`) and writes the block's table of classes,
and per document the numbers. Only the tables are joined with the classes of all documents; the verdicts come back to the block. A class
that a third of all documents have thus costs a row per block, not per document, and no task gathers its documents.

Defined results. Null, empty and blank texts have no words: nothing is removed and kept is empty. Rows with equal ids don't remove each other's
words. A row of a null id is kept whole and removes nothing. Other columns are ignored unless asked for. Whole texts are read, however long;
they are hashed in pieces of `PIECE` windows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written
from .jaccard import _K, bucketed, mix

#: Words in a window; of context on either side; possible starts of its anchor. They hang together as the module's text says.
WINDOW, CONTEXT, STARTS = 50, 12, 19
KEY = WINDOW - STARTS + 1  # 32 words: CONTEXT before the anchor, the rest from it
#: Windows that are hashed at once; classes in a block's table, those of its last text excepted.
PIECE, BLOCK = 200_000, 131_072
#: The most words of a symbol after each round.
LOW, HIGH = (4, 8), (4, 8, 16, 32, 64, *[128] * 9)
_ODD = [int(_K[0]) | 1, int(_K[2]) | 1]
_INVERSE = [pow(x, -1, 2**64) for x in _ODD]
_MOST = np.uint64(2**64 - 1)


class WordHashes(dict):
    """The two 64-bit hashes of words; when more than `held` words are known, it starts anew."""

    def __init__(self, held: int = 250_000) -> None:
        super().__init__()
        self.held, self.digests = held, bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.digests) // 16
        self.digests += xxhash.xxh3_128_digest(word)
        return k

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.held:
            self.clear()
            self.digests = bytearray()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        both = np.frombuffer(self.digests, "<u8").reshape(-1, 2)
        return both[at, 0], both[at, 1]


class Powers:
    """Powers of the two bases and their inverses, as long as the longest sequence so far."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, [], []

    def to(self, n: int) -> Powers:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            table = lambda b: np.concatenate([[np.uint64(1)], np.full(self.n, b, np.uint64)]).cumprod(dtype=np.uint64)
            self.up, self.down = [table(b) for b in _ODD], [table(b) for b in _INVERSE]
        return self


def symbols(w: np.ndarray, rounds: tuple[int, ...], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, names) of the symbols after these rounds; none reaches over a place of `begins`, where a text begins."""
    n = len(w)
    cut = np.zeros(n, bool)
    cut[begins] = True
    differs = np.concatenate([[True], w[1:] != w[:-1]]) | cut
    edge = np.flatnonzero(differs)
    length = np.diff(np.append(edge, n))
    start = np.ones(n, bool)
    short = (length >= 2) & (length <= 4)
    for k in (1, 2, 3):
        start[edge[short & (length > k)] + k] = False
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    name = mix(w[at] * _K[0] + size.astype(np.uint64))
    for r, most in enumerate(rounds):
        salt = _K[1] + _K[3] * np.uint64(r)
        kind = (mix(name ^ salt) & np.uint64(1)).astype(bool)
        merge = np.flatnonzero(~kind[:-1] & kind[1:] & (size[:-1] + size[1:] <= most) & ~cut[at[1:]])
        if len(merge):
            name[merge] = mix(name[merge] * _K[2] + name[merge + 1] + salt)
            keep = np.ones(len(at), bool)
            keep[merge + 1] = False
            at, name = at[keep], name[keep]
            size = np.diff(np.append(at, n))
    return at, name


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class Words:
    """The words of some pieces of texts, one after the other, with what it takes to hash any stretch of them."""

    def __init__(self, words: list[bytes], begins: list[int], hashes: WordHashes, powers: Powers) -> None:
        self.n, self.begins = len(words), np.array(begins)
        self.w = hashes.of(words)
        self.p = powers.to(self.n)
        self.sums = [np.concatenate([[np.uint64(0)], (mix(w ^ k) * up[: self.n]).cumsum(dtype=np.uint64)]) for w, k, up in zip(self.w, (_K[1], _K[4]), self.p.up, strict=True)]

    def hash(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words a to b (excluded)."""
        return mix((self.sums[which][b] - self.sums[which][a]) * self.p.down[which][a])

    def runs(self, level: str, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, verifier, first window, last window) of each run of consecutive windows of `use` (one flag a word) that have one symbol."""
        q = np.flatnonzero(use)
        if level == "windows" or not len(q):
            return self.hash(0, q, q + WINDOW), self.hash(1, q, q + WINDOW), q, q
        if level == "high":
            at, name = symbols(self.w[0], HIGH, self.begins)
            owner = np.searchsorted(at, q, "right") - 1
        else:
            at, name = symbols(self.w[0], LOW, self.begins)
            best = np.full(self.n, _MOST, np.uint64)
            best[at] = (mix(name ^ _K[4]) & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
            for step in (1, 2, 4, 8):
                best = np.minimum(best[:-step], best[step:])
            best = np.minimum(best[: -(STARTS - 16)], best[STARTS - 16 :])  # the least of 19
            owner = (best[q + CONTEXT] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (q[1:] != q[:-1] + 1)]))
        first, last, mine = q[new], q[np.append(new[1:], len(q)) - 1], owner[new]
        place = at[mine] if level == "high" else mine
        spread = mix((place - first + WINDOW).astype(np.uint64) * _K[0] + (last - first).astype(np.uint64))
        key = name[mine] if level == "high" else self.hash(0, mine - CONTEXT, mine - CONTEXT + KEY)
        return key, self.hash(1, first, last + WINDOW) ^ spread, first, last


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


_BLOCKS = "block long, no int, a long, b long, low long, high long, name binary, doc long, nos binary, firsts binary, lasts binary"


class Blocks:
    """Numbers the classes of documents: a block is a table of classes (no, a, b, smallest and largest document) and the numbers of each piece of a text."""

    def __init__(self) -> None:
        self.block = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.a, self.b, self.first, self.last, self.who, self.n = [], [], [], [], [], 0

    def add(self, name: bytes, doc: int, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        if len(a):
            for to, x in ((self.a, a), (self.b, b), (self.first, first.astype(np.int32)), (self.last, last.astype(np.int32))):
                to.append(x)
            self.who.append((name, doc, len(a)))
            self.n += len(a)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        a, b, first, last = (np.concatenate(x) for x in (self.a, self.b, self.first, self.last))
        d = np.repeat(np.array([x[1] for x in self.who], np.int64), [x[2] for x in self.who])
        order = np.lexsort((d, b, a))
        sa, sb, sd = a[order], b[order], d[order]
        new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
        nos = np.empty(len(a), np.int32)
        nos[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        top = np.append(at[1:], len(a)) - 1
        self.block += 1
        schema = pa.schema([("block", pa.int64()), ("no", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "low", "high")), ("name", pa.binary()), ("doc", pa.int64()), *((c, pa.binary()) for c in ("nos", "firsts", "lasts"))])
        for k in range(0, len(at), 16_384):
            s = slice(k, k + 16_384)
            m = len(at[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.block)), pa.array(np.arange(k, k + m, dtype=np.int32)), _longs(sa[at[s]]), _longs(sb[at[s]]), _longs(sd[at[s]]), _longs(sd[top[s]]), *(pa.nulls(m, schema.field(i).type) for i in range(6, 11))], schema=schema)
        ends = np.cumsum([0, *(x[2] for x in self.who)]).tolist()
        for k in range(0, len(self.who), 256):
            some = self.who[k : k + 256]
            m = len(some)
            cuts = list(zip(ends[k : k + m], ends[k + 1 : k + m + 1], strict=True))
            binaries = [pa.array([x[s:e].tobytes() for s, e in cuts], pa.binary()) for x in (nos, first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.block)), *(pa.nulls(m, schema.field(i).type) for i in range(1, 6)), pa.array([x[0] for x in some], pa.binary()), pa.array([x[1] for x in some], pa.int64()), *binaries], schema=schema)
        self.clear()


def _spans(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed, "<i4").reshape(-1, 2) if packed else np.zeros((0, 2), np.int32)


def name_classes(texts: DataFrame, level: str) -> DataFrame:
    """The blocks of texts (name, doc, text, spans). spans: windows (first, last) that are decided already, at level windows those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers, blocks = WordHashes(), Powers(), Blocks()
        words: list[bytes] = []
        pieces: list[tuple] = []

        def work() -> Iterator[pa.RecordBatch]:
            if pieces:
                begins = [x[3] for x in pieces]
                use = np.zeros(len(words), bool)
                for _, _, base, begin, n, spans in pieces:
                    use[begin : begin + n] = level != "windows"
                    for first, last in spans.tolist():
                        if last >= base and first < base + n:
                            use[begin + max(0, first - base) : begin + min(n, last + 1 - base)] = level == "windows"
                a, b, first, last = Words(words, begins, hashes, powers).runs(level, use)
                cuts = np.searchsorted(first, [*begins, len(words)])
                for (name, doc, base, begin, _, _), s, e in zip(pieces, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    blocks.add(name, doc, a[s:e], b[s:e], first[s:e] - begin + base, last[s:e] - begin + base)
                words.clear()
                pieces.clear()
                if blocks.n >= BLOCK:
                    yield from blocks.flush()

        for batch in batches:
            for name, doc, text, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = words_of(text)
                windows, spans = len(mine) - WINDOW + 1, _spans(packed)
                for base in range(0, max(windows, 0), PIECE):
                    n = min(PIECE, windows - base)
                    pieces.append((name, doc, base, len(words), n, spans))
                    words += mine[base : base + n + WINDOW - 1]
                    if len(words) >= PIECE:
                        yield from work()
        yield from work()
        yield from blocks.flush()

    return written(texts.select("name", "doc", "text", "spans").mapInArrow(run, _BLOCKS), f"blocks-{level}")


def verdicts(blocks: DataFrame, level: str) -> DataFrame:
    """block, no, least (the smallest document of the class), several (whether its key has other classes): of classes that matter to their block."""
    classes = blocks.where("no is not null").select("block", "no", "a", "b", "low", "high")
    if level == "low":
        keys = classes.groupBy("a").agg(F.min("low").alias("x"), F.max("high").alias("z"), (F.min("b") != F.max("b")).alias("several")).where("x < z").select("a", "several")
        classes = written(classes.join(keys, "a"), "shared-keys")
    else:
        classes = classes.withColumn("several", F.lit(False))
    least = classes.groupBy("a", "b").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    if level != "low":
        least = least.where("least < most")
    return classes.join(least.select("a", "b", "least"), ["a", "b"]).where("several or least < high").select("block", "no", "least", "several")


def decide(blocks: DataFrame, level: str) -> DataFrame:
    """name, spans, asked: per text the windows (first, last) that a smaller document has, and those that are to be named one by one."""
    found = verdicts(blocks, level)
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda t: F.lit(None).cast(t)
    left = found.select("block", F.lit(0).alias("ref"), "no", "least", "several", none("binary").alias("name"), none("long").alias("doc"), *[none("binary").alias(c) for c in ("nos", "firsts", "lasts")])
    refs = blocks.where("no is null").join(found.select("block").distinct(), "block", "left_semi")
    right = refs.select("block", F.lit(1).alias("ref"), none("int").alias("no"), none("long").alias("least"), none("boolean").alias("several"), "name", "doc", "nos", "firsts", "lasts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = None, []
        low = several = np.zeros(0)
        for batch in batches:
            out: list[tuple] = []
            which = np.asarray(batch.column(0))
            ref = np.asarray(batch.column(1)).astype(bool)
            edges = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (ref[1:] != ref[:-1])])) if len(which) else []
            for s, e in zip(edges, [*edges[1:], len(which)], strict=True):
                part = batch.slice(s, e - s)
                if which[s] != block:
                    block, table, low = which[s], [], None
                if not ref[s]:
                    table.append((np.asarray(part.column(2)), np.asarray(part.column(3)), part.column(4).to_numpy(zero_copy_only=False)))
                    continue
                if low is None:
                    no = np.concatenate([x[0] for x in table])
                    low, several = np.full(no.max() + 1, np.iinfo(np.int64).max), np.zeros(no.max() + 1, bool)
                    low[no], several[no] = np.concatenate([x[1] for x in table]), np.concatenate([x[2] for x in table]).astype(bool)
                for name, doc, *packed in zip(*(part.column(i).to_pylist() for i in range(5, 10)), strict=True):
                    nos, first, last = (np.frombuffer(x, "<i4") for x in packed)
                    known = nos < len(low)
                    nos, first, last = nos[known], first[known], last[known]
                    gone = low[nos] < doc
                    asked = several[nos] & ~gone
                    if gone.any() or asked.any():
                        out.append((name, *(np.stack([first[m], last[m]], axis=1).astype("<i4").tobytes() if m.any() else None for m in (gone, asked))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(3)], names=["name", "spans", "asked"])

    dealt = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "ref")
    return written(dealt.mapInArrow(run, "name binary, spans binary, asked binary"), f"decided-{level}")


def _joined(column: str) -> Callable:
    """All packed spans of a text's pieces, one after the other."""
    return F.expr(f"aggregate(collect_list({column}), cast('' as binary), (x, y) -> concat(x, y))").alias(column)


def drop_repeats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, n_words long, n_removed long, kept string (the words that stay, joined by one space), removed array<struct<first, last>> (windows that repeat)."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("name", F.when(F.col("doc").isNotNull(), F.unhex(F.md5(F.encode("text", "utf-8")))))
    # 1. Equal texts are one symbol.
    one = rows.where("name is not null").groupBy("name").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(one.repartition(parts, "name"), "name", parts)
    empty = F.lit(None).cast("binary").alias("spans")
    decided = [decide(name_classes(texts.select("name", "doc", "text", empty), "high"), "high")]
    for level, column in (("low", "spans"), ("windows", "asked")):
        before = decided[-1].where(f"{column} is not null").groupBy("name").agg(_joined(column)).withColumnRenamed(column, "spans")
        some = texts.join(before, "name", "left" if level == "low" else "inner")
        decided.append(decide(name_classes(some.select("name", "doc", "text", "spans"), level), level))
    spans = decided[0].unionByName(decided[1]).unionByName(decided[2]).where("spans is not null").groupBy("name").agg(_joined("spans"))
    # Written without buckets: then both sides of the last join are dealt by it, and Spark can split a text that a third of all rows have.
    first = written(texts.select("name", F.col("doc").alias("first_doc")).join(spans, "name", "left"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            n, gone, kept, removed = [], [], [], []
            for t, copy, packed in zip(*(batch.column(k + i).to_pylist() for i in range(3)), strict=True):
                words = words_of(t)
                n.append(len(words))
                if copy and len(words) >= WINDOW:
                    at, spans_ = np.zeros(0, np.int64), [(0, len(words) - WINDOW)]
                    out = np.ones(len(words), bool)
                else:
                    at, out, spans_ = _spans(packed).astype(np.int64), None, []
                if len(at):
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, at[:, 0], 1)
                    np.add.at(steps, at[:, 1] + WINDOW, -1)
                    out = steps.cumsum()[:-1] > 0
                    spans_ = sorted(map(tuple, at.tolist()))
                if out is not None:
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                removed.append([{"first": a, "last": b} for a, b in spans_])
            spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, spans_type)], names=["doc_id", *keep, "n_words", "n_removed", "kept", "removed"])

    fields = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])
    # Only a row of the smallest document of its text keeps words that no smaller document has.
    copy = F.coalesce(F.col("doc") > F.col("first_doc"), F.lit(False)).alias("copy")
    full = rows.join(first, "name", "left").select("doc", *[f"_k{i}" for i in range(len(keep))], "text", copy, "spans")
    return full.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string, removed array<struct<first: int, last: int>>")
