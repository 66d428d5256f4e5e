"""N-gram Jaccard self-join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct shingles (two of a compared pair of sets of n and m shingles collide with a chance of
n m / 2^64). Equal sets collapse first. Then

1. similar sets are partitioned into groups: each set is compared with the leaders of a few min-hash classes, what is similar enough is
   connected, and the components, cut into tiles of bounded size, are the groups;
2. the matrix says which token stands in which group. Tokens are ordered by frequency (the rare ones first), and for a set of n tokens
   only the first n - ceil(t n) + l are entered, l = n // 10 + 1: two sets of similarity t or more share l of these at least. Shared tokens
   of two groups are counted from it, and pairs of groups below that bound are never opened. Before pairs are made, groups that have too few
   tokens in common with all others together go, and pairs are only made between neighbouring bands of sizes;
3. an opened group is loaded once. The sets of the other group are its queries: if a query's overlap with the group's token union is below
   ceil(t n), the group can't hold a partner; else its members are compared exactly.

Groups that step 1 has connected aren't compared within, so large groups of near copies cost their size, not its square; links between
different groups are all found, so that components are exact.

Defined results. Null, empty and blank texts have the empty set and are linked with nothing: their component is their own id. Rows of a null
id get the component of their set, null if no row with an id has it. Rows with equal ids are judged each by its own text, and sets with the
same smallest id count as linked. Other columns are ignored. An empty table gives an empty result. Documents of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import noted, shared_dir, strings, written
from .components import components

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

_FACTORS = [np.uint64(pow(int(_K[2]), k + 1, 2**64)) for k in range(8)]


class ByteHashes(dict):
    """64-bit hashes of words as bytes; `held` words at most, then it starts anew."""

    def __init__(self, held: int = 250_000) -> None:
        super().__init__()
        self.held = held

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.held:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K[4]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, hashes: ByteHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ASCII-lower-cased words; bytes split at 0x20 and 0x09-0x0D."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n, most = max(1, len(w) - size + 1), min(size, len(w))
    s = w[:n] * _FACTORS[0]
    for k in range(1, most):
        s += w[k : k + n] * _FACTORS[k % len(_FACTORS)]
    s = mix(s + np.uint64(most))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _hash128(tokens: np.ndarray) -> tuple[int, int]:
    return int(mix(tokens * _K[0]).sum(dtype=np.uint64).view(np.int64)), int(mix(tokens ^ _K[3]).sum(dtype=np.uint64).view(np.int64))


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a set that is similar enough."""
    return -(-n * percent // 100)


def set_table(docs: DataFrame, *, doc: str, text: str, size: int, classes: int, per_task: int = 2000) -> DataFrame:
    """Rows (doc_id, th, n, h1, h2, mins) with the hash of the text, the 128-bit hash of its set and the min-hashes; rows (token, count) with each task's frequent tokens. Written once."""
    salts = [np.uint64(int(_K[0]) * (2 * c + 1) % 2**64) for c in range(classes)]
    names = ["doc_id", "th", "n", "h1", "h2", "mins", "token", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, heavy, held, held_n = ByteHashes(), Counter(), [], 0

        def flush() -> None:
            nonlocal held, held_n
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                often = np.flatnonzero(c >= 4)
                heavy.update(dict(zip(u[often].tolist(), c[often].tolist(), strict=True)))
                if len(heavy) > 100_000:
                    top = heavy.most_common(25_000)
                    heavy.clear()
                    heavy.update(dict(top))
            held, held_n = [], 0

        for batch in batches:
            rows, mins = [], []
            for t in strings(batch.column(1)):
                s = shingle_set(t, hashes, size)
                rows.append((len(s), *_hash128(s)))
                mins.append([int(mix(s ^ salt).min().view(np.int64)) for salt in salts] if len(s) else [])
                held.append(s)
                held_n += len(s)
            if held_n > 2_000_000:
                flush()
            n, h1, h2 = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else [pa.array([], pa.int64())] * 3
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, h1, h2, pa.array(mins, pa.list_(pa.int64())), none, none], names=names)
        flush()
        top = heavy.most_common(per_task)
        none = pa.nulls(len(top), pa.int64())
        tokens = pa.array(np.array([t for t, _ in top], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(top), pa.list_(pa.int64())), tokens, pa.array([c for _, c in top], pa.int64())], names=names)

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, n long, h1 long, h2 long, mins array<long>, token long, count long"), "sets")


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df, already dealt by key to `buckets` partitions, as a bucketed table in the shared folder: joins on key don't move it."""
    name = f"pageloom_{uuid.uuid4().hex}"
    at = f"{shared_dir(df.sparkSession)}/pageloom/{name}"
    df.write.option("path", at).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    noted(at, name)
    return df.sparkSession.table(name)


def representatives(docs: DataFrame, sets: DataFrame, *, doc: str, text: str) -> DataFrame:
    """One row per distinct set: sid (its smallest id), n, mins array<long>, text; bucketed by sid. A set's row is found by id and text hash; rows that repeat it repeat here, too, which changes nothing."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc).cast("long").alias("sid"), F.col(text).cast("string").alias("text")).repartition(n, "sid").withColumn("th", F.xxhash64("text"))
    same = F.col("th").bitwiseXOR(F.col("of")) == 0  # th as a join key would deal the rows by (sid, th), and each task would write a file of every bucket
    return bucketed(rows.join(sets.select("sid", F.col("th").alias("of"), "mins", "n"), "sid").where(same).select("sid", "n", "mins", "text"), "sid", n)


def open_groups(members: DataFrame, queries: DataFrame, texts: DataFrame, *, size: int, percent: int, at_once: int = 1000) -> DataFrame:
    """(a, b): links between the nodes of queries (sid, node, grp) and of members (sid, node, grp) that are similar enough, without those that follow from others of the same task. A group with many queries is opened for `at_once` queries at a time."""
    load = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).select("grp", F.ceil(F.col("c") / at_once).cast("int").alias("salts"))
    text = texts.select("sid", "text")
    left = members.join(load, "grp").select("grp", "sid", "node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("query"))
    right = queries.join(load, "grp").select("grp", "sid", "node", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("query"))
    rows = left.unionByName(right).join(text, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ByteHashes()
        group, sets, nodes, tokens, starts, sizes, union, top = None, [], [], None, None, None, None, {}

        def find(x: int) -> int:
            while top.get(x, x) != x:
                top[x] = top.get(top[x], top[x])
                x = top[x]
            return x

        for batch in batches:
            found = []
            for grp, salt, query, sid, node, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(t, hashes, size)
                if (grp, salt) != group:
                    group, sets, nodes, tokens, top = (grp, salt), [], [], None, {}
                if not query:
                    sets.append(s)
                    nodes.append(node)
                    continue
                if not sets:
                    continue
                if tokens is None:
                    tokens = np.concatenate(sets)
                    sizes = np.array([len(x) for x in sets])
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    union = np.unique(tokens) if len(sets) > 1 else sets[0]
                at = np.minimum(np.searchsorted(s, union), len(s) - 1)
                bound = int((s[at] == union).sum())
                if bound < needed(len(s), percent):
                    continue
                if len(sets) == 1:
                    common = np.array([bound])
                else:
                    at = np.minimum(np.searchsorted(s, tokens), len(s) - 1)
                    common = np.add.reduceat((s[at] == tokens).astype(np.int64), starts)
                for i in np.flatnonzero(100 * common >= percent * (len(s) + sizes - common)).tolist():
                    x, y = find(node), find(nodes[i])
                    if x != y:
                        top[x] = y
                        found.append((node, nodes[i]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    order = ["grp", "salt", "query"]
    dealt = rows.select(*order, "sid", "node", "text").repartition("grp", "salt").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def prefixes(texts: DataFrame, hot: list[int], *, size: int, percent: int) -> DataFrame:
    """texts' columns but text, and tokens array<long>: the rarest n - ceil(t n) + l tokens, and l."""
    shared = texts.sparkSession.sparkContext.broadcast((np.sort(np.array(hot, np.int64).view(np.uint64)), np.argsort(np.argsort(np.array(hot, np.int64).view(np.uint64)))))
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ByteHashes()
        known, _ = shared.value
        rank = np.empty(len(hot), np.int64)  # of the sorted hot tokens: the most frequent one last
        rank[shared.value[1]] = np.arange(len(hot), 0, -1)
        for batch in batches:
            out, least = [], []
            for t in strings(batch.column(batch.num_columns - 1)):
                s = shingle_set(t, hashes, size)
                n = len(s)
                least.append(n // 10 + 1)
                p = min(n, n - needed(n, percent) + least[-1])
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    is_hot = known[at] == s
                    if is_hot.any():
                        h = s[is_hot]
                        s = np.concatenate([s[~is_hot], h[np.argsort(rank[at[is_hot]], kind="stable")]])
                out.append(s[:p].view(np.int64))
            lengths = np.cumsum([0, *map(len, out)])
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(least, pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)], names=[*keep, "least", "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    return texts.select(*keep, "text").mapInArrow(run, f"{fields}, least int, tokens array<long>")


def size_band(n: Column, percent: int) -> Column:
    """Sets that are similar enough lie in one band of sizes or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent)) - 1e-9).cast("int")


def least_of(n: Column) -> Column:
    """How many entered tokens a set of n shares with any that is similar enough."""
    return F.floor(n / 10).cast("int") + 1


def overlap_bound(lo: Column, hi: Column, lo2: Column, hi2: Column, percent: int) -> Column:
    """The fewest entered tokens that two similar sets share, one of lo to hi tokens, the other of lo2 to hi2.

    Similar sets of n and m share percent * (n + m) / (100 + percent) tokens at least. ceil(t n) - l of a set's n tokens aren't entered, and what
    is shared beyond these is entered for both: more than share * (n + m) - (t n + 1) + n / 10 for either set, a line in n and m.
    """
    share, t = percent / (100 + percent), percent / 100
    slope = share - t + 0.1
    beyond = lambda a, z, other: slope * (z if slope < 0 else a) + share * other - 1
    both = F.floor(F.least(beyond(lo, hi, lo2), beyond(lo2, hi2, lo)) - 1e-6).cast("int") + 1
    return F.greatest(F.least(least_of(lo), least_of(lo2)), both)


def with_enough(shared: DataFrame, percent: int) -> DataFrame:
    """The rows of `shared` (token, grp, band, part, lo, hi) that can matter, by counts alone, before any pair is made.

    A pair of similar sets shares as many entered tokens as the lesser `least` of the two says, and all of them are in this table. A set's
    partners have `percent` of its tokens at least, so that their `least` is percent * (least - 1) / 100 + 1 or more: a group that has fewer tokens
    in the table has no partner. Tokens that then are left to one part go as well. What only has a common passage or line goes here.
    """
    fewest = F.floor((F.min(least_of(F.col("lo"))) - 1) * percent / 100) + 1
    enough = shared.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("c"), fewest.alias("l")).where("c >= l").select("grp", "band")
    rows = shared.join(enough, ["grp", "band"], "left_semi")
    # A token's bands and parts, by aggregation: a hot token's rows are summed up before they meet.
    several = rows.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a <> z").select("token")
    return rows.join(several, "token", "left_semi")


def jaccard_components(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, classes: int = 4, hot_tokens: int = 50_000, tile: int = 256) -> DataFrame:
    """Per row of docs: doc_id, n_shingles long, component_id long (the smallest id that is reachable by links, its own included)."""
    table = set_table(docs, doc=doc, text=text, size=size, classes=classes)
    rows = table.where("n is not null")
    hot = [r["token"] for r in table.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "token").limit(hot_tokens).collect()]
    first_row = F.min(F.struct("doc_id", "th", "mins", "n"))
    sets = rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(first_row.alias("r")).select("h1", "h2", F.col("r.doc_id").alias("sid"), "r.th", "r.mins", "r.n")
    texts = representatives(docs, sets, doc=doc, text=text)

    # 1. Connect what is similar to the leader of one of its min-hash classes.
    mins = texts.select("sid", F.posexplode("mins").alias("class", "key"))
    leaders = mins.groupBy("class", "key").agg(F.min_by("sid", F.xxhash64("sid", "class")).alias("grp"), F.count(F.lit(1)).alias("c")).where("c > 1").select("class", "key", "grp")
    pairs = written(mins.join(leaders, ["class", "key"]).where("sid <> grp").select("sid", "grp").distinct(), "leaders")
    near = open_groups(pairs.select("grp", F.col("grp").alias("sid"), F.col("grp").alias("node")).distinct(), pairs.select("sid", F.col("sid").alias("node"), "grp"), texts, size=size, percent=percent)
    first = components(near)

    # Groups: tiles of a component; what isn't connected yet joins others that have the same leader, in tiles of their own.
    placed = first.select(F.col("node").alias("sid"), "comp").unionByName(first.select(F.col("comp").alias("sid"), "comp").distinct())
    of_leader = placed.select(F.col("sid").alias("grp"), F.col("comp").alias("home"))
    loose = pairs.join(placed.select("sid"), "sid", "left_anti").join(of_leader, "grp", "left").groupBy("sid").agg(F.min(F.coalesce("home", "grp")).alias("home"))
    # A tile of sets that aren't connected holds one band of sizes: the least overlap that opens it is that of its smallest set.
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    loose = loose.join(texts.select("sid", band.alias("band")), "sid").select("sid", F.col("sid").alias("node"), "home", F.lit(False).alias("joined"), "band")
    homed = placed.select("sid", F.col("comp").alias("node"), F.col("comp").alias("home"), F.lit(True).alias("joined"), F.lit(-1).alias("band")).unionByName(loose)
    counts = homed.groupBy("home", "joined", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiled = homed.join(counts, ["home", "joined", "band"]).withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    named = tiled.groupBy("home", "joined", "band", "tile").agg(F.min("sid").alias("grp"))
    grouped = written(tiled.join(named, ["home", "joined", "band", "tile"]).select("sid", "node", "grp", F.when(F.col("joined"), F.col("home")).otherwise(F.col("grp")).alias("part"), "joined"), "groups")

    # 2. The matrix of tokens and groups. Groups of one part are connected and not compared.
    member = texts.select("sid", "n", "text").join(grouped, "sid", "left").select(F.coalesce("part", "sid").alias("part"), F.coalesce("grp", "sid").alias("grp"), size_band(F.col("n"), percent).alias("band"), F.col("n").cast("int").alias("n"), "text")
    matrix = prefixes(member, hot, size=size, percent=percent).select("part", "grp", "band", "n", F.explode("tokens").alias("token"))
    by_token = matrix.groupBy("token", "grp", "band").agg(F.first("part").alias("part"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    w = W.partitionBy("token")
    shared = by_token.withColumn("a", F.min("part").over(w)).withColumn("z", F.max("part").over(w)).where("a <> z").select("token", "grp", "band", "part", "lo", "hi")
    shared = written(shared, "matrix")
    for k in (1, 2):
        shared = written(with_enough(shared, percent), f"matrix-{k}")
    other = shared.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band2"), *[F.col(c).alias(f"{c}2") for c in ("grp", "part", "lo", "hi")])
    met = shared.join(other, ["token", "band"]).where("(band < band2 or grp < grp2) and part <> part2")
    pair = met.select("token", F.least("grp", "grp2").alias("grp"), F.greatest("grp", "grp2").alias("grp2"), overlap_bound(*[F.col(c) for c in ("lo", "hi", "lo2", "hi2")], percent).alias("least"))
    open_ = pair.groupBy("grp", "grp2").agg(F.count(F.lit(1)).alias("overlap"), F.min("least").alias("bound")).where("overlap >= bound")
    itself = grouped.where("not joined").groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("grp", F.col("grp").alias("grp2"))
    open_ = written(open_.select("grp", "grp2").unionByName(itself), "opened")

    # 3. The larger of two groups is opened, the sets of the other one are its queries.
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("c"))
    sized = open_.join(sizes, "grp", "left").withColumnRenamed("c", "c1").join(sizes.select(F.col("grp").alias("grp2"), F.col("c").alias("c2")), "grp2", "left")
    swap = F.coalesce("c1", F.lit(1)) > F.coalesce("c2", F.lit(1))
    asked = sized.select(F.when(swap, F.col("grp")).otherwise(F.col("grp2")).alias("grp"), F.when(swap, F.col("grp2")).otherwise(F.col("grp")).alias("from"))
    in_group = grouped.select(F.col("grp").alias("g"), F.col("sid").alias("s"), F.col("node").alias("v"))
    queries = asked.join(in_group, F.col("from") == F.col("g"), "left").select(F.coalesce("s", "from").alias("sid"), F.coalesce("v", "from").alias("node"), "grp")
    members = asked.select("grp").distinct().join(in_group, F.col("grp") == F.col("g"), "left").select("grp", F.coalesce("s", "grp").alias("sid"), F.coalesce("v", "grp").alias("node"))
    second = components(open_groups(members, queries, texts, size=size, percent=percent))

    # Every row gets its set, the set its node, this one the last component. Salted, so that the copies of a hot set are dealt to many tasks.
    salts = 16
    final = sets.join(grouped.select("sid", "node"), "sid", "left").select("h1", "h2", F.coalesce("node", "sid").alias("node"))
    final = final.join(second, "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("component_id"))
    final = final.select("h1", "h2", "component_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = rows.select("doc_id", "n", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")).join(final, ["h1", "h2", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
