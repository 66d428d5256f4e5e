"""Conversation repair, top-k search and negative mining against brute force, with the awkward cases of each."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import negatives, queries, repair, topk
from pageloom.llm import vectors as V

INF, NAN = float("inf"), float("nan")


def vectors(n: int = 900, dim: int = 12, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 6] + rng.normal(size=dim) * 0.6) / 4], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(100, rows[7][1], 1), (200, rows[200][1], rows[200][2]), (None, rows[100][1], 2), (1001, rows[100][1], 0), (1002, rows[100][1], 0), (-300, [0.0] * dim, 3)]  # repeated ids, a null id, ties, a negative query
    rows += [(2000, None, 1), (2100, [0.1, None] + [0.0] * 10, 1), (2200, [NAN] * dim, 1), (2300, [INF] * dim, 1), (2400, [], 2), (2500, [1.0], None), (2600, [0.3, -0.2], 1)]
    return [*rows, *[(3000 + i, rows[3][1], 0) for i in range(300)]]  # a hot vector


def ints(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))  # noqa: B905


def order(found):
    """By score, then id, null ids last."""
    return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in vectors()], "vec_id long, embedding array<float>, label int, rank string, score int").repartition(5).cache()


def test_top_k_equals_brute_force(table):
    rows = [(i, c) for i, v, _ in vectors() if (c := ints(v, 1024)) is not None]
    want = []
    for at, (q, v) in enumerate(rows):
        if q is not None and q % 100 == 0:
            best = order((product(v, c), i) for j, (i, c) in enumerate(rows) if j != at)[:10]
            want += [(q, k + 1, i, s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(table, vector=V.integers(F.col("embedding"), 1024))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_top_k_opens_few_blocks_where_rows_lie_in_regions(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    blocks = []
    for g in range(40):
        m = np.floor(64 * (centres[g] + rng.normal(size=(256, 16)) * 0.3)).astype(np.int64)
        form, data, high, low = topk._described(m)
        blocks.append({"grp": 0, "seq": g, "ids": list(range(g * 256, g * 256 + 256)), "dim": 16, "form": form, "data": data, "a": high.tolist(), "b": low.tolist()})
    group = topk._Group(blocks)
    seen = []
    group.rows = type("Seen", (list,), {"__getitem__": lambda self, i: (seen.append(i), list.__getitem__(self, i))[1]})(group.rows)
    tile = {"ids": [5], "dim": 16, "form": "<i8", "data": list.__getitem__(group.rows, 0)[5].tobytes(), "a": [5], "b": [V.LEAST]}
    out = next(iter(topk._scored(10)(group, tile)))

    assert out.num_rows == 10 and len(seen) <= 10


def test_hard_negatives_equal_brute_force(table):
    rows = [(i, label, c) for i, v, label in vectors() if label is not None and (c := ints(v, 256)) is not None]
    want = []
    for at, (a, label, v) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(product(v, c), i, x) for j, (i, x, c) in enumerate(rows) if j != at]
        for p, i, _ in order([s for s in scored if s[2] == label])[:5]:
            found = order([s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p])[:5]
            want += [(a, i, k + 1, n, p, s) for k, (s, n, _) in enumerate(found)]
    got = negatives.hard_negatives(table, label=F.col("label"), vector=V.integers(F.col("embedding"), 256))
    assert len(want) > 50
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_planes_hold_the_integers_and_drop_pairs():
    rng = np.random.default_rng(1)
    for m in (rng.integers(-200, 200, (70, 9)), np.zeros((3, 4), np.int64), np.array([[2**40, -(2**40)]]), -np.ones((5, 1), np.int64), np.zeros((2, 0), np.int64)):
        form, data = negatives.planes(m)
        assert (negatives.whole(negatives.plane_bits(data, form, m.shape[1], len(m))) == m).all()
    m, q = rng.integers(-200, 200, (70, 9)), rng.integers(-200, 200, (4, 9))
    form, data = negatives.planes(m)
    chunk = negatives._Chunk([{"grp": 0, "seq": 0, "ids": list(range(70)), "labels": [0] * 70, "dim": 9, "form": form, "data": data}])
    seen = []

    def narrow(i, j, low, high):
        exact = q @ m.T if i is None else (q[i] * m[j]).sum(1)
        assert (low <= exact).all() and (exact <= high).all()
        stay = high >= 60_000
        seen.append(int(stay.sum()))
        return stay

    i, j, s = negatives.sliced(q, chunk, np.ones((4, 70), bool), narrow)
    want = q @ m.T
    assert sorted(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == sorted((a, b, int(want[a, b])) for a, b in zip(*np.nonzero(want >= 60_000), strict=True))
    assert seen[-1] < seen[0] and seen == sorted(seen, reverse=True)


def test_huge_components_are_exact_and_stop_at_the_ends_of_a_long(spark):
    big = 2.0**45
    rows = [(0, [big, 1.0]), (1, [1.0, 3.0]), (2, [-big, -big]), (3, [1e300, 0.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["score"] for r in topk.top_k(df, vector=V.integers(F.col("embedding"), 1)).collect()}
    assert got == {1: 2**45 + 3, 2: V.LEAST, 3: V.MOST, 4: 1}
    assert negatives.hard_negatives(df, label=F.col("label"), vector=V.integers(F.col("embedding"), 1)).count() >= 0


def test_vector_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(df, vector=V.integers(F.col("embedding"), 1024)).collect() == []
    assert negatives.hard_negatives(df, label=F.col("label"), vector=V.integers(F.col("embedding"), 256)).collect() == []


def test_bounds_of_a_positive():
    for p in (100, 99, 1, 0, -1, -100, 2**62):
        low, high = (int(x[0]) for x in negatives.bounds(np.array([p]), 80, 100))
        assert high == p and 100 * low >= 80 * p > 100 * (low - 1)


# --- Conversation repair ---------------------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        last = next((c for c in reversed(text or "") if c not in SPACE), "")
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired) by trying every way, states kept with their least (cost, audit)."""
    found = faults(turns)
    states = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    def inserted(at):
        for _ in range(4):
            for state, (cost, audit, done) in list(at.items()):
                for role in ("user", "assistant"):
                    if to := after(state, role[0]):
                        put(at, to, (cost + 2, audit + "I", (*done, (role, ""))))
        return at

    states = inserted(states)
    for (role, text), fault in zip(turns, found, strict=True):
        new: dict = {}
        for state, (cost, audit, done) in states.items():
            put(new, state, (cost + 3, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            if to := after(state, (role or "")[:1]):
                put(new, to, (cost + more, audit + "K", (*done, (role, text))))
            for r in ("user", "assistant"):
                if to := after(state, r[0]):
                    put(new, to, (cost + more + 2, audit + "R", (*done, (r, text))))
        states = inserted(new)
    return min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])


def expected(rows):
    """conv_id -> what repair gives."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [r[1:] for r in rows if r[0] == conv and r[1:] != (None, None, None)]
        turns.sort(key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0],)) + tuple((x is not None, x or "") for x in r[1:]))
        known = [t for t, _, _ in turns if t is not None]
        plain = [(role, text) for _, role, text in turns]
        kinds = faults(plain)
        initials = [(role or "")[:1] for role, _ in plain]
        cost, audit, done = cheapest(plain)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, tuple(done))
    return out


def conversations(seed: int = 2, n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "Why?  \n", "", " \t", "a.", "b", None, "x" * 3000 + "."]
    rows = []
    for c in range(n):
        size = rng.choice([0, 1, 2, 3, 5, 8, 40])
        rows += [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "speaker"]), rng.choice(texts)) for t in range(size)]
        if not size:
            rows.append((c, None, None, None))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (-5, 2**62, "user", "a."), (-5, -(2**62), "assistant", "b.")]
    return rows


def test_repair_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    got = {r["conv_id"]: r for r in repair.repair(df).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        r = got[c]
        assert tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == w[:7], c
        assert tuple((t["role"], t["text"]) for t in r["repaired"]) == tuple((a or "", b or "") for a, b in w[7]), c


def test_layers_are_shared_by_prefixes():
    words = sorted("".join(w) for w in itertools.product("xuaS", repeat=5))
    walk = repair.Walk()
    for w in words:
        walk.to(w)
        alone = repair.Walk()
        alone.to(w)
        assert walk.answer() == alone.answer()
    assert walk.layers == sum(4**k for k in range(1, 6))


def test_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"line {t}" + "." * (t % 5 > 0)) for t in range(20_000)]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    want = expected(rows)[1]
    assert (got["cost"], got["audit"]) == want[5:7]


def test_repair_of_no_rows(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_repair_shuffles_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = repair.repair(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


def test_the_query_damages_as_agreed(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in conversations(7, 300) if r != "" or x]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = [(c, None, None, None) for c in {r[0] for r in rows}]
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
            damaged += [(c, t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    want = {c: (*w[:7], hashlib.sha256("\n".join(f"{a}:{b}" for a, b in w[7]).encode()).hexdigest()) for c, w in expected(damaged).items()}
    got = {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want


def test_archives_are_parsed_in_linear_time():
    import gzip
    import time

    from pageloom.llm import warc

    members = [gzip.compress(warc.record(i, f"https://a.test/{i}", "2024-01-01T00:00:00Z", "x", b"y" * (i % 50), None), 1, mtime=0) for i in range(40_000)]
    begun = time.process_time()
    at = 0
    for (offset, length, headers, _, payload), member, i in zip(warc.parse(b"".join(members)), members, range(40_000), strict=True):
        assert (offset, length, payload) == (at, len(member), b"y" * (i % 50)) and headers["WARC-Record-ID"] == f"<urn:page:{i}>"
        at += length
    assert time.process_time() - begun < 20
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(members[0][:-3]))
    big = gzip.compress(warc.record(1, "u", "d", "x", bytes(range(256)) * 4000, None), 1, mtime=0)
    assert [p for *_, p in warc.parse(big + members[3])] == [bytes(range(256)) * 4000, b"yyy"]
