"""The stages of the corpus pipeline against brute force, on what the stage before kept; the classifier against the labels it is trained on."""

import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm._common import written

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[q : q + 5]) for q in range(max(1, len(w) - 4))} if w else set()


def smallest_of_group(rows):
    sets, top = [(r.doc_id, shingles(r.text)) for r in rows], {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, z in sets[:i]:
            if s and z and 100 * len(s & z) >= 80 * len(s | z):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {x for x in top if find(x) == x}


def without_repeats(rows):
    first = {}
    for r in rows:
        w = words(r.text)
        for q in range(len(w) - 49):
            k = tuple(w[q : q + 50])
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    out = {}
    for r in rows:
        w = words(r.text)
        gone = {p for q in range(len(w) - 49) if first[tuple(w[q : q + 50])] < r.doc_id for p in range(q, q + 50)}
        if not gone:
            out[r.doc_id] = (r.text, r.n_chars)
        elif len(gone) < len(w):
            kept = " ".join(x for p, x in enumerate(w) if p not in gone)
            out[r.doc_id] = (kept, len(kept))
    return out


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, apply in corpus_pipeline.STAGES:
        docs = written(apply(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def test_all_but_the_last_return_the_columns_of_documents(steps):
    for rows in steps[1:-1]:
        assert tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS


def test_quality_rejects_what_is_labelled_bad(spark, steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[:2])
    assert all(before[i][c] == r[c] for i, r in after.items() for c in corpus_pipeline.COLUMNS)
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in before and r.quality is not None]
    assert labels and sum((i in after) == (q == 1) for i, q in labels) >= 0.97 * len(labels)


def test_one_document_of_each_group_stays(steps):
    want = smallest_of_group(steps[1])
    assert len(want) < len(steps[1])
    assert sorted(r.doc_id for r in steps[2]) == sorted(want)


def test_of_repeated_rows_one_stays(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(90)) for x in "abcde")
    rows = [(5, a)] * 40 + [(9, a + " more"), (9, a + " more"), (None, a), (3, b), (3, b), (3, None), (3, ""), (3, "")]
    rows += [(7, c), (7, b + " more"), (8, c), (None, d), (None, d), (None, d + " more"), (11, e), (None, None), (None, ""), (12, " "), (12, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    one_of_d = [t for i, t in got if i is None and t]
    assert len(one_of_d) == 1 and one_of_d[0] in (d, d + " more")
    want = [(5, a), (3, b), (3, ""), (7, c), (None, one_of_d[0]), (11, e), (None, ""), (12, " ")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_repeated_windows_go(steps):
    want = without_repeats(steps[2])
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[3]} == want and len(steps[3]) == len(want)


def test_all_tokens_are_packed(steps):
    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    t.no_padding()
    t.no_truncation()
    want = []
    for r in steps[3]:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in steps[4]) == sorted(want)
    bins: dict = {}
    for r in sorted(steps[4], key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096 and len(bins) <= 1.1 * -(-sum(x[3] for x in want) // 4096) + 1
