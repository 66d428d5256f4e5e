"""The training-data operators against brute force, round trips and held-out labels, with the awkward cases of each."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import bpe, chat, cotrain, jaccard, media, packing, queries, simhash, substring, token_counts, warc
from pageloom.llm._common import written

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 300))) for _ in range(40)]
    passage = " ".join(rng.choices(words, k=70))
    rows = list(base)
    for t in base[:15]:
        w = t.split()
        for _ in range(3):
            x = list(w)
            for _ in range(max(1, len(x) // 60)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append(" ".join(x))
    rows += [base[0]] * 4 + [base[20] + " " + passage + " " + base[21], passage + " " + base[22], base[23] + "\n" + passage]
    rows += [None, "", " \n ", "one", "two words", "a b c d", "A B C D", "x " * 200, "y " + "x " * 150 + "z", "é" * 5000, "<|endoftext|> Tail — İ é \x85", " ".join(rng.choices(words[:40], k=6000))]
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, out[3], (None, base[2]), (7, base[30])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "extra") for i, t in corpus()], "doc_id long, text string, lang string, n string").repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring(docs):
    rows = [(i, words(t)) for i, t in corpus()]
    first: dict = {}
    for i, w in rows:
        if i is not None:
            for q in range(len(w) - 49):
                k = tuple(w[q : q + 50])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, w in rows:
        gone = {p for q in range(len(w) - 49) if i is not None and first[tuple(w[q : q + 50])] < i for p in range(q, q + 50)}
        want.append((i is None, i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = [(r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.drop_repeats(docs.limit(0)).count() == 0


def test_jaccard(docs):
    rows = [(i, t) for i, t in corpus()]
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    # Row 7 occurs with two texts, each judged by itself.
    low: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    want = [(i, len(s), low.get(find(k), i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, tile=8).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_tokens_and_packing(spark, docs):
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    ids = {(i, t): word.encode(t or "", add_special_tokens=False).ids for i, t in corpus()}
    key = lambda i, x: (i is None, i or 0, x)
    got = [(r.doc_id, r.n_tokens, r.ids_text, r.decoded) for r in bpe.decode(bpe.encode(docs, WORD), WORD).collect()]
    want = [(i, len(ids[i, t]), " ".join(map(str, ids[i, t])), word.decode(ids[i, t], skip_special_tokens=False)) for i, t in corpus()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect()]
    want = [(i, len((t or "").encode()), n := len(byte.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in corpus()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    placed = packing.pack(packing.pieces(docs, WORD, size=64), size=64, open_bins=3, fan_in=2).collect()
    streams = sorted((key(i, zlib.crc32(np.array([*x, 1], "<u4")[k : k + 64].tobytes())), k // 64) for (i, t) in corpus() for x in [ids[i, t]] for k in range(0, len(x) + 1, 64))
    assert sorted((key(r.doc_id, r.ids_crc32), r.piece) for r in placed) == streams
    bins: dict = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(ids[i, t]) + 1 for i, t in corpus())
    assert len(bins) <= 1.1 * total / 64 + 2
    assert packing.pack(packing.pieces(docs.limit(0), WORD)).count() == 0


def test_lexicon_is_minimal_and_exact():
    entries = {w: [k, k + 1] for k, w in enumerate(["tapping", "mapping", "map", "tap", "é", "mop", "mopping"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    assert [lexicon.get(w) for w in ("", "ma", "mapp", "zap", "taps")] == [None] * 5
    assert len(lexicon.finals) < sum(map(len, entries))  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon({})).get("x") is None


def test_simhash(docs, spark):
    h = simhash.WordHashes()
    rows = sorted(((i, t or "") for i, t in corpus()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]
    got = [tuple(r) for r in simhash.with_next(docs, buckets=5).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.fingerprint("", h) == simhash.fingerprint(" \n", h) == 0
    prints = [(simhash.fingerprint(t, h),) for _, t in rows] + [(simhash.fingerprint(rows[0][1], h) ^ m,) for m in (1, 6, 7 << 20, 15 << 40)]
    u = {p & (2**64 - 1) for (p,) in prints}
    brute = {a: n for a in u if (n := sum(0 < (a ^ b).bit_count() <= 3 for b in u))}
    for tile in (1, 2048):
        found = simhash.radius_links(spark.createDataFrame(prints, "fingerprint long"), tile=tile).collect()
        assert {r.fingerprint & (2**64 - 1): r.n_links for r in found} == brute
    assert simhash.with_next(docs.limit(0)).count() == 0


def test_simhash_links_near_duplicates(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {i: (int(r.fingerprint, 16), r.n_links) for r in queries.op7_simhash(spark, str(tmp_path)).collect() if (i := r.doc_id) not in (None, 7)}
    texts = {i: t for i, t in corpus() if i in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := words(t))}
    pairs = [(a, b) for a in sets for b in sets if a < b and texts[a] != texts[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    apart = [(rows[a][0] ^ rows[b][0]).bit_count() for a, b in pairs]
    assert len(pairs) > 40 and sum(d > 3 for d in apart) > 10
    assert sum(d <= simhash.NEAR for d in apart) >= 0.98 * len(pairs)
    assert all(rows[a][1] and rows[b][1] for (a, b), d in zip(pairs, apart, strict=True) if 0 < d <= simhash.NEAR)


def test_simhash_radius_is_exact(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    u = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(14))) for b in base for _ in range(8)}
    brute = {a: n for a in u if (n := sum(0 < (a ^ b).bit_count() <= simhash.NEAR for b in u))}
    prints = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in u], "fingerprint long")
    for tile, whole in ((65_536, 1 << 22), (65_536, 0), (5, 0), (5, 1 << 22)):
        found = simhash.radius_links(prints, radius=simhash.NEAR, tile=tile, whole=whole).collect()
        assert {x.fingerprint & (2**64 - 1): x.n_links for x in found} == brute


def test_media(docs):
    out = media.audio_features(docs.select("doc_id", media.encode_wav(media.padded_payload(F.col("text"))).alias("media"))).collect()
    want = sorted((t or "").encode().ljust(192 * max(1, -(-len((t or "").encode()) // 192))) for _, t in corpus())
    assert sorted(bytes(r.samples) for r in out) == want
    for r in out[:5]:
        batch = pa.ipc.open_stream(r.tensors).read_all()
        assert sum(batch["frames"].to_pylist()) == r.frames and batch["logmel"].type.shape == [16, 32]
        assert all(0 <= s.start_ms < s.end_ms for s in r.spans)
    assert media.segments(np.array([0, 0, 9, 9, 1, 0, -9, 0, 0.0]), media.Features()) == [(2, 6)]


def test_media_frames_hold_the_tail():
    p = media.Features()
    for n, frames in ((1, 1), (192, 1), (193, 2), (288, 2), (289, 3), (380, 3), (384, 3)):
        mel, db = media.logmel(bytes([128] * (n - 1) + [255]), 8000, p)
        assert (len(mel), len(db)) == (frames, frames)
    quiet = media.logmel(bytes([128] * 380), 8000, p)[1]
    assert media.logmel(bytes([128] * 340 + [255, 0] * 20), 8000, p)[1][-1] > quiet[-1]


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", r"a\\</s> \<s> <\s> <\\s> <s<s> \ $1", "", None, "<s>[INST]", "\\", "é\U0001f600\n"]
    rows = [(c, k, ["user", "assistant"][k % 2], t) for c in range(3) for k, t in enumerate(nasty[c:])] + [(9, 0, "assistant", "x"), (9, 0, None, None), (None, None, "user", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    got = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in (0, 1, 2):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c].turns] == mine
        assert got[c].loss == "".join(t for role, t in mine if role == "assistant")
        assert got[c].valid
    assert (got[9].valid, got[9].bad_turn) == (False, 0)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_warc(spark):
    body = "<p>" + "same é " * 40
    rows = [(5, "http://B.example.com/x", body), (2, "http://a.example.com/y z", body), (9, None, body), (3, "http://a.example.com/", "short"), (4, "http://a.example.com/", "short"), (7, "u", None), (None, "v", body), (8, "w", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_roles(pages))
    assert all(gzip.decompress(r.warc).startswith(b"WARC/1.1\r\n") for r in archives.collect())
    index = warc.merge_index(warc.read_archives(archives), ranges=1, run_rows=2, held_runs=1, fan_in=2).collect()
    got = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index}
    raw = {i: (h or "").encode() for i, _, h in rows}
    want = {i: (len(b), hashlib.sha256(b).hexdigest(), "revisit" if i in (5, 9, None) else "response", 2 if i in (5, 9, None) else None) for i, b in raw.items()}
    assert got == want and all(r.intact for r in index)
    keys = [warc.index_key(tuple(r)) for r in index]
    assert keys == sorted(keys)
    assert list(warc.loser_tree([iter([1, 4]), iter([]), iter([2, 2, 9]), iter([0])], lambda x: x)) == [0, 1, 2, 2, 4, 9]


def test_cotraining(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    views = written(cotrain.features(docs), "test-views")
    model = cotrain.train(views, labels.where(~held))
    got = cotrain.score(views, model).join(labels.where(held), "doc_id").select((F.col("keep") == (F.col("quality") == 1)).alias("ok")).collect()
    assert len(got) > 50 and sum(r.ok for r in got) / len(got) >= 0.95
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "en", "s")], "doc_id long, text string, lang string, source string")
    none = cotrain.classify(odd, labels.limit(0), keep=("doc_id", "text")).collect()
    assert {r.doc_id: r.keep for r in none} == {None: True, 1: True}


def test_encoder_gives_the_librarys_ids_for_any_plain_text():
    import random

    import public_tokenizers
    from pageloom.llm.bpe import Encoder, word_split

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), word_split, None, list)
    r = random.Random(1)
    texts = ["".join(r.choice("ab'sst 019.,!<|>-_é\n\t\x01Zçöü~^$") for _ in range(r.randrange(200))) for _ in range(1000)]
    texts += ["", "<|endoftext|>", "a <|startoftext|>b", "</w> x</w>", "it's ''s '' 'll", "東京 ab"]
    assert [[x for w in words for x in w] for words in encoder.texts(texts)] == [encoder.library_ids(t) for t in texts]
    assert encoder.word_ids([]) == []


def test_words_beyond_plain_text_are_cut_where_the_library_cuts():
    r = random.Random(2)
    chars = "ab's  \n\t\r.,7é’“東京\u00a0\u3000\u200b\u0301İΣς\U0001f600\x85\x1c²ªﬁ"
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["don’t <|endoftext|>’ \n’", "a  \n ’b ’", "’", "x" * 50_000 + "’ " + "y’" * 50_000]
    for path, split in ((WORD, bpe.word_split), (BYTE, bpe.PIECES.findall)):
        encoder = bpe.Encoder(path, split, None, list)
        whole = [t for t in texts if encoder.words_of(t) is None]
        assert len(whole) < len(texts)
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            assert [[x for w in ws for x in w] for ws in encoder.texts(part)] == [encoder.library_ids(t) for t in part]
        assert encoder.words_of("it’s plain") is not None


def test_length_table():
    terms = {f" w{i}": i % 300 + 1 for i in range(5000)}
    held = token_counts.LengthTable(token_counts.pack_table(terms))
    assert held.find({*terms, "absent", ("beyond", " w1")}) == terms
    assert token_counts.LengthTable(token_counts.pack_table({})).find({"x"}) == {}
