"""Exact BPE encoding and decoding with a minimal acyclic transducer in front of the merges.

Words that are frequent in the corpus are compiled with their ids into a minimal acyclic automaton (shared prefixes and
suffixes). Counts along its arcs give each word its number, and the number leads to its ids, so the automaton is a transducer
whose outputs don't hinder the sharing of suffixes. The file is broadcast (its size is bounded by `keep` words of 64 characters),
each worker maps it into memory, and words that it doesn't hold are merged by the vocabulary's own merges. What a worker has
resolved stays in a bounded cache.

Texts are cut at the special tokens of the vocabulary first, as the library does by default. Words with characters beyond ASCII
and the letters of Latin-1, for which normalisation could matter, go to the library as they stand, with the white space before
them, and are kept in the cache like others. Only texts in which white space beyond ASCII touches other white space go there whole.

Defined results. A null or empty text has no ids; its digests are those of the empty string. Whole texts are encoded, however
long. Equal texts give equal rows; repeated rows stay; only `keep`, the id and text columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frequent_terms, strings

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters for which lower-casing and splitting need no Unicode tables and NFC changes nothing.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: A word with another character, and the white space before it: no pre-token reaches over its ends.
BEYOND = re.compile("((?:^|[\t\n\r ])[!-~À-ÖØ-öø-ÿ]*+[^\t\n\r -~À-ÖØ-öø-ÿ][^\t\n\r ]*+)")
#: White space beyond ASCII (or of the kinds that plain texts don't have) beside white space, which pre-tokens could join.
SPACES = re.compile(r"\s[^\S\t\n\r ]|[^\S\t\n\r ]\s")
_L = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: The pre-tokens of the word vocabulary, on lower-cased plain text.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
#: The pre-tokens of the byte-level vocabulary, on plain text.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def word_split(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, built from sorted words (each state is made unique as soon as it is closed)."""
    items = sorted((w.encode(), ids) for w, ids in words.items())
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[list[tuple[int, int]]] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            arcs.append(list(node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word: [final, arcs to closed states]
    last = b""
    for word, _ in items:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], close(path.pop())))
    root = close(path[0])
    below = [0] * len(finals)  # words at or below a state; children are closed before their parents
    first, labels, targets, skips = [0], bytearray(), [], []
    for s, out in enumerate(arcs):
        n = int(finals[s])
        for label, t in out:
            labels.append(label)
            targets.append(t)
            skips.append(n)
            n += below[t]
        below[s] = n
        first.append(len(labels))
    at = np.concatenate([[0], np.cumsum([len(ids) for _, ids in items])]) if items else np.zeros(1)
    parts = [np.array(first, "<i4").tobytes(), np.array(targets, "<i4").tobytes(), np.array(skips, "<i4").tobytes(), at.astype("<i4").tobytes(), np.array([i for _, ids in items for i in ids], "<i4").tobytes(), np.array(finals, "u1").tobytes(), bytes(labels)]
    return struct.pack("<8i", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon in a file that is mapped into memory; the file loses its name at once."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack_from("<8i", self.map)
        at, views = 32, []
        for n in sizes:
            views.append((at, at + n))
            at += n
        whole = memoryview(self.map)
        self.first, self.targets, self.skips, self.at, self.ids = (whole[a:b].cast("i") for a, b in views[:5])
        self.finals = whole[slice(*views[5])]
        self.labels = views[6][0]

    def get(self, word: str) -> list[int] | None:
        state, number, first, find, base = self.root, 0, self.first, self.map.find, self.labels
        for c in word.encode():
            arc = find(c.to_bytes(1, "little"), base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self.skips[arc]
            state = self.targets[arc]
        return list(self.ids[self.at[number] : self.at[number + 1]]) if self.finals[state] else None


class Cache(dict):
    """What a word turns into, filled in batches; `held` words at most, then it starts anew."""

    def __init__(self, held: int = 600_000) -> None:
        super().__init__()
        self.held = held


class Encoder:
    """Encodes texts as the library does (add_special_tokens=False), a batch at a time."""

    def __init__(self, path: str, split: Callable[[str], list[str]], lexicon: bytes | None, form: Callable[[list[int]], object]) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split, self.form, self.cache = split, form, Cache()
        self.lexicon = Lexicon(lexicon) if lexicon else None
        ends = np.zeros(self.library.get_vocab_size(), bool)
        ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends = ends if ends.any() else None
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {t: form([i]) for t, i in special.items()}
        self.first: Callable[[set], dict] | None = None  # a tier before the cache: the forms of those words that it knows
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Where tokens mark the ends of words, the words are encoded as one text, whose ids are cut behind the marks; every word has a mark at least, so that as many marks as words are one in each."""
        if self.ends is not None:
            ids = self.library_ids(" ".join(words))
            at = (np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1).tolist()
            if len(at) == len(words):
                return [ids[a:b] for a, b in zip([0, *at], at, strict=False)]
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def words_of(self, text: str) -> list | None:
        """The text's words; those that only the library can take are in a tuple, ("special", w) or ("beyond", w). None where it must take the text whole."""
        plain = PLAIN.fullmatch(text)
        if not plain and SPACES.search(text):
            return None
        marked = any(t in text for t in self.special)
        if plain and not marked:
            return self.split(text)
        out: list = []
        for i, part in enumerate(self.cut.split(text) if marked else [text]):
            if i % 2:
                out.append(("special", part))
            elif plain:
                out += self.split(part)
            else:
                for k, run in enumerate(BEYOND.split(part)):
                    out += [("beyond", run)] if k % 2 else self.split(run)
        return out

    def texts(self, texts: list[str]) -> list[list]:
        """For each text the forms of its words (or of the whole text, where the library encoded it)."""
        words = [self.words_of(text) for text in texts]
        if len(self.cache) > self.cache.held:
            self.cache.clear()
        cache = self.cache
        distinct = set().union(*filter(None, words))
        found = self.first(distinct) if self.first else {}
        unseen, beyond = [], []
        for w in distinct - cache.keys() - found.keys():
            if isinstance(w, tuple):
                if w[0] == "special":
                    cache[w] = self.special[w[1]]
                else:
                    beyond.append(w)
            elif self.lexicon and (ids := self.lexicon.get(w)) is not None:
                cache[w] = self.form(ids)
            else:
                unseen.append(w)
        for i in range(0, len(unseen), 1024):
            part = unseen[i : i + 1024]
            for w, ids in zip(part, self.word_ids(part), strict=True):
                cache[w] = self.form(ids)
        for i in range(0, len(beyond), 1024):
            part = beyond[i : i + 1024]
            for w, e in zip(part, self.library.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                cache[w] = self.form(e.ids)
        forms = {w: cache[w] for w in distinct - found.keys()} | found if self.first else cache
        out = [None if ws is None else list(map(forms.__getitem__, ws)) for ws in words]
        return [[self.form(self.library_ids(t))] if o is None else o for o, t in zip(out, texts, strict=True)]


_KEPT: dict[tuple, Encoder] = {}


def worker_encoder(path: str, split: Callable[[str], list[str]], lexicon: bytes | None, form: Callable[[list[int]], object]) -> Encoder:
    """This worker process's encoder: words that one of its tasks has resolved serve the next ones. One is kept, so that memory is that of one cache."""
    key = (path, split.__qualname__, form.__qualname__, lexicon and hashlib.sha256(lexicon).digest())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(path, split, lexicon, form)
    return _KEPT[key]


def lexicon_of(texts: DataFrame, path: str, split: Callable[[str], list[str]], *, keep: int = 65_536) -> bytes:
    """The compiled lexicon of the corpus's `keep` most frequent words with the ids that the vocabulary gives them."""
    from tokenizers import Tokenizer

    frequent = list(frequent_terms(texts, split, keep=keep))
    library = Tokenizer.from_file(path)
    return compile_lexicon({w: e.ids for w, e in zip(frequent, library.encode_batch_fast(frequent, add_special_tokens=False), strict=True)})


def encode(docs: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """doc_id, ids binary: the text's ids as little-endian unsigned 32-bit integers."""
    lexicon = lexicon if lexicon is not None else lexicon_of(docs.select(text), path, word_split)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, word_split, shared.value, as_bytes)
        for batch in batches:
            ids = [b"".join(ws) for ws in encoder.texts(strings(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens long, ids_text string (decimal, joined by a space), decoded string, as the library's decode(ids, skip_special_tokens=False).

    The vocabulary has no decoder, so that the library joins the tokens by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if library.decoder is not None:
            raise ValueError("this decoder is for vocabularies whose tokens are joined by a space")
        size = library.get_vocab_size(with_added_tokens=True)
        token = np.array([library.id_to_token(i) for i in range(size)], object)
        digits = np.array([str(i) for i in range(size)], object)
        for batch in batches:
            arrays = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(a) for a in arrays], pa.int64()), pa.array([" ".join(digits[a]) for a in arrays], pa.string()), pa.array([" ".join(token[a]) for a in arrays], pa.string())],
                names=["doc_id", "ids", "n_tokens", "ids_text", "decoded"],
            )

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long, ids_text string, decoded string")
