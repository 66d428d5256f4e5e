"""Token counts by a map-side two-tier lookup.

The first tier is a compact table of the corpus's most frequent pre-tokens: sorted 128-bit hashes with their lengths in tokens,
18 bytes an entry, `keep` entries (a proven bound). It is broadcast, and looked up in place. What it misses is encoded by the
library and kept in the second tier, a bounded cache of the worker process that its next tasks go on with. No pre-token is
shuffled: the frequent ones come from bounded summaries of the tasks (see frequent_terms).

Defined results. Null and empty texts have 0 tokens. Special strings inside texts count as the library counts them by default.
Words with characters beyond ASCII and the letters of Latin-1 are encoded by the library as they stand. Repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frequent_terms, strings
from .bpe import PIECES, worker_encoder


def _hashes(terms: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the terms' 128-bit hashes."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode()) for t in terms), "<u8").reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def pack_table(lengths: dict[str, int]) -> bytes:
    """The table of these lengths (below 65536): first halves in order, second halves, lengths."""
    first, second = _hashes(lengths)
    order = np.argsort(first, kind="stable")
    return first[order].tobytes() + second[order].tobytes() + np.array(list(lengths.values()), "<u2")[order].tobytes()


class LengthTable:
    """A packed table, read where it lies."""

    def __init__(self, packed: bytes) -> None:
        n = len(packed) // 18
        self.first, self.second, self.lengths = (np.frombuffer(packed, kind, n, at) for kind, at in (("<u8", 0), ("<u8", 8 * n), ("<u2", 16 * n)))

    def find(self, words: set) -> dict[str, int]:
        """The lengths of those words that the table holds (what isn't a string isn't looked up)."""
        terms = [w for w in words if isinstance(w, str)]
        if not terms or not len(self.first):
            return {}
        first, second = _hashes(terms)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        hit = np.flatnonzero((self.first[at] == first) & (self.second[at] == second))
        return dict(zip(map(terms.__getitem__, hit.tolist()), self.lengths[at[hit]].tolist(), strict=True))


def length_table(texts: DataFrame, path: str, *, keep: int = 65_536) -> bytes:
    """The packed table of the frequent pre-tokens (64 characters at most, so that a length takes two bytes)."""
    from tokenizers import Tokenizer

    frequent = list(frequent_terms(texts, PIECES.findall, keep=keep))
    library = Tokenizer.from_file(path)
    return pack_table({t: len(e.ids) for t, e in zip(frequent, library.encode_batch_fast(frequent, add_special_tokens=False), strict=True)})


def count_tokens(docs: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text", limit: int = 512, table: bytes | None = None) -> DataFrame:
    """doc_id, n_bytes long, n_tokens long, over_limit boolean (n_tokens > limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(length_table(docs.select(text), path) if table is None else table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, PIECES.findall, None, len)
        encoder.first = LengthTable(shared.value).find
        for batch in batches:
            texts = strings(batch.column(1))
            n = [sum(ws) for ws in encoder.texts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
