"""Quality classification by co-training of a text view and a page-metadata view.

The text view sees words: variety, immediate repetition, the share of the most frequent word, words with signs inside, hashed words. The
metadata view sees what a crawl records about a page without reading it: language, source, size, compressed size, lines and the mix of
character classes. Each view is a ridge logistic regression fitted by Newton steps; a step is one pass in which the tasks add up gradient and
curvature, so that labelled and pseudo-labelled rows of all partitions count and the driver gets d (d + 1) / 2 + d sums per view.

Rounds: each view is calibrated (Platt scaling of a score histogram) on a fold of the labelled rows that no fit sees, a fifth of them by the
hash of the id; unlabelled documents of which one view is confident teach the other view in the next fit. At the end the calibrated views
are combined by a logistic regression on their two logits, on that fold again, and all documents are scored from their stored views, so
that a text is read once.

Defined results. A null or empty text has the features of an empty page; null language and source are values of their own. Conflicting labels of
a document count as the lowest, null labels as none. Without any label every score is 0.5 and every document stays; without one in
the held fold the scales stay as they begin. Repeated rows are scored each
for itself; equal rows get equal scores. Extra columns pass by `keep` only. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import strings, written

HASHED, LANGS, SOURCES = 24, 8, 16
#: One fold of so many holds the labelled rows for calibration.
FOLDS = 5
_SIGNS = re.compile(r"[^\w\s.,;:!?'\"()-]")


def _steps(x: float, *at: float) -> list[float]:
    return [float(x >= a) for a in at]


def text_view(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    count = Counter(words)
    same = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    variety, top = len(count) / max(1, n), max(count.values(), default=0) / max(1, n)
    signs = sum(c for w, c in count.items() if _SIGNS.search(w)) / max(1, n)
    length = len(text) / max(1, n) / 10
    hashed = [0.0] * HASHED
    for w, c in count.items():
        hashed[zlib.crc32(w.encode("utf-8", "surrogatepass")) % HASHED] += c
    return [1.0, same, variety, top, signs, length, np.log1p(n) / 10, *_steps(same, 0.02, 0.1, 0.3), *_steps(signs, 0.01, 0.05, 0.2, 0.5), *_steps(top, 0.2, 0.5), *(h / max(1, n) for h in hashed)]


def metadata_view(text: str, lang: str | None, source: str | None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(text))
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    lines = text.count("\n") + 1
    kinds = [sum(map(text.count, c)) / n for c in ("|", "*#%&$@^~=+_<>{}[]\\/", "0123456789", ".,;:!?", " ")]
    out = [1.0, np.log1p(n) / 12, packed, packed * np.log1p(n) / 12, np.log1p(n / lines) / 8, *(min(1.0, 5 * k) for k in kinds)]
    out += _steps(kinds[0], 0.005, 0.03, 0.1) + _steps(kinds[1], 0.005, 0.03, 0.1) + _steps(packed, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)
    for value, size in ((lang, LANGS), (source, SOURCES)):
        hot = [0.0] * size
        hot[0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (size - 1)] = 1.0
        out += hot
    return out


D = (len(text_view("")), len(metadata_view("", None, None)))


@dataclass
class Model:
    """Weights of both views, their Platt scales (slope, shift), and the combination (bias, text, metadata)."""

    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros(d) for d in D])
    platt: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0), (1.0, 0.0)])
    mix: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.5, 0.5]))

    def logits(self, views: list[np.ndarray]) -> list[np.ndarray]:
        return [a * np.clip(x @ w, -30, 30) + b for x, w, (a, b) in zip(views, self.weights, self.platt, strict=True)]

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        a, b = self.logits(views)
        return sigmoid(self.mix[0] + self.mix[1] * a + self.mix[2] * b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, row (the columns of `keep`), t and m: both views as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = strings(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            t = [np.array(text_view(x), "<f4").tobytes() for x in texts]
            m = [np.array(metadata_view(*x), "<f4").tobytes() for x in zip(texts, langs, sources, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "row", "t", "m"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.struct(*keep).alias("row"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate((text, lang, source))])
    return rows.mapInArrow(run, f"doc_id long, row {rows.schema['row'].dataType.simpleString()}, t binary, m binary")


def _floats(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(at + v).to_pylist()), "<f4").reshape(-1, d).astype(np.float64) for v, d in enumerate(D)]


def _column(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in batch.column(at).to_pylist()], np.float64)


def _summed(rows: DataFrame, sums) -> dict[str, np.ndarray]:  # noqa: ANN001
    """Adds up what sums(views, y, held) gives for each batch, within tasks and then over them; the size doesn't depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in sums(_floats(batch, 0), _column(batch, 2), _column(batch, 3) > 0).items():
                    total[k] = total[k] + v if k in total else v
        names = [k for k, v in total.items() for _ in range(v.size)]
        at = [i for v in total.values() for i in range(v.size)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(np.concatenate([v.ravel() for v in total.values()]) if total else [], pa.float64())], names=["k", "i", "v"])

    got = rows.select("t", "m", "y", F.col("held").cast("int")).mapInArrow(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    size = Counter(r["k"] for r in got)
    out = {k: np.zeros(n) for k, n in size.items()}
    for r in got:
        out[r["k"]][r["i"]] = r["v"]
    return out


BINS = 48


def fit(rows: DataFrame, *, rounds: int = 2, first_steps: int = 5, steps: int = 2, ridge: float = 1.0, sure: float = 0.97, pseudo_weight: float = 0.3) -> Model:
    """A model from stored rows (t, m, y, held); y is null where there is no label. Labelled rows that are held calibrate, the others are fitted."""
    model = Model()

    def newton(teach: bool) -> None:
        now = Model([w.copy() for w in model.weights], list(model.platt), model.mix)

        def sums(views: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
            known, out = ~np.isnan(y), {}
            logits = now.logits(views) if teach else None
            for v, x in enumerate(views):
                target, weight = np.where(known, y, 0.0), (known & ~held).astype(np.float64)
                if teach:
                    other = sigmoid(logits[1 - v])
                    confident = ~known & ((other >= sure) | (other <= 1 - sure))
                    target = np.where(confident, other >= 0.5, target)
                    weight = np.where(confident, pseudo_weight, weight)
                use = weight > 0
                z, target, weight = x[use], target[use], weight[use]
                p = sigmoid(z @ now.weights[v])
                out[f"g{v}"] = z.T @ (weight * (p - target))
                out[f"h{v}"] = ((z * (weight * p * (1 - p))[:, None]).T @ z)[np.triu_indices(D[v])]
            return out

        total = _summed(rows, sums)
        for v, d in enumerate(D):
            if f"g{v}" in total:
                h = np.zeros((d, d))
                h[np.triu_indices(d)] = total[f"h{v}"]
                h = h + np.triu(h, 1).T + ridge * np.eye(d)
                model.weights[v] = model.weights[v] - np.linalg.solve(h, total[f"g{v}"] + ridge * model.weights[v])

    def calibrate() -> None:
        now = Model([w.copy() for w in model.weights])
        edge = np.linspace(-12, 12, BINS + 1)

        def sums(views: list[np.ndarray], y: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
            known = ~np.isnan(y) & held
            a, b = (np.clip(np.digitize(s[known], edge) - 1, 0, BINS - 1) for s in now.logits(views))
            return {"n": np.bincount(a * BINS + b + (y[known] > 0.5) * BINS * BINS, minlength=2 * BINS * BINS).astype(np.float64)}

        n = _summed(rows, sums).get("n", np.zeros(2 * BINS * BINS)).reshape(2, BINS, BINS)
        if n.sum() == 0:
            return
        mid = (edge[1:] + edge[:-1]) / 2
        for v in (0, 1):
            c = n.sum(axis=2 - v)
            shift, slope = _logistic(np.stack([np.ones(BINS), mid], 1), c[1], c[0], np.array([0.0, 1.0]))
            model.platt[v] = (slope, shift)
        la, lb = (s * mid + b for s, b in model.platt)
        grid = np.stack([np.ones((BINS, BINS)), *np.broadcast_arrays(la[:, None], lb[None, :])], 2).reshape(-1, 3)
        model.mix = _logistic(grid, n[1].ravel(), n[0].ravel(), np.array([0.0, 0.5, 0.5]))

    for _ in range(first_steps):
        newton(False)
    calibrate()
    for _ in range(rounds):
        for _ in range(steps):
            newton(True)
        calibrate()
    return model


def _logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, prior: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights near the prior, from counts."""
    w = prior.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ ((pos + neg) * p - pos) + ridge * (w - prior)
        h = (x * ((pos + neg) * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def train(views: DataFrame, labels: DataFrame, *, doc: str = "doc_id", label: str = "quality", **options: float) -> Model:
    """A model from the stored result of features() and the labels of some of its doc_ids."""
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("double")).alias("y"))
    rows = views.select("doc_id", "t", "m").join(y, "doc_id", "left").select("t", "m", "y", (F.col("y").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)).alias("held"))
    return fit(written(rows, "taught"), **options)


def score(views: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The columns that features() kept, p_text, p_metadata, score double, keep boolean: a map over the result of features(), nothing is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch, 1)
            p = [sigmoid(z) for z in model.logits(x)] + [model.score(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(z) for z in p), pa.array(p[2] >= threshold)], names=["row", "p_text", "p_metadata", "score", "keep"])

    kind = views.schema["row"].dataType.simpleString()
    return views.select("row", "t", "m").mapInArrow(run, f"row {kind}, p_text double, p_metadata double, score double, keep boolean").select("row.*", "p_text", "p_metadata", "score", "keep")


def classify(docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), **columns: str) -> DataFrame:
    """All documents, scored (see score) by a model that is trained on them and the labels."""
    views = written(features(docs, keep=keep, **columns), "views")
    return score(views, train(views, labels))
