"""The units of a text that answer a query: BM25 over the units of each text, natively and without a shuffle.

A text's units stay in its row as an array: document frequencies and the mean length are those of one text, so that nothing has to meet
elsewhere. Only the cut into units needs a worker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.bind import let, piecewise
from pageloom.functions.scalars import SPACE, strip
from pageloom.kernels.units import segment

# Weights, words that carry no meaning, words that stand for each other, what answers look like.
K1, B, PHRASE_BOOST, ANSWER_BOOST, SYNONYM_WEIGHT, HEADING_WEIGHT, REFERENCE_WEIGHT, MIN_LENGTH = 1.2, 0.75, 1.5, 1.3, 0.5, 0.5, 0.25, 4.0
STOPWORDS = "a an and are as at be been by can did do does for from had has have how i in is it its me of on or that the their there this to was were what when where which who whom whose why will with you your".split()
SYNONYMS = ["create creator creation design designer conceive invent inventor develop developer found founder author wrote written".split(), "release launch publish debut appear introduce unveil".split()]
SUFFIXES = ("ing", "ed", "es", "s")
PERSON = r"(?<![A-Za-z0-9_])\p{Lu}\p{Ll}+(?:\s+(?:(?:van|von|de|der|den|da|di|du|le|la|bin|al)\s+)?\p{Lu}\p{Ll}+)+"
DATE = r"(?i)(?<![A-Za-z0-9_])(?:(?:1[5-9][0-9][0-9]|20[0-9][0-9])s?|january|february|march|april|may|june|july|august|september|october|november|december)(?![A-Za-z0-9_])"
REFERENCES = r"(?i)^(?:(?:references?|notes?|citations?|sources?|footnotes?|bibliography|works cited)(?:\s*(?:,|&|and)\s*|\s*$))+$"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}々〆〇ー"
_RUN = rf"([\p{{L}}\p{{N}}&&[{_CJK}]]+|[\p{{L}}\p{{N}}\p{{M}}&&[^{_CJK}]]+)"
_LINK_END = r"(?:[^()\\\s]|\\.|\([^()\s]*+\))*+(?:\s++\"(?:[^\"\\]|\\.)*+\")?\)"
_LABEL = r"!?\[((?:[^\[\]\\]|\\.)*+)\]\("

UNIT = "struct<text: string, kind: string, offset: int, length: int, heading: string>"


def segment_units(markdown: Column) -> Column:
    """array<struct<text, kind, offset, length, heading>>; null and empty texts have none."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: segment(t) if isinstance(t, str) else [])

    return piecewise(run, f"array<{UNIT}>", 1)(markdown)


def stem(token: Column) -> Column:
    """A longer word without one common ending, and then without an e."""
    cut = F.regexp_replace(token, f"(?:{'|'.join(SUFFIXES)})$", "")
    short = F.when(F.char_length(cut) > 4, F.regexp_replace(cut, "e$", "")).otherwise(cut)
    return F.when(F.char_length(token) <= 4, token).otherwise(short)


def tokenize(text: Column) -> Column:
    """Tokens of a text: stems of words, pairs of neighbours in scripts without spaces."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_RUN), F.lit(1))

    def of(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{_CJK}]"), pairs).otherwise(F.array(stem(run)))

    return F.flatten(F.transform(runs, of))


def visible(text: Column) -> Column:
    """Links as their labels, citation marks as a space; links inside labels, too."""
    out = text
    for _ in range(2):
        out = F.regexp_replace(out, _LABEL + r"(?=#cite_(?:note|ref))" + _LINK_END, " ")
        out = F.regexp_replace(out, _LABEL + _LINK_END, "$1")
    return F.when(text.contains("]("), out).otherwise(text)


# The query is one short text, read on the driver by the same rules.


def _stem(t: str) -> str:
    if len(t) <= 4:
        return t
    t = next((t[: -len(s)] for s in SUFFIXES if t.endswith(s)), t)
    return t[:-1] if len(t) > 4 and t.endswith("e") else t


def _tokens(text: str) -> list[str]:
    import unicodedata

    cjk = lambda c: c in "々〆〇ー" or any(unicodedata.name(c, "").startswith(x) for x in ("CJK UNIFIED", "CJK COMPAT", "HIRAGANA", "KATAKANA", "HANGUL"))
    runs: list[list] = []
    for c in text.lower():
        kind = None if unicodedata.category(c)[0] not in "LNM" else "cjk" if cjk(c) else "word"
        if kind and runs and runs[-1][0] == kind:
            runs[-1][1] += c
        else:
            runs.append([kind, c])
    out = []
    for kind, run in runs:
        if kind == "word":
            out.append(_stem(run))
        elif kind:
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


def terms_of(query: str) -> dict[str, list[str]]:
    """The query's terms with the words that stand for each; stop words only if there is nothing else."""
    every = list(dict.fromkeys(_tokens(query)))
    stop = {_stem(w) for w in STOPWORDS}
    groups = [list(dict.fromkeys(_stem(v) for w in g for v in (w, f"{w}d", f"{w}ed"))) for g in SYNONYMS]
    terms = [t for t in every if t not in stop] or every
    return {t: [o for o in next((g for g in groups if t in g), []) if o != t] for t in terms}


def answer_patterns(query: str) -> list[str]:
    q = query.lower()
    return [PERSON] * bool(re.search(r"\bwho(?:m|se)?\b", q, re.A)) + [DATE] * bool(re.search(r"\bwhen\b|\b(?:what|which) year\b", q, re.A))


def is_reference(text: Column, heading: Column) -> Column:
    return text.contains("](#cite_ref") | F.coalesce(strip(heading).rlike(REFERENCES), F.lit(False))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda t: t == F.lit(word)


def rank_units(units: Column, query: str, *, max_units: float = 10, min_score: float = 0) -> Column:
    """The best units of each row's array with their score, best first, ties by offset. Scores are rounded to three places before they are compared with min_score."""
    phrase = query.strip().lower()
    terms = terms_of(phrase) if phrase else {}
    kind = f"array<struct<{UNIT[7:-1]}, score: double>>"
    if not terms:
        return F.array().cast(kind)
    words = list(dict.fromkeys([*terms, *(o for others in terms.values() for o in others)]))
    limit = max(1, math.floor(max_units)) if math.isfinite(max_units) else 10
    floor = min_score if math.isfinite(min_score) else 0

    def shown(u: Column) -> Column:
        text = visible(F.coalesce(u["text"], F.lit("")))
        return F.struct(u.alias("u"), text.alias("shown"), tokenize(text).alias("own"), F.array_distinct(tokenize(visible(F.coalesce(u["heading"], F.lit(""))))).alias("above"))

    def counted(x: Column) -> Column:
        above = F.array_except(x["above"], x["own"])
        length = F.greatest(F.size(x["own"]) + HEADING_WEIGHT * F.size(above), F.lit(MIN_LENGTH))
        own = F.array(*[F.size(F.filter(x["own"], _is(w))).cast("double") for w in words])
        heads = F.array(*[F.array_contains(above, w).cast("double") * HEADING_WEIGHT for w in words])
        return F.struct(x["u"].alias("u"), x["shown"].alias("shown"), length.alias("length"), own.alias("own"), heads.alias("heads"))

    zero = F.array(*[F.lit(0.0)] * len(words))

    def stats(d: Column) -> Column:
        n = F.size(d).cast("double")
        df = F.aggregate(d, zero, lambda s, x: F.zip_with(s, x["own"], lambda a, b: a + F.when(b > 0, 1.0).otherwise(0.0)))
        mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x["length"]) / F.nullif(n, F.lit(0.0))
        return F.struct(d.alias("docs"), mean.alias("mean"), F.transform(df, lambda x: F.log(1 + (n - x + 0.5) / (x + 0.5))).alias("idf"))

    def scored(x: Column, corpus: Column) -> Column:
        tf = F.zip_with(x["own"], x["heads"], lambda a, b: a + b)
        each = F.zip_with(corpus["idf"], tf, lambda i, t: i * (t * (K1 + 1)) / (t + K1 * (1 - B + B * x["length"] / corpus["mean"])))
        total = F.lit(0.0)
        for t, others in terms.items():
            at = [F.get(each, F.lit(words.index(w))) * (1.0 if w == t else SYNONYM_WEIGHT) for w in (t, *others)]
            total = total + (F.greatest(*at) if others else at[0])
        return F.struct(x["u"].alias("u"), x["shown"].alias("shown"), total.alias("total"))

    def boosted(x: Column) -> Column:
        total = x["total"]
        for pattern in answer_patterns(phrase):
            total = total * F.when(x["shown"].rlike(pattern), ANSWER_BOOST).otherwise(1.0)
        total = total * F.when(F.contains(F.lower(x["shown"]), F.lit(phrase)), PHRASE_BOOST).otherwise(1.0)
        total = total * F.when(is_reference(F.coalesce(x["u"]["text"], F.lit("")), x["u"]["heading"]), REFERENCE_WEIGHT).otherwise(1.0)
        return F.struct((-F.floor(total * 1000 + 0.5) / 1000).alias("down"), x["u"]["offset"].alias("offset"), x["u"].alias("u"))

    docs = F.transform(F.transform(units, shown), counted)
    some = let(let(docs, stats), lambda c: F.filter(F.transform(c["docs"], lambda x: scored(x, c)), lambda x: x["total"] > 0))
    ranked = F.filter(F.transform(some, boosted), lambda r: (r["down"] < 0) & (-r["down"] > floor))
    best = F.slice(F.array_sort(ranked), 1, limit)
    return F.transform(best, lambda r: F.struct(*[r["u"][c].alias(c) for c in ("text", "kind", "offset", "length", "heading")], (-r["down"]).alias("score"))).cast(kind)
