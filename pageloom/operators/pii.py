"""Redaction of personal data: secrets, e-mail addresses, card and bank account numbers, phone numbers.

Detectors claim spans on the original text in a fixed order; a candidate that overlaps a claimed span, or whose check fails, is
dropped. A native guard hands a worker only texts that can hold a match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.operators.markup import WS

#: What patterns find, what only a model could, and how it is replaced unless said otherwise.
ENTITIES, MODEL_ONLY_ENTITIES, DEFAULT_REPLACE_STYLE = ("EMAIL", "PHONE", "FINANCIAL", "SECRET"), ("PERSON", "LOCATION"), "tag"
RESULT = "struct<text: string, entities: map<string,int>, count: int>"

# What counts as a match.
SECRET = [r"(Bearer\s+)\S+", r"(api(?:\\?[_-])?key\s*[:=]\s*)\S+", r"(x-api-key\s*[:=]\s*)\S+", r"(password\s*[:=]\s*)\S+", r"(secret\s*[:=]\s*)\S+", r"(token\s*[:=]\s*)\S+"]
EMAIL = r"(?:[A-Za-z0-9._%+-]|\\[_-])+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}\b"
CARD = r"(?<![\w-])(?<!\d\.)(?:\d{13,19}|\d{2,6}(?:([ -])\d{2,6})(?:\1\d{2,6})*)(?![\w-])(?!\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PHONE = [
    r"(?<![\w+])\+\d{8,15}(?!\w)",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]\d{1,4}){1,5}(?!\w)",
    r"(?<![\w.,-])(?:1[ .-]?)?\([2-9]\d{2}\)[ .]?\d{3}[ .-]\d{4}(?![\w-])",
    r"(?<![\w.,-])(?:1[ .-])?[2-9]\d{2}([ .-])\d{3}\1\d{4}(?![\w-])",
]


def passes_luhn(candidate: str) -> bool:
    digits = [int(c) for c in candidate if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def passes_mod97(candidate: str) -> bool:
    compact = candidate.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def is_e164(candidate: str) -> bool:
    return 8 <= sum(c.isdigit() for c in candidate) <= 15


_RULES = (
    [("SECRET", re.compile(p.replace(r"\S", f"[^{WS}]").replace(r"\s", f"[{WS}]"), re.A | re.I), None) for p in SECRET]
    + [("EMAIL", re.compile(EMAIL, re.A), None), ("FINANCIAL", re.compile(CARD, re.A), passes_luhn), ("FINANCIAL", re.compile(IBAN, re.A), passes_mod97)]
    + [("PHONE", re.compile(p, re.A), is_e164 if i < 2 else None) for i, p in enumerate(PHONE)]
)


def wanted(entities: Iterable[str] | None) -> frozenset[str]:
    """The classes asked for; none given means all, unknown names count for nothing."""
    asked = [e.upper() for e in entities or () if isinstance(e, str)]
    return frozenset(asked) & frozenset(ENTITIES) if entities else frozenset(ENTITIES)


def spans(text: str, classes: frozenset[str]) -> list[tuple[int, int, str]]:
    """Claimed (start, end, class), by start. Claims never overlap, so that a candidate meets its two neighbours only."""
    claimed: list[tuple[int, int, str]] = []
    for name, pattern, check in _RULES:
        if name in classes:
            for m in pattern.finditer(text):
                start, end = m.end(1) if name == "SECRET" else m.start(), m.end()
                if start < end and (check is None or check(m[0])):
                    at = bisect_left(claimed, (start,))
                    if (at == 0 or claimed[at - 1][1] <= start) and (at == len(claimed) or claimed[at][0] >= end):
                        claimed.insert(at, (start, end, name))
    return claimed


def redact(text: str | None, classes: frozenset[str], style: str = "tag") -> dict:
    found = spans(text, classes) if text else []
    counts: dict[str, int] = {}
    out, at = [], 0
    for a, b, name in found:
        out += [text[at:a], {"mask": "[REDACTED]", "remove": ""}.get(style, f"<{name}>")]
        counts[name] = counts.get(name, 0) + 1
        at = b
    return {"text": None if text is None else "".join(out) + text[at:], "entities": counts, "count": len(found)}


#: A text without any of these has nothing to redact.
GUARD = r"(?i)[@0-9]|bearer|key|password|secret|token"


def redact_pii(text: Column, entities: Iterable[str] | None = None, replace_style: str = "tag") -> Column:
    """struct<text, entities, count>. Null stays null with count 0."""
    classes = wanted(list(entities) if entities is not None else None)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact(t, classes, replace_style) for t in texts], columns=["text", "entities", "count"])

    found = run(F.when(text.rlike(GUARD), text))
    clean = F.struct(text.alias("text"), F.create_map().cast("map<string,int>").alias("entities"), F.lit(0).alias("count"))
    return F.when(text.rlike(GUARD), found).otherwise(clean)
