"""The Arrow-backed operators as functions of SQL, for sessions that are driven by SQL texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pageloom.functions.weburl import try_parse
from pageloom.kernels import jsonquery, pagestate, units
from pageloom.kernels.jsontext import Missing, dumps, try_loads
from pageloom.operators import dom, markup, pii, tables
from pageloom.operators.embedded import STATE
from pageloom.operators.highlights import UNIT
from pageloom.sources.requests import resolve_one


def _select(json: str, path: str) -> str | None:
    root = try_loads(json)
    value, error = (None, "") if root is Missing else jsonquery.select(root, path)
    return None if error is not None else dumps(value)


def _absolute(href: str, base: str) -> str | None:
    u = try_parse(href, try_parse(base))
    return u.href if u else None


#: name: (function of one row's values, none of them null; its type).
SQL_FUNCTIONS = {
    "page_text": (lambda h: dom.page_text(markup.parse(h).body), "string"),
    "html_text": (markup.text_of, "string"),
    "page_links": (lambda h, u: dom.links(markup.parse(h), u), f"array<{dom.LINK}>"),
    "grid_tables": (tables.grid_html, "string"),
    "absolute_urls": (tables.absolute_html, "string"),
    "absolute_url": (_absolute, "string"),
    "resolve_template_url": (resolve_one, "string"),
    "segment_units": (units.segment, f"array<{UNIT}>"),
    "embedded_state": (pagestate.extract, STATE),
    "json_select": (_select, "string"),
    "redact_pii": (lambda t: pii.redact(t, frozenset(pii.ENTITIES))["text"], "string"),
}


def _udf(f, kind: str, n: int):  # noqa: ANN001, ANN202
    def rows(*series: pd.Series) -> list:
        return [f(*x) if all(isinstance(v, str) for v in x) else None for x in zip(*series, strict=True)]

    def out(*series: pd.Series) -> pd.Series | pd.DataFrame:
        r = rows(*series)
        if not kind.startswith("struct<"):
            return pd.Series(r, dtype=object)
        return pd.DataFrame([x or {"sources": None, "warnings": None} for x in r])

    def one(a: pd.Series) -> pd.Series:
        return out(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return out(a, b)

    def whole(a: pd.Series) -> pd.DataFrame:
        return out(a)

    return F.pandas_udf(whole if kind.startswith("struct<") else one if n == 1 else two, kind)


def register(spark: SparkSession) -> list[str]:
    """Registers all of SQL_FUNCTIONS; returns their names."""
    for name, (f, kind) in SQL_FUNCTIONS.items():
        n = 2 if name in ("page_links", "absolute_urls", "absolute_url", "resolve_template_url", "json_select") else 1
        spark.udf.register(name, _udf(f, kind, n))
    return list(SQL_FUNCTIONS)
