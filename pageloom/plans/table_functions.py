"""The operators that give several rows of one value, as Python table functions, and the native operators as SQL functions.

A call's rows go back as they are: a batch of Arrow for each call would cost more than most calls. A table function is called by LATERAL, `FROM pages, LATERAL page_links_of(html, url) AS l`; nulls give no rows. A native SQL function is its
operator's expression with the columns as parameters, so that a query that calls it is planned and compiled as if it had been written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import scalars as S
from pageloom.functions import urls, verdict
from pageloom.kernels import flight, jsonquery, pagestate, units
from pageloom.kernels.jsontext import Missing, dumps, try_loads
from pageloom.operators import dom, highlights, markup, pii, registry, tables
from pageloom.sources import body


def _found_paths(json: str, key: str, limit: int) -> Iterable[tuple]:
    root = try_loads(json)
    found = [] if root is Missing else jsonquery.find(root, key, limit=limit)["matches"]
    return [(m["path"], m["preview"], m["addressable"]) for m in found]


def _stream_rows(stream: str) -> Iterable[tuple]:
    return [(name, dumps(value)) for name, value in flight.parse_rows(stream).items()]


def _fields(rows: Iterable[dict], *names: str) -> list[tuple]:
    return [tuple(r[n] for n in names) for r in rows]


#: name: (rows of a call's values, none of them null; their type).
TABLE_FUNCTIONS: dict[str, tuple[Callable[..., Iterable[tuple]], str]] = {
    "page_links_of": (lambda html, url: [(i, *r) for i, r in enumerate(_fields(dom.links(markup.parse(html), url), "href", "text", "type", "domain", "rel", "original_href", "title"))], "pos int, href string, text string, type string, domain string, rel string, original_href string, title string"),
    "page_lines_of": (lambda html: enumerate(filter(None, dom.page_text(markup.parse(html).body).split("\n"))), "pos int, line string"),
    "page_depths_of": (lambda html: sorted(dom.signature(markup.parse(html))[1].items()), "depth int, n int"),
    "cells_of": (lambda html: _fields(tables.cells(html), *tables.CELL_FIELDS), ", ".join(tables.CELL_KINDS)),
    "units_of": (lambda text: _fields(units.segment(text), "text", "kind", "offset", "length", "heading"), "text string, kind string, offset int, length int, heading string"),
    "state_of": (lambda html: _fields(pagestate.extract(html)["sources"], "name", "variable", "json", "bytes", "note"), "name string, variable string, json string, bytes bigint, note string"),
    "json_paths_of": (_found_paths, "path string, preview string, addressable boolean"),
    "stream_rows_of": (_stream_rows, "id string, value string"),
    "redactions_of": (lambda text: pii.spans(text, frozenset(pii.ENTITIES)), "start int, stop int, entity string"),
}

_TEXT, _LISTS, _COUNTS = "STRING", "ARRAY<STRING>", "MAP<INT, INT>"
#: name: (native operator, types of its parameters).
NATIVE_FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "detect_template": (urls.detect, (_TEXT,)), "retired_template": (registry.retired_template, (_TEXT,)), "safe_href": (urls.safe_href, (_TEXT,)), "npm_repository_url": (urls.npm_repository_url, (_TEXT,)),
    "page_challenge": (verdict.challenge, (_TEXT,) * 3), "page_verdict": (verdict.verdict, (_TEXT, _TEXT, _TEXT, _TEXT, "INT")), "body_charset": (body.detect_charset, (_TEXT, "BINARY")),
    "tidy_text": (S.tidy, (_TEXT,)), "money": (S.money, (_TEXT,)), "compare_at_price": (S.compare_at_price, (_TEXT,)), "tag_list": (S.tags, (_TEXT,)), "iso_date": (S.iso_date, (_TEXT,)), "epoch_iso": (S.epoch_iso, ("DOUBLE",)),
    "is_remote": (S.is_remote, (_TEXT,)), "join_location": (S.join_location, (_TEXT,) * 3), "vin_value": (S.vin_value, (_TEXT,)), "vin_error_codes": (S.vin_error_codes, (_TEXT,)), "npi_name": (S.npi_name, (_TEXT,) * 6), "npi_yes_no": (S.npi_yes_no, (_TEXT,)),
    "ld_number": (S.ld_number, (_TEXT,)), "ld_availability": (S.availability, (_TEXT,)), "points_of": (S.points, (_TEXT,)), "comments_of": (S.comments, (_TEXT,)), "rating_of": (S.rating, (_TEXT,)), "count_of": (S.count_of, (_TEXT,)), "exact_count": (S.exact_count, (_TEXT,)),
    "full_size_image": (S.full_size_image, (_TEXT,)), "reddit_post_id": (S.reddit_post_id, (_TEXT,)), "github_repo_name": (S.github_repo_name, (_TEXT,)),
    "stem": (highlights.stem, (_TEXT,)), "text_tokens": (highlights.tokenize, (_TEXT,)), "visible_text": (highlights.visible, (_TEXT,)), "is_reference": (highlights.is_reference, (_TEXT,) * 2),
    "tag_similarity": (dom.tag_similarity, (_LISTS,) * 2), "depth_similarity": (dom.depth_similarity, (_COUNTS,) * 2), "page_similarity": (dom.similarity, (_LISTS, _COUNTS, _LISTS, _COUNTS)),
}


def _table_function(rows: Callable[..., Iterable[tuple]], kind: str):  # noqa: ANN202
    class Rows:
        def eval(self, *values: object) -> Iterable[tuple]:
            if all(v is not None for v in values):
                yield from rows(*values)

    return F.udtf(Rows, returnType=kind, useArrow=False)


# Operators stand in an expression's text as functions, =(a, b); as names they must be quoted. Texts in quotes stay as they are.
_OPERATOR = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`<>=!])(<=>|<=|>=|=|<|>|!|\+|-|\*|/|%|and|or)\(", re.S)


def sql_text(c: Column) -> str:
    """A native expression as SQL."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", c._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Registers all of TABLE_FUNCTIONS and NATIVE_FUNCTIONS for the session; returns their names."""
    for name, (rows, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, _table_function(rows, kind))
    for name, (f, kinds) in NATIVE_FUNCTIONS.items():
        parameters = [f"p{i}" for i in range(len(kinds))]
        text = sql_text(f(*map(F.col, parameters)))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p} {k}' for p, k in zip(parameters, kinds, strict=True))}) RETURN {text}")
    return [*TABLE_FUNCTIONS, *NATIVE_FUNCTIONS]
