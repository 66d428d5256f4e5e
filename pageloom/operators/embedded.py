"""Columns over the JSON that pages carry: found state, component rows, values by path, paths by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.kernels import devalue, flight, jsliteral, jsonquery, pagestate
from pageloom.kernels.jsontext import Missing, dumps, try_loads

SOURCE = "struct<name: string, variable: string, json: string, bytes: bigint, note: string>"
STATE = f"struct<sources: array<{SOURCE}>, warnings: array<string>>"
VALUE = "struct<value: string, warnings: array<string>>"


def _column(f: Callable, kind: str, *columns: Column) -> Column:
    """f of each row whose values aren't null, null of the others; rows that can't have a result come as null."""

    def run(*series: pd.Series) -> pd.Series | pd.DataFrame:
        rows = [f(*x) if all(isinstance(v, str) for v in x) else None for x in zip(*series, strict=True)]
        if kind.startswith("struct<"):
            names = next((r for r in rows if r is not None), None)
            return pd.DataFrame([names and dict.fromkeys(names) if r is None else r for r in rows]) if names else pd.DataFrame({c: [None] * len(rows) for c in fields})
        return pd.Series(rows, dtype=object)

    fields = [x.split(":")[0].strip() for x in _split(kind[7:-1])] if kind.startswith("struct<") else []
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def embedded_state(html: Column, *, raw: bool = False) -> Column:
    """struct<sources, warnings> of a page: what state it carries, as JSON with its size in bytes. Pages that can't carry any skip the reader."""
    may = html.rlike(r"(?i)<script|\sdata-")
    found = _column(lambda h: pagestate.extract(h, raw=raw), STATE, F.when(may, html))
    none = F.struct(F.array().cast(f"array<{SOURCE}>").alias("sources"), F.array().cast("array<string>").alias("warnings"))
    return F.when(html.isNotNull(), F.when(may, found).otherwise(none))


def embedded_sources(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """A row for each state that a page carries, in order."""
    return df.select(*keep, embedded_state(F.col(html)).alias("s")).select(*keep, F.posexplode("s.sources").alias("pos", "source")).select(*keep, "pos", "source.*")


def flight_rows(stream: Column) -> Column:
    """array<struct<id, value>> of a component stream, in the order of its ids; values as JSON."""
    return _column(lambda t: [{"id": k, "value": dumps(v)} for k, v in flight.parse_rows(t).items()], "array<struct<id: string, value: string>>", stream)


def flight_resolved(stream: Column, budget: int | None = None) -> Column:
    """struct<rows, resolved, cycles, over_budget>: rows as JSON with their references replaced."""

    def one(t: str) -> dict:
        r = flight.resolve_rows(flight.parse_rows(t), budget)
        return r | {"rows": dumps(r["rows"])}

    return _column(one, "struct<rows: string, resolved: bigint, cycles: bigint, over_budget: bigint>", stream)


def flight_data_rows(stream: Column) -> Column:
    return _column(lambda t: flight.data_rows(flight.parse_rows(t)), "array<struct<id: string, bytes: bigint, keys: array<string>, length: bigint>>", stream)


def apollo_transport(html: Column) -> Column:
    """The pushes of a page as JSON texts."""
    return _column(lambda h: list(map(dumps, pagestate.apollo_transport(h))), "array<string>", html)


def nuxt_data(payload: Column) -> Column:
    def one(t: str) -> dict:
        value, said = devalue.decode(None if (x := try_loads(t)) is Missing else x)
        return {"value": None if value is None else dumps(value), "warnings": said}

    return _column(one, VALUE, payload)


def script_literal(source: Column) -> Column:
    """struct<value, reason>: a script literal as JSON, or why it is none."""

    def one(t: str) -> dict:
        ok, value, _ = jsliteral.evaluate(t)
        return {"value": dumps(value) if ok else None, "reason": None if ok else value}

    return _column(one, "struct<value: string, reason: string>", source)


def _reader(name: str) -> Callable[[Column], Column]:
    def one(h: str) -> dict:
        items = list(getattr(pagestate.Page(h), name)())
        value = next((i.value for i in items if not isinstance(i, str)), None)
        return {"value": None if value is None else dumps(value), "warnings": [i for i in items if isinstance(i, str)]}

    return lambda html: _column(one, VALUE, html)


#: struct<value, warnings> of one framework's state.
sveltekit_data, inertia_page, shopify_state = (_reader(n) for n in ("svelte", "inertia", "shopify"))


def json_attributes(html: Column, min_bytes: int = pagestate.MIN_ATTRIBUTE_BYTES) -> Column:
    one = lambda h: [x | {"data": dumps(x["data"])} for x in pagestate.Page(h).json_attributes(min_bytes)]
    return _column(one, "array<struct<tag: string, attribute: string, id: string, data: string>>", html)


def serialized_size(json: Column) -> Column:
    """Bytes of a JSON text's value as it would be written."""
    return _column(lambda t: None if (x := try_loads(t)) is Missing else flight.Sizes().of(x), "bigint", json)


def json_select(json: Column, path: str) -> Column:
    """struct<value, error>: the value at a path as JSON, or what was missing where."""

    def one(t: str) -> dict:
        root = try_loads(t)
        value, error = (None, "not JSON") if root is Missing else jsonquery.select(root, path)
        return {"value": None if error else dumps(value), "error": error}

    return _column(one, "struct<value: string, error: string>", json)


def json_value(json: Column, path: str) -> Column:
    """The value at a path as text, natively; null if there is none. For filters and keys that need no diagnosis."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in jsonquery.path_of(path))
    return F.get_json_object(json, f"${steps}")


def find_json_paths(json: Column, key: str, *, limit: int = 50, preview_chars: int = 200, max_nodes: int = jsonquery.MAX_NODES) -> Column:
    """struct<matches, total, truncated>: where properties of a name stand."""

    def one(t: str) -> dict:
        root = try_loads(t)
        return jsonquery.find(None if root is Missing else root, key, limit=limit, preview_chars=preview_chars, max_nodes=max_nodes)

    return _column(one, "struct<matches: array<struct<path: string, preview: string, addressable: boolean>>, total: bigint, truncated: boolean>", json)


def preview_json(json: Column, most: int = 200) -> Column:
    return _column(lambda t: None if (x := try_loads(t)) is Missing else jsonquery.preview(x, most), "string", json)


def flatten_ld(json: Column) -> Column:
    """The objects of a linked-data block as JSON texts."""
    return _column(lambda t: [] if (x := try_loads(t)) is Missing else list(map(dumps, jsonquery.flatten_ld(x))), "array<string>", json)
