"""JSON as browsers read and write it: strict, of any depth, with integer-like keys first."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

_LONE = re.compile("[\ud800-\udfff]")
_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\]:,])|(\"(?:[^\"\\\x00-\x1f]|\\.)*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))")


class Missing:
    """What no JSON text stands for."""


def _number(text: str) -> float | int | None:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _refuse(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=_refuse)


def _deep(text: str) -> object:
    """The value of a text that is nested too deep for the library's reader."""
    at, root = 0, []
    stack: list = [root]
    keys: list = [None]
    want = "value"  # value, value or end, key, key or end, colon, comma
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        sign, string, scalar = m.groups()
        top = stack[-1]
        if sign in ("}", "]"):
            if len(stack) == 1 or isinstance(top, dict) != (sign == "}") or want not in ("comma", "value or end", "key or end"):
                raise ValueError("unexpected end")
            stack.pop()
            keys.pop()
        elif sign == "," and want == "comma" and len(stack) > 1:
            want = "key" if isinstance(top, dict) else "value"
            continue
        elif sign == ":" and want == "colon":
            want = "value"
            continue
        elif string is not None and want in ("key", "key or end"):
            keys[-1] = json.loads(string)
            want = "colon"
            continue
        elif want in ("value", "value or end") and sign in ("{", "[", None):
            value = {} if sign == "{" else [] if sign == "[" else json.loads(string, strict=True) if string is not None else _DECODER.decode(scalar)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if sign:
                stack.append(value)
                keys.append(None)
                want = "key or end" if sign == "{" else "value or end"
                continue
        else:
            raise ValueError("unexpected token")
        if len(stack) == 1:
            break
        want = "comma"
    if len(stack) != 1 or len(root) != 1 or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return root[0]


def loads(text: str) -> object:
    """The value of a text; ValueError if it is no JSON."""
    if text[:1] == "\ufeff":
        raise ValueError("not JSON")
    try:
        value, end = _DECODER.raw_decode(text.lstrip(" \t\n\r"))
        if text.lstrip(" \t\n\r")[end:].strip(" \t\n\r"):
            raise ValueError("not JSON")
        return value
    except RecursionError:
        return _deep(text)


def try_loads(text: str) -> object:
    try:
        return loads(text)
    except ValueError:
        return Missing


def scalar(x: object) -> str:
    if isinstance(x, str):
        out = json.dumps(x, ensure_ascii=False)
        return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out) if _LONE.search(out) else out
    if isinstance(x, float):
        return "null" if x != x or x in (float("inf"), float("-inf")) else re.sub(r"e([+-])0+(?=\d)", r"e\1", repr(int(x) if x.is_integer() and abs(x) < 1e21 else x))
    return "null" if x is None else "true" if x is True else "false" if x is False else str(x)


def keys_of(x: dict) -> Iterable[str]:
    """Keys in the order that browsers give them: integers first, by value."""
    numbers = [k for k in x if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and len(k) < 10]
    if not numbers:
        return x
    rest = set(numbers)
    return [*sorted(numbers, key=int), *(k for k in x if k not in rest)]


def pieces(value: object) -> Iterable[str]:
    """The JSON text of a value, bit by bit, of any depth."""
    stack: list = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            yield x[0]
        elif isinstance(x, list):
            yield "["
            stack.append(("]",))
            for i in range(len(x) - 1, -1, -1):
                stack.append(x[i])
                if i:
                    stack.append((",",))
        elif isinstance(x, dict):
            yield "{"
            stack.append(("}",))
            names = list(keys_of(x))
            for i in range(len(names) - 1, -1, -1):
                stack.append(x[names[i]])
                stack.append((("," if i else "") + scalar(names[i]) + ":",))
        else:
            yield scalar(x)


def dumps(value: object) -> str:
    return "".join(pieces(value))


def size(value: object) -> int:
    """Bytes of the JSON text."""
    return sum(len(p.encode("utf-8", "surrogatepass")) for p in pieces(value))
