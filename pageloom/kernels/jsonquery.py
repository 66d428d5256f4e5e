"""Values out of JSON by path, and paths by the name of a property."""

from __future__ import annotations

import re
from itertools import islice

from pageloom.kernels.jsontext import keys_of, pieces, scalar

MAX_NODES = 5_000_000
MOST_KEYS = 25


def path_of(path: str) -> list[str]:
    """`a.b[0]["c"]` is a, b, 0, c. Empty steps don't count."""
    steps = []
    for head, *brackets in (part.split("[") for part in path.split(".")):
        steps += [head, *(re.sub(r"^['\"]|['\"]$", "", b.removesuffix("]")) for b in brackets)]
    return [s for s in steps if s]


def _options(x: object) -> str:
    if isinstance(x, list):
        return f"array of length {len(x)}"
    if isinstance(x, dict):
        names = list(keys_of(x))
        return "available keys: " + ", ".join(names[:MOST_KEYS]) + (f", … ({len(names)} total)" if len(names) > MOST_KEYS else "")
    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
    return f"a {kind} value, which has no keys"


def _index(step: str, n: int) -> int | None:
    try:
        i = float(step)
    except ValueError:
        return None
    return int(i) if i.is_integer() and 0 <= i < n else None


def select(root: object, path: str) -> tuple[object, str | None]:
    """(value, None), or (None, what was missing where)."""
    steps = path_of(path)
    if not steps:
        return None, f'Path "{path}" is empty'
    x = root
    for k, step in enumerate(steps):
        i = _index(step, len(x)) if isinstance(x, list) else step if isinstance(x, dict) and step in x else None
        if i is None:
            at = f'"{".".join(steps[:k])}"' if k else "the result"
            return None, f'Path "{path}" not found: {at} has no "{step}" ({_options(x)})'
        x = x[i]
    return x, None


def preview(value: object, most: int) -> str:
    """The first characters of a value's JSON; of the rest nothing is written."""
    if isinstance(value, str):
        return scalar(value[:most])[:most]
    out, n = [], 0
    for p in pieces(value):
        out.append(p)
        n += len(p)
        if n >= most:
            break
    return "".join(out)[:most]


def find(root: object, key: str, *, limit: int = 50, preview_chars: int = 200, max_nodes: int = MAX_NODES) -> dict:
    """Where properties of this name (in any case) stand, in document order. Indexes of arrays have no name."""
    found, total, wanted, cut = [], 0, key.lower(), False
    if not isinstance(root, list | dict):
        return {"matches": [], "total": 0, "truncated": False}
    # A place is (value, its step, whether that is a property's name, the place above, whether a path can say it).
    stack: list = [(root, None, False, None, True)]
    visited = 0
    while stack:
        visited += 1
        if visited > max_nodes:
            cut = True
            break
        place = stack.pop()
        value, step, named, up, sayable = place
        if named and step.lower() == wanted:
            total += 1
            if len(found) < limit:
                steps, x = [], place
                while x[3] is not None:
                    steps.append(x[1])
                    x = x[3]
                found.append({"path": ".".join(reversed(steps)), "preview": preview(value, preview_chars), "addressable": sayable})
        if isinstance(value, list):
            stack.extend((value[i], str(i), False, place, sayable) for i in range(len(value) - 1, -1, -1))
        elif isinstance(value, dict):
            stack.extend((value[k], k, True, place, sayable and k != "" and not ("." in k or "[" in k)) for k in reversed(list(keys_of(value))))
    return {"matches": found, "total": total, "truncated": cut or total > len(found)}


def flatten_ld(node: object, most: int = MAX_NODES) -> list[dict]:
    """The objects of a linked-data block: those of arrays and of @graph, each before what it holds."""
    out, stack = [], [node]
    while stack and len(out) < most:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            out.append(x)
            if x.get("@graph"):
                stack.append(x["@graph"])
    return list(islice(out, most))
