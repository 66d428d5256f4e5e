"""Flat payloads in which every value is named by its index, as decoded data that JSON can hold."""

from __future__ import annotations

import base64
import struct

from pageloom.kernels.jsontext import Missing, keys_of, try_loads

MAX_DEPTH, MAX_COST, CHARS_PER_UNIT = 512, 5_000_000, 16
# Numbers that stand for values without an index; types with a meaning of their own; wrappers around a value.
HOLE, SPARSE = -2, -7
SPECIAL = {-1: None, -3: None, -4: None, -5: None, -6: 0}
TEXT_TYPES = frozenset("Date URL URLSearchParams Temporal.Duration Temporal.Instant Temporal.PlainDate Temporal.PlainTime Temporal.PlainDateTime Temporal.PlainMonthDay Temporal.PlainYearMonth Temporal.ZonedDateTime".split())
ARRAY_TYPES = {
    "Int8Array": "b", "Uint8Array": "B", "Uint8ClampedArray": "B", "Int16Array": "h", "Uint16Array": "H", "Float16Array": "e", "Int32Array": "i", "Uint32Array": "I", "Float32Array": "f", "Float64Array": "d", "BigInt64Array": "q", "BigUint64Array": "Q", "DataView": "B", "ArrayBuffer": "B",
}
OTHER_TYPES = frozenset({"Set", "Map", "RegExp", "Object", "BigInt", "null"})
WRAPPERS = frozenset("NuxtError ShallowRef ShallowReactive Ref Reactive".split())
EMPTY = frozenset({"EmptyRef", "EmptyShallowRef"})


class Pairs(list):
    """A map's entries."""


def revive_empty(x: object) -> object:
    """What an empty reference was made with."""
    if not isinstance(x, str):
        return x
    if x in ("_", "0n"):
        return None if x == "_" else 0
    value = try_loads(x)
    return x if value is Missing else value


class Decoder:
    def __init__(self, values: list) -> None:
        self.values, self.made = values, {}

    def at(self, i: object) -> object:
        if not isinstance(i, int) or isinstance(i, bool):
            raise ValueError("invalid input")
        if i < 0:
            if i not in SPECIAL:
                raise ValueError("invalid index")
            return SPECIAL[i]
        if i in self.made:
            return self.made[i]
        if i >= len(self.values):
            raise ValueError("invalid index")
        x = self.values[i]
        if isinstance(x, dict):
            out = self.made[i] = {}
            for k in keys_of(x):
                out[k] = self.at(x[k])
        elif isinstance(x, list) and x and isinstance(x[0], str):
            out = self.made[i] = self.typed(i, x[0], x[1:])
        elif isinstance(x, list) and x and x[0] == SPARSE:
            out = self.made[i] = {"length": x[1]} if x[1] > MAX_COST else [None] * x[1]
            if isinstance(out, dict):
                out.clear()
            for k, v in zip(x[2::2], x[3::2], strict=False):
                out[str(k) if isinstance(out, dict) else k] = self.at(v)
        elif isinstance(x, list):
            out = self.made[i] = []
            out.extend(None if v == HOLE else self.at(v) for v in x)
        else:
            out = self.made[i] = x
        return out

    def typed(self, i: int, kind: str, args: list) -> object:
        first = args[0] if args else None
        if kind in TEXT_TYPES:
            return first if isinstance(first, str) else None
        if kind == "RegExp":
            return f"/{first}/{args[1] if len(args) > 1 and args[1] is not None else ''}"
        if kind == "BigInt":
            return str(int(first))
        if kind == "Object":
            return first
        if kind in ARRAY_TYPES:
            raw = base64.b64decode(first) if isinstance(first, str) else bytes(self.at(first))
            numbers = struct.unpack(f"<{len(raw) // struct.calcsize(ARRAY_TYPES[kind])}{ARRAY_TYPES[kind]}", raw)
            return [str(n) if kind.startswith("Big") else n for n in numbers]
        if kind in ("Set", "Map", "null"):
            out = self.made[i] = [] if kind == "Set" else Pairs() if kind == "Map" else {}
            if kind == "Set":
                out.extend(self.at(v) for v in args)
            else:
                for k, v in zip(args[::2], args[1::2], strict=False):
                    if kind == "Map":
                        out.append((self.at(k), self.at(v)))
                    else:
                        out[k] = self.at(v)
            return out
        if isinstance(first, int) and not isinstance(first, bool):
            value = self.at(first)
        else:
            self.values.append(first)
            value = self.at(len(self.values) - 1)
        return revive_empty(value) if kind in EMPTY else value


class Plain:
    """A decoded graph as a tree: a value inside itself is {$ref: its path}; past the budget a repeated one is, too, and others are null."""

    def __init__(self) -> None:
        self.first: dict[int, str] = {}
        self.open: set[int] = set()
        self.cost, self.cut, self.over = 0, False, False

    def of(self, x: object, path: str = "", depth: int = 0) -> object:
        self.cost += 1 + (len(x) // CHARS_PER_UNIT if isinstance(x, str) else 0)
        if not isinstance(x, list | dict):
            if x is None or self.cost > MAX_COST:
                self.over |= x is not None
                return None
            return None if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x
        if id(x) in self.open:
            return {"$ref": self.first[id(x)]}
        if self.cost > MAX_COST:
            self.over = True
            return {"$ref": self.first[id(x)]} if id(x) in self.first else None
        if depth > MAX_DEPTH:
            self.cut = True
            return None
        self.first.setdefault(id(x), path)
        self.open.add(id(x))
        below = lambda k: f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}" if path else k
        if isinstance(x, dict):
            out = {k: self.of(x[k], below(k), depth + 1) for k in keys_of(x)}
        elif not isinstance(x, Pairs):
            out = [self.of(v, below(k), depth + 1) for k, v in enumerate(x)]
        elif all(isinstance(k, str) for k, _ in x):
            out = {k: self.of(v, below(k), depth + 1) for k, v in x}
        else:
            out = [[self.of(v, f"{below(n)}[{k}]", depth + 1) for k, v in enumerate(pair)] for n, pair in enumerate(x)]
        self.open.discard(id(x))
        return out


def decode(payload: object) -> tuple[object, list[str]]:
    """(value, warnings); the value is None if it can't be decoded."""
    if not isinstance(payload, list) or not payload:
        return None, ["__NUXT_DATA__ is not a devalue payload (expected a non-empty array); not decoded."]
    known = TEXT_TYPES | ARRAY_TYPES.keys() | OTHER_TYPES | WRAPPERS | EMPTY
    unknown = dict.fromkeys(x[0] for x in payload if isinstance(x, list) and x and isinstance(x[0], str) and x[0] not in known)
    said = [f"__NUXT_DATA__ uses reviver type(s) this reader does not know ({', '.join(unknown)}); each was read as its plain value."] if unknown else []
    try:
        decoded = Decoder(list(payload)).at(0)
    except (ValueError, TypeError, IndexError, KeyError, struct.error, RecursionError) as e:
        return None, [*said, f"__NUXT_DATA__ could not be decoded: {e}."]
    plain = Plain()
    value = plain.of(decoded)
    if plain.cut:
        said.append(f"Branches nested deeper than {MAX_DEPTH} levels were cut and read as null.")
    if plain.over:
        said.append(f"The decoded payload passed its output budget ({MAX_COST} units); past it, repeated objects are written as {{ $ref }} and other values as null.")
    return value, said
