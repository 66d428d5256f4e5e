"""Script literals without running them: a small parser for the forms that pages ship their state in, and a bounded evaluation.

Read are strings, numbers, booleans, null, arrays, objects with plain keys, + - ! and void, templates without expressions, joined strings,
dates and patterns made with `new`, and functions that are called where they stand and only return such a value. A name means a parameter of
such a function or undefined, NaN, Infinity. Everything else is refused with a reason. Bounds: nesting of 512, and a cost of 5,000,000
(one for each node, one for 16 characters of text, and for a parameter what its argument cost).
"""

from __future__ import annotations

import datetime
import math
import re
import sys

MAX_DEPTH, MAX_COST, CHARS_PER_UNIT = 512, 5_000_000, 16
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # for MAX_DEPTH levels of the parser below

_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r]*|/\*.*?\*/)*", re.S)
_TOKEN = re.compile(
    r"""(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>(?:[^\W\d]|[$_])(?:\w|\$)*)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<tpl>`(?:[^`\\]|\\.)*`)
    |(?P<op>\.\.\.|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\*\*|<<|>>|[{}()\[\],:;.?+\-*/%!~<>=&|^])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}


class Refusal(Exception):
    """Not a literal."""


class Undefined:
    """The value of void 0."""


def unescape(body: str) -> str:
    if "\\" not in body:
        return body
    text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _PLAIN.get(m[4], m[4]), body)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", text) else text


class Parser:
    """Nodes are tuples whose first item names their kind."""

    def __init__(self, text: str, start: int = 0) -> None:
        self.text, self.depth = text, 0
        self.end = start  # of the last token that was taken
        self.next(start)

    def next(self, at: int) -> None:
        at = _SKIP.match(self.text, at).end()
        m = _TOKEN.match(self.text, at)
        self.kind, self.token, self.after = (m.lastgroup, m[0], m.end()) if m else (None, self.text[at : at + 1], at)

    def take(self, token: str | None = None) -> str:
        if self.kind is None or (token is not None and (self.token != token or self.kind == "str")):
            raise SyntaxError(f"unexpected {self.token or 'end'!r}")
        out, self.end = self.token, self.after
        self.next(self.after)
        return out

    def at(self, *tokens: str) -> bool:
        return self.kind in ("op", "name") and self.token in tokens

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH + 8:
            raise Refusal(f"nesting deeper than {MAX_DEPTH} levels")
        left = self.unary()
        while self.at("+", "-", "*", "/", "%", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "??", "&", "|", "^", "<<", ">>", "**", "in", "instanceof"):
            op = self.take()
            left = ("binary", op, left, self.unary())
        if self.at("?", "=", "=>"):
            left = ("other", {"?": "ConditionalExpression", "=": "AssignmentExpression", "=>": "ArrowFunctionExpression"}[self.token])
        self.depth -= 1
        return left

    def unary(self) -> tuple:
        if self.at("-", "+", "!", "~", "void", "typeof", "delete"):
            return ("unary", self.take(), self._nested(self.unary))
        if self.at("new"):
            self.take()
            name = self.take() if self.kind == "name" else None
            return ("new", name, self.arguments() if self.at("(") else [])
        return self.postfix(self.primary())

    def _nested(self, parse) -> tuple:  # noqa: ANN001
        self.depth += 1
        if self.depth > MAX_DEPTH + 8:
            raise Refusal(f"nesting deeper than {MAX_DEPTH} levels")
        out = parse()
        self.depth -= 1
        return out

    def postfix(self, node: tuple) -> tuple:
        while True:
            if self.at("("):
                node = ("call", node, self.arguments())
            elif self.at(".", "?."):
                self.take()
                self.take()
                node = ("other", "MemberExpression")
            elif self.at("["):
                self.take()
                self.expression()
                self.take("]")
                node = ("other", "MemberExpression")
            else:
                return node

    def arguments(self) -> list:
        self.take("(")
        return self.items(")")

    def items(self, close: str) -> list:
        out = []
        while not self.at(close):
            if self.at(","):
                out.append(None)
            elif self.at("..."):
                self.take()
                self.expression()
                out.append(("spread",))
            else:
                out.append(self.expression())
            if not self.at(close):
                self.take(",")
        self.take(close)
        return out

    def primary(self) -> tuple:
        kind, token = self.kind, self.token
        if kind == "num":
            self.take()
            plain = token.replace("_", "")
            if plain.endswith("n"):
                return ("value", str(int(plain[:-1], 0)))
            if plain[:2].lower() in ("0x", "0b", "0o"):
                return ("value", int(plain, 0))
            x = float(plain)
            return ("value", int(x) if x.is_integer() and abs(x) < 1e21 else x)
        if kind == "str":
            self.take()
            return ("value", unescape(token[1:-1]))
        if kind == "tpl":
            self.take()
            return ("template", None if re.search(r"(?<!\\)\$\{", token) else unescape(token[1:-1].replace("\r\n", "\n")))
        if self.at("["):
            self.take()
            return ("array", self.items("]"))
        if self.at("{"):
            return self.object()
        if self.at("("):
            self.take()
            inner = self.expression()
            if self.at(","):
                inner = ("other", "SequenceExpression")
                while self.at(","):
                    self.take()
                    self.expression()
            self.take(")")
            return inner
        if self.at("function"):
            return self.function()
        if self.at("/"):
            return ("regex",)
        if kind == "name":
            self.take()
            return {"null": ("value", None), "true": ("value", True), "false": ("value", False)}.get(token) or ("name", token)
        raise SyntaxError(f"unexpected {token or 'end'!r}")

    def object(self) -> tuple:
        self.take("{")
        out = []
        while not self.at("}"):
            if self.at("..."):
                self.take()
                self.expression()
                out.append(("bad", "a spread property"))
            elif self.at("["):
                self.take()
                self.expression()
                self.take("]")
                self.take(":")
                self.expression()
                out.append(("bad", "a computed key"))
            else:
                kind = self.kind
                if kind not in ("name", "str", "num"):
                    raise SyntaxError(f"unexpected {self.token or 'end'!r}")
                node = self.primary() if kind != "name" else ("value", self.take())
                key = node[1] if isinstance(node[1], str) else str(node[1])
                if self.at(":"):
                    self.take()
                    out.append((key, self.expression()))
                elif kind == "name" and self.at(",", "}"):
                    out.append(("bad", f'a shorthand property "{key}"'))
                else:
                    raise Refusal("a method, getter or setter")
            if not self.at("}"):
                self.take(",")
        self.take("}")
        return ("object", out)

    def function(self) -> tuple:
        """function(a, b){return value}: anything more is no literal."""
        self.take("function")
        if self.kind == "name":
            self.take()
        self.take("(")
        names = []
        while not self.at(")"):
            if self.kind != "name":
                raise Refusal("a function call")
            names.append(self.take())
            if not self.at(")"):
                self.take(",")
        self.take(")")
        self.take("{")
        if not self.at("return"):
            raise Refusal("a function call")
        self.take()
        body = self.expression()
        if self.at(";"):
            self.take()
        if not self.at("}"):
            raise Refusal("a function call")
        self.take()
        return ("function", names, body)


def iso(value: float | str) -> str | None:
    """The moment of a date made from milliseconds or from an ISO text, null if it is none."""
    try:
        if isinstance(value, str):
            t = datetime.datetime.fromisoformat(value)
            t = t if t.tzinfo else t.replace(tzinfo=datetime.UTC)
        else:
            t = datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(milliseconds=math.trunc(value))
        t = t.astimezone(datetime.UTC)
        return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"
    except (ValueError, OverflowError):
        return None


def _safe(x: object) -> object:
    return None if x is Undefined or (isinstance(x, float) and not math.isfinite(x)) else x


class Evaluation:
    """Values of nodes; all nodes of one evaluation share its cost."""

    def __init__(self) -> None:
        self.cost = 0

    def charge(self, units: int) -> None:
        self.cost += units
        if self.cost > MAX_COST:
            raise Refusal(f"the literal exceeds the evaluation budget of {MAX_COST} units")

    def text(self, x: str) -> str:
        self.charge(-(-len(x) // CHARS_PER_UNIT))
        return x

    def of(self, node: tuple | None, scope: tuple | None = None, depth: int = 0) -> object:
        if node is None:
            return None
        if depth > MAX_DEPTH:
            raise Refusal(f"nesting deeper than {MAX_DEPTH} levels")
        self.charge(1)
        return getattr(self, f"_{node[0]}")(node, scope, depth + 1)

    def _value(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        return self.text(node[1]) if isinstance(node[1], str) else node[1]

    def _template(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        if node[1] is None:
            raise Refusal("a template literal with expressions")
        return self.text(node[1])

    def _array(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        return [_safe(self.of(x, scope, depth)) for x in node[1]]

    def _object(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        out = {}
        for key, value in node[1]:
            if key == "bad" and isinstance(value, str):
                raise Refusal(value)
            out[key] = _safe(self.of(value, scope, depth))
        return out

    def _unary(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        op, x = node[1], self.of(node[2], scope, depth)
        number = isinstance(x, int | float) and not isinstance(x, bool)
        if op == "void":
            return Undefined
        if op in "+-" and number:
            return -x if op == "-" else x
        if op == "!" and isinstance(x, int | float):
            return not x or x != x
        kind = "undefined" if x is Undefined else "boolean" if isinstance(x, bool) else "number" if number else "string" if isinstance(x, str) else "object"
        raise Refusal(f'the unary operator "{op}" on a {kind}')

    def _binary(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        if node[1] != "+":
            raise Refusal(f'the binary operator "{node[1]}"')
        a, b = self.of(node[2], scope, depth), self.of(node[3], scope, depth)
        if not (isinstance(a, str) and isinstance(b, str)):
            raise Refusal('a "+" that is not string concatenation')
        return self.text(a + b)

    def _name(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        while scope is not None:
            if node[1] in scope[0]:
                value, cost = scope[0][node[1]]
                self.charge(cost)
                return value
            scope = scope[1]
        known = {"undefined": Undefined, "NaN": math.nan, "Infinity": math.inf}
        if node[1] in known:
            return known[node[1]]
        raise Refusal(f'the identifier "{node[1]}"')

    def _arguments(self, nodes: list, scope, depth: int) -> list:  # noqa: ANN001
        out = []
        for x in nodes:
            if x == ("spread",):
                raise Refusal("a spread argument")
            before = self.cost
            out.append((self.of(x, scope, depth), self.cost - before))
        return out

    def _new(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        if node[1] in ("Date", "RegExp"):
            args = [x for x, _ in self._arguments(node[2], scope, depth)]
            if node[1] == "Date" and len(args) == 1 and isinstance(args[0], int | float | str) and not isinstance(args[0], bool):
                return iso(args[0])
            if node[1] == "RegExp" and 1 <= len(args) <= 2 and all(isinstance(x, str) for x in args):
                return self.text(f"/{args[0]}/{args[1] if len(args) > 1 else ''}")
        raise Refusal("a constructor call")

    def _call(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        if node[1][0] != "function":
            raise Refusal("a function call")
        _, names, body = node[1]
        args = self._arguments(node[2], scope, depth)
        own = {name: args[i] if i < len(args) else (Undefined, 0) for i, name in enumerate(names)}
        return self.of(body, (own, scope), depth)

    def _function(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        raise Refusal("a FunctionExpression")

    def _spread(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        raise Refusal("a spread element")

    def _regex(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        raise Refusal("a regular expression literal")

    def _other(self, node: tuple, scope, depth: int) -> object:  # noqa: ANN001
        raise Refusal(f"a {node[1]}")


def evaluate_node(node: tuple | None, run: Evaluation | None = None) -> tuple[bool, object]:
    """(True, value) or (False, reason)."""
    try:
        return True, _safe((run or Evaluation()).of(node))
    except Refusal as e:
        return False, f"not a literal: {e}"
    except RecursionError:
        return False, f"not a literal: nesting deeper than {MAX_DEPTH} levels"


def evaluate(text: str, start: int = 0) -> tuple[bool, object, int]:
    """(True, value, end) of the literal that begins at start, or (False, reason, start)."""
    try:
        p = Parser(text, start)
        node = p.expression()
    except SyntaxError as e:
        return False, f"not parseable: {e.msg}", start
    except (Refusal, RecursionError) as e:
        return False, f"not a literal: {e}", start
    ok, value = evaluate_node(node)
    return ok, value, p.end if ok else start
