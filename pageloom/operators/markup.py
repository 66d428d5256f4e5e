"""HTML trees for Arrow functions: building in linear time, text, selectors, serialisation. A tree never leaves the worker."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space; elements without an end, of the head, of raw text; what an opening tag closes, and how far up.
WS = "\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul li dt dd plaintext xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset("applet caption marquee object td template th".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
BUTTON_SCOPE, LIST_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
#: What a table's part stands in, and what is put there where it is missing.
TABLE_PLACES = {
    "caption": ({"table"}, {}), "colgroup": ({"table"}, {}), "col": ({"colgroup", "table"}, {"table": ["colgroup"]}), "tbody": ({"table"}, {}), "thead": ({"table"}, {}), "tfoot": ({"table"}, {}), "tr": ({"tbody", "thead", "tfoot", "table"}, {"table": ["tbody"]}),
    **dict.fromkeys(("td", "th"), ({"tr", "tbody", "thead", "tfoot", "table"}, {"table": ["tbody", "tr"], "tbody": ["tr"], "thead": ["tr"], "tfoot": ["tr"]})),
}
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Formatting elements that are opened again in a new block, at most: of nested ones with different attributes the innermost.
MOST_REOPENED = 64
_SPACES = re.compile(f"[{WS}]+")
_STRIP = re.compile(f"^[{WS}]+|[{WS}]+$")


def strip(text: str) -> str:
    return _STRIP.sub("", text)


def collapse(text: str) -> str:
    return strip(_SPACES.sub(" ", text))


class Node:
    __slots__ = ("attrs", "children", "index", "name", "parent", "pos")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.name, self.attrs, self.children, self.parent, self.pos = name, attrs or {}, [], parent, -1
        self.index: Index | None = None

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            if x.name != "#comment":
                yield x
                stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name != "#comment":
                stack.extend(reversed(x.children))
        return "".join(out)

    def up(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name != "#comment"]

    # Selections: select all, the first one, its text, its attribute. A document that has been asked must not be changed before it is asked again.
    def all(self, selector: str) -> list[Node]:
        if self.name == "#document":
            self.index = self.index or Index(self)
            return self.index.all(selector)
        test = matcher(selector)
        return [n for n in self.walk() if test(n)]

    def one(self, selector: str) -> Node | None:
        if self.name == "#document":
            return next(iter(self.all(selector)), None)
        test = matcher(selector)
        return next((n for n in self.walk() if test(n)), None)

    def first_text(self, selector: str) -> str | None:
        n = self.one(selector)
        return strip(n.text()) or None if n else None

    def first_attr(self, selector: str, attr: str) -> str | None:
        n = self.one(selector)
        return n.attrs.get(attr) or None if n else None

    def texts(self, selector: str) -> list[str]:
        return [t for n in self.all(selector) if (t := strip(n.text()))]


def _last(items: list, x: object) -> int:
    """The place of x itself, searched from the end, where it mostly is."""
    return next(i for i in range(len(items) - 1, -1, -1) if items[i] is x)


class Builder(HTMLParser):
    """A tree as browsers build it, after the HTML standard's tree construction.

    html, head and body are always there; parts of tables and ends of paragraphs, items and cells are implied; formatting elements that are
    left open go on in the next block, misnested ones are split, and what doesn't belong into a table stands before it. Left out: frames,
    what a select refuses, and namespaces other than self-closing elements in svg and math. An open element knows its place on the stack, and
    there are stacks of the open elements by name and of those that stop a search, so that looking for one doesn't walk through the others.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = self._append(self.root, Node("html"))
        self.head = self._append(self.html, Node("head"))
        self.body: Node | None = None
        self.stack = [self.html, self.head]
        self.open: defaultdict[str, list[Node]] = defaultdict(list)
        self.special: list[Node] = []
        self.active: list[Node | None] = []  # formatting elements to open again; None marks a cell's or an object's begin
        self.fostering = False

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted: nobody asks where a tag stands."""
        return j

    # Placing.

    @staticmethod
    def _append(parent: Node, x: Node) -> Node:
        x.parent = parent
        parent.children.append(x)
        return x

    def _place(self, x: Node | str, at: Node | None = None) -> None:
        """Appends x to the open element; before the table where it doesn't belong into one."""
        at = at or self.stack[-1]
        parent, before = at, None
        if self.fostering and at.name in TABLE_PARTS:
            table = next(n for n in reversed(self.stack) if n.name in ("table", "html"))
            if table.name == "table":
                parent, before = (table.parent, table) if table.parent else (self.stack[_last(self.stack, table) - 1], None)
        if isinstance(x, Node):
            x.parent = parent
        if before is None:
            parent.children.append(x)
        else:
            parent.children.insert(_last(parent.children, before), x)

    def _enter(self, name: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(name, attrs)
        self._place(node)
        node.pos = len(self.stack)
        self.stack.append(node)
        self.open[name].append(node)
        if name in SPECIAL:
            self.special.append(node)
        if name in MARKED:
            self.active.append(None)
        return node

    def _off(self, node: Node) -> None:
        """Off the lists of open elements, not off the stack."""
        node.pos = -1
        for some in (self.open[node.name], *([self.special] if node.name in SPECIAL else [])):
            del some[_last(some, node)]

    def _replace(self, start: int, end: int, new: list[Node]) -> None:
        """Other elements on the stack from start to end."""
        for x in self.stack[start:end]:
            if not any(x is y for y in new):
                self._off(x)
        self.stack[start:end] = new
        for i in range(start, start + len(new) if len(new) == end - start else len(self.stack)):
            self.stack[i].pos = i

    def _leave(self, node: Node) -> None:
        """Closes everything up to node and node itself."""
        while True:
            x = self.stack.pop()
            self._off(x)
            if x.name in MARKED:
                while self.active and self.active.pop() is not None:
                    pass
            if x is node:
                return

    def _in_body(self) -> None:
        if self.body is None:
            self.body = self._append(self.html, Node("body"))
            self.stack = [self.html, self.body]
            self.open.clear()

    def _inmost(self, names: set[str] | frozenset[str]) -> Node | None:
        return max((self.open[n][-1] for n in names if self.open.get(n)), key=lambda x: x.pos, default=None)

    def _scope(self, names: set[str] | frozenset[str], bounds: frozenset[str] = SCOPE) -> Node | None:
        """The innermost open element of these names that no boundary hides."""
        found = self._inmost(names)
        wall = self._inmost(bounds - names) if found else None
        return None if wall and wall.pos > found.pos else found

    def _close(self, names: set[str] | frozenset[str], bounds: frozenset[str] = SCOPE) -> bool:
        node = self._scope(names, bounds)
        if node:
            self._leave(node)
        return node is not None

    # Formatting elements.

    def _reopen(self) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1].pos < 0:
            k -= 1
        for i in range(k, len(self.active)):
            self.active[i] = self._enter(self.active[i].name, dict(self.active[i].attrs))

    def _remember(self, node: Node) -> None:
        own = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                break
            own.append(i)
        same = [i for i in own if self.active[i].name == node.name and self.active[i].attrs == node.attrs]
        if len(same) >= 3:
            del self.active[same[-1]]
        elif len(own) >= MOST_REOPENED:
            del self.active[own[-1]]
        self.active.append(node)

    def _formatting(self, name: str) -> Node | None:
        for x in reversed(self.active):
            if x is None or x.name == name:
                return x
        return None

    def _forget(self, node: Node) -> None:
        if any(x is node for x in self.active):
            del self.active[_last(self.active, node)]

    def _split(self, name: str) -> None:
        """The end of a formatting element that may have blocks inside which stay open: these get it as their content's wrapper."""
        top = self.stack[-1]
        if top.name == name and not any(x is top for x in self.active):
            self._leave(top)
            return
        for turn in range(8):
            node = self._formatting(name)
            if node is None:
                if not turn:
                    self._end(name)
                return
            if node.pos < 0:
                self._forget(node)
                return
            wall = self._inmost(SCOPE)
            if wall and wall.pos > node.pos:
                return
            k = node.pos
            block = next((i for i in range(k + 1, len(self.stack)) if self.stack[i].name in SPECIAL), None)
            if block is None:
                self._leave(node)
                self._forget(node)
                return
            self._rewrap(k, block)

    def _rewrap(self, k: int, block: int) -> None:
        node, furthest = self.stack[k], self.stack[block]
        mark, inner, kept = _last(self.active, node), furthest, []
        for steps, between in enumerate(reversed(self.stack[k + 1 : block]), 1):
            i = next((i for i, x in enumerate(self.active) if x is between), None)
            if i is not None and steps > 3:
                del self.active[i]
                mark -= i < mark
                i = None
            if i is None:
                continue
            twin = self.active[i] = Node(between.name, dict(between.attrs))
            kept.append(twin)
            if inner is furthest:
                mark = i + 1
            self._move(inner, twin)
            inner = twin
        if inner.parent:
            del inner.parent.children[_last(inner.parent.children, inner)]
        held, self.fostering = self.fostering, True
        self._place(inner, self.stack[k - 1])
        self.fostering = held
        twin = Node(node.name, dict(node.attrs), furthest)
        twin.children, furthest.children = furthest.children, [twin]
        for c in twin.children:
            if isinstance(c, Node):
                c.parent = twin
        i = _last(self.active, node)
        del self.active[i]
        self.active.insert(mark - (i < mark), twin)
        self._replace(k, block + 1, [*reversed(kept), furthest, twin])
        for x in [*reversed(kept), twin]:
            own = self.open[x.name]
            own.insert(next((j + 1 for j in range(len(own) - 1, -1, -1) if own[j].pos < x.pos), 0), x)

    def _move(self, x: Node, to: Node) -> None:
        if x.parent:
            del x.parent.children[_last(x.parent.children, x)]
        self._append(to, x)

    # Tags and texts.

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._in_body()
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in values.items():
                target.attrs.setdefault(k, v)
            return
        if self.body is None and tag not in HEAD_ONLY:
            self._in_body()
        if tag in TABLE_PLACES:
            self._table_part(tag, values)
            return
        in_table = self.stack[-1].name in TABLE_PARTS
        if in_table and tag == "table":
            self._close({"table"}, frozenset({"html"}))
        elif in_table and tag not in ("script", "style", "template") and not (tag == "input" and values.get("type", "").lower() == "hidden"):
            self.fostering = True
        self._start(tag, values)
        self.fostering = False

    def _table_part(self, tag: str, values: dict[str, str]) -> None:
        """Without an open table it is ignored."""
        if not self.open["table"]:
            return
        places, missing = TABLE_PLACES[tag]
        while self.stack[-1].name not in places:
            self._leave(self.stack[-1])
        for name in missing.get(self.stack[-1].name, []):
            self._enter(name)
        if tag in VOID:
            self._place(Node(tag, values))
        else:
            self._enter(tag, values)

    def _start(self, tag: str, values: dict[str, str]) -> None:
        if tag in CLOSES_P:
            if tag in ITEMS:
                self._close_item(ITEMS[tag])
            self._close({"p"}, BUTTON_SCOPE)
            if tag in HEADINGS and self.stack[-1].name in HEADINGS:
                self._leave(self.stack[-1])
            if tag == "form" and self.open["form"]:
                return
        elif tag == "a":
            if node := self._formatting("a"):
                self._split("a")
                self._forget(node)
                if node.pos >= 0:
                    self._replace(node.pos, node.pos + 1, [])
        elif tag == "nobr":
            self._reopen()
            if self._scope({"nobr"}):
                self._split("nobr")
        elif tag == "button":
            self._close({"button"})
        elif tag in ("option", "optgroup") and self.stack[-1].name == "option":
            self._leave(self.stack[-1])
        if self.body is not None and tag not in CLOSES_P and tag not in HEAD_ONLY and tag not in ("param", "source", "track"):
            self._reopen()
        if tag in VOID:
            self._place(Node(tag, values))
        else:
            node = self._enter(tag, values)
            if tag in FORMATTING:
                self._remember(node)

    def _close_item(self, names: set[str]) -> None:
        """An open item ends where only paragraphs, divisions and addresses of its own are open."""
        found = self._inmost(names)
        wall = next((x for x in reversed(self.special) if x.name not in ("address", "div", "p")), None) if found else None
        if found and (wall is found or wall.pos < found.pos):
            self._leave(found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if (self.open["svg"] or self.open["math"]) and self.stack[-1].name == tag:
            self._leave(self.stack[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._in_body()
        elif tag == "br":
            self.handle_starttag(tag, [])
        elif tag == "p":
            self._in_body()
            if not self._close({"p"}, BUTTON_SCOPE):
                self._start("p", {})
                self._leave(self.stack[-1])
        elif tag in TABLE_PLACES or tag == "table":
            self._close({tag}, frozenset({"table", "html"}))
        elif tag in FORMATTING and self.body is not None:
            self._split(tag)
        elif tag in HEADINGS:
            self._close(HEADINGS)
        elif tag in ITEMS:
            self._close({tag}, LIST_SCOPE if tag == "li" else SCOPE)
        elif tag in CLOSES_P or tag in MARKED or tag == "button":
            self._close({tag})
        else:
            self._end(tag)

    def _end(self, tag: str) -> None:
        """The end of an element that is neither block nor formatting: no block may stand between."""
        if found := self._inmost({tag}):
            if not self.special or self.special[-1].pos <= found.pos:
                self._leave(found)

    def handle_data(self, data: str) -> None:
        blank = not strip(data)
        if self.body is None and self.stack[-1] is self.head and not blank:
            self._in_body()
        if self.body is None and self.stack[-1] is self.head:
            return
        self.fostering = self.stack[-1].name in TABLE_PARTS and not blank
        if self.body is not None and (self.fostering or self.stack[-1].name not in TABLE_PARTS) and self.stack[-1].name not in RAW:
            self._reopen()
        self._place(data)
        self.fostering = False

    def handle_comment(self, data: str) -> None:
        self.stack[-1].children.append(Node("#comment", {"data": data}, self.stack[-1]))


def parse(html: str | None) -> Builder:
    b = Builder()
    b.feed(html or "")
    b.close()
    b._in_body()
    return b


# --- Selectors -------------------------------------------------------------------------------------------------------------------------

_PART = re.compile(r"""\*|(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>(?:[\w-]|\\.)+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<q>["']?)(?P<val>.*?)(?P=q)\s*)?\]""")
_COMPARE: dict[str, Callable[[str, str], bool]] = {
    "=": lambda x, v: x == v, "^=": lambda x, v: bool(v) and x.startswith(v), "$=": lambda x, v: bool(v) and x.endswith(v), "*=": lambda x, v: bool(v) and v in x, "~=": lambda x, v: v in x.split(), "|=": lambda x, v: x == v or x.startswith(f"{v}-"),
}


def _compound(text: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    for m in _PART.finditer(text):
        if m["tag"]:
            tests.append(lambda n, v=m["tag"].lower(): n.name == v)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"] and not m["op"]:
            tests.append(lambda n, a=m["attr"].lower(): a in n.attrs)
        elif m["attr"]:
            tests.append(lambda n, a=m["attr"].lower(), f=_COMPARE[m["op"]], v=m["val"]: a in n.attrs and f(n.attrs[a], v))
    if len(tests) == 1:
        return tests[0]
    return lambda n: all(t(n) for t in tests)


def _handle(compound: str) -> tuple[str, str]:
    """What an element must have that fits: an id, a class, a name or an attribute, the rarest that the selector names; every element has a *."""
    of = {g: m[g] for m in _PART.finditer(compound) for g in ("id", "cls", "tag", "attr") if m[g]}
    kind = next((g for g in ("id", "cls", "attr", "tag") if g in of), "*")
    return kind, of[kind].lower() if kind in ("attr", "tag") else of.get(kind, "")


class Index:
    """A document's elements by what selectors ask for, so that a selector is held against those only that may fit."""

    def __init__(self, root: Node) -> None:
        self.having: defaultdict[tuple[str, str], list[tuple[int, Node]]] = defaultdict(list)
        for at in enumerate(root.walk()):
            n = at[1]
            self.having["*", ""].append(at)
            self.having["tag", n.name].append(at)
            for a, v in n.attrs.items():
                self.having["attr", a].append(at)
                if a == "id":
                    self.having["id", v].append(at)
                elif a == "class":
                    for c in dict.fromkeys(v.split()):
                        self.having["cls", c].append(at)

    def all(self, selector: str) -> list[Node]:
        found: dict[int, Node] = {}
        for handle, test in ways(selector):
            found.update((i, n) for i, n in self.having.get(handle, ()) if i not in found and test(n))
        return [found[i] for i in sorted(found)]


def _before(n: Node) -> list[Node]:
    """The element's earlier siblings, the nearest first."""
    if n.parent is None:
        return []
    own = n.parent.elements()
    return own[: next(i for i, x in enumerate(own) if x is n)][::-1]


_NEAR: dict[str, Callable[[Node], list[Node] | Iterator[Node]]] = {" ": Node.up, ">": lambda n: [n.parent] if n.parent else [], "+": lambda n: _before(n)[:1], "~": _before}


@lru_cache(maxsize=256)
def ways(selector: str) -> list[tuple[tuple[str, str], Callable[[Node], bool]]]:
    """The selectors of a list: names, ids, classes, attributes, and the four ways to combine them. Of each, what an element must have and the whole test."""

    def fits(n: Node, chain: list, i: int) -> bool:
        how, test = chain[i]
        if not test(n):
            return False
        return i == 0 or any(fits(x, chain, i - 1) for x in _NEAR[how](n) if x.name != "#document")

    found = []
    for one in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r"\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|[^\s>+~\[])+)", one.strip())
        steps = [(op or (" " if gap else ""), part) for op, gap, part in tokens]
        chain: list[tuple[str, Callable[[Node], bool]]] = []
        how, last = "", ""
        for op, part in steps:
            if part:
                chain.append((how, _compound(part)))
                how, last = "", part
            else:
                how = op
        if chain:
            found.append((_handle(last), lambda n, chain=chain: fits(n, chain, len(chain) - 1)))
    return found


@lru_cache(maxsize=256)
def matcher(selector: str) -> Callable[[Node], bool]:
    """A test of elements for a list of selectors."""
    tests = [test for _, test in ways(selector)]
    return lambda n: any(test(n) for test in tests)


# --- Serialisation and text ------------------------------------------------------------------------------------------------------------


def _escape(text: str, attr: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return text.replace('"', "&quot;") if attr else text.replace("<", "&lt;").replace(">", "&gt;")


def inner_html(node: Node) -> str:
    out: list[str] = []
    stack: list = [(c, node.name) for c in reversed(node.children)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(x if inside in RAW else _escape(x))
        elif x.name == "#comment":
            out.append(f"<!--{x.attrs.get('data', '')}-->")
        else:
            out.append(f"<{x.name}" + "".join(f' {k}="{_escape(v, True)}"' for k, v in x.attrs.items()) + ">")
            if x.name not in VOID:
                stack.append(((f"</{x.name}>",), ""))
                stack.extend((c, x.name) for c in reversed(x.children))
    return "".join(out)


def outer_html(node: Node) -> str:
    shell = Node("#fragment")
    shell.children = [node]
    return inner_html(shell)


#: Elements whose tags leave the order of a text as it is, however they are nested or left open, and whose content is text.
_PLAIN = "a|abbr|b|big|blockquote|br|code|dd|dl|dt|em|h[1-6]|hr|i|img|li|ol|p|pre|q|s|small|span|strike|strong|sub|sup|tt|u|ul"
_PLAIN_TAG = rf"""</?(?:{_PLAIN})(?:[ \t\n]+[a-zA-Z][a-zA-Z-]*(?:="[^"<>]*"|='[^'<>]*')?)*[ \t\n]*>"""
_PLAIN_TAGS = re.compile(_PLAIN_TAG, re.I)
_PLAIN_FRAGMENT = re.compile(rf"(?:[^<]|{_PLAIN_TAG})*+", re.I)


def text_of(html: str | None, escaped: bool = False) -> str | None:
    """The text of a fragment as one line. A fragment stands in a div, and text inside divs of its own counts once for each of them."""
    if not html:
        return None
    if "<" not in html and "&" not in html:
        return collapse(html) or None
    if _PLAIN_FRAGMENT.fullmatch(html):
        raw = "".join(map(unescape, _PLAIN_TAGS.split(html)))
        return text_of(raw) if escaped else collapse(raw) or None
    raw = "".join(n.text() for n in parse(f"<div>{html}</div>").root.walk() if n.name == "div")
    return text_of(raw) if escaped else collapse(raw) or None


def html_text(c: Column, *, escaped: bool = False) -> Column:
    """The text of a fragment, null if there is none. Plain text never reaches the worker's parser."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: text_of(h, escaped) if isinstance(h, str) else None).astype(object)

    return F.pandas_udf(run, "string")(c)


def html_texts(c: Column, *, escaped: bool = False) -> Column:
    """html_text of each element of an array."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [text_of(h, escaped) for h in a])

    return F.pandas_udf(run, "array<string>")(c)
