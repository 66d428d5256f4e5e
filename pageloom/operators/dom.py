"""Projections of a page: text by lines, links, structure. One parse per page gives all of them; the tree never leaves the worker."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import weburl
from pageloom.functions.bind import piecewise
from pageloom.operators.markup import Builder, Node, collapse, parse, strip

# Elements that stand on lines of their own; schemes besides http and https whose links are kept.
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl dt dd section article header footer main nav aside figure figcaption form fieldset caption".split())
KEPT_SCHEMES = ("mailto", "tel")


def _pieces(root: Node) -> Iterator[str | None]:
    """The texts below root in order; None where a line ends."""
    stack: list = [(root, False)]
    while stack:
        x, link_follows = stack.pop()
        if x is None or isinstance(x, str):
            yield x
            continue
        if x.name == "br":
            yield None
        if x.name in ("br", "#comment", "script", "style"):
            continue
        if x is not root:
            after: list = [(None, False)] if x.name in BLOCKS or (x.name == "a" and link_follows) else []
            if x.name in ("td", "th"):
                after.append((" ", False))
            if x.name in BLOCKS:
                yield None
            stack.extend(after)
        follows = False
        for c in reversed(x.children):
            stack.append((c, follows))
            if isinstance(c, str):
                follows = False
            elif c.name != "#comment":
                follows = c.name == "a"


def page_text(root: Node) -> str:
    """Text by lines: blocks and br break, cells are kept apart, links that touch get lines of their own. Scripts and styles are left out."""
    lines, line = [], []
    for piece in _pieces(root):
        if piece is not None:
            line.append(piece)
        elif line:
            lines.append(collapse("".join(line)))
            line = []
    lines.append(collapse("".join(line)))
    return "\n".join(filter(None, lines))


def base_of(b: Builder, page_url: str | None, base_url: str | None = None) -> tuple[weburl.Url | None, weburl.Url | None]:
    """(page, base): a base that is given goes before the page's own base element, that before the page's address."""
    page, given = weburl.try_parse(page_url), weburl.try_parse(base_url)
    tag = next((n.attrs["href"] for n in b.root.walk() if n.name == "base" and "href" in n.attrs), None)
    return page, given or (weburl.try_parse(tag, page) if tag else None) or page


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def _kinds(raw: str, base: weburl.Url | None, host: str | None) -> tuple[str, str | None, str | None, str | None, str] | None:
    """(type, href, domain, original_href, key of equal links) of a link as it is written, None if it leads nowhere."""
    if raw.startswith("#"):
        return "anchor", raw, None, raw, f"# {raw}"
    url = weburl.try_parse(raw, base)
    if url is None:
        return None if base or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", raw) else ("relative", raw, None, raw, f"/ {raw}")
    if url.scheme not in ("http", "https"):
        kept = url.scheme in KEPT_SCHEMES
        return "other", url.href if kept else None, None, raw if kept else None, f": {url.href}"
    path = url.path.removesuffix("/") if len(url.path) > 1 else url.path
    return "internal" if url.host == host else "external", url.href, url.host, strip(_CONTROL.sub("", raw)) or None, url._replace(path=path, fragment=None).href


def links(b: Builder, page_url: str | None, *, base_url: str | None = None, include_anchors: bool = False, dedupe: bool = True) -> list[dict]:
    page, base = base_of(b, page_url, base_url)
    host = (page or base).host if page or base else None
    found: dict = {}
    for n in b.root.walk():
        raw = strip(n.attrs.get("href", "")) if n.name == "a" else ""
        if not raw or (raw[0] == "#" and not include_anchors) or (kind := _kinds(raw, base, host)) is None:
            continue
        name, href, domain, original, key = kind
        said = {k: strip(n.attrs.get(k, "")) or None for k in ("rel", "title")}
        found.setdefault(key if dedupe else len(found), {"href": href, "text": collapse(n.text()), "type": name, "domain": domain, "rel": said["rel"], "original_href": original, "title": said["title"]})
    return list(found.values())


def signature(b: Builder, root: Node | None = None) -> tuple[list[str], dict[int, int]]:
    """Sorted distinct tags and how many elements stand at each depth (html is at 1), of the page or of what is below root."""
    tags, depths = set(), Counter()
    stack = [(root, sum(1 for _ in root.up()))] if root else [(b.root, 0)]
    top = stack[0][0]
    while stack:
        n, d = stack.pop()
        if n is not top:
            tags.add(n.name)
            depths[d] += 1
        stack.extend((c, d + 1) for c in n.elements())
    return sorted(tags), dict(depths)


LINK = "struct<href: string, text: string, type: string, domain: string, rel: string, original_href: string, title: string>"
PROJECTIONS = f"struct<title: string, text: string, links: array<{LINK}>, tags: array<string>, depths: map<int,int>>"


def projections(html: Column | str, url: Column | str, *, base_url: str | None = None, include_anchors: bool = False, dedupe: bool = True, root: str | None = None) -> Column:
    """struct<title, text, links, tags, depths> of each page. Null html is an empty page, a null URL no base. root: a selector, the structure then is that of what is below its first element.

    It counts as nondeterministic, which it isn't, so that the optimizer never copies it: a page is parsed once.
    """

    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = []
        for h, u in zip(html, url, strict=True):
            b = parse(h)
            scope = b.root.one(root) if root else None
            tags, depths = signature(b, scope) if scope or not root else ([], {})
            title = next((collapse(n.text()) for n in b.root.walk() if n.name == "title"), "")
            rows.append((title, page_text(b.body), links(b, u, base_url=base_url, include_anchors=include_anchors, dedupe=dedupe), tags, depths))
        return pd.DataFrame(rows, columns=["title", "text", "links", "tags", "depths"])

    return piecewise(run, PROJECTIONS, 2).asNondeterministic()(html, url)


def tag_similarity(tags_a: Column, tags_b: Column) -> Column:
    a, b = F.array_distinct(tags_a), F.array_distinct(tags_b)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def depth_similarity(depths_a: Column, depths_b: Column) -> Column:
    both = F.map_values(F.map_zip_with(depths_a, depths_b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    total = lambda f: F.aggregate(both, F.lit(0), lambda s, v: s + f(v["x"], v["y"]))
    return F.when(depths_a.isNull() | depths_b.isNull(), F.lit(0.0)).when(F.size(both) == 0, F.lit(1.0)).otherwise(total(F.least) / total(F.greatest))


def similarity(tags_a: Column, depths_a: Column, tags_b: Column, depths_b: Column) -> Column:
    """Mean of the Jaccard index of the tags and the weighted one of the depths, 0 to 1; null counts as unlike."""
    return (
        F.when(tags_a.isNull() | tags_b.isNull(), F.lit(0.0))
        .when((F.size(tags_a) == 0) & (F.size(tags_b) == 0), F.lit(1.0))
        .when((F.size(tags_a) == 0) | (F.size(tags_b) == 0), F.lit(0.0))
        .otherwise((tag_similarity(tags_a, tags_b) + depth_similarity(depths_a, depths_b)) / 2)
    )
