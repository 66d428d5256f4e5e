"""URL functions and the choice of a template: native expressions, but for what needs an address read in full."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.scalars import strip
from pageloom.functions.weburl import Url, try_parse

# Fixed values: (template, pattern of the URLs it handles), in registration order.
TEMPLATES = [
    ("shopify-product", r"/products/[^/?#]+"),
    ("shopify-collection", r"/collections/[^/?#]+(?:/products\.json)?/?(?:[?#]|$)"),
    ("amazon-product", r"amazon\.(com|co\.uk|co\.jp|de|fr|es|it|nl|se|pl|ca|in|sg|ae|sa|eg|com\.au|com\.br|com\.mx|com\.be|com\.tr)"),
    ("github-repo", r"github\.com/[^/]+/[^/]+(?:/tree/.+)?/?$"),
    ("youtube-video", r"youtube\.com/watch|youtu\.be/[\w-]+"),
    ("reddit-thread", r"reddit\.com/(?:r/[^/]+/)?comments/[a-z0-9]+"),
    ("hacker-news-front-page", r"news\.ycombinator\.com(?:/(?:news|newest|front|best|ask|show|jobs|active))?/?(?:[?#].*)?$"),
    ("producthunt-launch", r"producthunt\.com/(posts|products)/"),
    ("stackoverflow-question", r"stackoverflow\.com/questions/\d+"),
    ("npm-package", r"npmjs\.com/package/|registry\.npmjs\.org/"),
    ("greenhouse-jobs", r"(boards|job-boards|boards-api)\.greenhouse\.io/"),
    ("lever-postings", r"(jobs|api)\.lever\.co/"),
    ("ashby-jobs", r"(jobs|api)\.ashbyhq\.com/"),
    ("workable-jobs", r"(apply\.workable\.com|www\.workable\.com/api/accounts|[\w-]+\.workable\.com/(jobs|spi))"),
    ("recruitee-offers", r"\.recruitee\.com/"),
    ("teamtailor-jobs", r"teamtailor\.com/?(?:jobs(\.rss)?/?)?(\?|#|$)"),
    ("nhtsa-vin", r"vpic\.nhtsa\.dot\.gov/api/vehicles/DecodeVin"),
    ("npi-provider", r"npiregistry\.cms\.hhs\.gov/api"),
]
RETIRED = [("linkedin-profile", r"linkedin\.com/in/"), ("tweet", r"(twitter|x)\.com/[^/]+/status/")]


_HIDDEN = re.compile(r"\((?:[^()\\\[]|\\.|\[(?:[^\]\\]|\\.)*\])*\)(?:[?*]|\{\d*,?\d*\})?|\[(?:[^\]\\]|\\.)*\][?*+]?|\\[a-zA-Z][?*+]?|[.][?*+]?|[\^$]|(?:\\.|[^\\])[?*]")


def needles(pattern: str) -> list[str]:
    """Texts of which an address must hold one for the pattern to match: the longest plain text of each alternative; none if an alternative has no plain text."""
    whole = re.fullmatch(r"\(((?:[^()\\]|\\.|\([^()]*\))*)\)", pattern)
    out = []
    for way in re.split(r"\|(?![^(]*\))", whole[1] if whole else pattern):
        plain = way.replace(r"\.", "\x01")
        while (shorter := _HIDDEN.sub("\0", plain)) != plain:
            plain = shorter
        texts = plain.replace("+", "\0").replace("\x01", ".").split("\0")
        out.append("" if re.search(r"[\\(){}|\[\]]", plain) else max(texts, key=len).lower())
    return out if all(out) else []


def _matches(url: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern matches in any case: it is tried where the address holds what it needs."""
    held = [F.contains(low, F.lit(n)) for n in needles(pattern)]
    tried = url.rlike(f"(?i){pattern}")
    return reduce(Column.__or__, held) & tried if held else tried


def detect(url: Column, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """The template of a URL: one whose pattern needs the host goes before one that doesn't, then the first registered.

    A pattern is tried on addresses that hold its plain text, which is looked for first: most rows are settled without a pattern.
    """
    elsewhere = F.regexp_replace(url, r"^(?i)(https?://)[^/?#:]+", "$1invalid-host")
    is_url, low = url.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lower(url)
    hits = [(F.lit(name), _matches(url, low, p), elsewhere.rlike(f"(?i){p}")) for name, p in templates]
    return F.coalesce(*[F.when(hit & is_url & ~other, name) for name, hit, other in hits], *[F.when(hit, name) for name, hit, _ in hits])


def retired(url: Column) -> Column:
    return F.coalesce(*[F.when((url == name) | _matches(url, F.lower(url), p), F.lit(name)) for name, p in RETIRED])


def safe_href(url: Column) -> Column:
    """Control characters and outer space dropped; null if nothing is left or the scheme isn't http or https."""
    clean = strip(F.regexp_replace(url, r"[\x00-\x1f\x7f]", ""))
    return F.when((clean != "") & (~clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | clean.rlike(r"^(?i)https?://")), clean)


def _addresses(f: Callable[[Url], str]) -> Callable[[Column, Column], Column]:
    def run(url: pd.Series, base: pd.Series) -> pd.Series:
        read = (try_parse(u, try_parse(b)) for u, b in zip(url, base, strict=True))
        return pd.Series([None if u is None else f(u) for u in read], dtype=object)

    return lambda url, base: F.pandas_udf(run, "string")(url, base)


def absolute_url(url: Column, base: Column) -> Column:
    """The address against a base (null for none), null if it is none."""
    return _addresses(lambda u: u.href)(url, base)


def dedupe_key(url: Column) -> Column:
    """The address in its normal form, without its fragment and without one slash at the end of a path that isn't the root; null if it is none."""
    key = lambda u: u._replace(path=u.path.removesuffix("/") if len(u.path) > 1 and u.host is not None else u.path, fragment=None).href
    return _addresses(key)(url, F.lit(None).cast("string"))


def npm_repository_url(value: Column) -> Column:
    """A repository as an address: shorthands are read as GitHub's, other protocols as https."""
    v = F.regexp_replace(F.regexp_replace(F.nullif(value, F.lit("")), r"^git\+", ""), r"\.git$", "")
    https = F.regexp_replace(F.regexp_replace(v, r"^git@([^:]+):", "https://$1/"), r"^(?:git|ssh)://(?:git@)?", "https://")
    return F.when(v.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.concat(F.lit("https://github.com/"), v)).otherwise(F.regexp_replace(https, r"^https://git@", "https://"))
