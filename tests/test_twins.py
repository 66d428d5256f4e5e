"""Helpers that exist as native expressions and as functions of the page readers: both give the same."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import scalars as S
from pageloom.functions import urls
from pageloom.operators import highlights, pages

PIECES = ["1,234", "12", "4.6", "4,7", " ", "points", "point", "comments", "comment", "discuss", "out of 5 stars", "5", "€", "$", "-", "InStock", "SoldOut", "preorder", "https://schema.org/", "https://", "http:", "javascript:", "/a", "\t", "\x01", "\xa0", "x", "._AC_SX1_.jpg", "._a_.PNG", ".gif", "transparent-pixel", "/x-locale/common/", "", "é", "ß", "İ", "1,2,3", ".", "0"]


def texts(n: int = 4000) -> list[str]:
    rng = random.Random(12)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 4))) for _ in range(n)]


TWINS = {
    "safe_href": (urls.safe_href, pages.safe_href), "points": (S.points, pages.hn_score), "comments": (S.comments, pages.hn_comments), "rating": (S.rating, pages.amazon_rating), "count": (S.count_of, pages.amazon_count), "exact_count": (S.exact_count, pages.exact_count),
    "full_size_image": (S.full_size_image, pages.full_size_image), "availability": (S.availability, lambda t: pages.availability_of({"availability": t})), "tidy": (S.tidy, pages.tidy), "tokens": (highlights.tokenize, highlights._tokens), "stem": (highlights.stem, highlights._stem),
}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twins(spark, name):
    native, plain = TWINS[name]
    rows = sorted(set(texts()))
    if name == "stem":
        rows = sorted({t for r in rows for t in highlights._tokens(r + "ing houses classes created es")})
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").repartition(4)
    got = {r.i: r.v for r in df.select("i", native(F.col("t")).alias("v")).collect()}
    odd = {rows[i]: (v, plain(rows[i])) for i, v in got.items() if v != plain(rows[i])}
    assert odd == {}, list(odd.items())[:5]
