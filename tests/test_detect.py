"""Detection by plain texts first: the same answers as by patterns alone, and how seldom a pattern is tried."""

import random
import re

from pyspark.sql import functions as F

from pageloom.functions import urls


def made(n: int = 100_000) -> list[str]:
    rng = random.Random(6)
    hosts = ["github.com", "www.amazon.co.uk", "amazon.xyz", "shop.test", "youtu.be", "YouTube.com", "old.reddit.com", "news.ycombinator.com", "www.producthunt.com", "stackoverflow.com", "npmjs.com", "registry.npmjs.org", "boards.greenhouse.io", "jobs.lever.co", "api.ashbyhq.com", "x.workable.com", "apply.workable.com", "acme.recruitee.com", "acme.teamtailor.com", "vpic.nhtsa.dot.gov", "npiregistry.cms.hhs.gov", "linkedin.com", "x.com", "none.test", "K.test"]
    parts = ["products", "collections", "all", "a", "b", "watch", "r", "comments", "1b2", "questions", "42", "package", "jobs", "jobs.rss", "spi", "api", "accounts", "vehicles", "DecodeVin", "in", "status", "products.json", "posts", "tree", "newest", "PRODUCTS", ""]
    tails = ["", "/", "?q=1", "#f", "?u=https://github.com/a/b", "?page=2#x"]
    out = [rng.choice(["https://", "http://", "HTTPS://", "", "ftp://"]) + rng.choice(hosts) + "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(tails) for _ in range(n)]
    return [*out, "https://vpic.nhtsa.dot.gov/api/vehicles/DecodeVin/1", "", "tweet", "linkedin-profile", "ﬀ", "https://GİTHUB.com/a/b", "https://github.com/" + "a" * 20_000]


def by_patterns(url):
    elsewhere = re.sub(r"^(https?://)[^/?#:]+", r"\1invalid-host", url, flags=re.I)
    hits = [n for n, p in urls.TEMPLATES if re.search(p, url, re.I | re.A)]
    strong = [n for n, p in urls.TEMPLATES if n in hits and re.match(r"[a-z][a-z0-9+.-]*:", url, re.I) and not re.search(p, elsewhere, re.I | re.A)]
    return next(iter([*strong, *hits]), None)


def test_detection_is_that_of_the_patterns(spark):
    texts = made()
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*texts, None])], "i int, u string").repartition(8)
    got = {r.i: (r.t, r.r) for r in df.select("i", urls.detect(F.col("u")).alias("t"), urls.retired(F.col("u")).alias("r")).collect()}
    for i, u in enumerate(texts):
        gone = next((n for n, p in urls.RETIRED if u == n or re.search(p, u, re.I | re.A)), None)
        assert got[i] == (by_patterns(u), gone), u
    assert got[len(texts)] == (None, None)
    assert len({t for t, _ in got.values()}) == len(urls.TEMPLATES) + 1


def test_patterns_are_seldom_tried():
    texts = made(5000)
    tried = sum(any(n in u.lower() for n in urls.needles(p)) for u in texts for _, p in urls.TEMPLATES)
    assert all(urls.needles(p) for _, p in urls.TEMPLATES) and tried < 0.1 * len(texts) * len(urls.TEMPLATES)


def test_needles_are_needed():
    assert urls.needles("a+b") == ["a"] or urls.needles("a+b") == ["b"]
    assert urls.needles(r"[a-z]+") == [] and urls.needles(r"x?y*") == []
    assert urls.needles(r"one\.test/|(two|three)four") == ["one.test/", "four"]
    for name, p in urls.TEMPLATES + urls.RETIRED:
        for u in made(3000):
            assert not re.search(p, u, re.I | re.A) or any(n in u.lower() for n in urls.needles(p)), (name, u)
