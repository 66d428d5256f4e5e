"""Pairs of groups that share too few entered tokens for their sets' sizes are not opened."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pageloom.llm import jaccard


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_no_similar_pair_shares_less_than_the_bound(spark, percent):
    rnd = random.Random(percent)
    rows = []
    for _ in range(300):
        lo = rnd.randint(1, 300)
        lo2 = rnd.randint(max(1, lo * percent // 100), lo * 100 // percent + 1)
        rows.append((lo, lo + rnd.choice([0, 0, rnd.randint(0, lo // 5)]), lo2, lo2 + rnd.choice([0, 0, rnd.randint(0, lo2 // 5)])))
    found = spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", jaccard.overlap_bound(*[F.col(x) for x in "abcd"], percent).alias("bound")).collect()

    def beyond(n, o):  # what is shared of a set whose last tokens aren't entered
        return o - jaccard.needed(n, percent) + n // 10 + 1

    for a, b, c, d, bound in found:
        pairs = [(n, m) for n, m in itertools.product(range(a, b + 1), range(c, d + 1)) if 100 * min(n, m) >= percent * max(n, m)]
        fewest = [min(beyond(n, o), beyond(m, o)) for n, m in pairs for o in [-(-percent * (n + m) // (100 + percent))]]
        assert not fewest or bound <= min(fewest), (a, b, c, d)
    if percent == 80:
        one = spark.range(1).select(jaccard.overlap_bound(*[F.lit(100)] * 4, 80)).first()[0]
        assert 11 < one <= 20  # 11 is the least of a set of 100 alone
