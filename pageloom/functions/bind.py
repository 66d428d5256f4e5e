"""Values that are computed once, however often they are named."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whatever is selected of them, filtered by them or joined on them later.

    A projection alone doesn't do: filters that are inferred from an explode, say, are pushed below it, with a copy of what they name. Neither
    projections nor filters pass through a generator that made their column, and one that makes a row of each row costs next to nothing.
    """
    names = list(columns)
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], made)


#: Rows of a batch whose results a worker holds at a time.
PIECE = 128


def piecewise(run: Callable[..., pd.Series | pd.DataFrame], kind: str, columns: int) -> Callable[..., Column]:
    """A pandas function of some columns that is called, and hands back its rows, by pieces of a batch.

    A batch has thousands of rows. What is made of them (units, links, trees' leavings) takes many times the room of the texts, and would all
    be held by each worker until the batch is through.
    """

    def pieces(columns: tuple[pd.Series, ...]) -> Iterator[pd.Series | pd.DataFrame]:
        for i in range(0, len(columns[0]), PIECE):
            yield run(*[c.iloc[i : i + PIECE] for c in columns])

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield from pieces((batch,))

    def some(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield from pieces(batch)

    whole = one if columns == 1 else some
    whole.__name__ = run.__name__
    return F.pandas_udf(whole, kind)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly over several tasks a core, for plans that make much of each row.

    A table of keys and names is a file of a few megabytes however many rows it has, and a row group is one task: what is made of its rows
    would be read by one or two cores. To be called on the narrow rows, before anything is made of them.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once. A column is a tree: without this each mention is another copy of it, and copies of copies grow without bound."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
