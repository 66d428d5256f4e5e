"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?, by a dynamic programme over a prefix trie.

A turn is one symbol (its role's initial and its fault), a conversation the word of its turns' symbols. Each task sorts its conversations
by word and walks them as a depth-first walk through the trie of these words: the path from the root is a stack of DP layers, one for each
symbol, so that a layer is computed once for all words that share the prefix, and the stack is no longer than the longest word. A layer holds
the least cost of reaching each of four states (nothing, s, an open u, complete pairs) from the start. At a word's end the layers are read
backwards for the states on cheapest ways, then forwards for the least of their edits.

Cost of edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only way for blank and duplicate turns), Insert an empty user or assistant
turn 2; a truncated turn that isn't deleted adds 1. Of equally cheap edit scripts the one whose initials come first in ASCII is taken; it
names one repaired conversation only, since each edit's role follows from the roles before it.

Defined cases: turns are in the order of turn (null first), role, text. A null text is blank, a null role is no role. A row whose turn, role and
text are all null is no turn, it only names its conversation; one without turns costs nothing and has no edits. A null conv_id is a
conversation. Repeated rows are duplicates. A conversation is one row of the result, so its texts must fit into one (2 GB); no other bound.
Gaps beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

START, S, U, A = range(4)
_FAR = 1 << 60
_ANSWER = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("at", pa.list_(pa.int32())), ("role", pa.list_(pa.string()))])
#: From, to, role of an inserted or reroled turn.
_NEXT = [(START, U, "user"), (S, U, "user"), (A, U, "user"), (U, A, "assistant")]
_KEPT = {"s": [(START, S)], "u": [(START, U), (S, U), (A, U)], "a": [(U, A)]}


def _edges(symbol: str) -> list[tuple[str, int, int, int, str | None]]:
    """Edits of a turn: initial, state before, state after, cost, new role. Symbols: the role's initial (o: others), upper case if truncated; x must go."""
    gone = [("D", s, s, 3, None) for s in range(4)]
    if symbol == "x":
        return gone
    more = int(symbol.isupper())
    return [*gone, *(("K", s, t, more, None) for s, t in _KEPT.get(symbol.lower(), [])), *(("R", s, t, 2 + more, r) for s, t, r in _NEXT)]


EDGES = {x: _edges(x) for x in "xsuaoSUAO"}


class Walk:
    """A walk through the trie of words; `layers` counts those that were computed."""

    def __init__(self) -> None:
        self.word, self.path, self.layers = "", [self._closed([0, _FAR, _FAR, _FAR])], 0

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """With inserted turns."""
        costs[U] = min(costs[U], min(costs[START], costs[S], costs[A]) + 2)
        costs[A] = min(costs[A], costs[U] + 2)
        return costs

    def to(self, word: str) -> None:
        """Goes up to the prefix that the word shares with the last one, then down."""
        shared = 0
        for x, y in zip(word, self.word):  # noqa: B905
            if x != y:
                break
            shared += 1
        del self.path[shared + 1 :]
        for x in word[shared:]:
            before, costs = self.path[-1], [_FAR] * 4
            for _, s, t, c, _ in EDGES[x]:
                if before[s] + c < costs[t]:
                    costs[t] = before[s] + c
            self.path.append(self._closed(costs))
            self.layers += 1
        self.word = word

    def answer(self) -> dict:
        """Cost, edits, and for each turn of the repaired conversation its place before (from 1, null if inserted) and new role (null if kept)."""
        word, path = self.word, self.path
        cost = min(path[-1][START], path[-1][A])
        good = [[False] * 4 for _ in path]  # states on a cheapest way
        for s in (START, A):
            good[-1][s] = path[-1][s] == cost
        for i in range(len(word), -1, -1):
            here, costs = good[i], path[i]
            if i < len(word):
                for _, s, t, c, _ in EDGES[word[i]]:
                    if good[i + 1][t] and costs[s] + c == path[i + 1][t]:
                        here[s] = True
            for s, t, _ in ((U, A, ""), *_NEXT[:3]):
                if here[t] and costs[s] + 2 == costs[t]:
                    here[s] = True
        audit, at, role, i, s = [], [], [], 0, START
        while i < len(word) or not (s in (START, A) and path[i][s] == cost):
            ways = [("I", s, t, 2, r) for q, t, r in _NEXT if q == s and good[i][t] and path[i][s] + 2 == path[i][t]]
            if i < len(word):
                ways += [e for e in EDGES[word[i]] if e[1] == s and good[i + 1][e[2]] and path[i][s] + e[3] == path[i + 1][e[2]]]
            edit, _, s, _, new = min(ways, key=lambda e: e[0])
            i += edit != "I"
            audit.append(edit)
            if edit != "D":
                at.append(None if edit == "I" else i)
                role.append(new)
        return {"cost": cost, "audit": "".join(audit), "at": at, "role": role}


@arrow_udf(T.StructType().add("cost", T.LongType()).add("audit", T.StringType()).add("at", T.ArrayType(T.IntegerType())).add("role", T.ArrayType(T.StringType())))
def _solved(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    walk, last = Walk(), None
    for batch in words:
        out = []
        for word in batch.to_pylist():
            if last is None or word != walk.word:
                walk.to(word)
                last = walk.answer()
            out.append(last)
        yield pa.array(out, _ANSWER)


_solve = _solved.asNondeterministic()  # so that the sort before it stays where it is


def _last(text: Column) -> Column:
    return F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def turn_facts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with place (from 1), initial, fault (blank, duplicate, truncated or null), illegal (its role may not follow the one before).

    One shuffle, by conversation; sorts spill. Rows that only name their conversation have the place null.
    """
    named = F.col("turn").isNull() & F.col("role").isNull() & F.col("text").isNull()
    rows = rows.select("conv_id", "turn", "role", "text", named.alias("bare"), F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"))
    order = Window.partitionBy("conv_id").orderBy("bare", F.col("turn").asc_nulls_first(), "role", "text")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    rows = rows.withColumn("place", F.when(~F.col("bare"), F.row_number().over(order))).withColumn("illegal", ~F.coalesce(F.col("bare") | pair.isin("su", "ua", "au"), F.lit(True)))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("place").asc_nulls_last())) > 1
    last = _last(F.coalesce("text", F.lit("")))
    fault = F.when(F.col("bare"), None).when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "place", "initial", fault.alias("fault"), "illegal")


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits) and repaired, the list of (role, text, edit).

    rows: conv_id, turn, role, text; other columns aren't read. The conversations stay where their turns were dealt to: one shuffle in all.
    """
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    facts = turn_facts(rows).withColumn("symbol", symbol)
    count = lambda c: F.count_if(c).alias
    whole = facts.groupBy("conv_id").agg(
        *(count(F.col("fault") == x)(x) for x in ("blank", "duplicate", "truncated")),
        count(F.col("illegal"))("illegal"),
        F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "turn", "role", "text", "symbol")))).alias("turns"),
    )
    spans = F.array_compact(F.col("turns.turn"))
    gaps = F.array_max(spans).cast("decimal(38,0)") - F.array_min(spans).cast("decimal(38,0)") + 1 - F.size(F.array_distinct(spans))
    words = whole.select("*", F.when(F.size(spans) > 0, gaps.try_cast("long")).otherwise(F.lit(0).cast("long")).alias("gaps"), F.array_join("turns.symbol", "").alias("word"))
    solved = words.sortWithinPartitions("word").withColumn("solved", _solve("word"))
    turn = lambda at: F.get(F.col("turns"), at - 1)
    step = lambda x: F.struct(
        F.coalesce(x["role"], turn(x["at"])["role"], F.lit("")).alias("role"),
        F.coalesce(turn(x["at"])["text"], F.lit("")).alias("text"),
        F.when(x["at"].isNull(), "insert").when(x["role"].isNotNull(), "rerole").otherwise("keep").alias("edit"),
    )
    return solved.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("solved.cost").alias("cost"), F.col("solved.audit").alias("audit"), F.transform(F.arrays_zip("solved.at", "solved.role"), step).alias("repaired")
    )
