"""Chat formatting with DataFrame functions only: a role automaton, a declarative template, loss-flagged segments.

A conversation is formatted turn by turn as ``begin role body text end``. The control strings of the template are escaped
inside roles and texts by a backslash after their first character (backslashes are doubled), so that the formatted string
can be split at its control strings and read back exactly.

Defined results. Null texts and roles count as empty. Turns are ordered by (turn, role, text), null turns first; repeated rows
are turns of their own. A conversation whose roles don't follow the automaton is formatted all the same; ``valid`` is false
and ``bad_turn`` is the index of the first turn that the automaton refuses. Rows of a null conv_id form one conversation.
Other columns of the input are ignored; an empty table gives an empty result.

Limits. The contract asks for one string and one digest per conversation, so a conversation has to fit into a row (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles bear loss, and which role may follow which (start state: "")."""

    begin: str = "<s>[INST]"
    body: str = "[/INST]"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters at least and no backslash: {c!r}")
        for mark in (self.begin, self.body, self.end):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"{mark!r} holds no control string, so it couldn't be found again")

    def _heads_tails(self) -> tuple[str, str]:
        return "".join(sorted({re.escape(c[0]) for c in self.controls})), "|".join(sorted({re.escape(c[1:]) for c in self.controls}))

    def escape(self, text: Column) -> Column:
        """Doubles backslashes, then puts one after the first character of whatever looks like a control string."""
        heads, tails = self._heads_tails()
        return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([{heads}])(?={tails})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        heads, tails = self._heads_tails()
        return F.regexp_replace(F.regexp_replace(text, rf"([{heads}])\\(?={tails})", "$1"), r"\\\\", r"\\")


def format_conversations(rows: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    t = template or Template()
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns")
    )
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in t.transitions.items() for b in after])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    step = lambda s, x: F.struct(
        x["role"].alias("state"), (s["i"] + 1).alias("i"), F.coalesce(s["bad"], F.when(~F.array_contains(allowed, F.concat(s["state"], F.lit(">"), x["role"])), s["i"])).alias("bad")
    )
    flag = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform("turns", lambda x: F.array(flag(F.concat(F.lit(t.begin), t.escape(x["role"]), F.lit(t.body)), F.lit(False)), flag(t.escape(x["text"]), x["role"].isin(list(t.loss_roles))), flag(F.lit(t.end), F.lit(False))))
    )
    out = turns.select("conv_id", segments.alias("segments"), F.aggregate("turns", start, step, lambda s: s["bad"]).alias("bad_turn"))
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"), F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    t = template or Template()
    pieces = F.filter(F.split(formatted, re.escape(t.end)), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(t.begin) + 1, 2**31 - 1), re.escape(t.body), 2))
    return F.transform(parts, lambda p: F.struct(t.unescape(p[0]).alias("role"), t.unescape(p[1]).alias("text")))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
