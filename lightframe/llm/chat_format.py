"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs and sorted; runs of one role are merged by array functions into a block
of several texts; blocks are joined into segments, each of them text that a model is trained on or not. Control
strings of the template that occur inside texts are escaped, so the formatted string can be read back into the same turns.
Escaping is done before the exchange; map-side aggregation hands on one row a conversation and task, so a
conversation that holds a large share of all turns arrives as a few rows. Its formatted string is one value, so a
conversation is bounded by what a value can hold (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A block is begin, head, role, body, its texts with `next` between them, end; where the role is null, head is left out."""

    begin: str = "<s>"
    head: str = "[INST]"
    body: str = "[/INST]"
    next: str = "<sep>"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or "\\" in a or any(b[0] in a[1:] for b in self.controls) or self.controls.count(a) > 1:
                raise ValueError("control strings differ, have two characters or more, no backslash, and no first character of one inside another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.head, self.body, self.next, self.end)

    def escape(self, text: Column) -> Column:
        """Backslashes are doubled, and one parts each control string after its first character."""
        parted = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), parted, "\\\\")

    def unescape(self, text: Column) -> Column:
        parting = "|".join(f"(?<={re.escape(c[0])})\\\\(?={re.escape(c[1:])})" for c in self.controls)
        return F.replace(F.regexp_replace(text, parting, ""), F.lit("\\\\"), F.lit("\\"))


LLAMA_LIKE = Template()


def merged(turns: Column) -> Column:
    """Sorted turns (role, text, ...) as blocks (role, texts): neighbours of one role share a block."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
    pairs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(
        F.filter(pairs, lambda p: p["a"].isNotNull()),
        lambda p: F.struct(F.get(turns, p["a"])["role"].alias("role"), F.transform(F.slice(turns, p["a"] + 1, p["b"] - p["a"]), lambda t: t["text"]).alias("texts")),
    )


def segments(blocks: Column, t: Template) -> Column:
    """Array of (text, loss): under the loss mask are exactly the escaped texts of `loss_roles`."""
    piece = lambda s, loss: F.struct(s.alias("text"), F.lit(loss).alias("loss"))

    def of_block(b: Column) -> Column:
        head = F.concat(F.lit(t.begin), F.coalesce(F.concat(F.lit(t.head), b["role"]), F.lit("")), F.lit(t.body))
        trained = F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(t.next)), False), piece(x, True)))
        plain = F.array(piece(F.concat(head, F.array_join(b["texts"], t.next), F.lit(t.end)), False))
        return F.when(b["role"].isin(*t.loss_roles), F.concat(F.flatten(trained), F.array(piece(F.lit(t.end), False)))).otherwise(plain)

    return F.flatten(F.transform(blocks, of_block))


def formatted(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = LLAMA_LIKE) -> DataFrame:
    """conv_id, segments (array of text, loss) and formatted (the segments' texts, joined) of every conversation.

    Turns go by `turn_col` (nulls first), ties by role, then by text; repeated rows are turns of their own. Null texts are
    empty; null roles make blocks without a head; rows without an id are one conversation. Other columns are not read."""
    esc = template.escape
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), esc(F.col(role_col).cast("string")).alias("role"), esc(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns")).select("conv_id", F.sort_array("turns").alias("turns"))
    blocks = gathered.select("conv_id", merged(F.col("turns")).alias("blocks"))
    parts = blocks.select("conv_id", segments(F.col("blocks"), template).alias("segments"))
    return parts.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def mask_runs(parts: Column) -> Column:
    """The loss mask of the formatted string as runs of code points: array of (chars, loss)."""
    return F.transform(parts, lambda s: F.struct(F.length(s["text"]).alias("chars"), s["loss"].alias("loss")))


def read_turns(text: Column, template: Template = LLAMA_LIKE) -> Column:
    """Array of (role, text): the turns of a formatted string."""
    t = template
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split(text, quoted(t.end), -1), lambda b: b != "")  # what follows the last end is empty

    def of_block(b: Column) -> Column:
        known = b.startswith(t.begin + t.head)
        head = F.substring_index(b, t.body, 1)
        role = F.when(known, t.unescape(F.substring(head, len(t.begin + t.head) + 1, F.length(head))))
        texts = F.split(F.substring(b, F.length(head) + len(t.body) + 1, F.length(b)), quoted(t.next), -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def report(chats: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """What can be read back from the output: the turns from the formatted string, the trained texts from the loss mask."""
    read = chats.select("conv_id", read_turns(F.col("formatted"), template).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])).alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    line = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n"))
    sha = lambda s: F.sha2(s.cast("binary"), 256)
    loss = F.array_join("trained", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")
