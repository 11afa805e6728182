r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role become one
block, and blocks become segments of one formatted text. A template names the control
strings:

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

`next` stands between the turns of a block, so that they can be told apart when the text is
read back. A segment is a piece of the formatted text and whether the loss counts it; the
segments joined are the formatted text, and those under the loss are the texts of the
template's learned roles, each by itself.

Control strings that occur in roles or texts are escaped: every backslash is doubled, and a
backslash is put behind the first character of whatever would be a control string. That
leaves none, not even one that overlaps another, and taking off the backslashes gives back
the text. Beside its own strings a template escapes those of other templates.

Turns meet by conversation in one shuffle, collected before it in part. A formatted
conversation is one value, which Spark holds up to 2 GB; all work on it is linear in its length.

Defined results: a null role or text is empty. Turns are in the order of turn (null first),
then role and text; repeated rows are turns of their own. Rows without a conversation id
make up one conversation without an id. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of chat templates in common use, which texts must not forge.
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>",
)


@dataclass(frozen=True)
class Template:
    """Control strings of a format, and the roles whose texts are learned."""

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    next: str = "<|im_next|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = FOREIGN

    def __post_init__(self):
        own, every = self.own(), self.controls()
        if len(set(own)) < 4 or any(len(c) < 2 or "\\" in c for c in every):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        # The tail of a text and the head of a mark, or the tail of a mark and the head of a
        # text, must not make up a control string.
        for mark in own:
            for c in every:
                if any(mark.startswith(c[i:]) or (c[i:].startswith(mark)) for i in range(1, len(c))):
                    raise ValueError(f"the end of {c!r} is the beginning of {mark!r}")
                if any(mark.endswith(c[:i]) for i in range(1, len(c))):
                    raise ValueError(f"the beginning of {c!r} is the end of {mark!r}")

    def own(self) -> tuple[str, ...]:
        return self.start, self.sep, self.next, self.end

    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.own(), *self.foreign]))


def escape(column: Column, template: Template) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit(f"(?:{heads})"), F.lit(r"$0\\"))


def unescape(column: Column) -> Column:
    return F.regexp_replace(column, F.lit(r"\\(\\?)"), F.lit("$1"))


def blocks(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, blocks): of each conversation the runs of one role, (role, texts)."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = conversations.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), *words).alias("said"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))

    def role_of(i: Column) -> Column:
        return F.element_at("turns", i)["role"]

    # Where a run begins, and one past the last turn.
    new = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (role_of(i) != role_of(F.greatest(i - 1, F.lit(1)))))
    turns = turns.withColumn("cuts", F.concat(new, F.array(F.size("turns") + 1)))

    def run(n: Column) -> Column:
        first, behind = F.element_at("cuts", n), F.element_at("cuts", n + 1)
        return F.struct(role_of(first).alias("role"), F.transform(F.slice("turns", first, behind - first), lambda t: t["text"]).alias("texts"))

    return turns.select("conv_id", F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), run).alias("blocks"))


def format_chats(conversations: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, segments) of each conversation; segments are (text, loss)."""

    def piece(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def of_block(block: Column) -> Column:
        head = F.concat(F.lit(template.start), escape(block["role"], template), F.lit(template.sep))

        def of_text(t: Column, i: Column) -> Column:
            mark = F.when(i + 1 == F.size(block["texts"]), F.lit(template.end)).otherwise(F.lit(template.next))
            return F.array(piece(escape(t, template), block["role"].isin(*template.learned)), piece(mark, F.lit(False)))

        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(F.transform(block["texts"], of_text)))

    made = blocks(conversations, conv, turn, role, text).select("conv_id", F.flatten(F.transform("blocks", of_block)).alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds, in order."""

    def split(column: Column, mark: str) -> Column:
        return F.split(column, re.escape(mark), -1)

    # Nothing stands before the first start; the end stands behind the last text of a block.
    found = split(formatted, template.start)
    parts = F.transform(F.slice(found, F.lit(2), F.size(found)), lambda b: split(b, template.sep))
    read = F.transform(
        parts, lambda p: F.struct(unescape(p[0]).alias("role"), split(F.element_at(split(p[1], template.end), 1), template.next).alias("texts"))
    )
    return F.flatten(F.transform(read, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text that the loss counts, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
