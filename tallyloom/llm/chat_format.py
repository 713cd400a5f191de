"""Chat formatting: a finite-state machine over roles and text segments with loss flags.

Everything is said by a template: roles and their order, the marks around a turn, the escapes
that keep marks out of texts, and the roles that are learnt from. Only column expressions are
used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Declarative form of a chat.

    ``begin`` holds ``{role}``. Every escape is one character and what stands for it; the escape
    sign itself comes first. A mark begins with a character that is escaped, so an escaped text
    holds no mark and no prefix of one.
    """

    begin: str = "<turn:{role}>"
    end: str = "</turn>\n"
    escapes: tuple = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))
    loss_roles: tuple = ("assistant",)
    # state after a role; a pair that is not listed is an error
    steps: tuple = (
        ("start", "system", "system"), ("start", "user", "user"),
        ("system", "user", "user"), ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepted: tuple = ("user", "assistant")

    def pattern(self) -> str:
        """Expression of one formatted turn: group 1 the role, group 2 the text, both escaped."""
        quiet = "".join(re.escape(c) for c, _ in self.escapes[1:])
        inner = f"([^{quiet}]*)"
        before, after = self.begin.split("{role}")
        return _quoted(before) + inner + _quoted(after) + inner + _quoted(self.end)


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in text)


def escape(c: Column, template: Template) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), template.escapes, c)


def unescape(c: Column, template: Template) -> Column:
    """Undo ``escape``: every escape sign in an escaped text is followed by its own code."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(template.escapes), c)


def _state(roles: Column, template: Template) -> Column:
    steps = F.create_map(*[F.lit(x) for a, r, b in template.steps for x in (f"{a} {r}", b)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(
        F.element_at(steps, F.concat(s, F.lit(" "), r)), F.lit("error")))


def format_chats(
    rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conversation, valid, segments, formatted) of every conversation.

    ``segments`` is an array of (text, loss) that joins to ``formatted``: the marks, and the
    escaped text of each turn, its flag set for the roles that are learnt from. ``valid`` is the
    verdict of the state machine on the order of roles; conversations that fail are formatted
    like the others.

    Rows go by turn; equal turns by role, then text; a null turn comes first. Null texts and
    roles are empty, null conversation ids form one conversation, repeated rows are repeated
    turns. A conversation is one row of the result, so it has to fit a task. Further columns are
    not read.
    """
    turns = rows.groupBy(F.col(f"`{conv_col}`").alias(conv_col)).agg(F.sort_array(F.collect_list(F.struct(
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))).alias("_turns"))
    before, after = template.begin.split("{role}")

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def turn(t: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(before), escape(t["role"], template), F.lit(after)), F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.end), F.lit(False)))

    return turns.select(
        conv_col,
        _state(F.transform("_turns", lambda t: t["role"]), template).isin(*template.accepted).alias("valid"),
        F.flatten(F.transform("_turns", turn)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """(conversation, valid, turns, learnt, formatted_chars): turns as (role, text) out of the formatted text,
    and the texts under the loss flags, all unescaped.

    For rows of ``format_chats`` with the same template: the turns come back as they were, null texts and
    roles as empty ones. A null conversation id stays null, an empty table gives no rows, a conversation is one
    row however long, and further columns are not read.
    """
    pattern = F.lit(template.pattern())
    roles, texts = (F.regexp_extract_all("formatted", pattern, F.lit(i)) for i in (1, 2))
    return chats.select(
        conv_col, "valid",
        F.zip_with(roles, texts, lambda r, t: F.struct(
            unescape(r, template).alias("role"), unescape(t, template).alias("text"))).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]),
                    lambda s: unescape(s["text"], template)).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"))
