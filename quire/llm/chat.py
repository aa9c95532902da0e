"""Chat formatting with DataFrame functions only (operator 2).

A declarative template gives each role a prefix and a suffix, says whether its texts count for the loss, and lists the
allowed successions of roles. A finite-state machine, folded over a conversation's roles, says whether the order is allowed;
the text is put together from segments that each carry a loss flag. Control strings inside texts are escaped with a
backslash, so that a rendered conversation can be read back without loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: known ones; other: prefix, middle and suffix of turns of any other role, which is written before the middle.

    moves: for each state of the machine the next state by role; the states in ``final`` may be the last. All control strings must begin
    with a character that is not in the rest of any of them.
    """

    roles: dict[str, Role]
    other: tuple[str, str, str]
    moves: dict[str, dict[str, str]] = field(hash=False)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [x for r in self.roles.values() for x in (r.prefix, r.suffix)] + list(self.other)


INST = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    other=("[ROLE]", "[:]", "[/ROLE]"),
    moves={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for x in template.controls:
        out = F.replace(out, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: Column, template: Template) -> Column:
    """Array of (text, loss) for an array of (role, text): prefix, escaped text and suffix of each turn."""

    def of(turn: Column) -> Column:
        def three(before: Column, after: Column, loss: Column) -> Column:
            kinds = ((before, F.lit(False)), (escape(turn["text"], template), loss), (after, F.lit(False)))
            return F.array(*(F.struct(x.alias("text"), y.alias("loss")) for x, y in kinds))

        prefix, middle, suffix = map(F.lit, template.other)
        out = three(F.concat(prefix, escape(turn["role"], template), middle), suffix, F.lit(False))
        for name, role in template.roles.items():
            out = F.when(turn["role"] == name, three(F.lit(role.prefix), F.lit(role.suffix), F.lit(role.loss))).otherwise(out)
        return out

    return F.flatten(F.transform(turns, of))


def state(turns: Column, template: Template) -> Column:
    """The machine's state after the last turn; ``refused`` from the first role that the state doesn't allow."""
    moves = F.create_map(*(F.lit(x) for a, to in template.moves.items() for role, b in to.items() for x in (f"{a} {role}", b)))
    return F.aggregate(turns, F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s, t["role"])), F.lit("refused")))


def read_back(formatted: Column, template: Template) -> Column:
    """Array of (role, text, loss) from a rendered conversation: the inverse of rendering."""
    ways = [f"{re.escape(r.prefix)}.*?{re.escape(r.suffix)}" for r in template.roles.values()] + [".*?".join(map(re.escape, template.other))]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(ways)), F.lit(0))

    def of(x: Column) -> Column:
        def between(start: int | Column, end: int) -> Column:
            start = F.lit(start) if isinstance(start, int) else start
            return unescape(F.substring(x, start + 1, F.length(x) - start - end))

        prefix, middle, suffix = template.other
        at = F.locate(middle, x) - 1
        out = F.struct(
            unescape(F.substring(x, F.lit(len(prefix) + 1), at - len(prefix))).alias("role"), between(at + len(middle), len(suffix)).alias("text"), F.lit(False).alias("loss")
        )
        for name, r in template.roles.items():
            own = F.struct(F.lit(name).alias("role"), between(len(r.prefix), len(r.suffix)).alias("text"), F.lit(r.loss).alias("loss"))
            out = F.when(F.startswith(x, F.lit(r.prefix)), own).otherwise(out)
        return out

    return F.transform(found, of)


def render(turns: DataFrame, template: Template = INST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, segments (text, loss), formatted text, state, valid.

    Turns go by turn, then role and text. A null text is empty, a null role the empty role, a role that the template doesn't
    know is written with its name. Rows without a conversation id are left out; repeated rows are repeated turns. Every
    conversation is rendered, whether its order is valid or not. Other columns are not read. An empty table gives no rows.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.where(F.col(conv_col).isNotNull()).groupBy(conv_col).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    made = whole.select(conv_col, segments(F.col("turns"), template).alias("segments"), state(F.col("turns"), template).alias("state"))
    return made.select(conv_col, "segments", F.concat_ws("", F.col("segments.text")).alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid"))
