"""Chat formatting with built-in DataFrame functions only.

A template declares, for each role, the text before and after a turn, whether the turn
counts for the loss, and which roles may follow. Since a state of the machine is the role
just read, a conversation is valid if its first role may start it, each role may follow the
one before, and its last role may end it: adjacent rows decide, in one pass over each
conversation. Every turn gives three segments: prefix, text and suffix; only an assistant's
text carries the loss flag. Control strings of the template inside a text are broken by a
backslash after their first character, and backslashes are doubled, so no text can forge a
turn and unescaping restores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.llm.shared import renamed


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool
    follows: tuple[str, ...]  # roles this one may come after; "" is the start
    ends: bool


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    other: Role
    controls: tuple[str, ...] = field(default=())


#: A template in the style of instruction markers; unknown roles are formatted but never valid.
INSTRUCT = Template(
    {
        "system": Role("<s><<SYS>>", "<</SYS>>", False, ("",), False),
        "user": Role("<s>[INST]", "[/INST]", False, ("", "system", "assistant"), False),
        "assistant": Role("<s>[REPLY]", "</s>", True, ("user",), True),
    },
    Role("<s>[OTHER]", "[/OTHER]", False, (), False),
    ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[REPLY]", "[OTHER]", "[/OTHER]", "[SEP]"),
)


def escape(text: Column, template: Template) -> Column:
    """Backslashes doubled, one put after the first character of every control string."""
    starts = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    """The text before ``escape``: each backslash goes and what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(template: Template, role: Column, value) -> Column:
    out = None
    for name, spec in template.roles.items():
        out = F.when(role == name, F.lit(value(spec))) if out is None else out.when(role == name, F.lit(value(spec)))
    return out.otherwise(F.lit(value(template.other)))


def segments(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments (array of (kind, text, loss)).

    Turns come in order of (turn, role, text), nulls first; a null text is empty and a null
    role is the empty role. Repeated rows are turns of their own, rows without a
    conversation id form one conversation with a null id. A role outside the template is
    kept by name in its prefix and makes the conversation invalid. An empty table gives none.
    """
    rows = renamed(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    allowed = [(a, b) for b, spec in template.roles.items() for a in spec.follows]
    steps = F.zip_with(F.concat(F.array(F.lit("")), F.slice(roles, 1, F.size(roles) - 1)), roles, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fits = F.forall(steps, lambda s: s["b"].isin(list(template.roles)) & F.concat_ws("\x00", s["a"], s["b"]).isin([f"{a}\x00{b}" for a, b in allowed]))
    valid = fits & F.element_at(roles, -1).isin([r for r, spec in template.roles.items() if spec.ends])

    def of_turn(t: Column) -> Column:
        def segment(kind: str, text: Column, loss: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))

        no, known = F.lit(False), t["role"].isin(list(template.roles))
        before = F.concat(_by_role(template, t["role"], lambda r: r.before), F.when(~known, F.concat(escape(t["role"], template), F.lit("[SEP]"))).otherwise(""))
        return F.array(segment("prefix", before, no), segment("text", escape(t["text"], template), _by_role(template, t["role"], lambda r: r.loss)), segment("suffix", _by_role(template, t["role"], lambda r: r.after), no))

    return convs.select(F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), F.flatten(F.transform("turns", of_turn)).alias("segments"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted``, the segments' texts on end, and ``loss_spans``, the (start, end) of those under the loss in it."""
    length = lambda s: F.char_length(s["text"])
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + length(s)).alias("at"),
            F.when(s["loss"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + length(s)).alias("end")))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return conversations.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn("loss_spans", spans)


def read_back(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Adds ``turns_read``: (role, text) of each turn parsed from ``formatted`` alone, and
    ``loss_texts``: what stands in ``formatted`` under ``loss_spans``.

    The text is cut at every turn start, the role found by its marker and both ends taken
    off; escaped texts hold no control string, so the cuts are exact.
    """
    opening = "<s>"
    parts = F.slice(F.split("formatted", re.escape(opening)), 2, F.greatest(F.size(F.split("formatted", re.escape(opening))) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        out = None
        for name, spec in template.roles.items():
            head = spec.before.removeprefix(opening)
            body = F.substring(p, F.lit(len(head) + 1), F.char_length(p) - len(head) - len(spec.after))
            got = F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))
            out = F.when(p.startswith(head), got) if out is None else out.when(p.startswith(head), got)
        head, tail = template.other.before.removeprefix(opening), template.other.after
        body = F.substring(p, F.lit(len(head) + 1), F.char_length(p) - len(head) - len(tail))
        return out.otherwise(F.struct(unescape(F.substring_index(body, "[SEP]", 1)).alias("role"), unescape(F.substring_index(body, "[SEP]", -1)).alias("text")))

    losses = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return conversations.withColumn("turns_read", F.transform(parts, turn)).withColumn("loss_texts", losses)


def digests(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what was read back: turns, text under the loss, length of the formatted text."""
    turns = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return conversations.select(
        conv_col,
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
