"""Chat formatting: role order checked by a finite-state machine, segments with loss flags from a template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A declarative chat template.

    A turn is ``open`` + role + ``sep`` + text + ``close``; only the text of a trained role is
    under the loss mask.  No control string may stay intact inside a role or a text, so the
    template's own ones are always among ``controls``.  ``moves`` lists the role order: from a
    state (``start`` or the role before) to the roles that may follow; ``final`` are the roles
    that a conversation may end with.
    """

    open: str = "<|turn|>"
    sep: str = "<|text|>"
    close: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(not text or "\\" in text for text in self.controls):
            raise ValueError("control strings are not empty and hold no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.sep, self.close, *self.foreign)

    def pattern(self) -> str:
        """Matches the first character of every control string."""
        return "(?s)(?=" + "|".join(re.escape(text) for text in self.controls) + ")(.)"


def escape(text: Column, template: Template) -> Column:
    r"""Doubles every ``\`` and puts one after the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), template.pattern(), r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, segments, formatted, valid, bad_turns.

    ``segments`` is an array of (role, text, loss) in output order, three per turn: what opens it,
    the escaped text, what closes it.  ``formatted`` is their texts in a row.  The state machine
    walks over the roles: ``bad_turns`` counts turns whose role may not follow the one before, and
    ``valid`` says that there are none and that the last role may end a conversation.

    Rows are put in order by turn, then role and text, so ties and repeated rows have one order and
    all stay.  A null turn comes first, a null role or text counts as empty, rows with a null id
    form one conversation.  A conversation becomes one row, as its formatted text is one training
    example: its size bounds what a task holds.  An empty table gives no rows.
    """
    template = template or Template()
    rows = turns.select(
        F.col(conv_col).alias(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("item"),
    )
    grouped = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list("item")).alias("items"))
    loss_role = lambda role: role.isin(*template.trained) if template.trained else F.lit(False)
    cut = lambda role, text, loss: F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "items",
            lambda x: F.array(
                cut(x["role"], F.concat(F.lit(template.open), escape(x["role"], template), F.lit(template.sep)), F.lit(False)),
                cut(x["role"], escape(x["text"], template), loss_role(x["role"])),
                cut(x["role"], F.lit(template.close), F.lit(False)),
            ),
        )
    )
    before = F.concat(F.array(F.lit("start")), F.transform(F.slice("items", 1, F.size("items") - 1), lambda x: F.concat(F.lit("="), x["role"])))
    allowed = F.lit(False)
    states = F.zip_with(before, F.transform("items", lambda x: x["role"]), lambda a, b: F.struct(a.alias("state"), b.alias("role")))

    def misfit(step: Column) -> Column:
        fits = allowed
        for state, roles in template.moves.items():
            name = "start" if state == "start" else f"={state}"
            if roles:
                fits = fits | ((step["state"] == name) & step["role"].isin(*roles))
        return ~fits

    formatted = grouped.select(
        conv_col,
        F.size("items").cast("bigint").alias("n_turns"),
        segments.alias("segments"),
        F.size(F.filter(states, misfit)).cast("bigint").alias("bad_turns"),
        F.element_at("items", -1)["role"].isin(*template.final).alias("ends"),
    )
    return formatted.select(
        conv_col,
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        ((F.col("bad_turns") == 0) & F.col("ends")).alias("valid"),
        "bad_turns",
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text as an array of (role, text): cut at the closing marks, then unescaped."""
    template = template or Template()
    parts = F.split(formatted, re.escape(template.close), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda part: F.substr(part, F.lit(len(template.open) + 1))
    return F.transform(
        F.transform(parts, lambda part: F.split(body(part), re.escape(template.sep), 2)),
        lambda pair: F.struct(unescape(pair[0]).alias("role"), unescape(pair[1]).alias("text")),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
