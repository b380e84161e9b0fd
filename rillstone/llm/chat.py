"""Chat formatting: a finite-state machine over roles, and a declarative template.

Everything is a DataFrame expression. A conversation is one row with its turns
as an array: the machine folds over the roles, the template maps each turn to
text segments with a loss flag. Control strings inside texts are escaped with a
backslash, ``<|`` as ``<\\|`` and ``<\\|`` as ``<\\\\|``, so that they never read
as markers and every text can be had back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class ChatTemplate:
    """Markers must begin with ``<|``. ``turns`` names, for each state, the roles that may follow; the state is the role before, "" at the start. ``final`` holds the roles that a conversation may end with."""

    before: str = "<|im_start|>"
    after: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


CHATML = ChatTemplate()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """As a text, and without line feeds."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescaped(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(rows: DataFrame, template: ChatTemplate = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments (array of text, loss), valid, error of each conversation; one shuffle by conversation.

    Turns go by turn, then role, then text, so ties and repeated rows have one
    order; a null turn comes first. Null roles and texts count as empty; rows
    with a null conversation make one conversation. ``error`` names the first
    step that the machine has no way for, or the end in a state that is not
    final; a conversation that fails is formatted all the same. Empty texts are
    empty segments, and an empty table gives no rows. Other columns are not
    carried. A conversation is one row: its length bounds a task's need.
    """
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    ways = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(b).alias("to")) for a, to in template.turns.items() for b in to])

    def step(state: Column, turn: Column) -> Column:
        known = F.array_contains(ways, F.struct(state["at"].alias("at"), turn["role"].alias("to")))
        error = F.when(known | state["error"].isNotNull(), state["error"]).otherwise(F.concat(state["at"], F.lit(" > "), turn["role"]))
        return F.struct(turn["role"].alias("at"), error.alias("error"))

    def said(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(template.before), escaped_role(turn["role"]), F.lit("\n")), F.lit(False)),
            part(escaped(turn["text"]), turn["role"].isin(*template.loss)),
            part(F.lit(template.after), F.lit(False)),
        )

    machine = F.aggregate("turns", F.struct(F.lit("").alias("at"), F.lit(None).cast("string").alias("error")), step)
    out = chats.select("conv_id", F.flatten(F.transform("turns", said)).alias("segments"), machine.alias("state"))
    error = F.when(out["state.error"].isNull() & ~out["state.at"].isin(*template.final), F.concat(F.lit("ends after "), out["state.at"])).otherwise(out["state.error"])
    return out.select("conv_id", "segments", error.isNull().alias("valid"), error.alias("error"))


def read_chats(formatted: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text, formatted, valid, error: what a reader of the segments gets back."""
    out = formatted.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(template.after))
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    pieces = F.split("formatted", f"\\Q{template.before}\\E", -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted", "valid", "error")


def chat_digests(rows: DataFrame) -> DataFrame:
    """The digests of read_chats over format_chats, written to the shared folder between the two; nulls, ties, repeated rows and empty tables are as there."""
    back = read_chats(written(format_chats(rows), "chats"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error",
    )
