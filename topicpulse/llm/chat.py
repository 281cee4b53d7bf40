"""Chat formatting (operator 7).

A finite-state machine over roles checks the order of turns; a declarative
template gives the text around each turn and says which part carries loss.
Control strings inside texts and roles are escaped, so the output can be read
back from its characters alone.

Per turn, three segments are emitted: header (no loss), escaped body (loss for
the template's loss roles), footer (no loss).  Escaping is a native per-row
expression before the shuffle.  Turns are then hash-partitioned by
conversation, sorted, and streamed: a task holds one Arrow batch and the state
of one conversation, however long that is.  ``Reader`` takes the segments'
text piece by piece and returns the turns; it holds no more than one turn.

Edge cases: null text is empty, null role is the empty role; roles are compared
as they stand (``Assistant`` is not ``assistant``), and any role outside the
machine's table puts the conversation in the error state, but is formatted like
the others; turns sort with null first, ties by role and text; a null conv_id is
a conversation of its own; repeated rows are repeated turns; a very long text
is one segment and is never cut; an empty table gives an empty result; columns
other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, who may speak when, and whose words carry loss."""

    header: str = "### {role}: "
    footer: str = " </turn>\n"
    escape: str = "\\"
    #: What stands after the escape character for each character that a control
    #: string starts with, so that no control string is left in a text.
    special: dict = field(default_factory=lambda: {"\\": "\\", "#": "h", "<": "l"})
    #: What a role escapes besides: the first character of what ends it in the header.
    special_in_roles: dict = field(default_factory=lambda: {":": "c"})
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> role -> next state; a role that is missing leads to "error".
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    accepting: frozenset = frozenset({"assistant"})

    def escaped(self, text: Column) -> Column:
        """Native: each special character becomes the escape character and its code."""
        for c, code in self.special.items():
            text = F.replace(text, F.lit(c), F.lit(self.escape + code))
        return text

    def head(self, role: Column) -> Column:
        """Native: the header with the escaped role."""
        role = self.escaped(role)
        for c, code in self.special_in_roles.items():
            role = F.replace(role, F.lit(c), F.lit(self.escape + code))
        before, after = self.header.split("{role}")
        return F.concat(F.lit(before), role, F.lit(after))

    def unescaped(self, text: str) -> str:
        back = {code: c for c, code in {**self.special, **self.special_in_roles}.items()}
        return re.sub(re.escape(self.escape) + "(.)", lambda m: back[m[1]], text)


class Reader:
    """Reads turns back from formatted text that comes in pieces of any length."""

    def __init__(self, template: Template):
        self.template = template
        self.before, self.after = template.header.split("{role}")
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """(role, text) of the turns that end in this piece."""
        footer = self.template.footer
        seek = max(0, len(self.rest) - len(footer) + 1)
        self.rest += piece
        turns, at = [], 0
        while (end := self.rest.find(footer, max(at, seek))) >= 0:
            if not self.rest.startswith(self.before, at):
                raise ValueError(f"no header at {self.rest[at:at + 40]!r}")
            at += len(self.before)
            stop = self.rest.index(self.after, at, end)
            turns.append((self.template.unescaped(self.rest[at:stop]),
                          self.template.unescaped(self.rest[stop + len(self.after):end])))
            at = end + len(footer)
        self.rest = self.rest[at:]
        return turns


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every conversation, in order within each partition.

    Input: conv_id, turn, role, text (other columns are ignored).  Output, three
    rows per turn: conv_id, segment (from 0), text, loss (whether the segment
    carries loss), state (of the machine after the turn).  The formatted
    conversation is its segments' text, one after the other.
    """
    role = F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), template.head(role).alias("header"),
        template.escaped(F.coalesce("text", F.lit(""))).alias("body"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, segment, state = object(), 0, "start"
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype("Int64")
            for conv, role, header, body in zip(ids, batch["role"], batch["header"], batch["body"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    current, segment, state = conv, 0, "start"
                state = template.moves.get(state, {}).get(role, "error")
                for text, loss in ((header, False), (body, role in template.loss_roles),
                                   (template.footer, False)):
                    out.append((conv, segment, text, loss, state))
                    segment += 1
            made = pd.DataFrame(out, columns=["conv_id", "segment", "text", "loss", "state"])
            made["conv_id"] = made["conv_id"].astype("Int64")
            yield made

    return ordered.mapInPandas(walk, "conv_id long, segment long, text string, loss boolean, "
                                     "state string")


def conversation_digests(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the formatted text and the loss flags.

    Roles, texts and the number of turns come from ``Reader``, which sees the
    text alone.  Takes the partitions of ``format_turns`` as they stand (all
    segments of a conversation together and in order) and keeps running hashes,
    so no conversation is ever held whole.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            out = []
            for conv, segment, piece, loss, state in zip(
                    batch["conv_id"].astype("Int64"), batch["segment"], batch["text"],
                    batch["loss"], batch["state"]):
                if segment == 0:
                    if held:
                        out.append(_closed(held, template))
                    held = {"conv_id": None if pd.isna(conv) else int(conv), "n": 0,
                            "reader": Reader(template), "turns": hashlib.sha256(),
                            "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in held["reader"].feed(piece):
                    held["n"] += 1
                    held["turns"].update(f"{role}\n{text}\n".encode())
                held["state"] = state
                held["chars"] += len(piece)
                if loss:
                    learned = template.unescaped(piece)
                    held["loss"].update(learned.encode())
                    held["loss_chars"] += len(learned)
            yield _frame(out)
        if held:
            yield _frame([_closed(held, template)])

    return segments.mapInPandas(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                "loss_sha256 string, formatted_chars long, valid boolean")


def _closed(held: dict, template: Template) -> tuple:
    return (held["conv_id"], held["n"], held["turns"].hexdigest(), held["loss_chars"],
            held["loss"].hexdigest(), held["chars"], held["state"] in template.accepting)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars",
                                       "loss_sha256", "formatted_chars", "valid"])
    made["conv_id"] = made["conv_id"].astype("Int64")
    return made.astype({"n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64",
                        "valid": "bool"})
