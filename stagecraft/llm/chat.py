"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says, per role, which marks open and close a turn and whether the text between them is learned
from, and which role may follow which.  Conversations stream through in turn order: each turn becomes up to
three text segments (opening mark, text, closing mark) with a loss flag each, and the machine's verdict on
the turn.  Control strings inside texts are broken up by a backslash after their first character, and
read back by taking one away, so marks can always be told from texts.

Rows are dealt out by conversation and sorted; after that one row at a time is held, so a conversation may
have any number of turns and any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from stagecraft.llm.util import map_arrow


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, allowed successions (None: the start), and how any other role is written.

    ``other`` carries the role's name, escaped like a text, between ``other_open`` and ``other_name_end``.
    """

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    })
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {
        None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    other_open: str = "<|role|>"
    other_name_end: str = "<|text|>"
    other_close: str = "<|end|>"

    def controls(self) -> list[str]:
        """Strings that may not stand inside a text: the marks without their outer white space."""
        marks = [m for t in self.turns.values() for m in (t.open, t.close)] + [self.other_open, self.other_name_end, self.other_close]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))

    def broken(self) -> re.Pattern:
        """A control string's first character, any backslashes, and (looking ahead) its remainder."""
        return re.compile("|".join(f"{re.escape(c[0])}\\\\*(?={re.escape(c[1:])})" for c in self.controls()))


class Formatter:
    """Writes and reads turns by a template."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.pattern = template.broken()

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][:-1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(segment, loss) in order; together they are the formatted turn."""
        t, turn = self.template, self.template.turns.get(role)
        if turn is None:
            head = t.other_open + self.escape(role) + t.other_name_end
            return [(head, False), (self.escape(text), False), (t.other_close, False)]
        return [(turn.open, False), (self.escape(text), turn.loss), (turn.close, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        t, at, out = self.template, 0, []
        while at < len(formatted):
            for role, turn in t.turns.items():
                if formatted.startswith(turn.open, at):
                    at += len(turn.open)
                    close = turn.close
                    break
            else:
                if not formatted.startswith(t.other_open, at):
                    raise ValueError(f"no turn opens at character {at}")
                end = formatted.index(t.other_name_end, at)
                role, at, close = self.unescape(formatted[at + len(t.other_open):end]), end + len(t.other_name_end), t.other_close
            # White space of a closing mark may also end the text; the control string itself cannot.
            inner = formatted.index(close.strip(), at) - (len(close) - len(close.lstrip()))
            out.append((role, self.unescape(formatted[at:inner])))
            at = inner + len(close)
        return out


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: Template | None = None) -> DataFrame:
    """(conv_id, position, segments, valid): one row per turn, in order inside each partition.

    ``segments`` is an array of (text, loss); ``valid`` tells whether the role may follow the one before.
    Turns are ordered by ``turn``, then role and text; NULLs come first and NULL roles and texts count as
    empty; rows without a conversation id form one conversation.  Invalid turns are marked, never dropped.
    An empty table gives an empty result; other columns are not read.
    """
    template = template or Template()
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def make():
        write, state = Formatter(template), {"conv": (), "role": None, "position": 0}

        def step(batch):
            out: dict[str, list] = {"conv_id": [], "position": [], "segments": [], "valid": []}
            for conv, role, said in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if (conv,) != state["conv"]:
                    state.update(conv=(conv,), role=None, position=0)
                out["conv_id"].append(conv)
                out["position"].append(state["position"])
                out["segments"].append([{"text": s, "loss": loss} for s, loss in write.segments(role, said)])
                out["valid"].append(role in template.follows.get(state["role"], ()))
                state.update(role=role, position=state["position"] + 1)
            yield out
        return step

    kind = turns.schema[conv_col].dataType.simpleString()
    return map_arrow(rows, make, f"conv_id {kind}, position long, segments array<struct<text:string,loss:boolean>>, valid boolean")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from the formatted segments alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid).  Works on the result of
    ``format_conversations`` as it lies, without another shuffle: hashes grow turn by turn.
    """
    template = template or Template()
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = Formatter(template)
        held = None  # [conv, turns, hash, loss characters, loss hash, characters, valid, last role]
        names = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                           ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
        for batch in batches:
            ended = []
            conv_type = batch.schema.field(0)
            for conv, segments, valid in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if held is None or held[0] != (conv,):
                    if held is not None:
                        ended.append(held)
                    held = [(conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, None]
                whole = "".join(s["text"] for s in segments)
                for role, text in read.read(whole):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                    held[7] = role
                for s in segments:
                    if s["loss"]:
                        learned = read.unescape(s["text"])
                        held[3] += len(learned)
                        held[4].update(learned.encode())
                held[5] += len(whole)
                held[6] = held[6] and valid
            if ended:
                yield rows(ended, conv_type, names, fields)
        if held is not None:
            yield rows([held], conv_type, names, fields)

    def rows(ended, conv_type, names, fields):
        import pyarrow as pa

        schema = pa.schema([conv_type, *names])
        values = [[h[0][0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5], h[6] and h[7] in template.final] for h in ended]
        return pa.RecordBatch.from_pydict(dict(zip(fields, map(list, zip(*values)))), schema=schema)

    return formatted.mapInArrow(run, schema)
