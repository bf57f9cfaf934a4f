"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role NL text <|im_end|> NL``.  Control strings inside
roles and texts are escaped by one more backslash after each ``<`` that stands before
backslashes and a bar.  A turn is first rendered as it is and parsed again by a deterministic parser, which takes one
backslash away at each such place; where the recovered turn differs from the source, the role or text that conflicts is
escaped, until both are identical.  The rendered text alone parses back: no level is needed to read it.

Rendering, escaping and parsing work on single turns and need no shuffle.  Digests go over
a conversation's turns in order, streamed, so even a conversation with most of all rows
needs the memory of one turn.

Defined cases: a null text is empty; a null role is the empty role; turns are ordered by turn
(nulls first), then role and text; repeated turns are all kept; rows without conv_id are one
conversation, with a null conv_id; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Newlines would end a role early.
_ROLE_OUT = (("\\", "\\\\"), ("\n", "\\n"))


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    for a, b in _ROLE_OUT:
        role = role.replace(a, b)
    return escape(role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, start and end of the text) of rendered turns, or None if malformed.

    Deterministic: each turn must open at the current place, its role ends at the first
    newline, its text at the first end mark, and no other mark may stand inside.
    """
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END + "\n", line + 1)
        if line < 0 or end < 0:
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in role or END in role or START in text or END in text:
            return None
        turns.append((role, text, line + 1, end))
        at = end + len(END) + 1
    return turns


def recover(rendered: str) -> list[tuple[str, str]] | None:
    """The turns (role, text) that rendered turns stand for, or None if malformed."""
    turns = parse(rendered)
    return None if turns is None else [(unescape_role(role), unescape(text)) for role, text, _, _ in turns]


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and how many of its two parts had to be escaped to survive the round trip."""
    safe_role, safe_text, level = role, text, 0
    while recover(rendered := render(safe_role, safe_text)) != [(role, text)]:
        if safe_text == text and recover(render("", text)) != [("", text)]:
            safe_text, level = escape(text), level + 1
        elif safe_role == role and recover(render(role, "")) != [(role, "")]:
            safe_role, level = escape_role(role), level + 1
        else:
            raise ValueError("a turn did not survive the round trip")
    return rendered, level


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        done = [format_turn(r or "", t or "") for r, t in zip(role, text, strict=True)]
        spans = [parse(x)[0] for x, _ in done]
        loss = [[s[2], s[3]] if r == "assistant" else None for r, s in zip(role, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32()), pa.array(loss, pa.list_(pa.int32())), batch.column("role"), batch.column("text")],
            ["conv_id", "turn", "formatted", "level", "loss_span", "role", "text"],
        )


FORMATTED = "conv_id long, turn long, formatted string, level int, loss_span array<int>, role string, text string"


def formatted_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn: its rendered text, number of escaped parts, and the span of its text that is under the loss mask (code points of ``formatted``; null unless an assistant's)."""
    small_batches(turns.sparkSession)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(_format, FORMATTED)


class _Conversation:
    """Digests of one conversation, turn by turn, from the formatted text alone."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, span: list[int] | None) -> None:
        for (plain_role, plain), (_, _, start, end) in zip(recover(formatted), parse(formatted), strict=True):
            self.n += 1
            self.turns.update(f"{plain_role}\n{plain}\n".encode("utf-8", "surrogatepass"))
            if span == [start, end]:
                self.loss_chars += len(plain)
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for conv_id, formatted, span in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_span")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            now.add(formatted, span)
        if len(done) >= 1000:
            yield out()
            done = []
    if now is not None:
        done.append(now.row())
    yield out()


def write_formatted(turns: DataFrame) -> DataFrame:
    """The formatted turns, written to the shared folder and read back."""
    return staged(formatted_turns(turns), "chat-formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation with counts and digests recovered by parsing ``formatted``."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.select("conv_id", "formatted", "loss_span").mapInArrow(_digest, DIGEST)
