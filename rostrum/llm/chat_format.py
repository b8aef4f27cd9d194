"""Chat formatting with a grammar round trip.

A conversation is `<|im_start|>` role newline text `<|im_end|>` newline for each turn. The deterministic parser `parse`
reads that grammar and takes back the escape `<\\...|`: one backslash fewer between `<` and `|`. Each turn is rendered as
it is, reparsed and compared with its source; while they differ, what conflicts is escaped: `<`, any backslashes,
`|` gets one backslash more, and in a role a line feed is written `\\n` and a backslash is doubled. So texts without control
strings stay as they are, and every text whatever comes back.

Turns are rendered and compared where they lie; then each conversation's rendered turns are dealt to one partition,
sorted by turn, and read back as a stream that keeps a hash state and no text. (A digest over a conversation is
sequential by nature; memory stays that of one turn, however long the conversation.)

Null roles and texts are empty. Null turns come first; ties are in order of their rendered form, so that repeated rows
and repeated turn numbers have one result. A null conv_id is a conversation of its own. Further columns are ignored.
An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import frugal

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")
MARKS = ("<|im_start|>", "<|im_end|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, unescaped; None if it isn't one."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(MARKS[1], line + 1) if line >= 0 else -1
        role = rendered[at + len(START) : line]
        text = rendered[line + 1 : end]
        if end < 0 or not rendered.startswith(END, end) or MARKS[0] in text or MARKS[0] in role or MARKS[1] in role:
            return None
        out.append((unescape_role(role), unescape(text)))
        at = end + len(END)
    return out


def render_turn(role: str, text: str) -> str:
    """The turn as it is if the parser returns it, with what conflicts escaped otherwise."""
    source = [(role, text)]
    shown_role, shown_text = role, text
    for _ in range(3):
        rendered = f"{START}{shown_role}\n{shown_text}{END}"
        got = parse(rendered)
        if got == source:
            return rendered
        if got is None or len(got) != 1 or got[0][1] != text:
            shown_text = escape(text)
        if got is None or len(got) != 1 or got[0][0] != role:
            shown_role = escape_role(role)
    raise ValueError("a turn doesn't survive its round trip")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shown = [render_turn(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(shown, pa.string())], ["conv_id", "turn", "rendered"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered: each turn in the template; joined by turn they are the formatted conversation."""
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(frugal(_render), "conv_id long, turn long, rendered string")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its rendered turns in order."""
    nothing = object()
    now: object = nothing
    state: list = []
    done: list = []

    def close() -> None:
        if now is not nothing:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for b in batches:
        for conv, rendered in zip(b.column("conv_id").to_pylist(), b.column("rendered").to_pylist(), strict=True):
            if conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(rendered)
            turns = parse(rendered)
            if turns is None:
                raise ValueError(f"conversation {conv}: a rendered turn doesn't parse")
            for role, text in turns:
                raw = text.encode()
                state[0] += 1
                state[1].update(role.encode() + b"\n" + raw + b"\n")
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(raw)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x, strict=True)) for x in done], schema=_SHAPE)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x, strict=True)) for x in done], schema=_SHAPE)


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
_SHAPE = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in COLUMNS])


def read_back(rendered: DataFrame) -> DataFrame:
    """One row for each conversation of `format_turns`: what the parser reads back, as digests."""
    placed = rendered.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("rendered"))
    return placed.mapInArrow(frugal(_read_back), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(conversations: DataFrame) -> DataFrame:
    return read_back(format_turns(conversations))
