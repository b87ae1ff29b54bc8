"""Chat formatting in budgeted windows, with a loss mask over each target once.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside roles and texts get
a backslash after their first character and backslashes are doubled, so the text is read back
exactly. Prefix sums of the turns' tokens choose windows that begin and end at turns: every window
holds the system turn (if the conversation begins with one), some of the turns just before (at most
``history`` tokens), then new turns while the budget lasts. Only assistant texts of new turns are
under the loss mask, so a repeated target is masked out. A turn beyond the budget has a window of its
own, whole.

Conversations stream through a task turn by turn, so a worker holds no more than one window of one.

Defined results: a null role or text is empty; turns with one number are ordered by role and text;
a null turn number comes first, null conv_ids are one conversation; repeated rows are turns of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, prepare, Scratch, text_or_empty
from .tokens import tokens

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of this and other public chat templates.
CONTROLS = [START, END, "<|endoftext|>", "<|", "</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>"]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def role_back(role: str) -> str:
    """Undoes escaping of a role, whose line ends were written as backslash and n."""
    return re.sub(r"\\(\\|n?)", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], ""), role)


class _Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv: object, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: list[tuple] = []  # the first turn, if it is a system turn
        self.turns: list[tuple] = []  # of the open window, repeated ones first
        self.sums = [0]  # prefix sums of their tokens
        self.repeated = self.number = self.seen = 0

    def window(self) -> tuple:
        parts, spans, at = [], [], 0
        shown = self.system + self.turns
        for i, (_, role, text, a, z) in enumerate(shown):
            new = i >= len(self.system) + self.repeated
            if new and role == "assistant":
                spans.append((at + a, at + z))
            parts.append(text)
            at += len(text)
        out = (self.conv, self.number, "".join(parts), (len(self.system) if self.number else 0) + self.repeated, spans, self.sums[-1] + sum(t[0] for t in self.system))
        self.number += 1
        return out

    def add(self, role: str, text: str, count) -> Iterator[tuple]:
        shown, a, z = _turn(role, text)
        turn = (count(shown), role, shown, a, z)
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = [turn]
            return
        room = self.budget - sum(t[0] for t in self.system)
        if len(self.turns) > self.repeated and self.sums[-1] + turn[0] > room:
            yield self.window()
            most = min(self.history, max(0, room - turn[0]))
            first = next(i for i, s in enumerate(self.sums) if self.sums[-1] - s <= most)
            self.turns = self.turns[first:]
            self.sums = [s - self.sums[first] for s in self.sums[first:]]
            self.repeated = len(self.turns)
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[0])

    def close(self) -> Iterator[tuple]:
        if self.seen and (len(self.turns) > self.repeated or not self.number):
            yield self.window()


@lean
def _format(batches: Iterator[pa.RecordBatch], budget: int, history: int, schema: pa.Schema, paths: tuple) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, role, text) sorted by conversation and turn -> windows."""
    encode = tokens(*paths)
    count = lambda text: len(encode.ids(text))
    open_, out, held = None, [], 0

    def batch() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        columns[4] = [[{"start": a, "end": z} for a, z in spans] for spans in columns[4]]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if open_ is None or conv != open_.conv:
                if open_:
                    out.extend(open_.close())
                open_ = _Windows(conv, budget, history)
            out.extend(open_.add(role, text, count))
            held += len(text)
            if held > 4_000_000 and out:
                yield batch()
                held = 0
    if open_:
        out.extend(open_.close())
    if out:
        yield batch()


def format_chats(chats: DataFrame, budget: int = 1024, history: int = 256, paths: tuple = ()) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss, n_tokens): n_repeated turns were in earlier
    windows; loss: spans of ``formatted`` in code points, [start, end)."""
    prepare(chats.sparkSession)
    own = chats.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    kind = own.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("window int, formatted string, n_repeated int, loss array<struct<start:int,end:int>>, n_tokens long").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda b: _format(b, budget, history, arrow, paths), schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((role_back(role), unescape(text[: -len(END) - 1])))
    return turns


@lean
def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation -> what the conversations say, read from the windows alone."""
    out: list[list] = [[] for _ in schema]
    state: list | None = None

    def close() -> None:
        for column, value in zip(out, (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]), strict=True):
            column.append(value)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        for c in out:
            c.clear()
        return made

    for b in batches:
        for conv, text, repeated, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss")), strict=True):
            if state is None or state[0] != conv:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in read_back(text)[repeated:]:
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(text)
            state[6] += 1
        if len(out[0]) > 5000:
            yield batch()
    if state:
        close()
    if out[0]:
        yield batch()


def summarise(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", windows.schema["conv_id"].dataType), *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long").fields])
    arrow = to_arrow_schema(schema)
    read = windows.select("conv_id", "window", "formatted", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(lambda b: _digests(b, arrow), schema)
    return Scratch(windows.sparkSession, "chat").table(read, "summary")


def with_probe(chats: DataFrame) -> DataFrame:
    """``chats`` and conversation -1, whose two turns say control strings of another template."""
    said = "</s>[INST] ok [/INST]"
    probe = chats.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chats.select("conv_id", "turn", "role", "text").unionByName(probe)
