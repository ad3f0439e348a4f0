"""Prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it as context, and its
reply as the only trainable text. A conversation whose last turn is not an assistant's gets one
more example that holds all its turns and trains nothing, so that no turn is lost.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is put
between ``<`` and ``|``, after those that stand there already, so ``<|`` occurs in
markers only and the reverse takes one away. A role's line feeds and backslashes are written as
``\\n`` and ``\\\\``.

Rows of a conversation are brought together and sorted by (turn, role, text), missing turns
first; missing roles and texts are empty. Rows without a conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"
READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_OPEN = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_BACK = re.compile(r"\\([\\n])")


class Example(NamedTuple):
    conv_id: int | None
    example: int
    text: str
    loss_start: int
    loss_end: int


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def turns_of(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def expand(conv_id, turns: Iterator[tuple[str, str]]) -> Iterator[Example]:
    """The examples of one conversation, in order."""
    written, length, number, trained = [], 0, 0, True
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        written.append(f"{head}{body}{END}\n")
        begin = length + len(head)
        length += len(written[-1])
        trained = role == ASSISTANT
        if trained:
            written = ["".join(written)]
            yield Example(conv_id, number, written[0], begin, begin + len(body))
            number += 1
    if not trained:
        yield Example(conv_id, number, "".join(written), 0, 0)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
    """Rows come sorted by conversation; one conversation is held at a time."""
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3))))
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        yield from expand(conv_id, ((role, text) for _, role, text in own))


def _arrow(rows: Iterator[tuple], schema: str, chars: int = 8_000_000, size=lambda r: 200) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    held: list[tuple] = []
    n = 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in held], kinds[kind]) for k, (_, kind) in enumerate(fields)],
            names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        n += size(row)
        if n >= chars:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _read_back(examples: Iterator[Example]) -> Iterator[tuple]:
    """What the formatted examples of each conversation say."""
    for conv_id, own in groupby(examples, key=lambda e: e.conv_id):
        loss, loss_chars, chars, last = hashlib.sha256(), 0, 0, ""
        for e in own:
            reply = unescape(e.text[e.loss_start : e.loss_end])
            loss.update(reply.encode())
            loss_chars += len(reply)
            chars += len(e.text)
            last = e.text
        turns = turns_of(last)
        whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        yield conv_id, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars


def _by_conversation(conversations: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "turn",
    ).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: one row per example."""
    return _by_conversation(conversations).mapInArrow(
        lambda batches: _arrow(_examples(batches), EXAMPLES, size=lambda e: len(e.text) + 100), EXAMPLES)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted examples."""
    return _by_conversation(conversations).mapInArrow(
        lambda batches: _arrow(_read_back(_examples(batches)), READ), READ)
