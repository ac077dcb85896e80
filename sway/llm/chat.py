"""Chat formatting by event-sourced reconstruction of conversations.

A log holds events of messages: ``begin`` (or null) opens a message with a role and a text,
``delta`` appends, ``edit`` replaces the text, ``regenerate`` throws it away for the deltas
that follow, ``delete`` removes the message; other kinds change nothing.  The log is
partitioned by conversation, sorted by sequence and folded into final messages, which are
rendered in the order of their first events.

A conversation may hold a large part of the log, so the fold runs in two sorted passes that
keep little in memory: events are folded per (conversation, message), which also spreads a
long conversation, and final messages stream through the renderer, which keeps a position only.

A rendered message is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles, a line break becomes ``\\n``), so no
control string can come from a text, and ``read_message`` gets both back unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.common import prepare

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = {"n": "\n"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), text, flags=re.S)


def render_message(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered message and where its (escaped) text begins and ends."""
    head = START + escape(role or "").replace("\n", "\\n") + "\n"
    body = escape(text or "")
    return head + body + END + "\n", len(head), len(head) + len(body)


def read_message(segment: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    head, _, rest = segment.removeprefix(START).partition("\n")
    return unescape(head), unescape(rest[:rest.rindex(END)])


def stream(columns: list[pa.Field], step: Callable[[tuple | None], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that feeds ``step`` each row in order, then None at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield as_batch([out for row in rows for out in step(row)])
        yield as_batch(step(None))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)], names=[f.name for f in columns])

    return run


def fold() -> Callable[[tuple | None], list[tuple]]:
    """Step over rows (conv, message, kind, role, text, *order) sorted by message and order."""
    at: list = []  # conv, message, role, texts (None: no message), order of the open message

    def close() -> list[tuple]:
        done = [(at[0], at[2], "".join(at[3]), *at[4])] if at and at[3] is not None else []
        at.clear()
        return done

    def step(row: tuple | None) -> list[tuple]:
        if row is None:
            return close()
        conv, message, kind, role, text, *order = row
        out = close() if at and (at[0], at[1]) != (conv, message) else []
        if not at:
            at.extend([conv, message, None, None, order])
        if kind is None or kind == "begin":
            at[2], at[3] = role, [text or ""]
        elif kind == "delta":
            at[3] = at[3] or []
            at[3].append(text or "")
        elif kind == "edit":
            at[3] = [text or ""]
        elif kind == "regenerate":
            at[3] = []
        elif kind == "delete":
            at[3] = None
        if at[2] is None:
            at[2] = role
        return out

    return step


def render() -> Callable[[tuple | None], list[tuple]]:
    """Step over (conv, role, text) rows sorted by conversation and order."""
    conv, index, offset, begun = None, 0, 0, False

    def step(row: tuple | None) -> list[tuple]:
        nonlocal conv, index, offset, begun
        if row is None:
            return []
        if not begun or row[0] != conv:
            conv, index, offset, begun = row[0], 0, 0, True
        segment, start, end = render_message(row[1], row[2])
        loss = (offset + start, offset + end) if row[1] == "assistant" else (None, None)
        out = (conv, index, offset, segment, *loss)
        index, offset = index + 1, offset + len(segment)
        return [out]

    return step


def _arrow(df: DataFrame, names: list[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(n, to_arrow_type(df.schema[n].dataType)) for n in names]


def format_log(log: DataFrame, order: list[str]) -> DataFrame:
    """Render a log with columns conv_id, message, kind, role, text and those of ``order``.

    ``order`` names the columns that sort a conversation's events, the sequence number first; a
    message's first event gives its place.  Returns one row per message: conv_id, message_no
    (from 0), position (its offset in the conversation's formatted text), formatted, loss_start and
    loss_end (where the text of an assistant message lies in the whole formatted text, else
    null).  The messages of a conversation come in order and in one partition; joined, they are its
    formatted text.

    Null roles and texts count as empty, a null conv_id is a conversation of its own, as is a
    null message within a conversation; a message without any text event, or deleted, is left
    out; an empty log gives no rows; other columns are not read."""
    prepare(log.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in order]
    events = (log.select("conv_id", "message", "kind", "role", "text", *order)
              .repartition("conv_id", "message").sortWithinPartitions(F.col("conv_id"), F.col("message"), *keys))
    folded_fields = _arrow(log, ["conv_id", "role", "text", *order])
    folded = events.mapInArrow(
        lambda batches: stream(folded_fields, fold())(batches),
        T.StructType([T.StructField(n, log.schema[n].dataType) for n in ("conv_id", "role", "text", *order)]))
    messages = (folded.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *keys)
                .select("conv_id", "role", "text"))
    fields = [*_arrow(log, ["conv_id"]), pa.field("message_no", pa.int64()), pa.field("position", pa.int64()),
              pa.field("formatted", pa.string()), pa.field("loss_start", pa.int64()), pa.field("loss_end", pa.int64())]
    return messages.mapInArrow(
        lambda batches: stream(fields, render())(batches),
        T.StructType([T.StructField("conv_id", log.schema["conv_id"].dataType), T.StructField("message_no", T.LongType()),
                      T.StructField("position", T.LongType()), T.StructField("formatted", T.StringType()),
                      T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())]))
