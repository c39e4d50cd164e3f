"""Chat formatting of typed content parts, and reading it back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cubewright.llm.common import batches_of, map_arrow

#: The template: each turn is HEAD, role, MIDDLE, content, TAIL. Inside contents the control
#: strings and the escape sign itself are escaped, so that they read back as they were.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
ESCAPE = "\\"
CONTROL = ("###", "</turn>", "<|")
#: Tokens that attachments expand to: an image's patches of so many pixels a side, tokens for a
#: second of audio and for a page of a document.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512

PART = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("width", "height", "seconds", "pages")]
)
_ATTACHMENT = [("kind", "string"), ("ref", "string"), ("start", "long"), ("tokens", "long")]
ATTACHMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in _ATTACHMENT]))
_ARROW_ATTACHMENTS = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in _ATTACHMENT]))

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE + ESCAPE)
    for c in CONTROL:
        text = text.replace(c, ESCAPE + c)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if ESCAPE in text else text


class PartVisitor:
    """Flattens typed parts, in order, into text with placeholders."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{(part['type'] or 'text').lower()}", self.visit_unknown)(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, kind: str, part: dict, tokens: float) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "start": self.length, "tokens": max(1, math.ceil(tokens))})
        self._add(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, (part["seconds"] or 0) * AUDIO_TOKENS)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"a part has the unknown type {part['type']!r}")


def text_part(text: Column) -> Column:
    """The parts of a turn that has text only."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), *[none.cast("double").alias(n) for n in ("width", "height", "seconds", "pages")])
    return F.array(part)


def format_chat(df: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment for each turn; a conversation's segments in order make its formatted text.

    parts: array of PART structs. Returns conv_col, position (of the turn, from 0), start (of the
    segment, in the conversation), segment, loss_start, loss_end (in the segment; equal where
    nothing is trained on), attachments (kind, ref, start of the placeholder in the segment,
    tokens it expands to) and expanded_tokens (of all attachments so far). Segments come sorted
    within partitions, each conversation in one.

    Turns go by turn_col, then role and content; null turns come first. Null roles and null or
    empty parts count as empty; a null conv_col is one conversation. A conversation streams: no
    more than an Arrow batch of it is held at a time. An empty table gives an empty result.
    """
    longs = ("position", "start", "loss_start", "loss_end", "expanded_tokens")
    schema = T.StructType(
        [df.schema[conv_col], T.StructField("segment", T.StringType()), *[T.StructField(n, T.LongType()) for n in longs], T.StructField("attachments", ATTACHMENTS)]
    )
    turns = df.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), parts.alias("p"))
    turns = turns.repartition("c").sortWithinPartitions("c", "t", "r", "p").select("c", "r", "p")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, start, tokens = object(), 0, 0, 0
        for b in batches_of(it, 1000):
            conv, rows = b.column(0).to_pylist(), []
            for c, role, got in zip(conv, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != now:
                    now, position, start, tokens = c, 0, 0, 0
                visitor = PartVisitor()
                for part in got or ():
                    visitor.visit(part)
                head = f"{HEAD}{escape(role).replace(':', ESCAPE + ':')}{MIDDLE}"
                content = "".join(visitor.out)
                for a in visitor.attachments:
                    a["start"] += len(head)
                    tokens += a["tokens"]
                segment = head + content + TAIL
                end = len(head) + (len(content) if role in loss_roles else 0)
                rows.append((segment, position, start, len(head), end, tokens, visitor.attachments))
                position += 1
                start += len(segment)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.string()), *[pa.array(x, pa.int64()) for x in cols[1:6]], pa.array(cols[6], _ARROW_ATTACHMENTS)], schema.names
            )

    return map_arrow(turns, run, schema)


def read_chat_digests(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: one row of counts and digests for each.

    segments must lie as format_chat leaves them, each conversation in order in one partition.
    Returns conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A segment
    that doesn't parse as one turn fails the task.
    """
    schema = T.StructType(
        [segments.schema[conv_col], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType())]
        + [T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None

        def close() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)

        conv_type = None
        for b in batches_of(it, 1000):
            conv_type, rows = b.column(0).type, []
            for c, segment, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or c != now:
                    if state is not None:
                        rows.append(close())
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = _TURN.fullmatch(segment)
                if m is None:
                    raise ValueError(f"not a turn: {segment[:80]!r}")
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                loss = unescape(segment[lo:hi])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(segment)
            yield batch(rows)
        if state is not None:
            yield batch([close()])

    return map_arrow(segments.select(conv_col, "segment", "loss_start", "loss_end"), run, schema)
