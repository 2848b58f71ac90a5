"""Chat formatting by event-sourced reconstruction (operator 6).

Logs are partitioned by conversation and sorted by turn and sequence. A fold turns messages, streamed
deltas, edits and regenerations into final messages, which are rendered one by one. All of it, and
reading the output back, streams over the sorted rows: at no time is a whole conversation held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: str) -> str:
    """Puts a backslash into every ``<|`` (and one more into ``<\\|``), so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: str, text: str) -> str:
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{START}{name}\n{escape(text)}{END}\n"


def parse(segment: str) -> tuple[str, str]:
    """The role and the text of one rendered message."""
    name, _, rest = segment[len(START) :].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
    return role, unescape(rest[: -len(END) - 1])


_EVENT = ("conv_id", "turn", "kind", "role", "text")


def formatted(events: DataFrame) -> DataFrame:
    """Rendered final messages ``(conv_id, turn, place, segment, trained)`` of ``events (conv_id, turn, seq, kind, role, text)``.

    Kinds: ``message`` begins a message with a role and a text; ``delta`` adds to the text of the turn's latest
    message, ``edit`` replaces it, ``regenerate`` empties it for the deltas that follow. Those three without a
    message before them in their turn begin one with their own role. Null roles and texts are empty; null
    ids and turns are values of their own and sort first. Events of one turn and sequence go by role and text.
    Within a partition the output stays sorted. An empty table gives an empty result.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, role, parts = 0, None, "", None
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, kind, by, text in zip(*(batch.column(c).to_pylist() for c in _EVENT), strict=True):
                if parts is not None and (kind == "message" or key != (conv, turn)):
                    out.append((*key, place, render(role, "".join(parts)), role == TRAINED))
                    place, parts = place + 1 if key[0] == conv else 0, None
                if parts is None:
                    key, role, parts = (conv, turn), by or "", []
                if kind in ("edit", "regenerate", "message"):
                    parts = []
                if kind != "regenerate" and text:
                    parts.append(text)
            yield _batch(out)
        if parts is not None:
            yield _batch([(*key, place, render(role, "".join(parts)), role == TRAINED)])

    rows = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    return rows.select(*_EVENT).mapInArrow(fold, "conv_id long, turn long, place long, segment string, trained boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "place", "segment", "trained"])


def digests(messages: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from what ``formatted`` returns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out: list[tuple] = []
            for conv, segment, trained in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "trained")), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        out.append(_digest(own))
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                own[1] += 1
                own[2].update(f"{role}\n{text}\n".encode())
                if trained:
                    own[3] += len(text)
                    own[4].update(text.encode())
                own[5] += len(segment)
            yield _digested(out)
        if own is not None:
            yield _digested([_digest(own)])

    return messages.mapInArrow(read, _DIGEST)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(own: list) -> tuple:
    return own[0], own[1], own[2].hexdigest(), own[3], own[4].hexdigest(), own[5]


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _DIGEST.split(", ")])


def conversation_events(turns: DataFrame) -> DataFrame:
    """A log with one ``message`` event for each row of ``turns (conv_id, turn, role, text)``, repeated rows kept."""
    return turns.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
