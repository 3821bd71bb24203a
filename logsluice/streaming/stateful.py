"""Continuation lines and spanning records on a stream of growing files.

Input comes from ``stream_lines``: every line has its first byte (``byte_pos``) and the
first byte of the next line (``next_pos``), so neighbours are known by position. Rows reach
a stateful function in no promised order and are sorted by ``byte_pos`` inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logsluice.functions.regexes import to_java
from logsluice.operators.flow import MAX_BUFFERED_BYTES
from logsluice.operators.parsers import OK

# Idle times after which an open buffer is let go.
CONTINUATION_IDLE_MS = 30_000
RECORD_IDLE_MS = 1_000

FOLDED_SCHEMA = "file string, byte_pos bigint, log_line string, lines bigint, bytes bigint"
RECORD_SCHEMA = "file string, byte_pos bigint, part bigint, line string"


class _Open:
    """The buffer of one file: where it began, where it goes on, its text."""

    def __init__(self, state: GroupState):
        self.begin, self.next, self.size, self.count, self.part, self.text = (
            state.get if state.exists else (-1, -1, 0, 0, 0, "")
        )
        self.pieces = [self.text] if self.text else []

    def start(self, pos: int, part: int = 0) -> None:
        self.begin, self.size, self.count, self.part, self.pieces = pos, 0, 0, part, []

    def add(self, text: str, next_pos: int) -> None:
        self.pieces.append(text)
        self.size += len(text.encode("utf-8"))
        self.count += 1
        self.next = next_pos

    @property
    def full(self) -> bool:
        return self.count > 0

    def keep(self, state: GroupState, idle_ms: int) -> None:
        if self.full:
            state.update((self.begin, self.next, self.size, self.count, self.part, "".join(self.pieces)))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()


_STATE = "begin bigint, next bigint, size bigint, count bigint, part bigint, text string"


def _folded(name: str, buffer: _Open) -> pd.DataFrame:
    row = (name, buffer.begin, "".join(buffer.pieces), buffer.count, buffer.size)
    return pd.DataFrame([row], columns=["file", "byte_pos", "log_line", "lines", "bytes"])


def fold_continuations_stream(
    parsed: DataFrame, limit: int = MAX_BUFFERED_BYTES, idle_ms: int = CONTINUATION_IDLE_MS
) -> DataFrame:
    """Unparseable lines of a stream joined to one ``log_line``, as in ``fold_continuations``.

    Only unparseable lines are shuffled: two of them belong together when the second begins
    where the first ended. A buffer is let go when the next unparseable line is not its
    neighbour, when it has ``limit`` bytes, or after ``idle_ms`` without new lines.
    """
    bad = parsed.filter(~F.coalesce(F.col(OK), F.lit(False))).select("file", "byte_pos", "next_pos", "line")

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = _Open(state)
        if state.hasTimedOut:
            yield _folded(key[0], buffer)
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("byte_pos", kind="stable")
        done = []
        for pos, next_pos, line in zip(rows["byte_pos"], rows["next_pos"], rows["line"]):
            if line is None:  # the end of a drained file
                if buffer.full:
                    done.append(_folded(key[0], buffer))
                    buffer.start(-1)
                continue
            if buffer.full and (pos != buffer.next or buffer.size >= limit):
                done.append(_folded(key[0], buffer))
                buffer.start(int(pos))
            elif not buffer.full:
                buffer.start(int(pos))
            buffer.add(line + "\\n", int(next_pos))
        buffer.keep(state, idle_ms)
        if done:
            yield pd.concat(done)

    return bad.groupBy("file").applyInPandasWithState(
        fold, FOLDED_SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def split_records_stream(
    lines: DataFrame, start: str, idle_ms: int = RECORD_IDLE_MS, part_bytes: int | None = None
) -> DataFrame:
    """Records of a stream that begin where a line matches ``start``, as in ``split_records``.

    The last record of a file is let go when the next one starts or after ``idle_ms``.
    """
    rows = lines.select("file", "byte_pos", "next_pos", "line", F.col("line").rlike(to_java(start)).alias("starts"))

    def record(name: str, buffer: _Open) -> tuple:
        return (name, buffer.begin, buffer.part, "".join(buffer.pieces))

    def split(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = _Open(state)
        columns = ["file", "byte_pos", "part", "line"]
        if state.hasTimedOut:
            yield pd.DataFrame([record(key[0], buffer)], columns=columns)
            state.remove()
            return
        part = pd.concat(list(frames)).sort_values("byte_pos", kind="stable")
        done = []
        for pos, next_pos, line, starts in zip(part["byte_pos"], part["next_pos"], part["line"], part["starts"]):
            if line is None:  # the end of a drained file
                if buffer.full:
                    done.append(record(key[0], buffer))
                    buffer.start(-1)
                continue
            if starts and buffer.full:
                done.append(record(key[0], buffer))
                buffer.start(int(pos))
            elif buffer.full and part_bytes is not None and buffer.size >= part_bytes:
                done.append(record(key[0], buffer))
                buffer.start(int(pos), buffer.part + 1)
            elif not buffer.full:
                buffer.start(int(pos))
            buffer.add(line, int(next_pos))
        buffer.keep(state, idle_ms)
        if done:
            yield pd.DataFrame(done, columns=columns)

    return rows.groupBy("file").applyInPandasWithState(
        split, RECORD_SCHEMA, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
