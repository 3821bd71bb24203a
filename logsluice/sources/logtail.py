"""Streaming source for growing files, with byte positions.

``spark.readStream.format("logtail")`` follows files through appends, renames, truncation and
removal. The offset is a ledger of files: under the inode, the position read, a generation, the
bytes at the begin of the file and before the position. A file whose bytes there have changed
was truncated, or its inode belongs to another file now; it is a new generation and is read from
byte 0, however large it has grown. A rotated file is read to its end under its first name while
the new file at the old path starts anew. A removed file keeps its entry, so it goes on where it
stood when it comes back; what could not be read of it is lost, which ends the query only with
``failOnLoss``.

Only whole lines are taken: the end of a micro-batch is the last newline seen so far. A backlog
is cut into byte ranges, so one large file is read by many tasks, and ``maxBytesPerTrigger`` is
shared out evenly among the files that have one. With ``drain`` (for runs that end with their
input) the last batch takes all there is and closes each file with a row whose line is NULL. The
folder must be visible under the same path on the driver and on all executors.
"""

from __future__ import annotations

import glob
import logging
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "logtail"
SCHEMA = "file string, block_start bigint, byte_pos bigint, next_pos bigint, line string"
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("block_start", pa.int64()),
        ("byte_pos", pa.int64()),
        ("next_pos", pa.int64()),
        ("line", pa.string()),
    ]
)

RANGE_BYTES = 64 << 20
READ_BYTES = 8 << 20
LOOK_BACK_BYTES = 1 << 16


# Bytes at the begin of a file and before the position that tell whether it is still the same.
SEEN_BYTES = 64
# Entries of removed files that are kept, the last ones gone.
MAX_GONE = 10_000
DRAIN = "#drain"

log = logging.getLogger(__name__)


@dataclass
class ByteRange(InputPartition):
    """Lines that begin in [start, stop) of one file."""

    name: str  # first known path, the value of the file column
    path: str  # where it is now
    identity: str
    floor: int  # a line is known to begin here
    start: int
    stop: int
    end: int  # last newline + 1 of this micro-batch
    head: str = ""  # bytes at the begin of the file
    closes: bool = False  # a row without line ends the file

    def __post_init__(self) -> None:
        super().__init__(self.start)


def _identity(st: os.stat_result) -> str:
    return f"{st.st_dev}:{st.st_ino}"


def _bytes_at(path: str, start: int, stop: int) -> str:
    """Bytes [start, stop) as text of one character a byte; shorter where the file is."""
    with open(path, "rb") as f:
        f.seek(max(0, start))
        return f.read(max(0, stop - max(0, start))).decode("latin-1")


def _seen(path: str, pos: int) -> dict:
    """What is remembered of the content up to ``pos``."""
    return {"head": _bytes_at(path, 0, min(pos, SEEN_BYTES)), "tail": _bytes_at(path, pos - SEEN_BYTES, pos)}


def _same(path: str, entry: dict) -> bool:
    """True while the file holds what was read of it."""
    try:
        return _seen(path, entry["pos"]) == {"head": entry["head"], "tail": entry["tail"]}
    except FileNotFoundError:
        return False


def _last_line_end(path: str, low: int, high: int) -> int:
    """Position after the last newline in [low, high), or low."""
    with open(path, "rb") as f:
        while high > low:
            start = max(low, high - LOOK_BACK_BYTES)
            f.seek(start)
            at = f.read(high - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


class LogTailReader(DataSourceStreamReader):
    """Offsets: {inode: {"name", "path", "pos", "own", "gen", "head", "tail", "gone", "resumed"}}."""

    def __init__(self, options: dict):
        def option(name: str, default=None):
            return options.get(name.lower(), options.get(name, default))

        def flag(name: str) -> bool:
            return str(option(name, "false")).lower() == "true"

        self.pattern = options["path"]
        if os.path.isdir(self.pattern):
            self.pattern = os.path.join(self.pattern, "*")
        self.extension = options.get("extension", "").lstrip(".")
        self.skip_to_end, self.drain, self.fail_on_loss = flag("skipToEnd"), flag("drain"), flag("failOnLoss")
        self.range_bytes = int(option("rangeBytes", RANGE_BYTES))
        limit = option("maxBytesPerTrigger")
        self.max_bytes = int(limit) if limit and not self.drain else None
        self.known: dict[str, dict] = {}
        self.looked: dict[str, tuple] = {}  # inode -> size and time when its content was last checked
        self.resumed = True
        self.token = uuid.uuid4().hex

    def _wanted(self, path: str) -> bool:
        return not self.extension or os.path.splitext(path)[1] == "." + self.extension

    def _present(self) -> dict[str, tuple[str, os.stat_result, bool]]:
        """inode -> (path, size and times, matches the pattern) of the files in the watched folders."""
        found: dict[str, tuple[str, os.stat_result, bool]] = {}
        matched = {p for p in glob.glob(self.pattern) if self._wanted(p)}
        folders = {os.path.dirname(p) for p in matched} | {os.path.dirname(self.pattern)}
        for folder in folders:
            if glob.has_magic(folder) or not os.path.isdir(folder):
                continue
            with os.scandir(folder) as entries:
                for entry in entries:
                    try:
                        if entry.is_file():
                            st = entry.stat()
                            found[_identity(st)] = (entry.path, st, entry.path in matched)
                    except FileNotFoundError:  # removed since the folder was listed
                        continue
        return found

    def _new(self, path: str, own: bool, pos: int = 0, resumed: bool = False) -> dict:
        return {"name": path, "path": path, "pos": pos, "own": own, "gen": uuid.uuid4().hex[:12], "gone": False, "resumed": resumed, **_seen(path, pos)}

    def initialOffset(self) -> dict:
        self.resumed = False
        if not self.skip_to_end:
            return {}
        self.known = {
            ident: self._new(path, True, _last_line_end(path, 0, st.st_size))
            for ident, (path, st, matched) in self._present().items()
            if matched
        }
        return self.known

    def _current(self, ident: str, path: str, st: os.stat_result, matched: bool, resumed: bool) -> dict | None:
        """Entry of a file that is there, at the position read so far; None when it isn't ours."""
        entry = self.known.get(ident)
        if entry is None:
            return self._new(path, matched, 0, resumed) if matched or resumed else None
        look = (st.st_size, st.st_mtime_ns, entry["pos"])
        if st.st_size >= entry["pos"] and (self.looked.get(ident) == look or _same(path, entry)):
            self.looked[ident] = look
            return dict(entry, path=path, gone=False)
        # Truncated in place, or the inode belongs to another file.
        if entry["path"] != path and not matched:
            return None
        return dict(self._new(path, True), name=entry["name"] if entry["path"] == path else path)

    def latestOffset(self) -> dict:
        # A restarted query has not told its offsets yet. Its first batch therefore takes
        # every file of the folder, without a limit; partitions() drops what is not its own.
        resumed, self.resumed = self.resumed, False
        now: dict[str, dict] = {}
        sizes: dict[str, int] = {}
        for ident, (path, st, matched) in sorted(self._present().items(), key=lambda kv: kv[1][0]):
            try:
                entry = self._current(ident, path, st, matched, resumed)
            except FileNotFoundError:
                continue
            if entry is not None:
                now[ident], sizes[ident] = entry, st.st_size
        gone = {i: dict(e, gone=True) for i, e in self.known.items() if i not in now and i != DRAIN}
        taken = self._shares({i: sizes[i] - e["pos"] for i, e in now.items()}, None if resumed else self.max_bytes)
        for ident, entry in now.items():
            try:
                end = self._end(entry, entry["pos"] + taken[ident], sizes[ident])
                if end != entry["pos"]:
                    entry |= {"pos": end, **_seen(entry["path"], end)}
            except FileNotFoundError:
                entry["gone"] = True
        now |= dict(list(gone.items())[-MAX_GONE:])
        if self.drain:
            now[DRAIN] = {"token": self.token}
        self.known = now
        return now

    @staticmethod
    def _shares(waiting: dict[str, int], budget: int | None) -> dict[str, int]:
        """Bytes each file may give: small backlogs whole, the rest of the budget in even parts."""
        if budget is None:
            return waiting
        out: dict[str, int] = {}
        left = sorted((i for i in waiting if waiting[i] > 0), key=waiting.__getitem__)
        for n, ident in enumerate(left):
            out[ident] = min(waiting[ident], max(1, budget // (len(left) - n)))
            budget = max(0, budget - out[ident])
        return {i: out.get(i, 0) for i in waiting}

    def _end(self, entry: dict, high: int, size: int) -> int:
        """End of the last whole line up to ``high``, or of a line that is longer than its share."""
        end = _last_line_end(entry["path"], entry["pos"], high)
        if end == entry["pos"] and entry["pos"] < high < size:
            end = self._next_line_end(entry["path"], entry["pos"], size, end)
        return end

    @staticmethod
    def _next_line_end(path: str, low: int, high: int, default: int) -> int:
        """End of the line that is longer than a whole micro-batch may be."""
        with open(path, "rb") as f:
            f.seek(low)
            line = f.readline(high - low)
        return low + len(line) if line.endswith(b"\n") else default

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.resumed = False
        self.known = {}
        out: list[ByteRange] = []
        closing = DRAIN in end and end[DRAIN] != start.get(DRAIN)
        for ident, to in end.items():
            before = start.get(ident)
            if ident == DRAIN or (before is None and not to["own"]):
                continue
            same = before is not None and (before["gen"] == to["gen"] or (to["resumed"] and _same(to["path"], before)))
            name = before["name"] if same else to["name"]
            self.known[ident] = dict(to, name=name, own=True)
            low, high = before["pos"] if same else 0, to["pos"]
            if to["gone"] and not same:
                continue
            for at in range(low, high, self.range_bytes):
                out.append(ByteRange(name, to["path"], ident, low, at, min(at + self.range_bytes, high), high, to["head"]))
            if closing:
                out.append(ByteRange(name, to["path"], ident, high, high, high, high, to["head"], True))
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.closes:
            yield self._closing(partition)
            return
        pos = partition.start
        try:
            path = self._locate(partition)
            with open(path, "rb") as f:
                if pos > partition.floor:  # the line that spans the border belongs to the range before
                    f.seek(pos - 1)
                    skipped = f.readline()
                    pos = pos - 1 + len(skipped)
                f.seek(pos)
                while pos < partition.stop:
                    chunk = f.read(min(READ_BYTES, partition.stop - pos))
                    if chunk and not chunk.endswith(b"\n"):
                        chunk += f.readline(partition.end - pos - len(chunk)) if pos + len(chunk) < partition.end else b""
                    if not chunk:
                        raise FileNotFoundError(f"{path}: file ends before byte {partition.stop}")
                    yield self._batch(partition, pos, chunk)
                    pos += len(chunk)
        except FileNotFoundError as lost:
            if self.fail_on_loss:
                raise
            log.warning("%s: bytes %d to %d are lost: %s", partition.name, pos, partition.stop, lost)

    @staticmethod
    def _locate(partition: ByteRange) -> str:
        """Path of the file now: it may have been renamed since the offsets were taken."""

        def here(path: str) -> bool:
            try:
                known = len(partition.head)
                return _identity(os.stat(path)) == partition.identity and _bytes_at(path, 0, known) == partition.head
            except FileNotFoundError:
                return False

        if here(partition.path):
            return partition.path
        with os.scandir(os.path.dirname(partition.path)) as entries:
            for path in [e.path for e in entries if e.is_file()]:
                if here(path):
                    return path
        raise FileNotFoundError(f"{partition.name}: the file with identity {partition.identity} is gone")

    @staticmethod
    def _closing(partition: ByteRange) -> pa.RecordBatch:
        values = [partition.name, partition.start, partition.end, partition.end, None]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)

    @staticmethod
    def _batch(partition: ByteRange, pos: int, chunk: bytes) -> pa.RecordBatch:
        raw = chunk.split(b"\n")
        if raw[-1] == b"":
            raw.pop()
        begins, at = [], pos
        for piece in raw:
            begins.append(at)
            at += len(piece) + 1
        n = len(raw)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.name] * n, pa.string()),
                pa.array([partition.start] * n, pa.int64()),
                pa.array(begins, pa.int64()),
                pa.array(begins[1:] + [at], pa.int64()),
                pa.array([piece.decode("utf-8", "replace") for piece in raw], pa.string()),
            ],
            schema=_ARROW,
        )


class LogTailSource(DataSource):
    """Data source registered as "logtail"."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def stream_lines(
    spark: SparkSession,
    path: str,
    extension: str = "",
    skip_to_end: bool = False,
    max_bytes_per_trigger: int | None = None,
    range_bytes: int = RANGE_BYTES,
    drain: bool = False,
    fail_on_loss: bool = False,
) -> DataFrame:
    """Follow growing files: file, block_start, byte_pos, next_pos, line.

    With ``drain`` the last batch of a run that ends with its input closes each file with a row
    whose line is NULL, on which the stateful operators give out what they hold.
    """
    spark.dataSource.register(LogTailSource)
    reader = (
        spark.readStream.format(FORMAT)
        .option("path", path)
        .option("extension", extension)
        .option("skipToEnd", str(skip_to_end).lower())
        .option("rangeBytes", range_bytes)
        .option("drain", str(drain).lower())
        .option("failOnLoss", str(fail_on_loss).lower())
    )
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load()
