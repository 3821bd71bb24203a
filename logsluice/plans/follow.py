"""Follows declared sources into declared sinks, with cursors, rejects and counters.

Each source is a stream of its growing files. A micro-batch is a step: the lines that were left
open before and the new ones go through the same operators as in a batch run, and what is still
open at their end (a record without a next start, a buffer of unparseable lines) is kept as lines
for the next step. So a record is put together by slices and never by one task that reads a file,
and what is carried is the open end only.

A step writes everything under its own number: sink, rejects, open lines, cursors, log. One row in
the ledger of the source ends it. A step that is repeated finds its row and does nothing, or finds
none and replaces what the broken attempt left. A query that starts without its checkpoint goes
on from the cursors of the last step.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from logsluice.functions.regexes import to_java
from logsluice.operators.flow import DEFAULT_AGE_DAYS, age_cutoff, last_places
from logsluice.operators.quality import file_cursors, ingest_log, ingest_report
from logsluice.plans.run import MARKED, check_specs, merged_cursors, plan_lines, write_sink
from logsluice.session import configure
from logsluice.sinks.ledger import LEDGER, Ledger, open_folder, present
from logsluice.sources.logtail import stream_lines
from logsluice.sources.text import CURSOR_SCHEMA
from logsluice.spec import LineKey, RecordFormat, SinkSpec, SourceSpec
from logsluice.streaming.stateful import CONTINUATION_IDLE_MS

KEY = LineKey("file", "block_start", "byte_pos")
LINE_SCHEMA = "file string, block_start bigint, byte_pos bigint, line string"
LINE_COLUMNS = ("file", "block_start", "byte_pos", "line")
# Steps whose tables stay in the state folder.
KEPT_STEPS = 5
COUNTS = ("lines_read", "lines_parsed", "lines_rejected")


def open_record(lines: DataFrame, start: str, key: LineKey = KEY) -> tuple[DataFrame, DataFrame]:
    """(lines of closed records, lines of each file's last record, which may go on).

    The table that is broadcast has a row for each file of these lines, which the driver has listed.
    """
    begins = lines.filter(F.col("line").rlike(to_java(start)))
    last = last_places(begins, key).select(key.source, F.struct("_block", "_pos").alias("_open"))
    place = F.struct(F.col(key.block).alias("_block"), F.col(key.pos).alias("_pos"))
    marked = lines.join(F.broadcast(last), key.source, "left")
    later = F.col("_open").isNull() | (place >= F.col("_open"))
    return marked.filter(~later).drop("_open"), marked.filter(later).drop("_open")


@dataclass
class Step:
    """Where the tables of a step are, and what it counted: a row of the ledger."""

    number: int
    query: str = ""
    batch: int = -1
    open_lines: int = 0
    waiting: int = 0  # files that have not reached their cursor yet
    counts: dict = field(default_factory=dict)

    def row(self) -> dict:
        return {"number": self.number, "query": self.query, "batch": self.batch, "open_lines": self.open_lines, "waiting": self.waiting, **self.counts}

    @classmethod
    def of(cls, row: dict) -> Step:
        return cls(row["number"], row["query"], row["batch"], row["open_lines"], row["waiting"], {c: row[c] for c in COUNTS})


class Followed:
    """One source that is being followed."""

    def __init__(
        self,
        spark: SparkSession,
        spec: SourceSpec,
        sink: SinkSpec,
        state: str,
        rejects_path: str = "",
        age_days: int | None = DEFAULT_AGE_DAYS,
        ingest: datetime | Column | None = None,
        follow_version: bool = False,
        cursors: DataFrame | None = None,
    ):
        self.spark, self.spec, self.sink = spark, spec, sink
        self.state = f"{state.rstrip('/')}/{spec.name}"
        self.rejects_path, self.age_days, self.ingest = rejects_path, age_days, ingest
        self.follow_version, self.first_cursors = follow_version, cursors
        self.ledger = Ledger(f"{self.state}/{LEDGER}")
        self.lock = threading.RLock()
        self.query: StreamingQuery | None = None
        self.last_step = time.monotonic()

    @property
    def fmt(self) -> RecordFormat:
        return self.sink.record_format

    # -- state

    def path(self, table: str, number: int) -> str:
        return f"{self.state}/{table}/{number:012d}"

    def last(self) -> Step:
        names = self.ledger.names("step-")
        return Step.of(self.ledger.rows(names[-1])[0]) if names else Step(-1)

    def read(self, table: str, step: Step, schema: str) -> DataFrame:
        """A table of a step; empty before the first."""
        if step.number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table, step.number))

    def cursors(self) -> DataFrame:
        """file, last_event_ts, app_ver behind the last step."""
        return self.read("cursors", self.last(), CURSOR_SCHEMA)

    def counters(self) -> dict[str, int]:
        """Lines read, parsed and rejected in all steps so far."""
        steps = (self.ledger.rows(n)[0] for n in self.ledger.names("step-"))
        totals = dict.fromkeys(COUNTS, 0)
        for row in steps:
            for name in COUNTS:
                totals[name] += row[name]
        return totals

    # -- steps

    def on_batch(self, lines: DataFrame, batch_id: int) -> None:
        """The foreachBatch function."""
        query = lines.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        self.step(lines, query, batch_id)

    def step(self, lines: DataFrame | None, query: str, batch_id: int) -> None:
        """New lines through the run; without lines, what is open is closed."""
        with self.lock:
            before = self.last()
            if lines is not None and before.query == query and before.batch >= batch_id:
                return
            if lines is not None and before.query != query and before.open_lines:
                # The old query's open lines don't go on in a new one, which reads its files anew.
                self.flush()
                before = self.last()
            now = Step(before.number + 1, query, batch_id)
            self._carry_out(lines, before, now)
            self.ledger.put(f"step-{now.number:012d}", [now.row()])
            self._forget(now.number - KEPT_STEPS)
            self.last_step = time.monotonic()

    def _carry_out(self, new: DataFrame | None, before: Step, now: Step) -> None:
        lines = self.read("open", before, LINE_SCHEMA)
        if new is not None:
            taken = new.select(*LINE_COLUMNS).filter(F.col("line").isNotNull())
            lines = lines.unionByName(taken) if before.open_lines else taken
        # Read by several jobs: the source is asked once.
        lines = lines.persist()
        try:
            whole, opened = lines, []
            if self.spec.front_split_regex and new is not None:
                whole, last = open_record(lines, self.spec.front_split_regex)
                opened.append(last)
            plan = self._plan(whole, before, now, hold_open=new is not None)
            timed = plan.timed.persist()
            try:
                if plan.tail is not None:
                    # Records of a split are lines again, at the place of their first line.
                    opened.append(plan.tail.select(*LINE_COLUMNS))
                name = f"{self.spec.name}-{now.number:012d}"
                write_sink(self.spark, self.sink, plan.records, [plan.events], KEY, batch_id=name)
                if self.rejects_path:
                    plan.rejects.write.mode("overwrite").parquet(f"{self.rejects_path}/{name}")
                self._save(timed, opened, before, now)
            finally:
                timed.unpersist()
        finally:
            lines.unpersist()

    def _plan(self, whole: DataFrame, before: Step, now: Step, hold_open: bool):
        if self.follow_version:
            versions = self.read("cursors", before, CURSOR_SCHEMA).select("file", F.col("app_ver").alias("_known"))
            whole = whole.join(versions, "file", "left")
        return plan_lines(
            whole,
            self.spec,
            self.fmt,
            KEY,
            ingest=self.ingest,
            cutoff=None if self.age_days is None else age_cutoff(self.age_days),
            cursors=self.waiting(before, now),
            follow_version=self.follow_version,
            growing=True,
            hold_open=hold_open,
            known_version="_known" if self.follow_version else "",
        )

    def waiting(self, before: Step, now: Step) -> DataFrame | None:
        """Cursors of the files that have not reached theirs; None when there is none.

        The first step of a query starts from the cursors of the last one before it.
        """
        if before.number < 0:
            return self.first_cursors
        if before.query != now.query:
            return self.read("cursors", before, CURSOR_SCHEMA)
        return self.read("waiting", before, CURSOR_SCHEMA) if before.waiting else None

    def _save(self, timed: DataFrame, opened: Sequence[DataFrame], before: Step, now: Step) -> None:
        rest = self.spark.createDataFrame([], LINE_SCHEMA)
        for part in opened:
            rest = rest.unionByName(part)
        now.open_lines = self._put("open", now, rest)
        waiting, old = self.waiting(before, now), self.read("cursors", before, CURSOR_SCHEMA)
        if waiting is not None:
            now.waiting = self._put("waiting", now, waiting.join(timed.select("file"), "file", "left_anti"))
            old = merged_cursors(old, waiting)
        seen = file_cursors(timed, KEY)
        if self.follow_version:
            # Files with lines but no time keep their time and get the new version.
            versions = file_cursors(timed, KEY, time=MARKED).select("file", F.col("last_event_ts").alias("_version"))
            seen = versions.join(merged_cursors(seen, old), "file", "left").withColumn("app_ver", F.col("_version"))
        else:
            seen = seen.withColumn("app_ver", F.lit(self.spec.app_ver))
        self._put("cursors", now, merged_cursors(seen, old))
        totals = ingest_report(timed).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
        now.counts = {c: totals[c] for c in COUNTS}
        log = ingest_log(timed, self.sink.name, self.spec.name, F.current_timestamp())
        log.write.mode("overwrite").parquet(self.path("log", now.number))

    def _put(self, table: str, now: Step, rows: DataFrame) -> int:
        rows.write.mode("overwrite").parquet(self.path(table, now.number))
        return self.spark.read.schema(rows.schema).parquet(self.path(table, now.number)).count()

    def _forget(self, number: int) -> None:
        """Remove tables that no step needs any more; the log stays."""
        for table in ("open", "cursors", "waiting"):
            system, folder = open_folder(self.path(table, number))
            if number >= 0 and present(system, folder):
                system.delete_dir(folder)

    # -- running

    def start(self, checkpoint: str, every: str | None, max_bytes: int | None) -> Followed:
        spec = self.spec
        lines = stream_lines(self.spark, spec.path, spec.extension, spec.skip_to_end, max_bytes, drain=every is None)
        lines = lines.observe("ingest", F.count("line").alias("lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes"))
        writer = lines.writeStream.queryName(f"follow-{spec.name}").foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        return self

    def flush(self) -> None:
        """Close what is open, as if no line followed."""
        with self.lock:
            last = self.last()
            if last.open_lines:
                self.step(None, last.query, last.batch)

    def wait(self, seconds: float | None = None, idle_ms: int = CONTINUATION_IDLE_MS) -> None:
        """Wait for the end of the run, or for some seconds; what stays open for ``idle_ms`` is closed."""
        end = None if seconds is None else time.monotonic() + seconds
        while self.query.isActive and (end is None or time.monotonic() < end):
            self.query.awaitTermination(0.2)
            if (time.monotonic() - self.last_step) * 1000 >= idle_ms and self.lock.acquire(blocking=False):
                try:
                    self.flush()
                finally:
                    self.lock.release()
        if not self.query.isActive:
            if self.query.exception() is not None:
                raise self.query.exception()
            self.flush()

    def stop(self) -> None:
        self.query.stop()
        self.flush()


class IngestCounters(StreamingQueryListener):
    """Live counters of the followed sources by query name: batches, lines and bytes taken in."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.totals.setdefault(event.name, {"batches": 0, "lines": 0, "bytes": 0})

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("ingest")
        if seen is not None:
            own = self.totals.setdefault(event.progress.name, {"batches": 0, "lines": 0, "bytes": 0})
            own["batches"] += 1
            own["lines"] += seen["lines"]
            own["bytes"] += seen["bytes"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def follow_sources(
    spark: SparkSession,
    sources: Sequence[SourceSpec],
    sinks: Sequence[SinkSpec],
    state: str,
    rejects_path: str = "",
    every: str | None = None,
    age_days: int | None = DEFAULT_AGE_DAYS,
    max_bytes_per_trigger: int | None = None,
    **options,
) -> list[Followed]:
    """Start a query for each source. ``every`` is the trigger interval; None takes what is there and stops.

    ``state`` is a folder that outlives the driver and that it shares with the executors: it holds
    the checkpoints, open lines, cursors and logs. Events older than ``age_days`` are left out.
    """
    configure(spark)
    by_name = {s.name: s for s in sinks}
    check_specs(sources, by_name)
    started = []
    for spec in sources:
        followed = Followed(spark, spec, by_name[spec.sink], state, rejects_path, age_days, **options)
        started.append(followed.start(f"{state.rstrip('/')}/{spec.name}/checkpoint", every, max_bytes_per_trigger))
    return started
