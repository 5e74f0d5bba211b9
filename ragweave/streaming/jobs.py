"""Jobs of files and links as a stateful stream: progress, failure, retry, cancel, soft delete with a later purge.

A job's commands (id, at, number, kind, n) may come out of order within the watermark's delay. They wait in a list of
pending commands and are applied in order of (at, number) once the watermark has passed them, so the stream
gives what a replay of the whole log gives. The state of a job is one small row, the pending list holds what is younger
than the watermark, and a purge removes all of it; a timer at event time wakes a job for either.

Commands: ``submit`` (starts over), ``start`` with n chunks, ``progress`` of n chunks, ``fail``, ``retry`` (no progress,
another attempt), ``cancel`` and ``delete``. Progress, failure and cancelling act on a job that is under way; the
chunks of one that was cancelled, failed or deleted count for nothing. A deleted job takes no command until its
purge. A command for an unknown job does nothing unless it is ``submit``; unknown kinds, and rows without id or
time, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KINDS = ("submit", "start", "progress", "fail", "retry", "cancel", "delete")
#: States in which a job is under way.
OPEN = ("uploaded", "processing")
TRANSITION = "id string, at_us long, number long, status string, processed long, total long, attempt int"
STATE = "status string, processed long, total long, attempt int, purge_us long"
COMMAND = "at_us long, number long, kind string, n long"

Job = tuple[str, int, int, int, int]


def step(job: Job | None, kind: str, n: int, at_us: int, delay_us: int) -> Job | None:
    """The job (status, processed, total, attempt, purge time) after a command; None if there is none."""
    if kind == "submit" and (job is None or job[0] != "deleting"):
        return ("uploaded", 0, 0, 1, 0)
    if job is None or job[0] == "deleting":
        return job
    status, processed, total, attempt, _ = job
    if kind == "retry":
        return ("uploaded", 0, 0, attempt + 1, 0)
    if kind == "delete":
        return ("deleting", processed, total, attempt, at_us + delay_us)
    if status not in OPEN:
        return job
    if kind == "start":
        return ("processing", 0, n, attempt, 0)
    if kind == "progress" and status == "processing":
        processed = min(processed + n, total)
        return ("ingested" if processed >= total else "processing", processed, total, attempt, 0)
    if kind in ("fail", "cancel"):
        return ("error" if kind == "fail" else "canceled", processed, total, attempt, 0)
    return job


class JobMachine(StatefulProcessor):
    """Applies pending commands behind the watermark and gives a row for each change of a job."""

    def __init__(self, delay_seconds: int):
        self.delay_us = delay_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.pending = handle.getListState("pending", COMMAND)
        self.wake = handle.getValueState("wake", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        came = [(r.at_us, r.number, r.kind, r.n) for r in rows]
        if came:
            self.pending.appendList(came)  # one call to the store for all
            self._wake_at(min(came)[0] // 1000 + 1)
        return iter(())

    def _wake_at(self, ms: int) -> None:
        held = self.wake.get()[0] if self.wake.exists() else None
        if held is None or ms < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        self.wake.clear()
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        commands = sorted(tuple(x) for x in self.pending.get())
        ready, later = [c for c in commands if c[0] < passed_us], [c for c in commands if c[0] >= passed_us]
        job = tuple(self.job.get()) if self.job.exists() else None
        out = []
        for at_us, number, kind, n in ready:
            if job and job[0] == "deleting" and at_us >= job[4]:
                out.append((job[4], -1, ("purged", *job[1:])))
                job = None
            new = step(job, kind, n, at_us, self.delay_us)
            if new is not None and new != job:
                out.append((at_us, number, new))
            job = new
        if job and job[0] == "deleting" and job[4] < passed_us:
            out.append((job[4], -1, ("purged", *job[1:])))
            job = None
        self.job.clear() if job is None else self.job.update(job)
        self.pending.put(later) if later else self.pending.clear()
        times = [c[0] for c in later[:1]] + ([job[4]] if job and job[0] == "deleting" else [])
        if times:
            self._wake_at(min(times) // 1000 + 1)
        for at_us, number, (status, processed, total, attempt, _) in out:
            yield Row(id=key[0], at_us=at_us, number=number, status=status, processed=processed, total=total, attempt=attempt)

    def close(self) -> None:
        pass


def transitions(commands: DataFrame, late: str = "10 minutes", purge_after: int = 3) -> DataFrame:
    """A stream of (id, at_us, number, status, processed, total, attempt) for each change of a job of a stream of commands.

    ``commands``: id, at (timestamp), number (ties), kind, n. The session needs RocksDB as its state store.
    """
    known = commands.filter(F.col("kind").isin(*KINDS) & F.col("id").isNotNull() & F.col("at").isNotNull())
    rows = known.withWatermark("at", late).select(F.col("id").cast("string").alias("id"), "at", F.unix_micros("at").alias("at_us"), F.col("number").cast("long").alias("number"), "kind", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    return rows.groupBy("id").transformWithState(JobMachine(purge_after), TRANSITION, "Append", "EventTime")


class PermissionCache(StatefulProcessor):
    """A user's permission holds for a time; a request without one is to be asked for, once, and is then held."""

    def __init__(self, ttl_seconds: float):
        self.ttl_ms = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = self.held.exists()
        n = sum(1 for _ in rows)
        if not known:
            self.held.update((n,))
            yield Row(user_id=key[0], asked=True)

    def close(self) -> None:
        pass


def to_ask(requests: DataFrame, ttl_seconds: float) -> DataFrame:
    """A stream of the users (user_id) whose permission isn't held any more; what is asked for counts from now on."""
    rows = requests.filter("user_id is not null").select(F.col("user_id").cast("string").alias("user_id"))
    return rows.groupBy("user_id").transformWithState(PermissionCache(ttl_seconds), "user_id string, asked boolean", "Append", "ProcessingTime")
