"""One job in flight for each file, as keyed state of a stream.

Events are submissions and ends of jobs. A submission of a file that is idle is claimed
at once, any other waits; the end of the running job, or its time limit, clears the
state and claims the next waiting one. State is one running job and the waiting list
for each file. Time limits pass with the file's next event or, for a file that stays
silent, with a timer once the watermark is beyond the limit; both say the same.

Events of one file come in order of time; one that is older than what its file has
seen counts at the newest time seen.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Longest time that a job may run.
LIMIT_SECONDS = 1800
CLAIMS = "pdf_filename string, job_id string, event string, at long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Walk:
    """The queue of one file; times are whole microseconds. ``out`` gets (job, event, time)."""

    def __init__(self, running: str | None, since: int, seen: int, waiting: list[str], limit: int):
        self.running, self.since, self.seen, self.limit = running, since, seen, limit
        self.waiting, self.known = deque(waiting), set(waiting)
        self.out: list[tuple[str, str, int]] = []

    def claim(self, job: str, at: int) -> None:
        self.running, self.since = job, at
        self.out.append((job, "CLAIMED", at))

    def clear(self, event: str, at: int) -> None:
        self.out.append((self.running, event, at))
        self.running = None
        if self.waiting:
            job = self.waiting.popleft()
            self.known.remove(job)
            self.claim(job, at)

    def expire(self, now: int, but: str | None = None) -> None:
        """Time limits up to ``now``, one after the other; job ``but`` may still end at its limit."""
        while self.running is not None and self.since + self.limit <= now:
            if self.running == but and now == self.since + self.limit:
                return
            self.clear("TIMED_OUT", self.since + self.limit)

    def submitted(self, job: str) -> None:
        if self.running is None:
            self.claim(job, self.seen)
        elif job != self.running and job not in self.known:
            self.waiting.append(job)
            self.known.add(job)

    def take(self, kind: str, job: str, at: int) -> None:
        self.seen = max(self.seen, at)
        self.expire(self.seen, job if kind == "END" else None)
        if kind == "END" and job is not None and job == self.running:
            self.clear("ENDED", self.seen)
        elif kind == "SUBMIT":
            self.submitted(job)


class InFlight(StatefulProcessor):
    def __init__(self, limit_seconds: int = LIMIT_SECONDS):
        self.limit = limit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "running string, since long, seen long")
        self.waiting = handle.getListState("waiting", "job_id string")

    def _load(self) -> Walk:
        running, since, seen = self.now.get() if self.now.exists() else (None, 0, 0)
        return Walk(running, since, seen, [r[0] for r in self.waiting.get()], self.limit)

    def _save(self, key, walk: Walk) -> Iterator[pd.DataFrame]:
        self.now.update((walk.running, walk.since, walk.seen))
        self.waiting.clear()
        if walk.waiting:
            self.waiting.put([(job,) for job in walk.waiting])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if walk.running is not None:
            self.handle.registerTimer((walk.since + self.limit) // 1000)
        if walk.out:
            yield pd.DataFrame([(key[0], *o) for o in walk.out], columns=["pdf_filename", "job_id", "event", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        walk = self._load()
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        for kind, job, at in zip(events["kind"], events["job_id"], events["at"], strict=True):
            walk.take(kind, job, int(at))
        yield from self._save(key, walk)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        walk = self._load()
        walk.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999)
        yield from self._save(key, walk)

    def close(self) -> None:
        pass


def claims(events: DataFrame, limit_seconds: int = LIMIT_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Claims, ends and time-outs (pdf_filename, job_id, event, at in microseconds) of a stream.

    ``events``: ts, pdf_filename, job_id, kind (SUBMIT, END, or TICK for the time alone), seq (order of events of one time).
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    timed = events.withWatermark("ts", lateness).select("ts", "pdf_filename", "job_id", "kind", "seq", F.unix_micros("ts").alias("at"))
    return timed.groupBy("pdf_filename").transformWithStateInPandas(
        statefulProcessor=InFlight(limit_seconds), outputStructType=CLAIMS, outputMode="append", timeMode="eventTime"
    )


def finished(jobs: DataFrame, limit_seconds: int = LIMIT_SECONDS) -> DataFrame:
    """Submissions, and the ends that workers report if one job of a file runs at a time.

    A job that is taken up at ``max(submitted, end before)`` and runs for its time ends
    at the sum of run times so far plus the greatest lead of a submission over the sum
    before it. ``jobs``: job_id, pdf_filename, submitted_at, seq, seconds (null: never ends).
    """
    took = F.least(F.coalesce(F.col("seconds"), F.lit(limit_seconds)), F.lit(limit_seconds)).cast("long") * 1_000_000
    order = Window.partitionBy("pdf_filename").orderBy("submitted_at", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    timed = jobs.withColumns({"took": took, "k": F.row_number().over(order), "total": F.sum(took).over(so_far)})
    timed = timed.withColumn("end", F.col("total") + F.max(F.unix_micros("submitted_at") - (F.col("total") - F.col("took"))).over(so_far))
    submits = timed.select(F.col("submitted_at").alias("ts"), "pdf_filename", "job_id", F.lit("SUBMIT").alias("kind"), (F.col("k") * 2).alias("seq"))
    ends = timed.where(F.col("seconds") < limit_seconds).select(F.timestamp_micros("end").alias("ts"), "pdf_filename", "job_id", F.lit("END").alias("kind"), (F.col("k") * 2 + 1).alias("seq"))
    return submits.unionByName(ends)
