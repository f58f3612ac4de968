"""Runs as jobs: a state machine for each job, with leases that expire.

Events (job, kind, at, worker) come in any order within the watermark's delay; they wait in state until it has passed them, so they are applied
in the order of ``at``, then of ``RANK``. A job is queued by ``submit``; ``lease`` gives it to a worker unless another one holds it, until ``LEASE``
after; ``heartbeat`` of that worker renews the lease; ``finish`` and ``fail`` of that worker end it as done or failed; ``cancel`` ends one that
hasn't ended. A lease that expires makes the job ``interrupted``: what its worker says after that, or at the same time, counts for
nothing, so an interrupted job never becomes done. It can be submitted again. Every change of state is passed on.
"""

from __future__ import annotations

import datetime
import itertools
import operator
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.streaming.deltas import PROVIDER

CHANGES = "job long, status string, at timestamp, worker string"
Change = Row(*[c.split()[0] for c in CHANGES.split(", ")])
LEASE = datetime.timedelta(minutes=90)
MILLISECOND, MICROSECOND = datetime.timedelta(milliseconds=1), datetime.timedelta(microseconds=1)
#: Jobs are kept on shelves by a hash, a shelf a key, since each visit to a key costs as much as some hundred jobs. A checkpoint holds to this number.
SHELVES = 1 << 10
#: Tables of a shelf: its jobs, and the events that wait, in the order in which they apply.
JOBS = pa.schema({"job": pa.int64(), "status": pa.string(), "worker": pa.string(), "until": pa.int64()})
WAITING = pa.schema({"job": pa.int64(), "at": pa.int64(), "rank": pa.int32(), "worker": pa.string()})
TOLD = pa.schema({"job": pa.int64(), "status": pa.string(), "at": pa.int64(), "worker": pa.string()})
#: From 2200 on, in microseconds, the clock of the watermark runs 1024 times slower, so all times have one that pandas can hold.
FAR = 7258118400 * 10**6
#: Of events at one time, in this order.
RANK = ("submit", "lease", "heartbeat", "finish", "fail", "cancel")
ENDED = ("done", "failed", "cancelled", "interrupted")


def after(state: tuple[str | None, str | None, int], kind: str, worker: str | None, at: int, lease: int) -> tuple[str | None, str | None, int]:
    """(status, worker, expiry) of a job after an event; unchanged for one that doesn't apply."""
    status, holder, until = state
    if kind == "submit":
        return ("queued", None, 0) if status is None or status == "interrupted" else state
    if kind == "lease":
        return ("running", worker, at + lease) if status == "queued" else state
    if kind == "cancel":
        return ("cancelled", holder, 0) if status in ("queued", "running") else state
    if status != "running" or worker != holder:
        return state
    if kind == "heartbeat":
        return (status, holder, at + lease)
    return ("done" if kind == "finish" else "failed", holder, 0)


def advanced(state: tuple[str | None, str | None, int], events: Iterable[tuple[int, int, str]], limit: int, lease: int) -> tuple[tuple[str | None, str | None, int], list[tuple[str, int, str | None]]]:
    """A job's state once all until limit is known, and its changes (status, at, worker) on the way; events (at, rank, worker) are in order."""
    told = []
    for at, rank, worker in (*events, (limit, len(RANK), "")):
        if state[0] == "running" and state[2] <= at:
            at_end, state = state[2], ("interrupted", state[1], 0)
            told.append(("interrupted", at_end, state[1]))
        if rank == len(RANK):
            break
        before, state = state, after(state, RANK[rank], worker or None, at, lease)
        if state[0] != before[0]:
            told.append((state[0], at, state[1]))
    return state, told


class JobStates(StatefulProcessor):
    """One job a key, for streams of few jobs whose states are to be looked up. It is one value, since each access is a round trip:
    its status, the next timer, and the few events that wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, worker string, expiry long, due long, waiting array<struct<at: long, rank: int, worker: string>>")

    def _load(self) -> tuple[tuple[str | None, str | None, int], int | None, set[tuple[int, int, str]]]:
        status, worker, expiry, due, waiting = self.job.get() or (None, None, 0, None, ())
        return (status, worker, expiry), due, {tuple(e) for e in waiting}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = {(row.millis, RANK.index(row.kind), row.worker or "") for row in rows if row.kind in RANK}
        if came:
            state, due, waiting = self._load()
            first = min(came)[0]
            if due is None or first < due:
                due = first
                self.handle.registerTimer(due)
            self.job.update((*state, due, sorted(waiting | came)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # nothing earlier can come any more
        state, due, waiting = self._load()
        state, told = advanced(state, sorted(e for e in waiting if e[0] <= limit), limit, LEASE // MILLISECOND)
        later = sorted(e for e in waiting if e[0] > limit)
        wake = min([*(e[0] for e in later[:1]), *([state[2]] if state[2] > limit else [])], default=None)
        if wake is not None and wake != due:
            self.handle.registerTimer(wake)
        self.job.update((*state, wake, later))
        return iter([Change(key[0], status, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), worker) for status, at, worker in told])

    def close(self) -> None:
        pass


def _clock(at: int) -> int:
    return min(at, FAR) + (max(at - FAR, 0) >> 10)


def _reached(clock: int) -> int:
    """The last time at which the clock shows this."""
    return clock if clock < FAR else FAR + ((clock - FAR) << 10) + 1023


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_numpy().tolist() for c in table.columns), strict=True)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table(list(zip(*rows, strict=True)), schema=schema) if rows else schema.empty_table()


def shelf_changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of a shelf's jobs that the watermark has decided; what is later waits, and the next of it, or the next end of a lease, wakes the shelf."""
    watermark = state.getCurrentWatermarkMs()
    limit, lease = _reached(watermark * 1000), LEASE // MICROSECOND
    jobs, waiting = (pa.ipc.open_stream(v).read_all() for v in state.get) if state.exists else (JOBS.empty_table(), WAITING.empty_table())
    came = (pa.table([b[c].to_numpy() for c in ("job", "micros", "rank", "worker")], schema=WAITING) for b in batches)
    waiting = pa.concat_tables([waiting, *(t.filter(pc.greater_equal(t["rank"], 0)) for t in came)])
    passed = pc.less_equal(waiting["at"], limit)
    due, later = waiting.filter(passed), waiting.filter(pc.invert(passed))
    over = jobs["job"].filter(pc.and_(pc.equal(jobs["status"], "running"), pc.less_equal(jobs["until"], limit)))
    due = pa.concat_tables([due, _columns([(job, limit, len(RANK), "") for job in over.to_pylist()], WAITING)]).sort_by([(c, "ascending") for c in WAITING.names])
    there = pc.is_in(jobs["job"], due["job"])
    states = {job: tuple(s) for job, *s in _rows(jobs.filter(there))}
    told = []
    for job, events in itertools.groupby(_rows(due), operator.itemgetter(0)):
        states[job], changes = advanced(states.get(job, (None, None, 0)), [e[1:] for e in events], limit, lease)
        told += [(job, *c) for c in changes]
    jobs = pa.concat_tables([jobs.filter(pc.invert(there)), _columns([(job, *s) for job, s in states.items()], JOBS)])
    state.update((_packed(jobs), _packed(later)))
    wake = pc.min(pa.chunked_array([*later["at"].chunks, *jobs["until"].filter(pc.equal(jobs["status"], "running")).chunks], pa.int64())).as_py()
    if wake is not None:
        state.setTimeoutTimestamp(max(_clock(wake) // 1000, watermark, 1))
    yield _columns(told if key[0] >= 0 else [(None, *t[1:]) for t in told], TOLD).to_pandas()


def job_changes(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events(job, kind, at, worker) as a stream, to changes of state. Jobs without a name are one, on a shelf of its own."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    micros = F.unix_micros("at")
    clock = F.timestamp_micros(F.greatest(F.lit(0), F.least(micros, F.lit(FAR)) + F.shiftright(F.greatest(micros - FAR, F.lit(0)), 10)))  # the watermark begins at 0
    shelf = F.when(F.col("job").isNull(), -1).otherwise(F.pmod(F.xxhash64("job"), F.lit(SHELVES))).cast("int")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, RANK)), F.col("kind")), F.lit(0)).cast("int") - 1
    # rows of other kinds go as far as the shelves: a filter would be put before the watermark, which they move
    rows = events.filter("at IS NOT NULL").select(shelf.alias("shelf"), F.coalesce("job", F.lit(0).cast("long")).alias("job"), micros.alias("micros"), rank.alias("rank"), F.coalesce("worker", F.lit("")).alias("worker"), clock.alias("clock")).withWatermark("clock", late)
    told = rows.groupBy("shelf").applyInPandasWithState(shelf_changes, "job long, status string, at long, worker string", "jobs binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("at", F.timestamp_micros("at"))
