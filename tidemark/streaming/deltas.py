"""What a changed watermark carries: the rows that are new in a source's set, by keyed state.

A poll of a source is its whole set of (id, status) rows, stamped with the poll's number and how many rows it has. The state of a source
is a map from id to the status last seen and the poll that saw it, one entry a row, kept by the state store and never gathered; a row that
is new or has another status is passed on at once. When all rows of a poll are there, what the poll didn't see is taken out, and the poll
is told: ``baseline`` for the first one, which passes no rows on, else ``unchanged`` or ``changed``, with the numbers of rows added (new
or with another status) and removed.

A source's polls come one after another; a batch may hold part of one. Rows of a poll that a later one has overtaken are dropped. A poll
that stays incomplete takes nothing out, and isn't told. A row that comes twice in a poll counts twice and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

DELTAS = "source string, poll long, kind string, id string, status string, n_added long, n_removed long"
Delta = Row(*[c.split()[0] for c in DELTAS.split(", ")])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SetDelta(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "status string, poll long")
        self.head = handle.getValueState("head", "poll long, rows long, added long, first boolean, met long, size long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        source = key[0]
        # met: entries that this poll has seen, of size that there are; only if some are left is the map gone through
        poll, n, added, first, met, size = self.head.get() or (None, 0, 0, True, 0, 0)
        for row in rows:
            if poll is not None and row.poll < poll:
                continue
            if row.poll != poll:
                poll, n, added, first, met = row.poll, 0, 0, poll is None, 0
            n += 1
            before = self.seen.getValue((row.id,))
            size += before is None
            met += before is None or before[1] != poll
            if before is None or before[0] != row.status:
                added += 1
                if not first:
                    yield Delta(source, poll, "added", row.id, row.status, None, None)
            if before is None or tuple(before) != (row.status, poll):
                self.seen.updateValue((row.id,), (row.status, poll))
            if n == row.rows:
                gone = 0
                for (name,), (_, last) in self.seen.iterator() if met < size else ():
                    if last < poll:
                        self.seen.removeKey((name,))
                        gone += 1
                size -= gone
                kind = "baseline" if first else "changed" if added or gone else "unchanged"
                yield Delta(source, poll, kind, None, None, added, gone)
        self.head.update((poll, n, added, first, met, size))

    def close(self) -> None:
        pass


def set_deltas(polls: DataFrame) -> DataFrame:
    """polls(source, poll, rows, id, status) as a stream, to rows that are added and one row for each poll."""
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return polls.groupBy("source").transformWithState(SetDelta(), DELTAS, "Append", "None")
