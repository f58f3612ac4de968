"""Stateful streams: the last-value gate, its ledger, and event-time windows. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.sources import stages

GATED = "source string, at timestamp, ord long, value string, kind string, previous string, signal_id string"


def signal_id(source: str, value: str) -> str:
    return hashlib.sha256(f"{source}\x1f{value}".encode()).hexdigest()[:16]


def _gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last seen value of a source is all its state: the first sight is a baseline, a different value a change.

    Polls of a source within one batch are put in order first; ``deltas`` holds sources whose polls are large.
    """
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["at", "ord"], kind="stable")
    kinds, before = [], []
    for value in rows["value"]:
        kinds.append("baseline" if last is None else "unchanged" if last == value else "changed")
        before.append(last)
        last = value
    state.update((last,))
    yield rows.assign(source=key[0], kind=kinds, previous=before, signal_id=[signal_id(key[0], v) for v in rows["value"]])[["source", "at", "ord", "value", "kind", "previous", "signal_id"]]


def last_value_gate(polls: DataFrame) -> DataFrame:
    """polls(source, at, ord, value) with kind, previous and signal_id, by keyed state. A restart goes on from the checkpoint."""
    return polls.groupBy("source").applyInPandasWithState(_gate, GATED, "last string", "append", GroupStateTimeout.NoTimeout)


def signal_ledger(gated: DataFrame) -> DataFrame:
    """Changes, each signal once however often it comes: the id follows from source and value."""
    return gated.filter("kind = 'changed'").dropDuplicates(["signal_id"])


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events a window and type; rows later than the watermark's delay are left out, and a window's state goes when it has passed."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def review_gate(findings: DataFrame, verdicts: DataFrame, wait: str = "3 days", late: str = "1 day") -> DataFrame:
    """Findings that wait for review, each told once: with the verdict of its own thread, or without one when the wait is over.

    findings(thread, finding, at), verdicts(thread, verdict, decided_at), as streams or tables alike. As a stream a finding is held in state
    until its verdict comes, and then goes on at once; a verdict that comes before it is held too. A verdict that was given before the
    finding, or later than ``wait`` after it, doesn't count, nor does one that arrives more than ``late`` after its time.
    """
    a = findings.withWatermark("at", late).select(F.col("thread"), "finding", "at")
    b = verdicts.withWatermark("decided_at", late).select(F.col("thread").alias("of_thread"), "verdict", "decided_at")
    same = (F.col("thread") == F.col("of_thread")) & (F.col("decided_at") >= F.col("at")) & (F.col("decided_at") <= F.col("at") + F.expr(f"INTERVAL {wait}"))
    return a.join(b, same, "left").select("thread", "finding", F.coalesce("verdict", F.lit("unreviewed")).alias("state"), "decided_at")


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """A table's files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(folder)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder, with the checkpoint that a later run goes on from.

    A complete result is written anew with every batch that changes it, and the last one counts.
    """
    spark, path = stream.sparkSession, stages.shared_path(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
