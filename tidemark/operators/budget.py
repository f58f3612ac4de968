"""The day's budget of calls and spend, and the cache of replies, over a log of calls.

A call whose reply is cached is free: one that an earlier day kept (``cached``), or whose key was paid for earlier on the day. Any other call
is paid while the day has had fewer than ``max_calls`` paid calls and has spent less than ``max_spend``; the call that passes the limit
is the last one paid. From then on a day refuses what isn't cached, so the paid calls are those first calls of a key that come
before the point where the running sums reach a limit, and that point follows from two-level prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import prefix_sums


def ledger(calls: DataFrame, cached: DataFrame, max_calls: int, max_spend: int) -> DataFrame:
    """call_id, day, outcome (paid, cached, refused), charged, and what the day had spent before.

    calls(call_id, day, at, key, cost) with costs in whole units and call_id distinct; cached(key): replies kept before the first of the days.
    A key asked on several of the days is cached on the later ones only by ``cached``: run a day at a time, or name the day in the key.
    """
    kept = cached.select("key").distinct().withColumn("kept", F.lit(True))
    place = F.struct("at", "call_id")
    first = calls.groupBy("day", "key").agg(F.min(place).alias("first"))
    rows = calls.join(first, ["day", "key"]).join(kept, "key", "left")
    opening = F.col("kept").isNull() & (place == F.col("first"))
    asked = prefix_sums(rows.withColumn("opening", opening), [F.col("at"), F.col("call_id")], {"calls_before": F.col("opening").cast("int"), "spent_before": F.when(F.col("opening"), F.col("cost"))}, ["day"])
    # sums over all first calls: right up to the limit, and beyond it the day refuses anyway
    open_yet = (F.col("calls_before") < max_calls) & (F.col("spent_before") < max_spend)
    paid = asked.filter(F.col("opening") & open_yet).select("day", "key", F.lit(True).alias("bought"))
    known = asked.join(paid, ["day", "key"], "left")
    outcome = F.when(F.col("kept").isNotNull() | (F.col("bought") & ~F.col("opening")), "cached").when(F.col("opening") & F.col("bought"), "paid").otherwise("refused")
    return known.select("call_id", "day", outcome.alias("outcome"), F.when(outcome == "paid", F.col("cost")).otherwise(0).alias("charged"), "spent_before")


def days(rows: DataFrame) -> DataFrame:
    """day, calls, spent, cached, refused of a ledger."""
    return rows.groupBy("day").agg(F.count_if(F.col("outcome") == "paid").alias("calls"), F.sum("charged").alias("spent"), F.count_if(F.col("outcome") == "cached").alias("cached"), F.count_if(F.col("outcome") == "refused").alias("refused"))
