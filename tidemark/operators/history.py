"""Change over runs: diff classes, resolution, partial refresh, streaks, decisions and precision. State is a table; a new state is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.functions import ladders as L


def diff_class(previous_state: Column, previous_severity: Column, severity: Column, previous_print: Column, print_: Column) -> Column:
    """new (never seen, or resolved before), worsened, improved, changed or unchanged against the state of the last run."""
    before, now = L.rank_of(previous_severity, K.SEVERITIES), L.rank_of(severity, K.SEVERITIES)
    return F.when(previous_state.isNull() | (previous_state == "resolved"), "new").when(now > before, "worsened").when(now < before, "improved").when(~previous_print.eqNullSafe(print_), "changed").otherwise("unchanged")


def classified(found: DataFrame, state: DataFrame) -> DataFrame:
    """found(finding_id, severity, fingerprint) with diff_class against state(finding_id, state, severity, fingerprint)."""
    old = state.select("finding_id", F.col("state").alias("__state"), F.col("severity").alias("__severity"), F.col("fingerprint").alias("__print"))
    out = found.join(old, "finding_id", "left")
    return out.withColumn("diff_class", diff_class(F.col("__state"), F.col("__severity"), F.col("severity"), F.col("__print"), F.col("fingerprint"))).drop("__state", "__severity", "__print")


def resolve_absent(open_: DataFrame, seen: DataFrame, examined: DataFrame, key: str = "finding_id", scope: str = "dep_id") -> DataFrame:
    """Open findings that this run didn't see, among dependencies that it examined: absence elsewhere says nothing."""
    return open_.join(seen.select(key).distinct(), key, "left_anti").join(examined.select(scope).distinct(), scope, "left_semi")


def merged_slice(previous: DataFrame, new: DataFrame, examined: DataFrame, key: str = "dep_id") -> DataFrame:
    """The examined slice replaced by its new rows, all else carried on; an examined key without a new row goes."""
    return previous.join(examined.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(previous: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("first_seen",)) -> DataFrame:
    """New rows win; columns in ``keep`` stay as first written; keys that aren't new stay as they are."""
    old = previous.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in previous.columns if c != key])
    both = new.withColumn("__new", F.lit(True)).join(old, new[key] == old["__key"], "full")
    pick = lambda c: F.coalesce(f"__{c}", c) if c in keep else F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}"))
    return both.select(F.coalesce(key, "__key").alias(key), *[pick(c).alias(c) for c in previous.columns if c != key])


def latest(rows: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The last row of each key by an order; an aggregate, so rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in rows.columns])


def streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each event with its run of failures so far: the events since the last success. A running count of successes numbers the runs."""
    w = W.partitionBy(key).orderBy(*order)
    rows = events.withColumn("failed", failed).withColumn("__run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inside = W.partitionBy(key, "__run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("streak", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(inside)).drop("__run")


def confirmed(status: Column, signals: Column, streak: Column, needed: int = K.CONFIRMING_RUNS) -> Column:
    """A broken status counts after enough runs in a row; a vendor's own declaration needs one."""
    declared = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in K.DECLARED]))
    return F.when(F.coalesce(declared, F.lit(False)), status).when((status == "broken") & (streak < needed), "inconclusive").otherwise(status)


def suppressed(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """found with held: whether the latest decision on the finding was a rejection on the very same evidence."""
    last = latest(decisions, ["finding_id"], "id").select("finding_id", F.col("verdict").alias("__verdict"), F.col("fingerprint").alias("__print"))
    out = found.join(last, "finding_id", "left")
    return out.withColumn("held", F.coalesce((F.col("__verdict") == "rejected") & (F.col("__print") == F.col("fingerprint")), F.lit(False))).drop("__verdict", "__print")


def precision(decisions: DataFrame, half: str | None = None) -> DataFrame:
    """decided, accepted, precision over the latest decisions, of one half of the findings if asked; null without any."""
    last = latest(decisions, ["finding_id"], "id")
    if half:
        last = last.filter(H.split_half(F.col("finding_id")) == half)
    accepted = F.count_if(F.col("verdict") == "accepted")
    return last.agg(F.count(F.lit(1)).alias("decided"), accepted.alias("accepted"), F.round(accepted / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1))), 3).alias("precision"))


def coverage(rows: DataFrame, stamp: str, as_of: Column, fresh_days: int) -> DataFrame:
    """fresh, stale and the oldest stamp."""
    age = F.datediff(as_of, F.to_date(stamp))
    return rows.agg(F.count_if(age <= fresh_days).alias("fresh"), F.count_if(age > fresh_days).alias("stale"), F.min(F.to_date(stamp)).alias("oldest"))


def watermark_signals(polls: DataFrame) -> DataFrame:
    """polls(source, at, value) with kind (baseline, unchanged, changed), previous value and signal_id: the last seen value is the gate.

    The id follows from source and new value alone, so a value that comes back gives the same signal and a ledger keeps it once.
    """
    w = W.partitionBy("source").orderBy("at")
    before = F.lag("value").over(w)
    kind = F.when(F.row_number().over(w) == 1, "baseline").when(before == F.col("value"), "unchanged").otherwise("changed")
    return polls.withColumn("kind", kind).withColumn("previous", before).withColumn("signal_id", H.short_id(F.col("source"), F.col("value")))


def ledger(signals: DataFrame) -> DataFrame:
    """Changes, each signal once, at its first time."""
    return signals.filter("kind = 'changed'").groupBy("signal_id").agg(F.min_by(F.struct("source", "at", "value"), F.col("at")).alias("s")).select("signal_id", "s.source", "s.at", "s.value")


def rotation(candidates: DataFrame, last: str, name: str, most: int) -> DataFrame:
    """The next slice of a rotation: never looked at first, then the longest ago, ties by name."""
    return candidates.orderBy(F.col(last).asc_nulls_first(), F.lower(name)).limit(most)


def kept_feedback(lines: DataFrame, keys: list[str], order: str, most: int = 40) -> DataFrame:
    """Distinct lines, each at its last time, the newest ``most`` of all; the bound is the feature: a prompt reads them."""
    last = lines.groupBy(*keys).agg(F.max(order).alias(order))
    return last.orderBy(F.col(order).desc(), *keys).limit(most)


def shown_feedback(lines: DataFrame, signal: str, order: str, most: int = 12) -> DataFrame:
    """Feedback for one signal: lines on that signal first, then others, newest first."""
    return lines.orderBy((F.col("signal") == signal).desc(), F.col(order).desc()).limit(most)
