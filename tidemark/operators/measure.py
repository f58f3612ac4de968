"""Measures of the engine and of models beside it: suites against thresholds, costs of replies, agreement between and within providers,
and when each fetch of a plan may happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as K
from tidemark.functions import ladders as L
from tidemark.functions import net as N
from tidemark.functions import text as T


def suite_rates(cases: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """suite, cases, passed, rate, needed, met of cases(suite, ok). suites(suite): those that count even without a case, whose rate is 1."""
    out = cases.groupBy("suite").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"))
    if suites is not None:
        out = suites.select("suite").distinct().join(out, "suite", "left").na.fill(0, ["cases", "passed"])
    needed = F.coalesce(L.lookup(K.SUITE_THRESHOLDS, F.col("suite")), F.lit(1.0))
    rate = F.when(F.col("cases") > 0, F.col("passed") / F.col("cases")).otherwise(1.0)
    return out.select("suite", "cases", "passed", F.round(rate, 3).alias("rate"), needed.alias("needed"), (rate >= needed).alias("met"))


def costed(replies: DataFrame, prices: DataFrame) -> DataFrame:
    """replies(model, tokens_in, tokens_out, ...) with cost_usd and cost_basis, by prices(model, usd_in, usd_out) for a million tokens.

    A model is looked up as it is named, else without the part before its first slash; one without a price costs 0 and says ``unpriced``.
    """
    key = F.lower(F.trim(F.coalesce("model", F.lit(""))))
    listed = prices.select(F.lower(F.trim("model")).alias("__listed"), F.struct("usd_in", "usd_out").alias("__price")).dropDuplicates(["__listed"])
    rows = replies.withColumns({"__own": key, "__bare": F.when(F.contains(key, F.lit("/")), F.expr("substring(lower(trim(model)), instr(lower(trim(model)), '/') + 1)"))})
    rows = rows.join(listed.withColumnsRenamed({"__listed": "__own", "__price": "__p1"}), "__own", "left").join(listed.withColumnsRenamed({"__listed": "__bare", "__price": "__p2"}), "__bare", "left")
    price = F.coalesce("__p1", "__p2")
    cost = (F.col("tokens_in") * price["usd_in"] + F.col("tokens_out") * price["usd_out"]) / 1_000_000
    return rows.withColumns({"cost_usd": F.coalesce(cost, F.lit(0.0)), "cost_basis": F.when(price.isNull(), "unpriced").otherwise("estimated")}).drop("__own", "__bare", "__p1", "__p2")


def parity(runs: DataFrame) -> DataFrame:
    """One row a provider that was attempted: attempts, ok, accepted, accept_rate, invented, fenced, cached, mean_cost_usd, mean_ms, cost_basis, isolation.

    runs(provider, ok, accepted, reason, error, needed_fence_strip, cached, cost_usd, elapsed_ms, cost_basis, isolation). Cached runs cost nothing
    and stay out of the mean.
    """
    attempted = F.coalesce("ok", F.lit(False)) | (F.coalesce("error", F.lit("")) != "")
    named = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c)
    out = runs.groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("ok"), F.count_if("accepted").alias("accepted"), F.round(F.count_if("accepted") / F.count(F.lit(1)), 3).alias("accept_rate"),
        F.count_if(F.contains("reason", F.lit("invented a source"))).alias("invented"), F.count_if("needed_fence_strip").alias("fenced"), F.count_if("cached").alias("cached"),
        F.coalesce(F.round(F.avg(F.when(~F.col("cached"), F.col("cost_usd"))), 6), F.lit(0.0)).alias("mean_cost_usd"), F.floor(F.avg("elapsed_ms")).alias("mean_ms"), named("cost_basis"), named("isolation"), F.bool_or(attempted).alias("tried"),
    )
    return out.filter("tried").drop("tried")


def self_similarity(runs: DataFrame) -> DataFrame:
    """provider, pairs, mean_self_similarity of runs(provider, case, repeat, said): how alike a provider's repeats of one case are.

    Repeats of a case are a few, a parameter of the run that made them, so their pairs are too.
    """
    said = runs.filter("said IS NOT NULL").select("provider", "case", "repeat", "said")
    later = said.select("provider", "case", F.col("repeat").alias("r2"), F.col("said").alias("s2"))
    pairs = said.join(later, ["provider", "case"]).filter("repeat < r2").withColumn("ratio", F.round(T.similarity(F.col("said"), F.col("s2")), 3))
    return pairs.groupBy("provider").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("ratio"), 3).alias("mean_self_similarity"))


def spaced(targets: DataFrame, delays: DataFrame, order: Column) -> DataFrame:
    """targets(host, ...) with at_s: seconds from the start of a run at which each may be fetched; hosts run beside each other, delays(host, delay)."""
    rows = targets.join(delays.select("host", "delay"), "host", "left")
    nth = F.row_number().over(W.partitionBy("host").orderBy(order)) - 1
    return rows.withColumn("at_s", nth * N.interval(F.col("delay"))).drop("delay")
