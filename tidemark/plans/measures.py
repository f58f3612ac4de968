"""Queries on fetching, costs, suites and agreement, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import net as N
from tidemark.functions import urls as U
from tidemark.operators import measure
from tidemark.plans.common import table
from tidemark.plans.web import HOST_SQL


def address_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's address may be fetched from: addresses are made of event ids, all over the space."""
    i = F.col("event_id")
    ip = F.concat_ws(".", *[c.cast("string") for c in (i * 7 % 256, i * 13 % 256, i * 3 % 256, i % 256)])
    url = F.when(i % 50 == 0, F.concat(F.lit("ftp://h.io/"), i.cast("string"))).otherwise(F.concat(F.lit("https://h.io/"), i.cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", N.safety(url, F.when(i % 60 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("8.8.8.8"), ip))).alias("safety"))
    return rows


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file a host: some close their English pages to all, some wait, some fail to serve it."""
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host")).distinct()
    kind = F.length("host") % 4
    body = F.when(kind == 0, "User-agent: *\nDisallow: /en/\nAllow: /\n").when(kind == 1, "User-agent: tidemark\nCrawl-delay: 4\nDisallow: /de/\n\nUser-agent: *\nDisallow: /\n").otherwise("User-agent: *\nDisallow: /\n")
    return rows.select("host", body.alias("body"), F.when(kind == 3, 404).otherwise(200).alias("status"))


def robots_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages an agent may fetch by their hosts' robots files."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host")).join(_robots(spark, sf_dir), "host")
    return rows.select("page_id", N.robots_allow("url", "body", "status", F.lit("tidemark/1.0")).alias("allowed"))


def fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page may be fetched, in milliseconds from the start, by its host's own pace."""
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    delays = _robots(spark, sf_dir).select("host", N.crawl_delay("body", "status", F.lit("tidemark/1.0")).alias("delay"))
    return measure.spaced(rows, delays, F.col("page_id")).select("page_id", (F.col("at_s") * 1000).cast("long").alias("at_ms"))


def reply_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations as a reply of some model, in nano-dollars: prices by full name, by name without its vendor, or none."""
    names = ["alpha-1", " Vendor/Alpha-1", "vendor/beta-2", "gamma", "other/deep/beta-2"]
    model = F.element_at(F.array(*map(F.lit, names)), (F.col("turn") % 5 + 1).cast("int"))
    replies = table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens_in"), (F.col("turn") * 10).alias("tokens_out"))
    prices = spark.createDataFrame([("alpha-1", 1.0, 5.0), ("vendor/beta-2", 3.0, 15.0), ("deep/beta-2", 0.5, 0.25)], "model string, usd_in double, usd_out double")
    out = measure.costed(replies, prices)
    return out.groupBy("conv_id", "cost_basis").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("cost_usd") * 1e9).cast("long")).alias("nano_usd"))


def suite_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites of cases made of orders against what each must reach; one has no cases."""
    suite = F.element_at(F.array(*map(F.lit, ("trust", "findings", "other"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    cases = table(spark, sf_dir, "orders").select(suite.alias("suite"), ((F.col("o_custkey") % 3 == 0) | (F.col("o_orderstatus") != "P")).alias("ok"))
    return measure.suite_rates(cases, spark.createDataFrame([("trust",), ("findings",), ("other",), ("discovery",)], "suite string"))


def provider_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers over all orders as attempts: acceptance, invented sources, cost and pace. One was never attempted."""
    k = F.col("o_orderkey")
    ok = (k % 4 != 3) & (k % 7 != 0)
    runs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("provider"), ok.alias("ok"), (ok & (k % 5 != 0)).alias("accepted"), F.when(k % 5 == 0, "it invented a source").otherwise("").alias("reason"), F.when((k % 4 != 3) & (k % 7 == 0), "timeout").alias("error"),
        (k % 9 == 0).alias("needed_fence_strip"), (k % 2 == 0).alias("cached"), (k % 8 * 0.5).alias("cost_usd"), (k % 100).alias("elapsed_ms"), F.when(k % 4 == 1, "reported").otherwise("estimated").alias("cost_basis"), F.lit("none").alias("isolation"),
    )
    out = measure.parity(runs)
    return out.select("provider", "attempts", "ok", "accepted", "accept_rate", "invented", "fenced", "cached", "mean_cost_usd", "mean_ms", F.array_join("cost_basis", ",").alias("cost_basis"), F.array_join("isolation", ",").alias("isolation"))


def provider_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike a role's turns of a conversation are, taken as repeats of one case, as thousandths."""
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("provider"), F.col("conv_id").alias("case"), F.col("turn").alias("repeat"), F.col("text").alias("said"))
    out = measure.self_similarity(rows)
    return out.select("provider", "pairs", F.round(F.col("mean_self_similarity") * 1000).cast("long").alias("thousandths"))


QUERIES = {f.__name__: f for f in (address_safety, robots_policy, fetch_schedule, reply_costs, suite_outcomes, provider_parity, provider_variance)}

_KIND = f"h AS (SELECT page_id, url, {HOST_SQL} AS host FROM pages), k AS (SELECT *, length(host) % 4 AS kind, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM h)"

ORACLE_SQL = {
    "address_safety": """
WITH e AS (SELECT event_id AS i, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b, event_id * 3 % 256 AS c, event_id % 256 AS d FROM events)
SELECT i AS event_id, CASE WHEN i % 50 = 0 THEN 'bad_scheme' WHEN i % 60 = 1 THEN 'unresolvable' WHEN a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
  OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) THEN 'private' ELSE 'ok' END AS safety FROM e""",
    "robots_policy": f"WITH {_KIND} SELECT page_id, CASE kind WHEN 0 THEN NOT starts_with(path, '/en/') WHEN 1 THEN NOT starts_with(path, '/de/') WHEN 2 THEN false ELSE true END AS allowed FROM k",
    "fetch_schedule": f"WITH {_KIND} SELECT page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) * CASE kind WHEN 1 THEN 4000 ELSE 1500 END AS at_ms FROM k",
    "reply_costs": """
WITH r AS (SELECT conv_id, turn % 5 AS m, length(coalesce(text, '')) AS i, turn * 10 AS o FROM conversations)
SELECT conv_id, CASE WHEN m = 3 THEN 'unpriced' ELSE 'estimated' END AS cost_basis, count(*) AS n, CAST(sum(CASE WHEN m < 2 THEN 1000 * i + 5000 * o WHEN m = 2 THEN 3000 * i + 15000 * o WHEN m = 4 THEN 500 * i + 250 * o ELSE 0 END) AS BIGINT) AS nano_usd FROM r GROUP BY 1, 2""",
    "suite_outcomes": """
WITH o AS (SELECT ['trust', 'findings', 'other'][o_custkey % 3 + 1] AS suite, o_custkey % 3 = 0 OR o_orderstatus <> 'P' AS ok FROM orders), s AS (SELECT suite, count(*) AS cases, count(*) FILTER (ok) AS passed FROM o GROUP BY 1)
SELECT suite, cases, passed, round(passed / cases, 3) AS rate, 1.0::DOUBLE AS needed, passed = cases AS met FROM s UNION ALL SELECT 'discovery', 0, 0, 1.0, 1.0, true""",
    "provider_parity": """
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS p, o_orderkey % 4 <> 3 AND o_orderkey % 7 <> 0 AS ok FROM orders)
SELECT 'p' || p AS provider, count(*) AS attempts, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND k % 5 <> 0) AS accepted, round(count(*) FILTER (ok AND k % 5 <> 0) / count(*), 3) AS accept_rate, count(*) FILTER (k % 5 = 0) AS invented,
  count(*) FILTER (k % 9 = 0) AS fenced, count(*) FILTER (k % 2 = 0) AS cached, coalesce(round(avg(k % 8 * 0.5::DOUBLE) FILTER (k % 2 <> 0), 6), 0) AS mean_cost_usd, CAST(floor(avg(k % 100)) AS BIGINT) AS mean_ms,
  CASE WHEN p = 1 THEN 'reported' ELSE 'estimated' END AS cost_basis, 'none' AS isolation FROM r WHERE p <> 3 GROUP BY p""",
}
