"""Queries that run as streams over the events table and must agree with their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.plans import runs
from tidemark.plans.common import table
from tidemark.plans.web import HOST_SQL
from tidemark.sources import fetch_log, stages
from tidemark.streaming import caches, deltas, gates, jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.read_table_stream(spark, sf_dir, "events", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.last_value_gate(_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.col("event_type").alias("value")))


def stream_watermark_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.drained(_gated(spark, sf_dir))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("signals"))


def stream_signal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the stream, each once."""
    rows = gates.drained(gates.signal_ledger(_gated(spark, sf_dir)))
    return rows.select("signal_id", "source", "value")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates.drained(gates.windowed_counts(_events(spark, sf_dir)), "complete")
    return rows.select(F.col("start").cast("string").alias("start"), "event_type", "n")


#: Rows that a file of a part holds at least, unless the part is a single file.
FILE_ROWS = 1 << 16


def _filed(df: DataFrame, part: str, parts: int) -> tuple[str, int]:
    """df in files by part, written one part after another, as a stream would bring them, and how many files a part is.

    All parts have as many, but the last one perhaps fewer, so a stream that takes as many at a time takes one part at a time.
    """
    rows, path = stages.staged(df), stages.shared_path(df.sparkSession)
    sizes = {r[part]: r["count"] for r in rows.groupBy(part).count().filter(F.col(part).between(0, parts - 2)).collect()}  # one row a part
    scanned = max(1, rows.rdd.getNumPartitions())  # rows are dealt out by each of these: one with as many rows as files fills them all
    least = min(sizes.get(n, 0) for n in range(parts - 1)) if parts > 1 else 0
    files = max(1, min(df.sparkSession.sparkContext.defaultParallelism, least // max(FILE_ROWS, scanned)))
    for n in range(parts):
        own = rows.filter(F.col(part) == n).drop(part)
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(path)
    return path, files


def _stream(spark: SparkSession, path: str, files: int) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


POLLS = 8


def poll_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new in each user's set of event types, poll by poll (an eighth of all events each), and how each poll went."""
    events = table(spark, sf_dir, "events")
    n = events.count()
    rows = events.groupBy(F.col("user_id").cast("string").alias("source"), F.expr(f"event_id * {POLLS} div {n}").alias("poll"), F.col("event_type").alias("id")).agg(F.when(F.count(F.lit(1)) > 3, "busy").otherwise("calm").alias("status"))
    sizes = rows.groupBy("source", "poll").agg(F.count(F.lit(1)).alias("rows"))
    filed = _filed(rows.join(sizes, ["source", "poll"]).withColumn("part", F.col("poll")), "part", POLLS)
    return gates.drained(deltas.set_deltas(_stream(spark, *filed)))


def job_events(spark: SparkSession, sf_dir: str, parts: int = 6) -> DataFrame:
    """Orders as jobs: submitted, leased, renewed, finished and cancelled at times that follow from their keys; part: the file that brings an event.

    Every tenth job's events come a day late, and within a file in any order. A last event far ahead closes the books.
    """
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    own = F.concat(F.lit("w"), (k % 5).cast("string"))
    event = lambda on, kind, minutes, worker=None: F.when(on, F.struct(F.lit(kind).alias("kind"), (start + F.expr(f"INTERVAL {minutes} MINUTES")).alias("at"), (worker if worker is not None else F.lit(None).cast("string")).alias("worker")))
    each = F.array_compact(F.array(
        event(F.lit(True), "submit", 0), event(k % 4 != 0, "lease", 60, own), event(k % 6 == 0, "lease", 65, F.lit("other")), event(k % 3 == 0, "heartbeat", 120, own),
        event(k % 5 != 0, "finish", 180, F.when(k % 9 == 3, "other").otherwise(own)), event(k % 7 == 0, "cancel", 30),
    ))
    rows = table(spark, sf_dir, "orders").select(k.alias("job"), F.explode(each).alias("e")).select("job", "e.*")
    seen = F.unix_timestamp("at") + F.when(F.col("job") % 10 == 0, 86400).otherwise(0)
    low, high = rows.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at")) + 86401).first()
    filed = rows.withColumn("part", F.floor((seen - low) * parts / (high - low)).cast("int"))
    close = spark.range(1).select(F.lit(-1).cast("long").alias("job"), F.lit("close").alias("kind"), F.timestamp_seconds(F.lit(high + 10**9)).alias("at"), F.lit(None).cast("string").alias("worker"), F.lit(parts).alias("part"))
    return filed.unionByName(close)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every job, when it was reached, and how many changes led there."""
    changes = gates.drained(jobs.job_changes(_stream(spark, *_filed(job_events(spark, sf_dir), "part", 7))))
    return changes.groupBy("job").agg(F.max_by("status", "at").alias("status"), F.unix_seconds(F.max("at")).alias("at"), F.max_by("worker", "at").alias("worker"), F.count(F.lit(1)).alias("n_changes"))


def _reviews(spark: SparkSession, sf_dir: str, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """Events as findings, and for three of four orders of the same number a verdict, some days later."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("thread"), F.col("event_type").alias("finding"), F.col("ts").cast("timestamp").alias("at"))
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("thread"), F.col("o_orderstatus").alias("verdict"))
    decided = events.select("thread", "at").join(orders, "thread").select("thread", "verdict", (F.col("at") + F.make_dt_interval(days=(F.col("thread") % 6).cast("int"), hours=F.lit(1))).alias("decided_at"))
    low, high = events.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at"))).first()
    filed = lambda df, at: df.withColumn("part", F.least(F.floor((F.unix_timestamp(at) - low) * parts / (high - low + 1)).cast("int"), F.lit(parts - 1)))
    return filed(events, "at"), filed(decided, "decided_at")


def stream_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and verdicts as two streams: each finding goes on with the verdict of its thread, or unreviewed when the wait is over."""
    findings, verdicts = _reviews(spark, sf_dir)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("thread"), F.lit("close").alias("what"), F.lit("2100-01-01").cast("timestamp").alias("when"), F.lit(4).alias("part"))
    told = [_stream(spark, *_filed(df.unionByName(end.toDF(*df.columns)), "part", 5)) for df in (findings, verdicts)]
    out = gates.drained(gates.review_gate(*told))
    return out.filter("thread >= 0").withColumn("decided_at", F.unix_micros("decided_at"))


#: Bodies that a cache of the query holds, fewer than it is asked for.
BODIES = 40


def body_requests(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """Events as requests of four caches for some hundred URLs, a few of them far more often; part: the file that brings a request, and one to close."""
    e = F.col("event_id")
    url = F.concat_ws("/", "event_type", F.when(e % 3 == 0, e % 7).otherwise((e * e) % 211).cast("string"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("string").alias("cache"), e.alias("request"), url.alias("url"), F.col("ts").cast("timestamp").alias("at"))
    low, high = rows.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at"))).first()
    filed = rows.withColumn("part", F.floor((F.unix_timestamp("at") - low) * parts / (high - low + 1)).cast("int"))
    close = spark.range(1).select(F.lit("close").alias("cache"), F.lit(-1).cast("long").alias("request"), F.lit(None).cast("string").alias("url"), F.timestamp_seconds(F.lit(high + 10**8)).alias("at"), F.lit(parts).alias("part"))
    return filed.unionByName(close)


def cached_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of every request: hits, misses, bodies out of date, and what was driven out. Held against a replay in the tests."""
    return gates.drained(caches.served(_stream(spark, *_filed(body_requests(spark, sf_dir), "part", 5)), BODIES))


def fetch_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a log of fetches in three entries: two are read, then the stream starts anew and reads the third; each fetch comes once."""
    spark.dataSource.register(fetch_log.FetchLog)
    page = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "url", F.when(page % 9 == 0, 404).otherwise(200).alias("status"), F.col("url").alias("final_url"), F.when(page % 9 == 0, "gone").alias("error"), F.when(page % 9 != 0, F.col("html")).alias("body"), page.cast("string").alias("at"), (page % 3).alias("entry"))
    rows, root, out = stages.staged(rows), stages.shared_path(spark), stages.shared_path(spark)
    for upto in (2, 3):
        for n in range(0 if upto == 2 else 2, upto):
            fetch_log.appended(rows.filter(F.col("entry") == n), root, n)
        query = spark.readStream.format("fetches").load(root).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination()
    return spark.read.schema(fetch_log.FETCHES).parquet(f"{out}/rows").select("host", "url", F.col("status").cast("long").alias("status"), "error", F.sha2("body", 256).alias("body"), "at")


QUERIES = {f.__name__: f for f in (stream_watermark_gate, stream_signal_ledger, stream_tumbling, poll_deltas, job_states, stream_review_gate, cached_bodies, fetch_log_stream)}
ORACLE_SQL = {
    "stream_watermark_gate": runs.ORACLE_SQL["watermark_gate_batch"],
    "stream_signal_ledger": f"SELECT signal_id, source, value FROM ({runs.ORACLE_SQL['signal_ledger']})",
    "stream_tumbling": runs.ORACLE_SQL["tumbling_windows"],
    "fetch_log_stream": f"""SELECT {HOST_SQL} AS host, url, CAST(CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status, CASE WHEN page_id % 9 = 0 THEN 'gone' END AS error,
  CASE WHEN page_id % 9 <> 0 THEN sha256(html) END AS body, CAST(page_id AS VARCHAR) AS at FROM pages""",
    "poll_deltas": f"""
WITH n AS (SELECT count(*) AS n FROM events),
s AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id * {POLLS} // n AS poll, event_type AS id, CASE WHEN count(*) > 3 THEN 'busy' ELSE 'calm' END AS status FROM events, n GROUP BY 1, 2, 3),
p AS (SELECT source, poll, lag(poll) OVER (PARTITION BY source ORDER BY poll) AS prev FROM (SELECT DISTINCT source, poll FROM s)),
a AS (SELECT s.source, s.poll, s.id, s.status, p.prev, o.id IS NULL AS fresh FROM s JOIN p ON p.source = s.source AND p.poll = s.poll LEFT JOIN s AS o ON o.source = s.source AND o.poll = p.prev AND o.id = s.id AND o.status = s.status),
g AS (SELECT p.source, p.poll, count(*) AS gone FROM p JOIN s AS o ON o.source = p.source AND o.poll = p.prev LEFT JOIN s ON s.source = p.source AND s.poll = p.poll AND s.id = o.id WHERE s.id IS NULL GROUP BY 1, 2),
q AS (SELECT source, poll, any_value(prev) AS prev, count(*) FILTER (fresh) AS added FROM a GROUP BY 1, 2)
SELECT source, poll, 'added' AS kind, id, status, CAST(NULL AS BIGINT) AS n_added, CAST(NULL AS BIGINT) AS n_removed FROM a WHERE fresh AND prev IS NOT NULL
UNION ALL SELECT q.source, q.poll, CASE WHEN prev IS NULL THEN 'baseline' WHEN added > 0 OR gone > 0 THEN 'changed' ELSE 'unchanged' END, NULL, NULL, added, coalesce(gone, 0) FROM q LEFT JOIN g ON g.source = q.source AND g.poll = q.poll""",
    "job_states": """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_minutes(o_orderkey % 1440) AS b, 'w' || o_orderkey % 5 AS w FROM orders),
s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'cancelled' WHEN k % 4 = 0 AND k % 6 <> 0 THEN 'queued' WHEN k % 4 <> 0 AND k % 3 = 0 AND k % 5 <> 0 AND k % 9 <> 3 THEN 'done' ELSE 'interrupted' END AS status FROM o)
SELECT k AS job, status, CAST(epoch(b + to_minutes(CASE WHEN status = 'queued' THEN 0 WHEN status = 'cancelled' THEN 30 WHEN status = 'done' THEN 180 WHEN k % 4 = 0 THEN 155 WHEN k % 3 = 0 THEN 210 ELSE 150 END)) AS BIGINT) AS at,
  CASE WHEN status IN ('queued', 'cancelled') THEN NULL WHEN k % 4 = 0 THEN 'other' ELSE w END AS worker, CAST(CASE status WHEN 'queued' THEN 1 WHEN 'cancelled' THEN 2 ELSE 3 END AS BIGINT) AS n_changes FROM s""",
    "stream_review_gate": """
SELECT event_id AS thread, event_type AS finding, CASE WHEN event_id % 6 < 3 THEN coalesce(o_orderstatus, 'unreviewed') ELSE 'unreviewed' END AS state,
  CASE WHEN event_id % 6 < 3 AND o_orderkey IS NOT NULL THEN epoch_us(CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 6 AS INTEGER)) + INTERVAL 1 HOUR) END AS decided_at
FROM events LEFT JOIN orders ON o_orderkey = event_id AND o_orderkey % 4 <> 3""",
}
