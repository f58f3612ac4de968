"""Queries on ordered events, run-over-run change, decisions and partial refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import hashing as H
from tidemark.functions import ladders as L
from tidemark.operators import history, observe, resolve
from tidemark.plans.common import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def running_session_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running session number per user: a signup opens a session, ties of time by event id."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("session_no"), F.row_number().over(w).cast("long").alias("place"))
    return rows


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of errors per user: the longest, and how often an error was confirmed by the one before it."""
    rows = history.streaks(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    status = history.confirmed(F.when(F.col("failed"), "broken").otherwise("ok"), F.array().cast("array<string>"), F.col("streak"))
    return rows.withColumn("status", status).groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.count_if(F.col("status") == "broken").alias("confirmed"), F.count_if(F.col("status") == "inconclusive").alias("waiting"))


def _half(spark: SparkSession, sf_dir: str, early: bool) -> DataFrame:
    """One half of the month as a run's findings: one a user and type, its severity by how much was seen."""
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    rows = _events(spark, sf_dir).filter(cut if early else ~cut).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    severity = F.element_at(F.array(*[F.lit(s) for s in ("info", "low", "medium", "high", "critical")]), F.least(F.col("n"), F.lit(5)).cast("int"))
    ident = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"))
    return rows.select(ident.alias("finding_id"), F.col("user_id").alias("dep_id"), severity.alias("severity"), F.pmod(F.col("n"), F.lit(3)).cast("string").alias("fingerprint"))


def prev_value_diff_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the second half against the state that the first half left."""
    state = _half(spark, sf_dir, True).withColumn("state", F.when(F.col("dep_id") % 10 == 0, "resolved").otherwise("open"))
    return history.classified(_half(spark, sf_dir, False), state).groupBy("diff_class").agg(F.count(F.lit(1)).alias("n"))


def resolve_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in 1996 and none in 1997, among those whose nation was examined."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_nationkey", F.year("o_orderdate").alias("y"))
    open_ = orders.filter("y = 1996").select(F.col("o_custkey").alias("finding_id"), F.col("c_nationkey").alias("dep_id")).distinct()
    seen = orders.filter("y = 1997").select(F.col("o_custkey").alias("finding_id"))
    examined = table(spark, sf_dir, "nation").filter("n_regionkey IN (0, 2)").select(F.col("n_nationkey").alias("dep_id"))
    return history.resolve_absent(open_, seen, examined).select("finding_id", F.col("dep_id").cast("long").alias("dep_id"))


def merge_examined_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances by nation, with the slice of one region replaced by new values for those that still have any."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dep_id"), F.round("c_acctbal", 2).alias("balance"))
    examined = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("dep_id"))
    new = rows.join(examined, "dep_id", "left_semi").filter("balance > 0").withColumn("balance", F.round(F.col("balance") + 100, 2))
    merged = history.merged_slice(rows, new, examined)
    return merged.groupBy("dep_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("balance") * 100).cast("long")).alias("cents"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on their customers: status F accepts, O rejects, P leaves open for later."""
    verdict = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("unsure")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("finding_id"), verdict.alias("verdict"), F.substring("o_orderpriority", 1, 1).alias("fingerprint"))


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_decisions(spark, sf_dir), ["finding_id"], "id").select("finding_id", "id", "verdict")


def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held back: the last word on them was a rejection on evidence that hasn't changed."""
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("finding_id"), (F.pmod("c_custkey", F.lit(5)) + 1).cast("string").alias("fingerprint"))
    return history.suppressed(found, _decisions(spark, sf_dir)).groupBy("held").agg(F.count(F.lit(1)).alias("n"))


def precision_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.precision(_decisions(spark, sf_dir))


def precision_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.precision(_decisions(spark, sf_dir), "score")


def majority_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return resolve.majority(rows, ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", F.col("o_orderpriority").alias("priority"), "n")


def sessions_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days on which a user was seen."""
    days = _events(spark, sf_dir).select("user_id", F.dayofmonth("ts").alias("day"))
    out = resolve.islands(days, ["user_id"], "day")
    return out.select("user_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def session_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days as the shortest spec, and read back."""
    days = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(F.dayofmonth("ts"))).alias("days"))
    spec = days.withColumn("spec", L.compacted(F.col("days")))
    return spec.select("user_id", "spec", F.size(L.session_numbers(F.col("spec"))).cast("long").alias("n_days"))


def rotation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twelve customers to look at: those without any order first, then by how long ago the last one was."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "last")
    return history.rotation(rows, "last", "c_name", 12).select("c_custkey", "c_name", F.to_date("last").cast("string").alias("last_order"))


def fold_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day folded into one status by strict precedence, as observations of a page are."""
    rows = _events(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("dep_id"), F.col("event_id").alias("ord"),
        ((F.col("event_type") == "error") & (F.col("value") > 45)).alias("parked"), ((F.col("event_type") == "error") & (F.col("value") <= 45)).alias("gone"),
        (F.col("event_type") != "signup").alias("reachable"), (F.col("event_type") == "view").alias("blocked"), (F.col("event_type") == "signup").alias("robots"),
        ((F.col("event_type") == "click") & (F.col("value") > 80)).alias("sunset_near"), ((F.col("event_type") == "click") & (F.col("value") <= 20)).alias("moved"),
        F.lit(None).cast("int").alias("drift"),
    )
    return observe.folded(rows).groupBy("status", "signal").agg(F.count(F.lit(1)).alias("n"))


def watermark_gate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as polled sources whose value is the last event's type: baselines, unchanged and changed polls."""
    polls = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("value"))
    return history.watermark_signals(polls).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("signals"))


def signal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changed value once a source, with its id and first sight."""
    polls = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("value"))
    return history.ledger(history.watermark_signals(polls)).select("signal_id", "source", "value", F.col("at.event_id").alias("event_id"))


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of 1996 by customer brought up to 1997: new values win, the first sight stays."""
    orders = table(spark, sf_dir, "orders")
    of = lambda y: orders.filter(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("first_seen"))
    return history.upserted(of(1996), of(1997), "key").select("key", "n", F.col("first_seen").cast("string").alias("first_seen"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("stamp"))
    out = history.coverage(last, "stamp", F.lit("2001-08-01").cast("date"), 365)
    return out.withColumn("oldest", F.col("oldest").cast("string"))


def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When orders of each priority fall due, and their age in days on a fixed day."""
    level = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", L.due_date(level, F.to_date("o_orderdate")).cast("string").alias("due"), L.days_since(F.col("o_orderdate"), F.lit("2002-01-01").cast("timestamp")).cast("long").alias("age"))
    return rows


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").cast("string").alias("start"), "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.session_window("ts", "8 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("string").alias("start"), "n")


def learn_score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return rows.groupBy(H.split_half(F.col("k")).alias("half")).agg(F.count(F.lit(1)).alias("n"))


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty orders of a nation's customers, as a list of runs is shown; every wildcard customer is in all lists."""
    customers = table(spark, sf_dir, "customer").filter("c_nationkey = 7 OR c_custkey % 100 = 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey", "left_semi")
    return rows.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20).select("o_orderkey", "o_custkey")


def events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a tail: those after an id, for sources that were never seen before it."""
    rows = _events(spark, sf_dir)
    before = rows.filter("event_id <= 500").select("user_id").distinct()
    return rows.filter("event_id > 500").join(before, "user_id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest forty distinct (priority, status) lines of orders' customers, of which twelve are shown for one priority."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("signal"), F.concat_ws(" ", "o_orderstatus", F.pmod("o_custkey", F.lit(9)).cast("string")).alias("line"), F.col("o_orderkey").alias("at"))
    return history.shown_feedback(history.kept_feedback(lines, ["signal", "line"], "at"), "1-URGENT", "at")


QUERIES = {
    f.__name__: f
    for f in (
        feedback_lines, running_session_no, failure_streaks, prev_value_diff_class, resolve_absent, merge_examined_slice, latest_decision, suppressed_findings, precision_overall,
        precision_heldout, majority_mode, sessions_islands, session_specs, rotation_queue, fold_observations, watermark_gate_batch, signal_ledger, state_upsert,
        coverage_summary, due_dates, tumbling_windows, sliding_windows, session_windows, learn_score_split, run_list, events_after,
    )
}

_HALF = """SELECT user_id || '/' || event_type AS finding_id, user_id AS dep_id, ['info', 'low', 'medium', 'high', 'critical'][least(count(*), 5)] AS severity,
  least(count(*), 5) AS rank, CAST(count(*) % 3 AS VARCHAR) AS fp FROM events WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY user_id, event_type"""
_LATEST = """SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS finding_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'unsure' END AS verdict,
  substr(o_orderpriority, 1, 1) AS fp, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth = 1"""
_POLLS = "SELECT CAST(user_id AS VARCHAR) AS source, event_id, event_type AS value, lag(event_type) OVER w AS prev, row_number() OVER w AS nth, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_SID = "substr(sha256(source || chr(31) || value), 1, 16)"

ORACLE_SQL = {
    "feedback_lines": """
WITH l AS (SELECT o_orderpriority AS signal, o_orderstatus || ' ' || (o_custkey % 9) AS line, max(o_orderkey) AS "at" FROM orders GROUP BY 1, 2),
k AS (SELECT * FROM l ORDER BY "at" DESC LIMIT 40)
SELECT signal, line, "at" FROM k ORDER BY (signal = '1-URGENT') DESC, "at" DESC LIMIT 12""",
    "running_session_no": """
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""",
    "failure_streaks": """
WITH a AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
b AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM a)
SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (bad AND streak >= 2) AS confirmed, count(*) FILTER (bad AND streak < 2) AS waiting FROM b GROUP BY 1""",
    "prev_value_diff_class": f"""
WITH p AS ({_HALF.format(op="<")}), n AS ({_HALF.format(op=">=")})
SELECT CASE WHEN p.finding_id IS NULL OR p.dep_id % 10 = 0 THEN 'new' WHEN n.rank > p.rank THEN 'worsened' WHEN n.rank < p.rank THEN 'improved'
            WHEN n.fp <> p.fp THEN 'changed' ELSE 'unchanged' END AS diff_class, count(*) AS n FROM n LEFT JOIN p USING (finding_id) GROUP BY 1""",
    "resolve_absent": """
SELECT DISTINCT o_custkey AS finding_id, CAST(c_nationkey AS BIGINT) AS dep_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE year(o_orderdate) = 1996 AND n_regionkey IN (0, 2) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""",
    "merge_examined_slice": """
WITH m AS (SELECT c_nationkey, round(c_acctbal, 2) AS b, n_regionkey = 1 AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(c_nationkey AS BIGINT) AS dep_id, count(*) AS n, CAST(sum(CAST(round((CASE WHEN hit THEN round(b + 100, 2) ELSE b END) * 100) AS BIGINT)) AS BIGINT) AS cents
FROM m WHERE NOT hit OR b > 0 GROUP BY 1""",
    "latest_decision": f"SELECT finding_id, id, verdict FROM ({_LATEST})",
    "suppressed_findings": f"""
WITH l AS ({_LATEST}) SELECT coalesce(verdict = 'rejected' AND fp = CAST(c_custkey % 5 + 1 AS VARCHAR), false) AS held, count(*) AS n
FROM customer LEFT JOIN l ON finding_id = CAST(c_custkey AS VARCHAR) GROUP BY 1""",
    "precision_overall": f"WITH l AS ({_LATEST}) SELECT count(*) AS decided, count(*) FILTER (verdict = 'accepted') AS accepted, round(count(*) FILTER (verdict = 'accepted') / count(*), 3) AS precision FROM l",
    "precision_heldout": f"""
WITH l AS ({_LATEST}), s AS (SELECT * FROM l WHERE CAST('0x' || substr(sha256(finding_id), 1, 8) AS BIGINT) % 2 = 1)
SELECT count(*) AS decided, count(*) FILTER (verdict = 'accepted') AS accepted, round(count(*) FILTER (verdict = 'accepted') / count(*), 3) AS precision FROM s""",
    "majority_mode": """
WITH c AS (SELECT o_custkey, o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)
SELECT o_custkey, priority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS nth FROM c) WHERE nth = 1""",
    "sessions_islands": """
WITH d AS (SELECT DISTINCT user_id, day(ts) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d)
SELECT user_id, min(d) AS low, max(d) AS high FROM g GROUP BY user_id, g""",
    "session_specs": """
WITH d AS (SELECT DISTINCT user_id, day(ts) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d),
i AS (SELECT user_id, min(d) AS a, max(d) AS b FROM g GROUP BY user_id, g)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spec, CAST(sum(b - a + 1) AS BIGINT) AS n_days FROM i GROUP BY 1""",
    "rotation_queue": """
SELECT c_custkey, c_name, CAST(CAST(last AS DATE) AS VARCHAR) AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey
ORDER BY last NULLS FIRST, lower(c_name) LIMIT 12""",
    "fold_observations": """
WITH o AS (SELECT user_id, day(ts) AS d, event_type AS t, value AS v FROM events),
f AS (SELECT user_id, d, bool_or(t = 'error' AND v > 45) AS parked, bool_or(t = 'error' AND v <= 45) AS gone, bool_and(t = 'signup') AS robots, bool_or(t <> 'signup') AS reach,
             bool_and(t = 'view' OR t = 'signup') AND bool_or(t = 'view') AS blocked, bool_or(t = 'click' AND v > 80) AS sunset, bool_or(t = 'click' AND v <= 20) AS moved FROM o GROUP BY 1, 2)
SELECT CASE WHEN parked OR gone THEN 'broken' WHEN robots THEN 'inconclusive' WHEN NOT reach THEN 'unreachable' WHEN blocked THEN 'inconclusive' WHEN sunset OR moved THEN 'changed' ELSE 'ok' END AS status,
       CASE WHEN parked THEN 'domain_parked' WHEN gone THEN 'url_gone' WHEN robots THEN 'disallowed_by_robots' WHEN NOT reach THEN '' WHEN blocked THEN 'blocked_by_host'
            WHEN sunset THEN 'sunset_language_about_subject' WHEN moved THEN 'redirected_off_path' ELSE '' END AS signal, count(*) AS n FROM f GROUP BY 1, 2""",
    "watermark_gate_batch": f"""
WITH p AS ({_POLLS}) SELECT CASE WHEN nth = 1 THEN 'baseline' WHEN prev = value THEN 'unchanged' ELSE 'changed' END AS kind, count(*) AS n, count(DISTINCT {_SID}) AS signals FROM p GROUP BY 1""",
    "signal_ledger": f"""
WITH p AS ({_POLLS}), c AS (SELECT *, row_number() OVER (PARTITION BY source, value ORDER BY ts, event_id) AS k FROM p WHERE nth > 1 AND prev <> value)
SELECT {_SID} AS signal_id, source, value, event_id FROM c WHERE k = 1""",
    "state_upsert": """
WITH o AS (SELECT o_custkey AS key, year(o_orderdate) AS y, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS f FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2),
a AS (SELECT * FROM o WHERE y = 1996), b AS (SELECT * FROM o WHERE y = 1997)
SELECT coalesce(a.key, b.key) AS key, coalesce(b.n, a.n) AS n, CAST(coalesce(a.f, b.f) AS VARCHAR) AS first_seen FROM a FULL JOIN b ON a.key = b.key""",
    "coverage_summary": """
WITH l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS s FROM orders GROUP BY 1)
SELECT count(*) FILTER (DATE '2001-08-01' - s <= 365) AS fresh, count(*) FILTER (DATE '2001-08-01' - s > 365) AS stale, CAST(min(s) AS VARCHAR) AS oldest FROM l""",
    "due_dates": """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + [7, 30, 90, 180, 365][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS VARCHAR) AS due,
       CAST(floor(date_diff('second', o_orderdate, TIMESTAMP '2002-01-01') / 86400) AS BIGINT) AS age FROM orders""",
    "tumbling_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_windows": """
WITH w AS (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM w GROUP BY 1""",
    "session_windows": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 8 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "learn_score_split": """
SELECT CASE WHEN CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 THEN 'learn' ELSE 'score' END AS half, count(*) AS n FROM customer GROUP BY 1""",
    "run_list": """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7 OR c_custkey % 100 = 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
    "events_after": "SELECT event_type, count(*) AS n FROM events WHERE event_id > 500 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id <= 500) GROUP BY 1",
}
