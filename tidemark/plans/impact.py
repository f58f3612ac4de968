"""Queries on reach, severity and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import ladders as L
from tidemark.operators import score
from tidemark.plans.common import EVIDENCE_SQL, TENTHS_SQL, locations, table, with_course


def blast_radius_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers ranked by reach: weighted locations, watch tier, bumped severity; the worst twelve."""
    rows = locations(spark, sf_dir).withColumn("graded", score.graded(F.col("object_type")))
    sums = rows.groupBy("supplier").agg(score.blast(F.col("evidence_source"), F.col("graded")).alias("blast_radius"), score.watch_tier(F.col("evidence_source"), F.col("graded")).alias("watch_tier"), F.count(F.lit(1)).alias("n_locations"))
    out = sums.withColumn("severity", L.severity(F.lit("S5"), F.col("watch_tier"), F.col("blast_radius")))
    nations = table(spark, sf_dir, "nation")
    top = out.orderBy(F.col("blast_radius").desc(), "supplier").limit(12)
    named = top.join(table(spark, sf_dir, "supplier"), F.col("supplier") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("supplier", F.col("s_name").alias("name"), F.col("n_name").alias("nation"), "blast_radius", "watch_tier", "n_locations", "severity")


def _tiers(rows: DataFrame) -> DataFrame:
    tiers = rows.groupBy("dep_id").agg(score.watch_tier(F.col("evidence_source"), score.graded(F.col("object_type"))).alias("watch_tier"), F.count(F.lit(1)).alias("n"))
    return tiers.groupBy("watch_tier").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_locations"))


def part_tiers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch tiers of parts and how many parts and locations each has, over all locations."""
    return _tiers(locations(spark, sf_dir))


def projection_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier and course: reach, graded and executing counts, computed anew from the course's own locations."""
    rows = with_course(spark, sf_dir, locations(spark, sf_dir))
    return score.reach(rows, "supplier", "course").select("supplier", "course", "blast_radius", "tenths", "locations", "graded_locations", "questions_executing", "questions_mentioning")


def projection_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose courses' tenths don't add up to their own: must be none."""
    rows = with_course(spark, sf_dir, locations(spark, sf_dir))
    both = score.reach(rows, "supplier", "course").groupBy("supplier").agg(F.sum("tenths").alias("parts")).join(score.reach(locations(spark, sf_dir), "supplier").select("supplier", "tenths"), "supplier")
    return both.agg(F.count_if(F.col("parts") != F.col("tenths")).alias("violations"), F.count(F.lit(1)).alias("suppliers"))


def _elsewhere(rows: DataFrame) -> DataFrame:
    pairs = score.also_in(rows.withColumn("dep_id", F.col("supplier")))
    return pairs.groupBy("dep_id", "course").agg(F.count(F.lit(1)).alias("others"), F.sum("blast_radius").alias("radius_elsewhere")).withColumnRenamed("dep_id", "supplier")


def projection_also_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier and course, how many other courses the supplier reaches and their reach by their own counts, over all locations."""
    return _elsewhere(with_course(spark, sf_dir, locations(spark, sf_dir)))


def severity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as severities, moved by what the order is worth."""
    level = F.element_at(F.array(*[F.lit(s) for s in reversed(K.SEVERITIES)]), F.substring("o_orderpriority", 1, 1).cast("int"))
    steps = F.when(F.col("o_totalprice") > 300000, 2).when(F.col("o_totalprice") < 50000, -1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select(level.alias("base"), L.bumped(level, steps).alias("severity"))
    return rows.groupBy("base", "severity").agg(F.count(F.lit(1)).alias("n"))


def earliest_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_course(spark, sf_dir, locations(spark, sf_dir).filter("evidence_source = 'solution_import'")).select("dep_id", "course", F.col("session_no").cast("long").alias("session_no"))
    return score.earliest_session(rows)


def grouping_sets_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global and per-course reach in one pass."""
    rows = with_course(spark, sf_dir, locations(spark, sf_dir))
    weight = score.tenths(F.col("evidence_source"), score.graded(F.col("object_type")))
    sets = rows.groupingSets([[F.col("evidence_source")], [F.col("evidence_source"), F.col("course")], []], F.col("evidence_source"), F.col("course"))
    return sets.agg(F.sum(weight).cast("long").alias("tenths"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def evidence_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each kind of evidence by course, one column a kind."""
    rows = with_course(spark, sf_dir, locations(spark, sf_dir))
    kinds = ["solution_import", "link:a_href", "prose_name", "link:bare"]
    out = rows.groupBy("course").pivot("evidence_source", kinds).count().na.fill(0, kinds)
    return out.select("course", *[F.col(k).alias(k.replace(":", "_")) for k in kinds])


QUERIES = {f.__name__: f for f in (blast_radius_topk, part_tiers_all, projection_by_nation, projection_additivity, projection_also_in_all, severity_ladder, earliest_affected, grouping_sets_rollup, evidence_mix)}

_COURSE = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_RUNS = f"({EVIDENCE_SQL} = 'solution_import')"
_REACH = f"""CAST(round_even(sum({TENTHS_SQL}) / 10.0, 0) AS BIGINT) AS blast_radius, CAST(sum({TENTHS_SQL}) AS BIGINT) AS tenths, count(*) AS locations,
  count(*) FILTER (l_linestatus = 'F' AND {EVIDENCE_SQL} <> 'prose_name') AS graded_locations,
  count(*) FILTER (l_linestatus = 'F' AND {_RUNS}) AS questions_executing, count(*) FILTER (l_linestatus = 'F' AND NOT {_RUNS}) AS questions_mentioning"""
TIER_SQL = f"""CASE WHEN bool_or({EVIDENCE_SQL} = 'solution_import' OR ({EVIDENCE_SQL} = 'link:a_href' AND l_linestatus = 'F')) THEN 'critical'
  WHEN bool_or({EVIDENCE_SQL} = 'link:a_href') THEN 'standard' ELSE 'mention-only' END"""

ORACLE_SQL = {
    "blast_radius_topk": f"""
WITH s AS (SELECT l_suppkey AS supplier, CAST(round_even(sum({TENTHS_SQL}) / 10.0, 0) AS BIGINT) AS blast_radius, {TIER_SQL} AS watch_tier, count(*) AS n_locations FROM lineitem GROUP BY 1),
t AS (SELECT *, CASE WHEN watch_tier = 'critical' AND blast_radius >= 8 THEN 'high' WHEN watch_tier = 'mention-only' OR blast_radius <= 1 THEN 'low' ELSE 'medium' END AS severity
      FROM s ORDER BY blast_radius DESC, supplier LIMIT 12)
SELECT supplier, s_name AS name, n_name AS nation, blast_radius, watch_tier, n_locations, severity
FROM t JOIN supplier ON supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "part_tiers_all": f"""
WITH t AS (SELECT l_partkey, {TIER_SQL} AS watch_tier, count(*) AS n FROM lineitem GROUP BY 1)
SELECT watch_tier, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n_locations FROM t GROUP BY 1""",
    "projection_by_nation": f"SELECT l_suppkey AS supplier, n_name AS course, {_REACH} FROM {_COURSE} GROUP BY 1, 2",
    "projection_additivity": f"""
WITH p AS (SELECT l_suppkey AS s, n_name, sum({TENTHS_SQL}) AS t FROM {_COURSE} GROUP BY 1, 2), q AS (SELECT s, sum(t) AS parts FROM p GROUP BY 1),
g AS (SELECT l_suppkey AS s, sum({TENTHS_SQL}) AS t FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (parts <> t) AS violations, count(*) AS suppliers FROM q JOIN g USING (s)""",
    "projection_also_in_all": f"""
WITH p AS (SELECT l_suppkey AS s, n_name AS c, CAST(round_even(sum({TENTHS_SQL}) / 10.0, 0) AS BIGINT) AS r FROM {_COURSE} GROUP BY 1, 2)
SELECT a.s AS supplier, a.c AS course, count(*) AS others, CAST(sum(b.r) AS BIGINT) AS radius_elsewhere FROM p a JOIN p b ON a.s = b.s AND a.c <> b.c GROUP BY 1, 2""",
    "severity_ladder": """
WITH o AS (SELECT 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS b, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice < 50000 THEN -1 ELSE 0 END AS d FROM orders),
n AS (SELECT ['info', 'low', 'medium', 'high', 'critical'] AS l)
SELECT l[b] AS base, l[least(5, greatest(1, b + d))] AS severity, count(*) AS n FROM o, n GROUP BY 1, 2""",
    "earliest_affected": f"""
WITH r AS (SELECT l_partkey AS dep_id, month(l_shipdate) AS session_no, n_name AS course FROM {_COURSE} WHERE {EVIDENCE_SQL} = 'solution_import'),
k AS (SELECT *, row_number() OVER (PARTITION BY dep_id ORDER BY session_no, course) AS nth FROM r)
SELECT dep_id, CAST(session_no AS BIGINT) AS session_no, course FROM k WHERE nth = 1""",
    "grouping_sets_rollup": f"""
SELECT e AS evidence_source, c AS course, CAST(sum(t) AS BIGINT) AS tenths, count(*) AS n, CAST(grouping_id(e, c) AS BIGINT) AS level
FROM (SELECT {EVIDENCE_SQL} AS e, n_name AS c, {TENTHS_SQL} AS t FROM {_COURSE}) GROUP BY GROUPING SETS ((e), (e, c), ())""",
    "evidence_mix": f"""
SELECT n_name AS course, count(*) FILTER ({EVIDENCE_SQL} = 'solution_import') AS solution_import, count(*) FILTER ({EVIDENCE_SQL} = 'link:a_href') AS link_a_href,
       count(*) FILTER ({EVIDENCE_SQL} = 'prose_name') AS prose_name, count(*) FILTER ({EVIDENCE_SQL} = 'link:bare') AS link_bare FROM {_COURSE} GROUP BY 1""",
}
