"""Readers of the driver tables, and how they stand in for the engine's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in fewer parts than there are cores (one row group, say) is dealt out, for work that is heavy a row; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def evidence() -> Column:
    """Kind of evidence of a line item: a few of flag A run, the rest of them are visited, R is a passing mention, N a bare link."""
    flag = F.col("l_returnflag")
    return F.when((flag == "A") & (F.col("l_quantity") >= 48), "solution_import").when(flag == "A", "link:a_href").when(flag == "R", "prose_name").otherwise("link:bare")


EVIDENCE_SQL = """CASE WHEN l_returnflag = 'A' AND l_quantity >= 48 THEN 'solution_import' WHEN l_returnflag = 'A' THEN 'link:a_href'
  WHEN l_returnflag = 'R' THEN 'prose_name' ELSE 'link:bare' END"""
TENTHS_SQL = f"""(CASE {EVIDENCE_SQL} WHEN 'solution_import' THEN 50 WHEN 'link:a_href' THEN 20 WHEN 'prose_name' THEN 2 ELSE 10 END
  * CASE WHEN l_linestatus = 'F' AND {EVIDENCE_SQL} <> 'prose_name' THEN 2 ELSE 1 END)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as locations of parts: the course is the customer's nation, the session the ship month, open items aren't graded."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return rows.select(
        F.col("l_partkey").alias("dep_id"), F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_id"), evidence().alias("evidence_source"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, "CODING_QUESTIONS").otherwise("OBJECTIVE_QUESTIONS")).otherwise("LEARNING_RESOURCE").alias("object_type"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("content_id"), F.month("l_shipdate").alias("session_no"), F.lit("package").alias("kind"),
    )


def with_course(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Locations with the course of their order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("course"))
    # orders meet customers first: the large side is shuffled once
    return rows.join(orders.join(customers, "o_custkey").join(nations, "c_nationkey").select("order_id", "course"), "order_id")
