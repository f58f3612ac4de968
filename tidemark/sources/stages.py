"""Stage artifacts: written tables where a plan has to be cut, and dated artifacts of runs.

A cut is needed where a fixpoint iterates or where an artifact is the interface; elsewhere plans stay lazy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/tidemark-stages"
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, and read back; no executor's loss costs what came before."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy_parts(spark: SparkSession) -> int:
    """Parts for rows that are short and cost much: a number that is asked for isn't lowered to what the bytes alone would need."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def write_artifact(df: DataFrame, path: str, day: str) -> None:
    """One day's artifact of a run; writing it again replaces that day alone."""
    df.withColumn("dt", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def latest_artifact(spark: SparkSession, path: str, schema: StructType | None = None, upto: str | None = None) -> DataFrame:
    """The artifact of the last day, or of the last one up to a day; partitions of other days aren't read."""
    rows = (spark.read.schema(schema.add("dt", "string")) if schema else spark.read).parquet(path)
    days = rows.select(F.col("dt").cast("string").alias("dt")).distinct()
    last = (days.filter(F.col("dt") <= upto) if upto else days).agg(F.max("dt").alias("dt")).first()["dt"]  # one value
    return rows.filter(F.col("dt").cast("string") == last).drop("dt")


def merged_artifact(spark: SparkSession, path: str, day: str, new: DataFrame, examined: DataFrame, key: str = "dep_id") -> None:
    """A partial refresh: today's artifact, else the newest earlier one, with the examined keys replaced."""
    from tidemark.operators.history import merged_slice

    write_artifact(staged(merged_slice(latest_artifact(spark, path, upto=day), new, examined, key)), path, day)


def fresh(df: DataFrame, stamp: str, now: Column, hours: int) -> DataFrame:
    """Rows of a snapshot that haven't outlived their time."""
    return df.filter(F.col(stamp) > now - F.expr(f"INTERVAL {hours} HOURS"))
