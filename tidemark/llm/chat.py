"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

A log often holds a conversation several times, as it grew. Every turn gets a rolling prefix hash: the running sum, over the turns so
far, of 120 bits of the SHA-256 of (place, role, text). A conversation whose last hash is the hash of a proper prefix of another one is
a snapshot of it; an anti-join on (turns, hash) drops it. Of equal conversations the smallest conv_id stays. What stays is rendered.

Hashes are narrow rows; texts move once more, for the conversations that stay. The prefix side is made distinct before the join, so a
first turn that many conversations share is one row there.

Defined cases: turns are ordered by turn (null first), then role, then text; a null conv_id is a conversation like any other; a null
role is rendered as ``unknown`` and a null text as empty, but they differ from those strings in comparison; repeated rows are repeated
turns; an empty table gives an empty result; other columns don't matter. Markers within a text are broken up, so no text can open or
close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _framed(c: Column) -> Column:
    """A string that no other value shares, null included, and that stays apart from what follows it."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def _part(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text, and the prefix hash (h1, h2) up to each turn; last: whether the conversation ends there."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.row_number().over(order))
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit("|"), _framed(F.col("role")), _framed(F.col("text"))), 256)
    by_place = W.partitionBy("conv_id").orderBy("place")
    so_far = by_place.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("digest", digest)
    return rows.select("conv_id", "place", "role", "text", F.sum(_part(F.col("digest"), 1)).over(so_far).alias("h1"), F.sum(_part(F.col("digest"), 16)).over(so_far).alias("h2"), F.lead("place").over(by_place).isNull().alias("last"))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another, one of each set of equal ones."""
    key = [F.col("place"), F.col("h1"), F.col("h2")]
    whole = rolled.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = rolled.filter("not last").select(*key).distinct()
    return whole.join(prefixes, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    clean = F.coalesce(text, F.lit(""))
    for mark in (OPEN, CLOSE):
        clean = F.replace(clean, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), clean, F.lit(CLOSE), F.lit("\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: one row for each conversation that stays."""
    rolled = rolling(turns)
    narrow = _text.materialise(rolled.select("conv_id", "place", "h1", "h2", "last"))
    stays = maximal(narrow).withColumnRenamed("conv_id", "kept_id")
    lines = rolled.select("conv_id", "place", rendered(F.col("role"), F.col("text")).alias("line"))
    joined = lines.join(stays, lines["conv_id"].eqNullSafe(stays["kept_id"]))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "")
    return joined.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), told.alias("rendered"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op2_chat_formatting": op2_chat_formatting}

ORACLE_SQL = {
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         role, text, CASE WHEN role IS NULL THEN '-' ELSE length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE length(text) || ':' || text END AS framed,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10)
           || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS line
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list(framed ORDER BY place) AS turns, string_agg(line, '' ORDER BY place) AS rendered FROM t GROUP BY conv_id),
d AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns)
SELECT d.conv_id, d.n_turns, d.n_copies, c.rendered
FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE e.n_turns > d.n_turns AND e.turns[1] = d.turns[1] AND e.turns[1:d.n_turns] = d.turns)
"""
}
