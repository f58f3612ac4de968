"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, in words, over its size is the number of copies every document of it should get. The whole part is given; the
fractional parts are rounded dependently: two documents with fractional copy probabilities exchange mass (words times probability) at
random, without a change of its sum and without bias, until one of them is integral; the other goes on to the next pair. This runs
within blocks of a source, longest documents first, so that what is left over is short; the one residual of each block goes up a
reduction tree, ``fan_in`` blocks to a node, and at a source's root a coin settles the last one. So the words taken from a source miss
its target by less than the size of one short document, at any number of tasks, and no source needs to be in one place.

Random numbers depend on seed, source, level and block alone, and rows are ordered within a block: reruns agree. A row's block follows
from its doc_id and size; rows that repeat both are dealt by where they lie in the input instead, so that no block outgrows the others.

Defined cases: null text counts as empty (size 0, nothing taken); null sources are a source of their own, ordered last; repeated rows
and doc_ids are rounded one by one; a source of no words has target 0; an empty table gives an empty result; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
BLOCK_ROWS = 2_048
HEAVY = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_no, source_size, members, target: weights by rank, each target at most ``most`` times its source's size.

    The excess of capped sources goes to the others by weight. Capped sources are those that come first by size over weight, so one
    running sum over the sources finds the level; there is one row a source here, not one a document.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("members"))
    ranked = totals.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = reduce(lambda out, i: out.when(F.col("source_no") % len(weights) == i, weights[i]), range(1, len(weights)), F.when(F.col("source_no") % len(weights) == 0, weights[0]))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("top", most * F.col("source_size"))
    before = W.orderBy(F.col("top") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    weighs = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / weighs)
    # the first source that stays below its top has the level that holds for all after it
    level = F.min(F.when(F.col("top") >= F.col("level") * F.col("weight"), F.struct("rank", "level"))).over(everything)
    levels = levels.withColumn("rank", F.row_number().over(W.orderBy(F.col("top") / F.col("weight"), "source_no"))).withColumn("at", level)
    target = F.when(F.col("at").isNull() | (F.col("rank") < F.col("at.rank")), F.col("top")).otherwise(F.least(F.col("top"), F.col("at.level") * F.col("weight")))
    return levels.select("source", "source_no", "source_size", "members", target.alias("target"))


def pivotal(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds chances to 0 or 1 but for at most one, whose index is returned (-1: none). The sum of sizes times chances is kept."""
    p = chances.astype(float).copy()
    coins = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not sizes[i]:
            p[i] = float(coins[i] < p[i])
            continue
        if p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = float(sizes[held]), float(sizes[i])
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        move = up if coins[i] * (up + down) < down else -down
        full = abs(move) >= (a * (1 - p[held]) if move > 0 else a * p[held]) - 1e-9 * a
        other = abs(move) >= (b * p[i] if move > 0 else b * (1 - p[i])) - 1e-9 * b
        p[held], p[i] = p[held] + move / a, p[i] - move / b
        if full:
            p[held] = float(move > 0)
        if other:
            p[i] = float(move < 0)
        held = -1 if full and other else i if full else held
    return p, held


def against_the_rest(sizes: np.ndarray, chance: float, whole_size: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Settles documents, longest first, each against all that come after it, which share one chance; as far as those can take the mass.

    Returns 0, 1 or nan (not settled) for each, and the chance that all others have then.
    """
    out = np.full(len(sizes), np.nan)
    rest = float(whole_size)
    for i, a in enumerate(sizes):
        rest -= a
        if rest <= 0 or not 1e-12 < chance < 1 - 1e-12:
            break
        if_taken, if_not = chance - a * (1 - chance) / rest, chance + a * chance / rest
        if if_taken < 0 or if_not > 1:
            break
        taken = rng.random() < chance
        out[i], chance = float(taken), if_taken if taken else if_not
    return out, chance


NARROW = "doc_id long, source string, size long, source_no int, source_size long, target double, whole long, chance double, block long, settled boolean"
NAMES = [x.split()[0] for x in NARROW.split(", ")]


def rounded(docs: DataFrame, seed: int = 7, fan_in: int = 64, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    sized = _text.materialise(_text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")))
    same = F.xxhash64("doc_id", "source", "size")
    again = _text.maybe_in(sized.groupBy(same.alias("key")).count().filter("count > 1").select("key"))
    targets = source_targets(sized, **shares).select(F.col("source").alias("s"), "source_no", "source_size", "members", "target")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["s"]))
    expect = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = F.ceil(F.col("members") / block_rows).cast("long")
    block = F.pmod(F.when(again(same), F.xxhash64("row")).otherwise(F.xxhash64("doc_id", "size")), parts)
    rows = rows.withColumn("expect", expect).select("doc_id", "source", "size", F.col("source_no").cast("int"), "source_size", "target", F.floor("expect").cast("long").alias("whole"), (F.col("expect") - F.floor("expect")).alias("chance"), block.alias("block"), F.lit(False).alias("settled"))

    def level_of(depth: int, root: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
            rng = np.random.Generator(np.random.Philox([seed * 1000 + depth, (int(group["source_no"].iloc[0]) << 32) + int(group["block"].iloc[0])]))
            p, held = pivotal(group["size"].to_numpy(), group["chance"].to_numpy(), rng)
            if root and held >= 0:
                p[held] = float(rng.random() < p[held])
                held = -1
            group["chance"], group["settled"] = p, np.arange(len(p)) != held
            return group

        return run

    rows = _text.materialise(rows.withColumn("heavy", (F.col("size") > 0) & (F.col("size") * HEAVY >= F.col("source_size")) & (F.col("chance") > 0)), narrow=True)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        rng = np.random.Generator(np.random.Philox([seed * 1000 + 999, int(group["source_no"].iloc[0]) << 32]))
        taken, after = against_the_rest(group["size"].to_numpy(), float(group["chance"].iloc[0]), float(group["source_size"].iloc[0]), rng)
        group["settled"], group["chance"], group["after"] = ~np.isnan(taken), np.where(np.isnan(taken), after, taken), after
        return group[[*NAMES, "after"]]

    heavy = _text.materialise(rows.filter("heavy").drop("heavy").groupBy("source_no").applyInPandas(settle, NARROW + ", after double"), narrow=True)
    after = heavy.groupBy("source_no").agg(F.max("after").alias("after"))
    light = rows.filter("not heavy").drop("heavy").join(after, "source_no", "left").withColumn("chance", F.coalesce("after", "chance")).select(*NAMES)
    rows = light.unionByName(heavy.filter("not settled").select(*NAMES))

    largest = targets.agg(F.max("members")).first()[0] or 0
    blocks = -(-largest // block_rows)
    done: list[DataFrame] = [heavy.filter("settled").select(*NAMES)]
    depth, left = 0, rows
    while True:
        root = blocks <= 1
        out = left.groupBy("source_no", "block").applyInPandas(level_of(depth, root), NARROW)
        if root:
            done.append(out)
            break
        out = _text.materialise(out, narrow=True)
        done.append(out.filter("settled"))
        left = out.filter("not settled").withColumn("block", F.expr(f"block div {fan_in}"))
        blocks, depth = -(-blocks // fan_in), depth + 1
    copies = F.col("whole") + F.col("chance").cast("long")
    return _text.few(reduce(DataFrame.unionByName, done)).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    # equal rows are told apart by a number; it isn't a key of the join, so that texts are shuffled once for both
    empty = F.lit("")
    key = {"k1": F.coalesce("id", F.lit(0)), "k2": F.col("id").isNull(), "k3": F.coalesce("from", empty), "k4": F.col("from").isNull(), "k5": F.col("words")}
    nth = F.row_number().over(W.partitionBy(*key).orderBy("k1"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("from"), word_count(F.col(text_col)).alias("words")).withColumns(key).withColumn("nth", nth)
    took = rounded(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    took = took.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("size").alias("words"), F.col("copies").cast("int").alias("copies")).withColumns(key)
    took = took.withColumn("which", nth).filter("copies > 0").select(*key, "which", "copies")
    both = rows.join(took, list(key)).filter(F.col("nth") - F.col("which") == 0)
    return _text.compacted(both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"), like=docs)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_text.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
