"""Approximate nearest neighbours by cosine: a forest of sorted hash strings.

Each tree hashes a vector to a long string of cross-polytope symbols (under a random rotation, the largest coordinate and its sign) and
keeps the strings as one sorted array. A query descends each tree to the longest prefix that it shares with anything, by binary search;
then all trees ascend together, a bit of prefix at a time, until enough distinct candidates lie under their prefixes. Candidates are
ranked by the exact cosine in double precision.

Rows are dealt by hash into blocks, each with a forest of its own; a task builds a block's forest once and then streams queries past it, a
batch at a time. Every row is indexed and every query meets every block, so what a task holds is bounded at any input size.

How far a query ascends follows from what it finds: a vector as near as one of the k nearest found so far lies under the query's prefix in
about as many trees as that one does (c), so all trees miss such a vector with a chance near exp(-c). The ascent ends when the mean of
these chances over the k nearest is at most ``missed``. On clustered vectors that is after a hundredth of a block; on vectors without
structure, whose nearest ones are hardly nearer than others, after about two fifths of it.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without vec_id; vectors
meet only those of their own length; a repeated vec_id counts once, with its smallest vector; equal vectors tie and rank by vec_id; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

TREES, SYMBOLS, MISSED, NEAREST = 64, 4, 0.08, 5
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1 << 18


def usable(vector: Column) -> Column:
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of hash strings over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS, seed: int = 5) -> None:
        self.trees, self.symbols, self.seed, self.n = trees, symbols, seed, len(x)
        self.bits = max(1, (2 * x.shape[1] - 1).bit_length())
        self.width = self.bits * symbols
        keys = self.strings(x)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each row in each tree."""
        rng = np.random.Generator(np.random.Philox(self.seed))
        d, out = x.shape[1], np.zeros((self.trees, len(x)), dtype=np.int64)
        x = x.astype(np.float32)
        for t in range(self.trees):
            for _ in range(self.symbols):
                y = x @ rng.standard_normal((d, d), dtype=np.float32)
                at = np.abs(y).argmax(axis=1)
                out[t] = (out[t] << self.bits) | (at * 2 + (y[np.arange(len(x)), at] > 0))
        return out

    def nearest(self, x: np.ndarray, queries: np.ndarray, k: int, missed: float, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the rows under its prefixes in the trees, all trees ascending together, and their products with it.

        own: a row for each query that is the query itself (-1: none) and doesn't count.
        """
        keys = self.strings(queries)
        levels = self.width + 1
        low = np.empty((levels, self.trees, len(queries)), dtype=np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            for level in range(levels):
                rest = self.width - level
                first = (keys[t] >> rest) << rest
                low[level, t] = np.searchsorted(self.sorted[t], first)
                high[level, t] = np.searchsorted(self.sorted[t], first + (1 << rest))
        total = (high - low).sum(axis=1)
        for q in range(len(queries)):
            level = int(np.flatnonzero(total[:, q] >= min(4 * k, self.n))[-1])
            held = -1
            while True:
                if total[level, q] > held:  # the prefixes of this level hold more than those of the last one
                    held = total[level, q]
                    under = np.concatenate([self.order[t, low[level, t, q] : high[level, t, q]] for t in range(self.trees)])
                    trees = np.bincount(under, minlength=self.n)
                    if own is not None and own[q] >= 0:
                        trees[own[q]] = 0
                    found = np.flatnonzero(trees)
                    near = x[found] @ queries[q]
                    best = np.argpartition(near, -k)[-k:] if len(near) > k else np.arange(len(near))
                    if len(near) > k and np.exp(-trees[found[best]]).mean() <= missed:
                        break
                if not level:
                    break
                level -= 1
            yield found, near


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision; vectors are first scaled by powers of two, which is exact, so that no product over- or underflows."""
    a, b = (np.ldexp(v, -math.frexp(float(np.abs(v).max()))[1]) for v in (a, b))
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def distinct_vectors(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id once; of equal vectors the rows with the smallest ids, as many as a result could need."""
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    ids, x = ids[first], x[first]
    _, group = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    sizes = np.bincount(group.ravel())
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = np.sort(order[nth < most])
    return ids[keep], x[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, missed: float = MISSED, trees: int = TREES, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query; a row never finds its own id."""

    def plain(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))

    _text.bound_batches(vectors.sparkSession)
    rows = plain(vectors)
    asked = plain(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    n = rows.groupBy(F.size("vector").alias("d")).count().agg(F.max("count")).first()[0] or 0
    m = queries.count()
    parts, asks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    part = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    everyone = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    key = F.concat_ws("/", F.size("vector"), "b", "q").alias("task")
    held = rows.withColumn("b", part(parts, 1)).withColumn("q", everyone(asks)).select(key, F.lit(False).alias("query"), "id", "vector")
    asked = asked.withColumn("q", part(asks, 2)).withColumn("b", everyone(parts)).select(key, F.lit(True).alias("query"), "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task, each task's block before its queries."""
        task, block, forest = None, [], None
        for batch in batches:
            tasks, asks_ = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (asks_[1:] != asks_[:-1])) + 1), len(tasks)] if len(tasks) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tasks[a] != task:
                    task, block, forest = tasks[a], [], None
                ids = batch.column(2).slice(a, b - a).to_numpy()
                x = batch.column(3).slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if not asks_[a]:
                    block.append((ids, x))
                    continue
                if not block:
                    continue
                if forest is None:
                    base_ids, base = distinct_vectors(np.concatenate([i for i, _ in block]), np.concatenate([v for _, v in block]), k + 1)
                    unit = unit_vectors(base)
                    forest = Forest(unit, trees)
                for s in range(0, len(ids), 512):
                    out: list[tuple[int, int, float]] = []
                    ask_ids, ask = ids[s : s + 512], x[s : s + 512]
                    own = np.minimum(np.searchsorted(base_ids, ask_ids), len(base_ids) - 1)
                    own = np.where(base_ids[own] == ask_ids, own, -1)
                    for i, (found, near) in enumerate(forest.nearest(unit, unit_vectors(ask), k, missed, own)):
                        if not len(found):
                            continue
                        least = np.partition(near, -k)[-k] if len(near) > k else -2
                        found = found[near >= least - 1e-9]
                        best = sorted((-exact_cosine(base[j], ask[i]), int(base_ids[j])) for j in found)[:k]
                        out.extend((int(ask_ids[i]), v, -c) for c, v in best)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    tasks = held.unionByName(asked).repartition("task").sortWithinPartitions("task", "query")
    found = tasks.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {"op7_ann": op7_ann}
ORACLE_SQL: dict[str, str] = {}
