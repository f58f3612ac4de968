"""Connected components of an edge table by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text


def components(edges: DataFrame, most_rounds: int = 60, scratch: _text.Scratch | None = None) -> DataFrame:
    """node, root: the smallest node of each node's component, for all nodes that an edge (a, b) touches. Edges that lead nowhere are ignored.

    A round never holds more edges than the last one. Minima are combined before they are shuffled, and a node that very many edges meet
    is joined by broadcast (``_text.hot_join``), so no node's edges land in one task. Nothing but those few nodes is collected. What the
    result reads goes to scratch, if given.
    """
    now = _text.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), narrow=True)
    n = F.count(F.lit(1)).alias("n")
    for _ in range(most_rounds):
        # done when no node has two edges and every edge leads to a node that leads nowhere
        forked = now.groupBy("u").count().filter("count > 1").select("u")
        chained = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if forked.unionByName(chained).isEmpty():
            if scratch:
                scratch.held.append(now)
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _text.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), n), narrow=True)
        # large star: larger neighbours go to the smallest one
        large = _text.materialise(_text.hot_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), narrow=True)
        # small star: a node and its smaller neighbours go to the smallest of them
        low = _text.materialise(large.groupBy("u").agg(F.min("v").alias("m"), n), narrow=True)
        joined = _text.hot_join(large, low, ["u"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = _text.materialise(small, narrow=True)
        for done in (now, least, large, low):
            _text.remove(done)
        now = after
    raise RuntimeError("the components did not settle")
