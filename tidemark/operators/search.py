"""Ranked search of pages within a subject's domains: an inverted index in blocks, and the best pages block by block.

The index holds, for each term, registrable domain and block of ``BLOCK`` pages in a row, the pages (as gaps) with the term's BM25 weight
in each, in millionths, and the largest weight. A common term is spread over its blocks, so no group is larger than a block.

A query is asked of its own domains alone, and one without a domain is refused: what a subject's pages don't say isn't looked for elsewhere.
A block and a share of the questions meet in one piece of work, which returns the k best pages of the block for each question. The result
is that of scoring every page. Ties go to the smaller page id.

For few questions of a large index, ``opened`` says which blocks can matter: the sum of the largest weights of a query's terms bounds what
any page of a block can score. The most promising blocks, as many as hold k pages, are scored first; the k-th best of these is a floor, and
only blocks whose bound reaches it have to be opened.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType

from tidemark.operators.prefix import numbered
from tidemark.sources.stages import staged

BLOCK = 4096
#: Questions that meet a block in one piece of work.
ASKED = 16384
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


@F.pandas_udf(ArrayType(LongType()))
def _places(gaps: pd.Series) -> pd.Series:
    return gaps.map(lambda x: np.cumsum(np.asarray(x, dtype=np.int64)))


def postings(pages: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The index of pages(page_id, domain, text), page_id distinct: blocks (term, domain, block, n, top, gaps, weights), and pages (place, page_id)."""
    placed = staged(numbered(pages.select("page_id", "domain"), [F.col("page_id").asc()]))
    counts = pages.select("page_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = staged(counts.join(placed, "page_id"))
    lengths = counts.groupBy("page_id").agg(F.sum("tf").alias("length"))
    n, mean = placed.agg(F.count(F.lit(1))).scalar(), lengths.agg(F.sum("length")).scalar() / placed.agg(F.count(F.lit(1))).scalar()
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.round(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)) * 1_000_000).cast("long")
    rows = counts.join(lengths, "page_id").join(spread, "term").select("term", "domain", F.expr(f"(place - 1) div {block}").alias("block"), "place", weight.alias("weight"))
    grouped = rows.groupBy("term", "domain", "block").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("p"), F.max("weight").alias("top"))  # at most a block
    gap = F.transform("p", lambda x, i: F.when(i == 0, x["place"]).otherwise(x["place"] - F.get("p", i - 1)["place"]))
    blocks = grouped.select("term", "domain", "block", F.size("p").alias("n"), "top", gap.alias("gaps"), F.transform("p", lambda x: x["weight"]).alias("weights"))
    return blocks, placed.select("place", "page_id")


def scored(hits: DataFrame) -> DataFrame:
    """query_id, place, score of every page in opened blocks."""
    each = hits.select("query_id", F.explode(F.arrays_zip(_places("gaps").alias("place"), F.col("weights").alias("weight"))).alias("x"))
    return each.groupBy("query_id", F.col("x.place").alias("place")).agg(F.sum("x.weight").alias("score"))


def opened(hits: DataFrame, k: int) -> DataFrame:
    """The blocks (query_id, block) that a top-k has to open, given all that its terms meet."""
    bounds = staged(hits.groupBy("query_id", "block").agg(F.sum("top").alias("bound"), F.max("n").alias("pages")))
    order = W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block").rowsBetween(W.unboundedPreceding, -1)
    lead = bounds.withColumn("held", F.coalesce(F.sum("pages").over(order), F.lit(0))).filter(F.col("held") < k)
    best = scored(hits.join(lead.select("query_id", "block"), ["query_id", "block"], "left_semi"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))
    floor = best.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("query_id").agg(F.when(F.max("nth") == k, F.min("score")).otherwise(0).alias("floor"))
    return bounds.join(floor, "query_id").filter(F.col("bound") >= F.col("floor")).select("query_id", "block")


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best pages of one block for each question of one share; weights are summed page by page, and stay in the task."""

    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        gaps, out = [np.cumsum(np.asarray(g, dtype=np.int64)) for g in index["gaps"]], []
        first = min((g[0] for g in gaps), default=0)
        size = max((g[-1] for g in gaps), default=-1) - first + 1
        # the low bits count the terms met: a page is found for a term that weighs nothing, too
        held = {key: (g - first, (np.asarray(w, dtype=np.int64) << 16) + 1) for key, g, w in zip(zip(index["domain"], index["term"]), gaps, index["weights"])}
        for question, domain, terms in zip(asked["asked"], asked["domain"], asked["terms"]):
            total = np.zeros(size, dtype=np.int64)
            for there in filter(None, (held.get((domain, t)) for t in terms)):
                total[there[0]] += there[1]
            at = np.flatnonzero(total)
            score = total[at] >> 16
            if len(at) > k:
                near = score >= np.partition(score, -k)[-k]
                at, score = at[near], score[near]
            order = np.argsort(-score, kind="stable")[:k]
            out.append(pd.DataFrame({"asked": question, "place": at[order] + first, "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": asked["asked"], "place": [], "score": []})

    return run


def searched(queries: DataFrame, blocks: DataFrame, places: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, page_id, score of the k best pages for each of queries(query_id, text, domains); refused queries give none.

    A page counts for the terms it has, each once; without any it isn't found. Queries of the same terms and domains are one question. Every
    block of a question's domains gives its k best, so what is shuffled grows with questions and blocks, never with the pages that share a word.
    """
    named = F.array_sort(F.array_distinct(F.filter("domains", lambda d: d != "")))
    own = queries.select("query_id", named.alias("domains"), F.array_sort(F.array_distinct(terms_of(F.col("text")))).alias("terms"))
    own = staged(own.filter((F.size("domains") > 0) & (F.size("terms") > 0)))
    questions = own.groupBy("domains", "terms").agg(F.min("query_id").alias("asked"))
    members = own.join(questions, ["domains", "terms"]).select("query_id", "asked")
    each = staged(questions.select("asked", F.explode("domains").alias("domain"), "terms"))
    shares = each.count() // ASKED + 1
    met = blocks.join(each.select("domain", F.explode("terms").alias("term")).distinct(), ["domain", "term"], "left_semi")
    index = met.select("domain", "term", "block", "gaps", "weights", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    here = each.join(blocks.select("domain", F.col("block").alias("there")).distinct(), "domain").withColumn("share", F.pmod(F.xxhash64("asked"), F.lit(shares)).cast("int"))
    kind = queries.schema["query_id"].dataType.simpleString()
    found = index.groupBy("block", "share").cogroup(here.groupBy("there", "share")).applyInPandas(_best(k), f"asked {kind}, place long, score long")
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.col("score").desc(), "place"))  # places are in the order of page_id
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(places, "place")
    return best.join(members, "asked").select("query_id", "rank", "page_id", "score")


def refused(queries: DataFrame) -> DataFrame:
    """Queries that name no domain."""
    return queries.filter(F.size(F.filter(F.coalesce("domains", F.array().cast("array<string>")), lambda d: d != "")) == 0).select("query_id")


def write_index(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """The index as tables, sorted by term so that a search reads few of its files' row groups."""
    blocks, places = postings(pages)
    blocks = staged(blocks)  # dealing out by ranges reads its input twice
    blocks.repartitionByRange("term", "domain").sortWithinPartitions("term", "domain", "block").write.parquet(f"{path}/blocks")
    places.write.parquet(f"{path}/pages")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/pages")
