"""The plan-read-replan loop over all subjects at once: rounds over a frontier, with the state of each round in a table.

In a round every open subject gets URLs from a planner, of which at most ``most_urls`` count; those that it has visited are left out by an
anti-join on (subject, URL), those on hosts that don't speak for it are rejected and never read. What is left is read from the ``fetches``
snapshot, by a reader that returns claims. A subject stays open until it ends, and the endings stay apart, since each asks for another
follow-up:

* ``no_source``: no domain speaks for it, so nothing is planned;
* ``blocked``: the planner gave no answer;
* ``silence``: the planner says that the vendor publishes nothing, and has nothing to read;
* ``exhausted``: nothing new to read, or the last round is over without a claim;
* ``done``: a claim that substantiates.

Each round is written before the next begins: claims first, then the state, whose ``_SUCCESS`` makes the round count. A run that stops
goes on from the last round that counts; a round that doesn't is done again and overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import urls as U

MOST_URLS, MOST_ROUNDS = 4, 2
ENDINGS = ("no_source", "blocked", "silence", "exhausted", "done")
_NONE = "CAST(array() AS array<string>)"


def _there(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def _state(spark: SparkSession, path: str, upto: int) -> DataFrame:
    return spark.read.parquet(*[f"{path}/state/{n}" for n in range(1, upto + 1)])


def planned(subjects: DataFrame, replies: DataFrame, visited: DataFrame | None, most_urls: int = MOST_URLS) -> DataFrame:
    """subjects(dep_id, domains) with planned and rejected URLs and the status that the plan gives them (null: there is something to read).

    replies(dep_id, urls, publishes_nothing, error), one a subject at most; visited(dep_id, url).
    """
    asked = subjects.join(replies, "dep_id", "left")
    said = F.array_distinct(F.transform(F.slice(F.coalesce("urls", F.expr(_NONE)), 1, most_urls), lambda u: F.trim(u)))
    each = asked.filter(F.size("domains") > 0).select("dep_id", "domains", F.posexplode(said).alias("ord", "url"))
    if visited is not None:
        each = each.join(visited, ["dep_id", "url"], "left_anti")
    each = each.withColumn("own", U.within(U.host(F.col("url")), F.col("domains")))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "url")))), lambda x: x["url"])  # noqa: E731  at most most_urls
    sorted_out = each.groupBy("dep_id").agg(ordered(F.col("own")).alias("planned"), ordered(~F.col("own")).alias("rejected"))
    out = asked.join(sorted_out, "dep_id", "left").withColumns({c: F.coalesce(c, F.expr(_NONE)) for c in ("planned", "rejected")})
    blocked = F.col("urls").isNull() | F.col("error").isNotNull()
    status = F.when(F.size("domains") == 0, "no_source").when(blocked, "blocked").when(F.size("planned") > 0, None).when(F.coalesce("publishes_nothing", F.lit(False)), "silence").otherwise("exhausted")
    return out.select(*subjects.columns, F.when(status.isNull(), F.col("planned")).otherwise(F.expr(_NONE)).alias("planned"), "rejected", status.alias("status"))


def round_of(spark: SparkSession, path: str, number: int, subjects: DataFrame, fetches: DataFrame, planner: Callable, reader: Callable, rounds: int, most_urls: int) -> None:
    """One round: plan, read, claims, state."""
    before = _state(spark, path, number - 1) if number > 1 else None
    open_rows = subjects if before is None else subjects.join(before.filter((F.col("round") == number - 1) & (F.col("status") == "open")).select("dep_id"), "dep_id", "left_semi")
    read_before = None if before is None else before.filter(F.col("round") == number - 1).select("dep_id", F.posexplode("read").alias("ord", "url")).join(fetches, "url")
    visited = None if before is None else before.select("dep_id", F.explode("planned").alias("url")).distinct()
    # the planner's own work is done once: claims and state both start from the written plan
    planned(open_rows.select("dep_id", "domains"), planner(open_rows, read_before, number), visited, most_urls).write.mode("overwrite").parquet(f"{path}/plan/{number}")
    plan = spark.read.parquet(f"{path}/plan/{number}")
    wanted = plan.select("dep_id", F.posexplode("planned").alias("ord", "url"))
    fine = F.coalesce((F.col("status") >= 200) & (F.col("status") < 300) & (F.coalesce("body", F.lit("")) != ""), F.lit(False))
    got = wanted.join(fetches, "url", "left").withColumn("fine", fine)
    claims = reader(got.filter("fine").select("dep_id", "url", F.col("body").alias("html")), subjects)
    claims.withColumn("round", F.lit(number)).write.mode("overwrite").parquet(f"{path}/claims/{number}")
    claims = spark.read.parquet(f"{path}/claims/{number}").groupBy("dep_id").agg(F.count(F.lit(1)).alias("n_claims"))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "url")))), lambda x: x["url"])
    seen = got.groupBy("dep_id").agg(ordered(F.col("fine")).alias("read"), ordered(~F.col("fine")).alias("unreadable"))
    state = plan.join(seen, "dep_id", "left").join(claims, "dep_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0).cast("long")))
    status = F.coalesce("status", F.when(F.col("n_claims") > 0, "done").when(F.lit(number >= rounds), "exhausted").otherwise("open"))
    state = state.withColumn("status", status).withColumns({c: F.coalesce(c, F.expr(_NONE)) for c in ("read", "unreadable")})
    state.withColumn("round", F.lit(number)).drop("domains").write.mode("overwrite").parquet(f"{path}/state/{number}")


def run(subjects: DataFrame, fetches: DataFrame, planner: Callable, reader: Callable, path: str, rounds: int = MOST_ROUNDS, most_urls: int = MOST_URLS, stop_after: int | None = None) -> int:
    """All rounds that are left, until every subject has ended; the number of rounds that there are. Results: ``endings``, ``claims``.

    subjects(dep_id, domains array, ...) have one row each; fetches(url, status, body). planner(open subjects, pages read in the round
    before with their bodies, or None, round) gives replies; reader(pages(dep_id, url, html), subjects) gives claims with a dep_id.
    stop_after: leave off after so many rounds of this call, to go on later.
    """
    spark, number = subjects.sparkSession, 0
    while _there(spark, f"{path}/state/{number + 1}"):
        number += 1
    done = 0
    while number < rounds and (stop_after is None or done < stop_after):
        if number and _state(spark, path, number).filter((F.col("round") == number) & (F.col("status") == "open")).isEmpty():
            break
        number, done = number + 1, done + 1
        round_of(spark, path, number, subjects, fetches, planner, reader, rounds, most_urls)
    return number


def endings(spark: SparkSession, path: str, rounds: int) -> DataFrame:
    """dep_id, status, rounds, n_visited, n_read, n_unreadable, n_rejected, n_claims of every subject."""
    size = lambda c: F.sum(F.size(c)).cast("long").alias(f"n_{c}")
    told = _state(spark, path, rounds).groupBy("dep_id").agg(F.max_by("status", "round").alias("status"), F.max("round").cast("long").alias("rounds"), F.sum(F.size("planned")).cast("long").alias("n_visited"), size("read"), size("unreadable"), size("rejected"), F.sum("n_claims").alias("n_claims"))
    return told


def claims(spark: SparkSession, path: str, rounds: int) -> DataFrame:
    return spark.read.parquet(*[f"{path}/claims/{n}" for n in range(1, rounds + 1)])


def link_planner(seeds: str = "seeds", internal: tuple[str, ...] = ()) -> Callable:
    """A planner without a model: a subject's seeds first, then the links on the pages just read, in their order, each once.

    Subjects may have the columns publishes_nothing and error, as a model's reply would say them; without, neither is so.
    """

    def plan(subjects: DataFrame, read: DataFrame | None, number: int) -> DataFrame:
        flag = lambda c, kind: F.col(c) if c in subjects.columns else F.lit(None).cast(kind)
        own = subjects.select("dep_id", F.col(seeds).alias("seeds"), flag("publishes_nothing", "boolean").alias("publishes_nothing"), flag("error", "string").alias("error"))
        if read is None:
            return own.select("dep_id", F.col("seeds").alias("urls"), "publishes_nothing", "error")
        found = read.select("dep_id", "ord", F.posexplode(F.transform(U.links(F.col("body"), internal), lambda x: x["url"])).alias("at", "url"))
        first = found.groupBy("dep_id", "url").agg(F.min(F.struct("ord", "at")).alias("place"))
        nth = F.row_number().over(W.partitionBy("dep_id").orderBy("place"))
        few = first.withColumn("nth", nth).filter(F.col("nth") <= MOST_URLS)  # a reply's first URLs alone count
        urls = few.groupBy("dep_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "url"))), lambda x: x["url"]).alias("urls"))
        return own.join(urls, "dep_id", "left").select("dep_id", F.coalesce("urls", F.expr(_NONE)).alias("urls"), "publishes_nothing", "error")

    return plan
