"""Queries on pages, texts and names of the driver tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.functions import ladders as L
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import resolve, trust
from tidemark.plans.common import spread, table
from tidemark.sources.stages import staged


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def host_registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = U.host(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", h.alias("host"), U.registrable(h).alias("owner"), U.normalised(F.col("url")).alias("clean"))


def host_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hosts by how many pages they have; of like counts, the one seen first."""
    rows = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    return rows.orderBy(F.col("n").desc(), "first").select("host", "n", "first")


#: A small authority list over the hosts of the test pages.
_AUTHORITY = {"example.org": "CORROBORATING", "example.com": "LEAD_ONLY", "cheap-pills.example.com": "EXCLUDED", "m.example.net": "AUTHORITATIVE"}


def host_suffix_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the tier of the longest listed domain at or above their host: an equi-join on exploded suffixes."""
    domains = spark.createDataFrame(list(_AUTHORITY.items()), "domain string, tier string")
    rows = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return trust.host_suffix_join(rows, domains).select("page_id", "host", F.coalesce("tier", F.lit("LEAD_ONLY")).alias("tier"))


def page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority cascade over all pages, for a claim about prices of a subject that owns example.org."""
    rows = _pages(spark, sf_dir).select("page_id", "url", F.array(F.lit("example.org")).alias("own_domains"), F.lit("pricing").alias("kind"))
    return trust.classified(rows).groupBy("tier", "substantiates").agg(F.count(F.lit(1)).alias("n"))


def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a page's anchors, which are relative on these pages, each once, with its first place."""
    found = F.regexp_extract_all("html", F.lit(U.LINK_PATTERNS["a_href"]), 1)
    clean = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(clean).alias("place", "target")).select("page_id", F.col("place").cast("long").alias("place"), "target")


def main_text_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.page_title(F.col("html")).alias("title"))


def main_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each page's visible prose and its number of lines."""
    rows = _pages(spark, sf_dir).select("page_id", T.main_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("chars"), F.size(F.split("t", "\n")).cast("long").alias("lines"))


def image_link_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct anchors and images of each host's pages; a host's pages count once each."""
    rows = _pages(spark, sf_dir).select(U.host(F.col("url")).alias("host"), F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)"'), 1).alias("a"), F.regexp_extract_all("html", F.lit(r'<img[^>]*src="([^"]+)"'), 1).alias("i"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    anchors = rows.select("host", F.explode("a").alias("x")).groupBy("host").agg(F.countDistinct("x").alias("anchors"))
    images = rows.select("host", F.explode("i").alias("x")).groupBy("host").agg(F.countDistinct("x").alias("images"))
    return pages.join(anchors, "host", "left").join(images, "host", "left").na.fill(0, ["anchors", "images"])


_WORDS = ("license", "public license", "the and", "contact", "token")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.hits(F.col("text"), _WORDS)).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def phrase_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a fixed list that a conversation's turn had and the next one hasn't."""
    from pyspark.sql import Window as W

    words = ("the ", "and ", "die ", "que ", "de ")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.hits(F.col("text"), words).alias("now"))
    before = F.lag("now").over(W.partitionBy("conv_id").orderBy("turn"))
    lost = rows.withColumn("before", before).filter("before is not null").select(F.explode(F.array_except("before", "now")).alias("word"))
    return lost.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which 'license' starts near 'released' or 'under': a band join on places within a text."""
    near = T.hits_near(F.col("text"), ("license", "licensed"), F.array(F.lit("released"), F.lit("under")), 40)
    rows = table(spark, sf_dir, "documents").filter("contains(lower(text), 'licens')").select("doc_id", near.alias("near"))
    return rows.select("doc_id", F.array_join("near", ",").alias("near"))


def sentences_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces of each document read as sentences, and how many don't."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array(T.raw_sentences(F.col("text")))).alias("raw"))
    return rows.select("doc_id", F.size("raw").cast("long").alias("pieces"), F.size(T.prose_of(F.col("raw"))).cast("long").alias("prose"))


def sentence_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document with the next one, for lines that hold 'licens'."""
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = lines.withColumn("after", F.lead("line").over(W.partitionBy("doc_id").orderBy("place"))).filter("lower(line) LIKE '%licens%'")
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.length("line").cast("long").alias("own"), F.coalesce(F.length("after"), F.lit(0)).cast("long").alias("next"))


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_id")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1")


#: Hashes under one key that meet in one piece of work.
_TOGETHER = 2048
#: Full keys that are sent to all tasks at most, 12 bytes each.
_FEW_KEYS = 1 << 18
#: Keyed hashes of a task.
_TASK = 1 << 19


def near_hashes(classes: DataFrame, together: int = _TOGETHER) -> DataFrame:
    """doc_id, of, bits: every pair of classes(doc_id, h), each with a hash of its own, at most eight bits apart, once, of being the smaller id.

    A hash stands under each part's value and under every value one bit off it (67 keys), so two parts up to 2 bits apart share a key. The
    keyed hashes are shuffled once, and those of a key compared where they are. Full keys are cut into blocks, of which every two meet in a
    place of their own.
    """
    rows = classes.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), H.bits(F.col("h")).alias("x"))
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * H.KEYS // _TASK)
    rows = rows.repartition(parts, "x")
    keyed = rows.mapInArrow(H.near_keys, "doc_id long, x long, key long")
    # a key is full only through values that are common themselves, so only their keys are counted; the rest adds less than one block
    value = ", ".join(f"{i << 22}L + (shiftrightunsigned(x, {low}) & {(1 << n) - 1}L)" for i, (low, n) in enumerate(H.PARTS))
    flips = ", ".join(f"{m}L" for m in (0, *(1 << j for j in range(22))))
    common = rows.select(F.expr(f"explode(array({value}))").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 23 > together)
    full = common.select("n", F.expr(f"explode(transform(array({flips}), m -> v ^ m))").alias("key")).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > together)
    full = staged(full.select("key", F.ceil(F.col("n") / together).cast("long").alias("blocks")))
    few = full.limit(_FEW_KEYS + 1).count() <= _FEW_KEYS  # usually: each stands for a block of rows and more. Beyond it both sides are shuffled
    dealt = keyed.join(F.broadcast(full) if few else full, "key", "left").withColumn("own", F.expr("pmod(xxhash64(x), blocks)"))
    met = f"""transform(sequence(0L, blocks - 1), b -> struct(key + {1 << 24}L * (least(own, b) * blocks + greatest(own, b)) AS place, CAST(if(own = b, 2, if(own < b, 0, 1)) AS tinyint) AS side))"""
    dealt = dealt.select("doc_id", "x", F.expr(f"inline(if(blocks is null, array(struct(key AS place, 2Y AS side)), {met}))"))
    return dealt.repartition(parts, "place").mapInArrow(H.near_pairs, "doc_id long, of long, bits long")


def near_duplicate_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the similarity hash of their prose: with 0 bits, each member of a class of equal hashes and the class's first document;
    with 1 to 8 bits, the first documents of every two classes that near to each other."""
    hashed = staged(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", H.simhash(F.col("text")).alias("h")))
    rows = hashed.filter("h <> ''")  # only now: a filter goes below the hash it reads, and each text would be hashed twice
    firsts = staged(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")))
    members = rows.join(firsts.withColumnRenamed("doc_id", "of"), "h").filter("doc_id <> of").select("doc_id", "of", F.lit(0).cast("long").alias("bits"))
    return members.unionByName(near_hashes(firsts))


def simhash_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch in built-in functions alone, over pages' titles."""
    rows = _pages(spark, sf_dir).select("page_id", H.simhash_native(T.page_title(F.col("html"))).alias("h"))
    return rows.select("page_id", F.col("h").isNull().alias("too_short"), F.bit_count("h").cast("long").alias("ones"))


def row_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each region's nations that doesn't depend on their order."""
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(H.row_set_hash("n_nationkey", "n_name").alias("hash"))


def prose_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases found in documents by one compiled alternation, longest first, on word bounds, then resolved to their entries."""
    aliases = {"general public license": "gpl", "public license": "licence", "license": "licence", "creative commons": "cc", "mit": "mit", "apache": "apache"}
    alternatives = "|".join(sorted(aliases, key=len, reverse=True))
    dim = spark.createDataFrame(list(aliases.items()), "alias string, entry string")
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\w.\-])({alternatives})(?![\w\-])"), 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("alias")).join(dim, "alias")
    return rows.groupBy("entry", "alias").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


def alias_resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as names, resolved against entries made of brands and types: the wanted kind first, then the earliest entry."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    brands = part.groupBy(F.col("p_brand").alias("canonical_name")).agg(F.min("p_partkey").alias("ord")).withColumn("kind", F.lit("tool"))
    types = part.groupBy(F.col("p_type").alias("canonical_name")).agg(F.min("p_partkey").alias("ord"))
    both = brands.unionByName(types.withColumn("kind", F.lit("tool"))).unionByName(types.withColumn("kind", F.lit("service")).withColumn("ord", F.col("ord") + 1000000))
    entries = both.select(F.concat_ws(":", "kind", "canonical_name").alias("entry_id"), "kind", "canonical_name", F.array(F.upper("canonical_name")).alias("aliases"), "ord")
    names = part.select("p_partkey", F.col("p_type").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "service").otherwise("package").alias("wanted_kind"))
    return resolve.resolved(names, resolve.alias_index(entries)).groupBy("entry_id", "wanted_kind").agg(F.count(F.lit(1)).alias("n"))


def ambiguous_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook names against course keys: an exact stem, else containment either way, and two courses are none."""
    books = table(spark, sf_dir, "nation").select(F.concat(F.col("n_name"), F.lit(" - Course Contents.xlsx")).alias("book"))
    keys = table(spark, sf_dir, "region").select(T.workbook_stem(F.col("r_name")).alias("key"), F.col("r_name").alias("course"))
    more = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.substring(T.workbook_stem(F.col("n_name")), 1, 7).alias("key"), F.col("n_name").alias("course"))
    return resolve.course_of_workbook(books, keys.unionByName(more)).groupBy("course").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") != "").alias("problems"))


def domain_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages resolved to entries by their exact host, else by the owner's domain."""
    hosts = _pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    dim = hosts.filter("page_id % 4 = 0").select(F.col("host").alias("domain"), F.col("page_id").alias("ord")).unionByName(spark.createDataFrame([("example.org", 10**6), ("example.net", 10**6 + 1)], "domain string, ord long"))
    dim = dim.withColumn("entry_id", F.concat(F.lit("e"), F.col("ord").cast("string")))
    return resolve.entry_of_domain(hosts, dim).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))


def priority_first_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts looked up by name in suppliers' catalogues: the first supplier in order that lists a part serves it."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    first = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("supplier"), F.count(F.lit(1)).alias("listed_by"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    out = parts.join(first, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.groupBy("brand").agg(F.sum("supplier").alias("suppliers"), F.sum("listed_by").alias("listings"), F.count_if(F.col("supplier").isNull()).alias("unlisted"))


def anti_semi_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders, by nation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    with_, without = customers.join(keys, "c_custkey", "left_semi"), customers.join(keys, "c_custkey", "left_anti")
    both = with_.withColumn("has", F.lit(1)).unionByName(without.withColumn("has", F.lit(0)))
    return both.groupBy("nation").agg(F.sum("has").cast("long").alias("with_orders"), F.sum(1 - F.col("has")).cast("long").alias("without"))


def scope_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within a scope of courses (regions) and sessions (months of their orders)."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("course"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dep_id"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") > 5000, "critical").when(F.col("c_acctbal") > 0, "standard").otherwise("mention-only").alias("watch_tier"), "c_nationkey")
    places = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dep_id"), F.month("o_orderdate").alias("session_no")).join(customers.select("dep_id", "c_nationkey"), "dep_id").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    scope = resolve.Scope(courses={"ASIA", "EUROPE"}, sessions={3, 4, 5}, tiers={"critical", "standard"}, kinds={"BUILDING", "MACHINERY"})
    return scope.select(customers, places).select("dep_id", "kind", "watch_tier")


def json_props_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each event's JSON, by type."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_type", value.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("n"))


@F.pandas_udf(ArrayType(StructType().add("path", StringType()).add("depth", LongType())))
def json_paths(text: pd.Series) -> pd.Series:
    """Path and depth of every field and element of a JSON text, the root first; by a stack, so at any depth the parser takes."""

    def walk(doc: str | None) -> list[dict] | None:
        if doc is None:
            return None
        out, stack = [], [("$", json.loads(doc), 0)]
        while stack:
            path, node, depth = stack.pop()
            out.append({"path": path, "depth": depth})
            inner = ((f".{k}", v) for k, v in node.items()) if isinstance(node, dict) else ((f"[{i}]", v) for i, v in enumerate(node)) if isinstance(node, list) else ()
            stack.extend((path + step, v, depth + 1) for step, v in inner)
        return out

    return text.map(walk)


def variant_walk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of nested JSON made from all events, with its path, to whatever depth it has: one pass, a walk a row."""
    doc = F.expr("parse_json('{\"a\": {\"props\": ' || props || ', \"t\": \"' || event_type || '\"}, \"b\": [' || event_id || ', {\"v\": ' || round(value) || '}]}')")
    rows = table(spark, sf_dir, "events").select(F.explode(json_paths(F.to_json(doc))).alias("x"))
    return rows.groupBy("x.path").agg(F.count(F.lit(1)).alias("n"), F.max("x.depth").alias("depth"))


def fit_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit scores over factors taken from vectors, some unknown: weights renormalise, too few known factors give none."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    factors = {"does_taught_job": F.when(e(1) > -0.1, F.round(e(1) * 4, 2)), "free_student_path": F.when(e(2) > -0.05, F.round(e(2) * 4, 2)), "signup_friction": F.when(e(3) > 0, F.round(e(3) * 4, 2)), "maturity": F.round(e(4) * 4, 2), "coverage_of_steps": F.when(e(5) > 0.05, F.lit("nan").cast("double")).otherwise(F.round(e(5) * 4, 2))}
    rows = table(spark, sf_dir, "embeddings").select("vec_id", L.fit_score(factors).alias("fit"))
    return rows.select("vec_id", F.round(F.col("fit") * 1000).cast("long").alias("fit_thousandths"))


def sessions_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations by place in it: counts, roles, conversations; the unnumbered last."""
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") < 6, F.col("turn")).alias("session"), "role", "conv_id")
    out = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.countDistinct("conv_id").alias("conversations"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return out.orderBy(F.col("session").asc_nulls_last())


def shutdown_parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all orders written in the forms vendors use, and read back."""
    day = F.to_date("o_orderdate")
    form = F.when(F.col("o_orderkey") % 6 == 0, F.date_format(day, "M/d/yyyy")).when(F.col("o_orderkey") % 6 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 6 == 2, F.date_format(day, "MMMM d, yyyy")).when(F.col("o_orderkey") % 6 == 3, F.date_format(day, "MMM d, yyyy")).when(F.col("o_orderkey") % 6 == 4, F.concat(F.lit("retires on "), F.date_format(F.add_months(day, 120), "yyyy-MM-dd"), F.lit(" at noon"))).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", L.shutdown_date(form).cast("string").alias("date"))


def ids_and_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of parts as dependencies and of a finding on each."""
    ident = H.dep_id(F.lit("package"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", ident.alias("dep_id"), H.short_id(ident, F.lit("S4")).alias("finding_id"), H.fingerprint(F.lit("S4"), F.lower("p_brand")).alias("fingerprint"))


def inventory_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an inventory: parts whose name, brand or type holds a string, most located first, after an offset."""
    located = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "part").withColumn("names", F.array(F.lower("p_name"), F.lower("p_brand"), F.lower("p_type"))).filter(F.exists("names", lambda x: F.contains(x, F.lit("#2"))))
    out = rows.join(located, F.col("p_partkey") == F.col("l_partkey"), "left").na.fill(0, ["n"])
    return out.orderBy(F.col("n").desc(), "p_type", F.lower("p_name"), "p_partkey").offset(10).limit(25).select("p_partkey", "n")


QUERIES = {
    f.__name__: f
    for f in (
        host_registrable, host_counts_all, host_suffix_classify, page_tiers, links_extract, main_text_title, main_text_len, image_link_census, phrase_hits, phrase_lost, phrase_proximity,
        sentences_prose, sentence_neighbours, exact_duplicate_groups, near_duplicate_simhash, simhash_builtin, row_set_hash, prose_alias_match, alias_resolve_priority, ambiguous_theta_match,
        domain_entries, priority_first_catalogue, anti_semi_suite, scope_select, json_props_shred, variant_walk_all, fit_weighted_mean, sessions_groups, shutdown_parse_all, ids_and_prints, inventory_browse,
    )
}

HOST_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '^www\.', '')"
OWNER_SQL = "CASE WHEN regexp_matches(h, '^[0-9.]*$') THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END"
TITLE_SQL = r"substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 160)"

_PIECES = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"
_PROSE = (
    rf"length(s) >= 20 AND NOT regexp_matches(s, '{K.MACHINE_PATTERN}') AND NOT regexp_matches(s, '{K.TITLE_PATTERN}')"
    r""" AND (length(s) >= 90 OR regexp_matches(s, '[.!?]["'')\]]?$')) AND NOT ends_with(s, '?') AND len(regexp_extract_all(s, '[A-Za-z][a-z'']+')) >= 5 AND regexp_matches(s, '[a-z]{3}[ ,][a-z]{2}')"""
    r" AND len(list_filter(string_split_regex(s, '\s+'), lambda w: regexp_matches(w, '^\p{Lu}'))) / greatest(len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')), 1) <= 0.45"
)


def _without_chrome(tags: str) -> str:
    out = "coalesce(html, '')"
    for t in tags.split():
        out = rf"regexp_replace({out}, '(?is)<{t}\b[^>]*>.*?</{t}>', chr(10), 'g')"
    return out


def _unescaped(text: str, **entities: int) -> str:
    for name, code in entities.items():
        text = f"replace({text}, '&{name};', chr({code}))"
    return text


ORACLE_SQL = {
    "sentences_prose": f"WITH d AS (SELECT doc_id, {_PIECES} AS raw FROM documents) SELECT doc_id, len(raw) AS pieces, len(list_filter(raw, lambda s: {_PROSE})) AS prose FROM d",
    "phrase_proximity": """
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE contains(lower(text), 'licens')), i AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS p FROM d),
p AS (SELECT doc_id, p, w FROM i, (SELECT unnest(['license', 'licensed']) AS w) WHERE t[p : p + length(w) - 1] = w), s AS (SELECT doc_id, p FROM i WHERE t[p : p + 7] = 'released' OR t[p : p + 4] = 'under'),
n AS (SELECT DISTINCT p.doc_id, w FROM p JOIN s ON p.doc_id = s.doc_id AND abs(p.p - s.p) <= 40)
SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY w), '') AS near FROM d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY 1""",
    "main_text_len": rf"""
WITH a AS (SELECT page_id, {_without_chrome('script style noscript nav header footer aside form svg template')} AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '{K.BLOCK_END_PATTERN}', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace({_unescaped('t', lt=60, gt=62, quot=34, nbsp=160, copy=169, middot=183)}, '&amp;?', '&', 'g') AS t FROM b),
l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{{a0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM c)
SELECT page_id, length(t) AS chars, len(string_split(t, chr(10))) AS lines FROM l""",
    "host_registrable": rf"""
WITH p AS (SELECT page_id, url, {HOST_SQL} AS h FROM pages)
SELECT page_id, h AS host, {OWNER_SQL} AS owner, CASE WHEN regexp_matches(url, '^(?i)https?:') THEN regexp_replace(regexp_replace(rtrim(trim(url), '.,;:!?)]}}''"*_'), '#.*$', ''), '\?$', '') ELSE '' END AS clean FROM p""",
    "host_counts_all": f"SELECT host, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) GROUP BY 1",
    "host_suffix_classify": f"""
WITH p AS (SELECT page_id, {HOST_SQL} AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'cheap-pills.example.com' OR host LIKE '%.cheap-pills.example.com' THEN 'EXCLUDED' WHEN host = 'm.example.net' OR host LIKE '%.m.example.net' THEN 'AUTHORITATIVE'
  WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'CORROBORATING' ELSE 'LEAD_ONLY' END AS tier FROM p""",
    "page_tiers": f"""
WITH p AS (SELECT url, {HOST_SQL} AS h FROM pages),
t AS (SELECT CASE WHEN h = '' OR contains(lower(url), 'best-') OR contains(lower(url), 'top-10') OR contains(lower(url), 'aggregator') THEN 'EXCLUDED'
  WHEN regexp_matches(h, '^(community|forum|forums|discuss|answers|ask|support-community|users|help-community)[.]') OR regexp_matches(lower(url), '/(t|questions|discussions|threads|topic|forum|community)/|/viewtopic') THEN 'LEAD_ONLY'
  WHEN h = 'example.org' OR h LIKE '%.example.org' THEN 'AUTHORITATIVE' ELSE 'LEAD_ONLY' END AS tier FROM p)
SELECT tier, tier = 'AUTHORITATIVE' AS substantiates, count(*) AS n FROM t GROUP BY 1, 2""",
    "links_extract": r"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*("[^"]+"|''[^'']+''|[^\s>"'']+)', 1) AS a FROM pages),
u AS (SELECT page_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM x),
d AS (SELECT page_id, regexp_replace(t, '^["'']|["'']$', '', 'g') AS target, min(i) AS i FROM u GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, target FROM d""",
    "main_text_title": f"SELECT page_id, {TITLE_SQL} AS title FROM pages",
    "image_link_census": f"""
WITH p AS (SELECT {HOST_SQL} AS host, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS a, regexp_extract_all(html, '<img[^>]*src="([^"]+)"', 1) AS i FROM pages),
a AS (SELECT host, count(DISTINCT x) AS n FROM (SELECT host, unnest(a) AS x FROM p) GROUP BY 1), i AS (SELECT host, count(DISTINCT x) AS n FROM (SELECT host, unnest(i) AS x FROM p) GROUP BY 1)
SELECT host, count(*) AS pages, coalesce(any_value(a.n), 0) AS anchors, coalesce(any_value(i.n), 0) AS images FROM p LEFT JOIN a USING (host) LEFT JOIN i USING (host) GROUP BY 1""",
    "phrase_hits": """
SELECT phrase, count(*) AS n, min(doc_id) AS first FROM documents, (SELECT unnest(['license', 'public license', 'the and', 'contact', 'token']) AS phrase) WHERE contains(lower(text), phrase) GROUP BY 1""",
    "phrase_lost": """
WITH c AS (SELECT lower(text) AS now, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT word, count(*) AS n FROM c, (SELECT unnest(['the ', 'and ', 'die ', 'que ', 'de ']) AS word) WHERE before IS NOT NULL AND contains(before, word) AND NOT contains(now, word) GROUP BY 1""",
    "sentence_neighbours": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS place FROM d),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM u)
SELECT doc_id, place, length(line) AS own, coalesce(length(after), 0) AS next FROM n WHERE lower(line) LIKE '%licens%'""",
    "exact_duplicate_groups": "SELECT sha256(text) AS text_id, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "row_set_hash": "SELECT CAST(n_regionkey AS BIGINT) AS region, sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey || '|' || n_name)) AS hash FROM nation GROUP BY 1",
    "prose_alias_match": r"""
WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\w.\-]+', '  ', 'g') || ' ' AS t FROM documents),
e AS (SELECT doc_id, replace(replace(replace(t, ' general  public  license ', ' [general public license] '), ' public  license ', ' [public license] '), ' creative  commons ', ' [creative commons] ') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(t, ' (license|mit|apache)([. ])', ' [\1]\2', 'g') AS t FROM e),
g AS (SELECT doc_id, regexp_replace(t, ' (general  public  license|public  license|creative  commons)[.]', ' [\1]', 'g') AS t FROM f),
x AS (SELECT doc_id, replace(unnest(regexp_extract_all(t, '\[([^\]]*)\]', 1)), '  ', ' ') AS alias FROM g)
SELECT CASE alias WHEN 'general public license' THEN 'gpl' WHEN 'public license' THEN 'licence' WHEN 'license' THEN 'licence' WHEN 'creative commons' THEN 'cc' ELSE alias END AS entry,
       alias, count(*) AS n, count(DISTINCT doc_id) AS documents FROM x GROUP BY 1, 2""",
    "alias_resolve_priority": r"""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'service:' ELSE 'tool:' END || p_type AS entry_id, CASE WHEN p_partkey % 2 = 0 THEN 'service' ELSE 'package' END AS wanted_kind, count(*) AS n FROM part GROUP BY 1, 2""",
    "ambiguous_theta_match": r"""
WITH b AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS stem FROM nation),
k AS (SELECT regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') AS key, r_name AS course FROM region UNION ALL SELECT substr(regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g'), 1, 7), n_name FROM nation WHERE n_nationkey % 3 = 0),
h AS (SELECT stem, max(CASE WHEN stem = key THEN course END) AS exact, count(DISTINCT course) AS n, min(course) AS one FROM b JOIN k ON stem = key OR (length(key) >= 5 AND (contains(stem, key) OR contains(key, stem))) GROUP BY 1),
r AS (SELECT CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN one ELSE '' END AS course, exact IS NULL AND coalesce(n, 0) <> 1 AS bad FROM b LEFT JOIN h USING (stem))
SELECT course, count(*) AS n, count(*) FILTER (bad) AS problems FROM r GROUP BY 1""",
    "domain_entries": f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS h FROM pages), o AS (SELECT page_id, h, {OWNER_SQL} AS owner FROM h),
d AS (SELECT h AS domain, min(page_id) AS ord FROM o WHERE page_id % 4 = 0 GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('example.org', 1000000), ('example.net', 1000001)) v),
e AS (SELECT domain, min(ord) AS ord FROM d GROUP BY 1)
SELECT 'e' || coalesce(x.ord, y.ord) AS entry_id, count(*) AS n FROM o LEFT JOIN e x ON o.h = x.domain LEFT JOIN e y ON o.owner = y.domain GROUP BY 1""",
    "priority_first_catalogue": """
WITH f AS (SELECT l_partkey, min(l_suppkey) AS s, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT lower(p_brand) AS brand, CAST(sum(s) AS BIGINT) AS suppliers, CAST(sum(n) AS BIGINT) AS listings, count(*) FILTER (s IS NULL) AS unlisted FROM part LEFT JOIN f ON p_partkey = l_partkey GROUP BY 1""",
    "anti_semi_suite": """
WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has FROM customer)
SELECT nation, count(*) FILTER (has) AS with_orders, count(*) FILTER (NOT has) AS without FROM c GROUP BY 1""",
    "scope_select": """
SELECT c_custkey AS dep_id, c_mktsegment AS kind, CASE WHEN c_acctbal > 5000 THEN 'critical' ELSE 'standard' END AS watch_tier FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE month(o_orderdate) IN (3, 4, 5))""",
    "json_props_shred": "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'k' AS BIGINT)) AS most, count(props->>'k') AS n FROM events GROUP BY 1",
    "variant_walk_all": """
WITH e AS (SELECT count(*) AS n FROM events)
SELECT p AS path, n, CAST(d AS BIGINT) AS depth FROM e, (VALUES ('$', 0), ('$.a', 1), ('$.b', 1), ('$.a.props', 2), ('$.a.t', 2), ('$.b[0]', 2), ('$.b[1]', 2), ('$.a.props.k', 3), ('$.b[1].v', 3)) v(p, d)""",
    "fit_weighted_mean": """
WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
f AS (SELECT vec_id, CASE WHEN v[1] > -0.1 THEN round(v[1] * 4, 2) END AS a, CASE WHEN v[2] > -0.05 THEN round(v[2] * 4, 2) END AS b, CASE WHEN v[3] > 0 THEN round(v[3] * 4, 2) END AS c, round(v[4] * 4, 2) AS d,
             CASE WHEN v[5] > 0.05 THEN NULL ELSE round(v[5] * 4, 2) END AS e FROM e),
g AS (SELECT vec_id, unnest([a, b, c, d, e]) AS x, unnest([40, 25, 15, 10, 10]) AS w, unnest([true, false, false, false, false]) AS central FROM f),
h AS (SELECT vec_id, CASE WHEN x IS NOT NULL THEN CAST(round(least(1, greatest(0, x)) * 100) AS BIGINT) END AS x, w, central FROM g),
m AS (SELECT vec_id, coalesce(bool_or(central AND x IS NOT NULL) AND count(x) >= 3, false) AS enough, CAST(sum(x * w) AS BIGINT) AS mass, CAST(sum(w) FILTER (x IS NOT NULL) AS BIGINT) AS total FROM h GROUP BY 1)
SELECT vec_id, CASE WHEN enough THEN (20 * mass + total) // (2 * total) END AS fit_thousandths FROM m""",
    "sessions_groups": """
SELECT CASE WHEN turn < 6 THEN turn END AS session, count(*) AS n, count(*) FILTER (role = 'user') AS users, count(DISTINCT conv_id) AS conversations, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1""",
    "shutdown_parse_all": """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 = 4 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 120 MONTH AS DATE) END AS VARCHAR) AS date FROM orders""",
    "ids_and_prints": """
WITH d AS (SELECT p_partkey, lower(p_brand) AS b, substr(sha256('package' || chr(31) || lower(p_name)), 1, 16) AS dep_id FROM part)
SELECT p_partkey, dep_id, substr(sha256(dep_id || chr(31) || 'S4'), 1, 16) AS finding_id, substr(sha256('S4|' || b), 1, 16) AS fingerprint FROM d""",
    "inventory_browse": """
SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
WHERE contains(lower(p_name), '#2') OR contains(lower(p_brand), '#2') OR contains(lower(p_type), '#2') ORDER BY 2 DESC, p_type, lower(p_name), p_partkey LIMIT 25 OFFSET 10""",
}
