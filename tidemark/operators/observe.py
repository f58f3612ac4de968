"""Observations of the outside world, read from snapshots: pages folded into a status, package and node probes, pricing memory.

``unreachable`` is not ``broken``, and a first sight is a baseline, never a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import code as C
from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.functions import ladders as L
from tidemark.functions import text as T
from tidemark.operators import dictionary
from tidemark.operators import resolve
from tidemark.sources import snapshots


def url_observations(targets: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row for each target URL: targets(dep_id, ord, url, terms array) against fetches(url, status, final_url, error, body)."""
    page = T.main_text(F.col("body"))
    rows = targets.join(fetches.withColumn("page", page), "url", "left")
    status = F.col("status")
    return rows.select(
        "dep_id", "ord", "url", status.alias("http_status"), "final_url", "page",
        F.coalesce(status.isin(404, 410), F.lit(False)).alias("gone"),
        F.coalesce(status.isin(401, 403, 429, 451), F.lit(False)).alias("blocked"),
        (status.isNotNull() & (status < 500)).alias("reachable"),
        F.coalesce(F.col("error") == "disallowed_by_robots", F.lit(False)).alias("robots"),
        (F.size(T.hits(F.col("page"), K.PARKED)) > 0).alias("parked"),
        T.hits(F.col("page"), K.WALL).alias("wall"), T.hits(F.col("page"), (*K.SUNSET_STRONG, *K.SUNSET_WEAK)).alias("sunset"),
        (F.size(T.hits_near(F.col("page"), K.SUNSET_STRONG, F.col("terms"))) > 0).alias("sunset_near"),
        F.coalesce(_off_path(F.col("url"), F.col("final_url")), F.lit(False)).alias("moved"),
    )


def _off_path(url: Column, final: Column) -> Column:
    """Whether a page with a path of its own now ends on another host or on the front page."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = lambda u: F.rtrim(F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    return (F.coalesce(final, F.lit("")) != "") & ((host(url) != host(final)) | ((path(url) != "") & (path(final) == "")))


def folded(observed: DataFrame) -> DataFrame:
    """dep_id, status, signal: several observations of a dependency folded into one status by strict precedence.

    Flags are aggregated first and one cascade decides, so the order of observations can't matter.
    """
    has, every = (lambda c: F.bool_or(F.col(c)).alias(c)), (lambda c: F.bool_and(F.col(c)).alias(f"all_{c}"))
    facts = observed.groupBy("dep_id").agg(*map(has, ("parked", "gone", "reachable", "blocked", "sunset_near", "moved")), every("robots"), F.bool_and(~F.col("reachable") | F.col("blocked")).alias("only_blocked"), F.max("drift").alias("drift"))
    far = F.col("drift") > K.SIMHASH_FAR
    cascade = [
        (F.col("parked"), "broken", "domain_parked"), (F.col("gone"), "broken", "url_gone"), (F.col("all_robots"), "inconclusive", "disallowed_by_robots"),
        (~F.col("reachable"), "unreachable", ""), (F.col("only_blocked") & F.col("blocked"), "inconclusive", "blocked_by_host"),
        (F.col("sunset_near"), "changed", "sunset_language_about_subject"), (F.col("moved"), "changed", "redirected_off_path"), (F.coalesce(far, F.lit(False)), "changed", "page_text_changed"),
    ]
    status, signal = F, F
    for rule, s, g in cascade:
        status, signal = status.when(rule, s), signal.when(rule, g)
    return facts.select("dep_id", status.otherwise("ok").alias("status"), signal.otherwise("").alias("signal"))


def packages(dependencies: DataFrame, registry: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """dep_id, status, signals, latest_version: packages against their registry's snapshot and the version of the last run.

    dependencies(dep_id, registry, registry_id, taught_version), registry(registry, name, found, reachable, latest_version, released_at, yanked, deprecated),
    previous(dep_id, latest_version).
    """
    reg = registry.select("registry", F.col("name").alias("registry_id"), "found", "reachable", "latest_version", "released_at", (F.coalesce("yanked", F.lit(False)) | F.coalesce("deprecated", F.lit(False))).alias("bad"))
    rows = dependencies.join(reg, ["registry", "registry_id"], "left").join(previous.select("dep_id", F.col("latest_version").alias("before")), "dep_id", "left")
    found, reachable = F.coalesce("found", F.lit(False)), F.coalesce("reachable", F.lit(False))
    released = (F.coalesce("before", F.lit("")) != "") & (F.coalesce("latest_version", F.lit("")) != "") & (F.col("before") != F.col("latest_version"))
    behind = (F.coalesce("taught_version", F.lit("")) != "") & (F.coalesce("latest_version", F.lit("")) != "") & (C.major(F.col("taught_version")) != C.major(F.col("latest_version")))
    status = F.when(~found & reachable, "broken").when(~found, "unreachable").when(F.col("bad") | released, "changed").otherwise("ok")
    flags = F.array_compact(F.array(
        F.when(~found & reachable, "registry_missing"), F.when(found & F.col("bad"), "registry_deprecated"), F.when(found & ~F.col("bad") & released, "new_release"),
        F.when(found & behind, "major_behind_taught_pin"), F.when(found & (L.days_since(F.col("released_at"), now) > K.STALE_RELEASE_DAYS), "no_release_in_2y"),
    ))
    return rows.select("dep_id", status.alias("status"), flags.alias("signals"), "latest_version")


#: Registries by precedence.
REGISTRIES = ("pypi", "npm")


def unresolved_tools(dependencies: DataFrame, locations: DataFrame, unpinned: bool = False) -> DataFrame:
    """Tools without a domain or a registry that a sheet pins to a version; with unpinned, the rest of them too."""
    tools = dependencies.filter((F.col("kind") == "tool") & (F.size(F.coalesce("official_domains", F.array().cast("array<string>"))) == 0) & (F.coalesce("registry", F.lit("")) == ""))
    return tools if unpinned else tools.join(locations.filter("evidence_source = 'sheet_pin'").select("dep_id"), "dep_id", "left_semi")


def registry_lookup(tools: DataFrame, entries: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, entry_id, registry, latest_version) of tools that a registry serves under their name, the first registry in order; names that none serves.

    Names without an entry of kind tool are neither. An entry moves by the first of its names that is served; names after that find no tool.
    """
    names = tools.select(F.col("canonical_name").alias("name"), F.lit("tool").alias("wanted_kind")).distinct()
    known = resolve.resolved(names, resolve.alias_index(entries), strict=True).filter("entry_id is not null").select("name", "entry_id")
    order = F.array_position(F.array(*map(F.lit, REGISTRIES)), F.col("registry"))
    hits = registry.filter(F.col("found") & F.col("registry").isin(*REGISTRIES)).groupBy("name").agg(F.min_by(F.struct("registry", "latest_version"), order).alias("hit"))
    looked = known.join(hits, "name", "left")
    first = looked.groupBy("entry_id").agg(F.min(F.when(F.col("hit").isNotNull(), F.col("name"))).alias("served"))
    looked = looked.join(first, "entry_id").filter("served is null OR name <= served")
    return looked.filter("hit is not null").select("name", "entry_id", "hit.registry", "hit.latest_version"), looked.filter("hit is null").select("name")


def retyped(entries: DataFrame, served: DataFrame) -> DataFrame:
    """Registry entries with the served tools as packages of that registry, under their new key, merged with an entry that has the key already."""
    found = served.select("entry_id", F.col("registry").alias("__home"), F.col("name").alias("__name"))
    text = F.concat(F.lit("retyped tool->package: "), F.col("__home"), F.lit(" serves a project under this name, so the registry is its authority"))
    notes = F.when(F.coalesce("notes", F.lit("")) == "", text).otherwise(F.concat("notes", F.lit(" | "), text))
    moved = entries.join(found, "entry_id").withColumns({"entry_id": F.concat_ws(":", F.lit("package"), T.norm(F.col("canonical_name"))), "kind": F.lit("package"), "registry": F.col("__home"), "registry_id": F.col("__name"), "review_status": F.lit("approved"), "notes": notes})
    return snapshots.merged_entries(entries.join(found, "entry_id", "left_anti"), moved.select(*entries.columns))


def models(dependencies: DataFrame, catalogue: DataFrame, vendors: DataFrame, today: Column) -> DataFrame:
    """dep_id, status, signals, provider, replacements: model ids against vendors' own catalogues; the first vendor that lists an id serves it.

    catalogue(vendor, entry_id, status, shutdown_date, replacement_ids, still_listed, listed_price, rate_limit), vendors(vendor, ord, ok, supported).
    Ids match exactly but for case, never by part.
    """
    readable = catalogue.join(vendors.filter("ok AND supported").select("vendor", "ord"), "vendor").withColumn("key", F.lower(F.trim("entry_id")))
    rows = dependencies.withColumn("key", F.lower(F.trim("canonical_name")))
    listed = rows.select("key").distinct().join(readable, "key").groupBy("key").agg(F.min_by(F.struct(*readable.columns), F.col("ord")).alias("e"))
    unreadable = F.coalesce(vendors.agg(F.bool_or(~F.col("ok"))).scalar(), F.lit(False))
    out = rows.join(listed, "key", "left")
    e = F.col("e")
    retired, when = F.coalesce(e["status"].isin(*K.RETIRED), F.lit(False)), L.shutdown_date(e["shutdown_date"])
    blob = F.lower(F.concat_ws(" ", e["listed_price"], e["rate_limit"]))
    restricted = retired & F.coalesce(e["still_listed"], F.lit(False)) & F.exists(T.strings(K.QUOTED_PRICES), lambda p: F.contains(blob, p))
    gone = e["status"].isin("shut down", "removed")
    says = lambda status, signal: F.struct(F.lit(status).alias("status"), F.lit(signal).alias("signal"))
    ladder = (
        F.when(e.isNull() & unreadable, says("inconclusive", "model_catalogue_unreadable")).when(e.isNull(), says("ok", "model_provider_unknown"))
        .when(~retired, says("ok", "model_listed_available")).when(restricted, says("broken", "model_tier_restricted")).when(F.col("when") <= today, says("broken", "model_shutdown_passed"))
        .when(F.col("when").isNotNull(), says("changed", "model_deprecation_declared")).when(gone, says("broken", "model_shutdown_passed")).otherwise(says("changed", "model_deprecation_declared"))
    )
    named = retired & (F.size(F.coalesce(e["replacement_ids"], F.array().cast("array<string>"))) > 0)
    return out.withColumn("when", when).withColumn("l", ladder).select("dep_id", "canonical_name", F.col("l.status").alias("status"), F.array_compact(F.array(F.col("l.signal"), F.when(named, "vendor_named_replacement"))).alias("signals"), e["vendor"].alias("provider"), F.when(retired, e["replacement_ids"]).alias("replacements"))


def served_replacements(probed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """dep_id, name: replacements that the same vendor still serves."""
    asked = probed.select("dep_id", F.col("provider").alias("vendor"), F.explode("replacements").alias("name")).withColumn("key", F.lower(F.trim("name")))
    served = catalogue.filter(~F.col("status").isin(*K.RETIRED)).select("vendor", F.lower(F.trim("entry_id")).alias("key")).distinct()
    return asked.join(served, ["vendor", "key"], "left_semi").select("dep_id", "name")


def nodes(dependencies: DataFrame, index: DataFrame, rules: DataFrame, upstream_ok: bool) -> DataFrame:
    """dep_id, status, signal, rule_id: workflow nodes against the upstream index and its declared changes.

    A rule that names nodes hits those alone; one that names none hits a node whose last name it mentions.
    """
    if not upstream_ok:
        return dependencies.select("dep_id", F.lit("inconclusive").alias("status"), F.lit("n8n_upstream_unreachable").alias("signal"), F.lit(None).cast("string").alias("rule_id"))
    leaf = F.substring_index("canonical_name", ".", -1)
    human = F.lower(F.regexp_replace(leaf, "(?<!^)(?=[A-Z])", " "))
    rows = dependencies.withColumn("there", F.lit(True)).select("dep_id", "canonical_name", leaf.alias("leaf"), human.alias("human"))
    gone = rows.join(index.select(F.col("node").alias("canonical_name")), "canonical_name", "left_anti").select("dep_id", F.lit(True).alias("gone"))
    named = rows.join(rules.select("rule_id", F.explode("node_types").alias("canonical_name")), "canonical_name").groupBy("dep_id").agg(F.min("rule_id").alias("named"))
    blob = F.lower(F.concat_ws(" ", "title", "description"))
    general = rules.filter(F.size("node_types") == 0).select("rule_id", blob.alias("blob"))
    terms = rows.select("dep_id", F.explode(F.array_distinct(F.array(F.lower("leaf"), F.lower("human")))).alias("term")).filter(F.length("term") > 3)
    capable = dictionary.containing(general, "blob", terms, "term").groupBy("dep_id").agg(F.min("rule_id").alias("possible"))
    out = rows.join(gone, "dep_id", "left").join(named, "dep_id", "left").join(capable, "dep_id", "left")
    status = F.when(F.col("gone"), "broken").when(F.col("named").isNotNull() | F.col("possible").isNotNull(), "changed").otherwise("ok")
    signal = F.when(F.col("gone"), "node_removed_upstream").when(F.col("named").isNotNull(), "breaking_change_declared").when(F.col("possible").isNotNull(), "breaking_change_possible").otherwise("")
    return out.select("dep_id", status.alias("status"), signal.alias("signal"), F.when(F.col("gone").isNull(), F.coalesce("named", "possible")).alias("rule_id"))


def pricing(observed: DataFrame, previous: DataFrame) -> DataFrame:
    """dep_id, signals, lost: pricing pages against the phrases and the hash of the last run; a page seen first is a baseline.

    observed(dep_id, page), previous(dep_id, text_hash, free).
    """
    rows = observed.withColumns({"text_hash": H.simhash(F.col("page")), "free": T.hits(F.col("page"), K.FREE_SIGNALS), "paid": T.hits(F.col("page"), K.PAID_SIGNALS)})
    rows = rows.join(previous.select("dep_id", F.col("text_hash").alias("old_hash"), F.col("free").alias("old_free")), "dep_id", "left")
    lost = F.coalesce(F.array_except("old_free", "free"), F.array().cast("array<string>"))
    first = F.coalesce("old_hash", F.lit("")) == ""
    flags = F.array_compact(F.array(F.when(F.size(lost) > 0, "free_tier_language_lost"), F.when(F.size("paid") > 0, "pricing_restriction_language"), F.when(H.distance(F.col("old_hash"), F.col("text_hash")) > K.SIMHASH_FAR, "pricing_page_changed")))
    return rows.select("dep_id", F.when(first, F.array(F.lit("pricing_baseline_recorded"))).otherwise(flags).alias("signals"), F.when(first, F.array().cast("array<string>")).otherwise(lost).alias("lost"))
