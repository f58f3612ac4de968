"""The inventory: dependencies and where they are used, extracted in two passes.

The first pass reads what stands on its own (links, imports, installs, models, nodes); what it finds becomes aliases; the second matches
those aliases in prose and resolves what was left over. Between the passes the registry is a table, so the fixpoint is two plain stages.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import code as C
from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import dictionary, resolve, score
from tidemark.sources.stages import staged

_PLACE = ("course", "topic_name", "unit_id", "unit_name", "content_id", "field_path", "object_type", "session_no")


def _found(records: DataFrame, items: Column, kind: str, name: Column, evidence: Column, domains: Column | None = None, version: Column | None = None) -> DataFrame:
    rows = records.select(*_PLACE, F.explode(items).alias("x"))
    none = F.array().cast("array<string>")
    return rows.select(F.lit(kind).alias("kind"), name.alias("name"), evidence.alias("evidence_source"), (none if domains is None else domains).alias("domains"), (F.lit("") if version is None else version).alias("taught_version"), *_PLACE)


def link_mentions(records: DataFrame, skip: tuple[str, ...] = K.SKIP_HOSTS, internal: tuple[str, ...] = ()) -> DataFrame:
    """Services that authored links point at; citations and plumbing left out."""
    rows = records.select(*_PLACE, F.explode(U.links(F.col("body_text"), internal)).alias("l"))
    owner = U.registrable(U.host(F.col("l.url")))
    rows = rows.withColumn("owner", owner).filter(~F.col("owner").isin(*skip) & ~U.is_citation(F.col("l.url")))
    name = U.service_name(F.col("owner"))
    rows = rows.withColumn("name", name).filter(F.length("name") >= 3)
    return rows.select(F.lit("service").alias("kind"), "name", F.concat(F.lit("link:"), F.col("l.syntax")).alias("evidence_source"), F.array_distinct(F.array("owner", U.host(F.col("l.url")))).alias("domains"), F.lit("").alias("taught_version"), *_PLACE)


def package_mentions(records: DataFrame) -> DataFrame:
    body = F.col("body_text")
    imported = _found(records.filter("evidence_source = 'solution_code'"), C.imports(body), "package", F.col("x.name"), F.lit("solution_import"))
    prose = records.filter(F.col("evidence_source").isin("markdown", "solution_prose"))
    pinned = F.transform(C.installs(body), lambda p: F.struct(p["name"].alias("name"), F.element_at(F.concat(F.transform(F.filter(C.pins(body), lambda q: q["name"] == p["name"]), lambda q: q["version"]), F.array(F.lit(""))), 1).alias("version")))
    installed = _found(prose, pinned, "package", F.col("x.name"), F.lit("install_command"), None, F.col("x.version"))
    return imported.unionByName(installed)


def model_mentions(records: DataFrame) -> DataFrame:
    return _found(records, C.models(F.col("body_text")), "model", F.col("x"), F.lit("model_id"))


def node_mentions(records: DataFrame) -> DataFrame:
    """Workflow nodes: out of JSON at any depth, each with its own version, without any from other text."""
    named = records.filter(F.contains("body_text", F.lit("n8n-nodes")))
    named = named.withColumn("nodes", C.json_nodes(F.col("body_text")))
    typed = F.filter("nodes", lambda n: ~F.lower(F.substring_index(n["type"], ".", -1)).isin(*K.PLACEHOLDER_NODES))
    bare = F.transform(C.node_mentions(F.col("body_text")), lambda t: F.struct(t.alias("type"), F.lit("").alias("version")))
    items = U.first_each(F.when(F.col("nodes").isNotNull(), F.concat(typed, F.filter(bare, lambda b: ~F.exists(typed, lambda t: t["type"] == b["type"])))).otherwise(bare), lambda x: x)
    return _found(named, items, "n8n_node", F.col("x.type"), F.lit("n8n_workflow"), F.array(F.lit("n8n.io"), F.lit("docs.n8n.io")), F.col("x.version"))


def structured(records: DataFrame) -> DataFrame:
    """Pass one: all mentions that need no registry."""
    fields = records.filter(~F.col("evidence_source").isin("question_tag", "test_case_enum"))
    return link_mentions(fields).unionByName(package_mentions(fields)).unionByName(model_mentions(fields)).unionByName(node_mentions(fields))


def entries_of(mentions: DataFrame) -> DataFrame:
    """Registry entries that mentions imply: entry_id, kind, canonical_name, aliases, ord (the earliest place, for first-come precedence)."""
    place = F.concat_ws("/", "course", "field_path", "name")
    rows = mentions.groupBy("kind", T.norm(F.col("name")).alias("key")).agg(F.min_by("name", place).alias("canonical_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("aliases"), F.min(place).alias("ord"))
    return rows.select(F.concat_ws(":", "kind", "key").alias("entry_id"), "kind", "canonical_name", "aliases", "ord")


PROSE_KINDS = ("service", "tool")


def prose_mentions(records: DataFrame, entries: DataFrame, stop: tuple[str, ...] = (), shortest: int = 5) -> DataFrame:
    """Pass two: aliases of services and tools in prose, longest first, on word bounds; the dictionary may be as large as it likes."""
    aliases = resolve.alias_index(entries.filter(F.col("kind").isin(*PROSE_KINDS))).filter((F.length("alias_key") >= shortest) & ~F.col("alias_key").rlike("^[0-9]+$"))
    aliases = aliases.filter(~F.col("alias_key").isin(*stop)) if stop else aliases
    first = aliases.groupBy("alias_key").agg(F.min_by("entry_id", "ord").alias("entry_id"))
    prose = records.filter(F.col("evidence_source").isin("markdown", "solution_prose", "title"))
    rows = dictionary.matched(prose, "body_text", first, "alias_key").select(*_PLACE, F.explode("found").alias("alias_key"))
    named = rows.join(first, "alias_key").join(entries.select("entry_id", "kind", F.col("canonical_name").alias("name")), "entry_id")
    return named.select("kind", "name", F.lit("prose_name").alias("evidence_source"), F.array().cast("array<string>").alias("domains"), F.lit("").alias("taught_version"), *_PLACE)


def tag_mentions(records: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags that resolve to an entry, and the rest as candidates (name, n, courses) for review; machine-made ids are neither."""
    tags = records.filter("evidence_source = 'question_tag'").withColumn("name", F.trim("body_text")).filter(~F.col("name").rlike("^[a-z0-9]+(_[a-z0-9]+)+$") & (F.length("name") >= 3))
    found = resolve.resolved(tags.withColumn("wanted_kind", F.lit(None).cast("string")), resolve.alias_index(entries))
    known = found.filter("entry_id is not null").drop("name").join(entries.select("entry_id", "kind", F.col("canonical_name").alias("name")), "entry_id")
    known = known.select("kind", "name", F.lit("question_tag").alias("evidence_source"), F.array().cast("array<string>").alias("domains"), F.lit("").alias("taught_version"), *_PLACE)
    rest = found.filter("entry_id is null").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("course")).alias("courses"))
    return known, rest


def built(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """dependencies, locations and tag candidates of records."""
    records = staged(records)  # every extractor reads them
    first = staged(structured(records))
    entries = staged(entries_of(first))
    tags, candidates = tag_mentions(records, entries)
    mentions = first.unionByName(prose_mentions(records, entries)).unionByName(tags)
    keyed = staged(mentions.withColumn("dep_id", H.dep_id(F.col("kind"), T.norm(F.col("name")))))  # read for places, tiers and names
    locations = keyed.select("dep_id", "kind", "evidence_source", *_PLACE).dropDuplicates()
    tiers = locations.groupBy("dep_id").agg(score.watch_tier(F.col("evidence_source"), score.graded(F.col("object_type"))).alias("watch_tier"), F.count(F.lit(1)).alias("n_locations"))
    place = F.concat_ws("/", "course", "field_path", "name")
    dependencies = keyed.groupBy("dep_id", "kind").agg(F.min_by("name", place).alias("canonical_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains")))).alias("official_domains"), F.min_by("taught_version", F.when(F.col("taught_version") != "", place)).alias("taught_version"))
    return dependencies.join(tiers, "dep_id"), locations, candidates
