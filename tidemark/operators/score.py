"""Scoring: reach of a dependency, findings from observations and claims, and their projection onto one course.

Tables: locations(dep_id, course, unit_id, unit_name, content_id, evidence_source, object_type, session_no),
dependencies(dep_id, kind, canonical_name, watch_tier, ...), probes(dep_id, status, signals array, ...),
claims(dep_id, kind, quote, source_url, substantiates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.functions import ladders as L
from tidemark.functions.text import strings


def graded(object_type: Column) -> Column:
    return F.coalesce(object_type.isin(*K.GRADED_TYPES), F.lit(False))


def tenths(evidence: Column, is_graded: Column) -> Column:
    """Weight of one location in tenths; grading doubles what isn't a passing mention."""
    weight = F.coalesce(L.lookup(K.EVIDENCE_TENTHS, evidence), F.lit(K.OTHER_TENTHS))
    return weight * F.when(is_graded & ~evidence.isin(*K.PASSING), K.GRADED_TIMES).otherwise(1)


def blast(evidence: Column, is_graded: Column) -> Column:
    """Aggregate: reach of a group's locations, rounded half to even. Tenths add up exactly in any order."""
    return F.bround(F.sum(tenths(evidence, is_graded)) / 10).cast("long")


def watch_tier(evidence: Column, is_graded: Column) -> Column:
    """Aggregate: critical where something runs or is visited for marks, standard where visited, else mention-only."""
    runs = F.bool_or(evidence.isin(*K.RUNTIME))
    marked = F.bool_or(evidence.isin(*K.VISITED) & is_graded)
    return F.when(runs | marked, "critical").when(F.bool_or(evidence.isin(*K.VISITED)), "standard").otherwise("mention-only")


def executes(kind: Column, evidence: Column, object_type: Column) -> Column:
    """Whether a graded item runs the thing rather than names it."""
    return evidence.isin(*K.EXECUTING) | ((kind == "model") & (evidence == "model_id") & (object_type == "CODING_QUESTIONS"))


def reach(locations: DataFrame, *keys: str) -> DataFrame:
    """Per key: blast_radius, tenths, locations, graded_locations, questions_executing, questions_mentioning.

    ``locations`` has kind next to its own columns. The same function serves the global numbers and every projection: only keys differ.
    """
    is_graded = graded(F.col("object_type"))
    question = is_graded & (F.coalesce("content_id", F.lit("")) != "")
    runs = executes(F.col("kind"), F.col("evidence_source"), F.col("object_type"))
    return locations.groupBy(*keys).agg(
        blast(F.col("evidence_source"), is_graded).alias("blast_radius"),
        F.sum(tenths(F.col("evidence_source"), is_graded)).cast("long").alias("tenths"),
        F.count(F.lit(1)).alias("locations"),
        F.count_if(is_graded & ~F.col("evidence_source").isin(*K.PASSING)).alias("graded_locations"),
        F.count_if(question & runs).alias("questions_executing"),
        F.count_if(question & ~runs).alias("questions_mentioning"),
    )


def probe_signals(probes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """dep_id, probe_signal, signal: probe signals that are news. Prose churn on a mention and a bare release bump aren't."""
    rows = probes.select("dep_id", "status", F.col("signals").alias("all_signals"), F.explode("signals").alias("probe_signal")).join(dependencies.select("dep_id", "watch_tier"), "dep_id")
    bare = F.array_contains("all_signals", "new_release") & ~F.array_contains("all_signals", "major_behind_taught_pin")
    quiet = ((F.col("probe_signal") == "page_text_changed") & (F.col("watch_tier") == "mention-only")) | ((F.col("probe_signal") == "new_release") & bare)
    return rows.filter(~quiet).withColumn("signal", L.lookup(K.PROBE_SIGNAL, F.col("probe_signal"))).filter("signal is not null").select("dep_id", "probe_signal", "signal")


def claim_signals(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """dep_id, signal, source_url: claims that may settle something. Prices alone are no news, nor is an interface claim without a probe."""
    restricted = F.exists(strings(K.PRICING_RESTRICTION), lambda p: F.contains(F.lower(F.col("quote")), p))
    probed = probes.select("dep_id", F.lit(True).alias("probed")).distinct()
    rows = claims.filter("substantiates").withColumn("signal", L.lookup(K.CLAIM_SIGNAL, F.col("kind"))).filter("signal is not null")
    rows = rows.filter((F.col("kind") != "pricing") | restricted).join(probed, "dep_id", "left")
    return rows.filter((F.col("kind") != "implementation") | F.coalesce("probed", F.lit(False))).select("dep_id", "signal", "source_url")


#: Probe signals that rest on what a vendor declares.
FROM_VENDOR = ("breaking_change_declared", "breaking_change_possible", "model_shutdown_passed", "model_tier_restricted", "model_deprecation_declared")


def findings(dependencies: DataFrame, locations: DataFrame, probes: DataFrame, claims: DataFrame, alternatives: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """finding_id, dep_id, signal, label, kind_of_signal, severity, blast_radius, probe_signals, evidence_urls and counts.

    declared: the worst severity that a vendor states for its change (column of probes, may be null). notes(dep_id, note) of changes that can't
    be cited (``evidence.declared``) join the probe signals of what the vendor declared. Each rule of the program is one
    step: signals to news, news to findings, severities by signal, then what depends on a dependency's other findings.
    """
    numbers = reach(locations.join(dependencies.select("dep_id", "kind"), "dep_id"), "dep_id")
    observed = probe_signals(probes, dependencies).groupBy("dep_id", "signal").agg(F.array_sort(F.collect_set("probe_signal")).alias("probe_signals"))
    claimed = claim_signals(claims, probes).groupBy("dep_id", "signal").agg(F.array_sort(F.collect_set("source_url")).alias("evidence_urls"))
    # a broken thing of which nothing more is known is a dead URL
    broken = probes.filter("status = 'broken'").join(observed.select("dep_id").distinct(), "dep_id", "left_anti")
    broken = broken.select("dep_id", F.lit("S1").alias("signal"), F.array(F.lit("broken")).alias("probe_signals"))
    none = F.array().cast("array<string>")
    both = observed.unionByName(broken).join(claimed, ["dep_id", "signal"], "full").select("dep_id", "signal", F.coalesce("probe_signals", none).alias("probe_signals"), F.coalesce("evidence_urls", none).alias("evidence_urls"))
    if alternatives is not None:
        dead = both.filter(F.col("signal").isin("S1", "S4")).select("dep_id").distinct()
        better = alternatives.join(dead, "dep_id", "left_anti").groupBy("dep_id").agg(F.array_sort(F.collect_set("source_url")).alias("evidence_urls"))
        both = both.unionByName(better.select("dep_id", F.lit("S10").alias("signal"), none.alias("probe_signals"), "evidence_urls"))
    rows = both.join(dependencies.select("dep_id", "kind", "canonical_name", "watch_tier"), "dep_id").join(numbers, "dep_id", "left").na.fill(0, ["blast_radius", "questions_executing", "graded_locations", "questions_mentioning", "locations"])
    # a model's deprecation is a retired model
    rows = rows.withColumn("signal", F.when((F.col("kind") == "model") & (F.col("signal") == "S4"), "S7").otherwise(F.col("signal")))
    rows = rows.groupBy("dep_id", "signal", "kind", "canonical_name", "watch_tier", "blast_radius", "locations", "graded_locations", "questions_executing", "questions_mentioning").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("probe_signals")))).alias("probe_signals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_urls")))).alias("evidence_urls"))
    declared = probes.select("dep_id", F.col("declared_severity")) if "declared_severity" in probes.columns else probes.select("dep_id", F.lit(None).cast("string").alias("declared_severity"))
    rows = _severity(rows.join(declared, "dep_id", "left"))
    if notes is not None:
        told = notes.groupBy("dep_id").agg(F.array_sort(F.collect_set("note")).alias("__notes"))
        rows = rows.join(told, "dep_id", "left").withColumn("probe_signals", F.when(F.col("__notes").isNotNull() & F.arrays_overlap("probe_signals", strings(FROM_VENDOR)), F.concat("probe_signals", "__notes")).otherwise(F.col("probe_signals"))).drop("__notes")
    # a moved page of a dead URL is one event
    dead = F.bool_or(F.col("signal") == "S1").over(W.partitionBy("dep_id"))
    moved = (F.col("signal") == "S5") & (F.size(F.array_except("probe_signals", strings(["redirected_off_path", "page_text_changed"]))) == 0)
    rows = rows.withColumn("dead", dead).filter(~(moved & F.col("dead")) & ((F.size("probe_signals") > 0) | (F.size("evidence_urls") > 0)))
    label, of = (L.lookup({k: v[i] for k, v in K.SIGNALS.items()}, F.col("signal")) for i in (0, 1))
    return rows.select(H.short_id(F.col("dep_id"), F.col("signal")).alias("finding_id"), "dep_id", "canonical_name", "signal", label.alias("label"), of.alias("kind_of_signal"), "severity", "blast_radius", "locations", "graded_locations", "questions_executing", "questions_mentioning", "probe_signals", "evidence_urls")


def _severity(rows: DataFrame) -> DataFrame:
    """rows with severity: base and reach, then what the probe signals say, then the vendor's own word where that is worse.

    Each step is a column of ranks, so no step's expression is repeated in the next.
    """
    has = lambda s: F.array_contains("probe_signals", s)
    base = F.col("__base")
    own = (
        F.when(has("node_removed_upstream"), 4)
        .when(has("model_shutdown_passed") | has("model_tier_restricted"), L.retirement_rank(base, F.col("questions_executing"), F.col("graded_locations")))
        .when(has("free_tier_language_lost"), F.least(F.lit(4), base + 1)).when(has("pricing_page_changed") & (F.size("probe_signals") == 1), 1).otherwise(base)
    )
    from_vendor = F.arrays_overlap("probe_signals", strings(FROM_VENDOR))
    rows = rows.withColumn("__base", L.severity_rank(F.col("signal"), F.col("watch_tier"), F.col("blast_radius"))).withColumn("__own", own)
    rows = rows.withColumn("__stated", F.when(from_vendor, L.rank_of(F.col("declared_severity"), K.SEVERITIES)))
    worse = F.greatest("__own", F.coalesce("__stated", F.lit(0)))
    return rows.withColumn("severity", L.named(worse - F.when(has("breaking_change_possible"), 1).otherwise(0))).drop("__base", "__own", "__stated")


def ranked(found: DataFrame) -> DataFrame:
    """Worst first, then by reach."""
    return found.orderBy(L.rank_of(F.col("severity"), K.SEVERITIES).desc(), F.col("blast_radius").desc(), "finding_id")


def projected(found: DataFrame, dependencies: DataFrame, locations: DataFrame) -> DataFrame:
    """Findings as each course sees them: vendor facts as they are, every count computed anew from the course's own locations."""
    rows = locations.join(dependencies.select("dep_id", "kind"), "dep_id")
    local = reach(rows, "dep_id", "course")
    facts = found.select("finding_id", "dep_id", "canonical_name", "signal", "severity", "probe_signals", F.col("locations").alias("total_locations"), F.col("blast_radius").alias("total_radius"))
    out = facts.join(local, "dep_id").join(dependencies.select("dep_id", "watch_tier"), "dep_id")
    retiring = F.arrays_overlap("probe_signals", strings(["model_shutdown_passed", "model_tier_restricted", "model_deprecation_declared"]))
    out = out.withColumn("__rank", L.severity_rank(F.col("signal"), F.col("watch_tier"), F.col("blast_radius")))
    here = F.when(retiring, L.retirement_rank(F.col("__rank"), F.col("questions_executing"), F.col("graded_locations"))).otherwise(F.col("__rank"))
    return out.withColumn("local_severity", L.named(here)).drop("probe_signals", "__rank")


def also_in(locations: DataFrame) -> DataFrame:
    """dep_id, course, other, blast_radius, locations: the other courses that a course's dependency reaches, by their own counts."""
    per = reach(locations, "dep_id", "course")
    other = per.select("dep_id", F.col("course").alias("other"), "blast_radius", "locations", "graded_locations")
    return per.select("dep_id", "course").join(other, "dep_id").filter("course <> other")


def earliest_session(locations: DataFrame) -> DataFrame:
    """dep_id, session_no, course of the first affected session, over all locations."""
    numbered = locations.filter("session_no is not null")
    return numbered.groupBy("dep_id").agg(F.min(F.struct("session_no", "course")).alias("first")).select("dep_id", "first.session_no", "first.course")


#: Signals that make step-by-step pictures worth another look.
SHOWN_SIGNALS = ("S2", "S5", "S8")


def screenshots_at_risk(found: DataFrame, locations: DataFrame, census: DataFrame) -> DataFrame:
    """finding_id, screenshots: pictures of the units that a finding touches, each unit once. census(course, unit_id, images)."""
    units = found.filter(F.col("signal").isin(*SHOWN_SIGNALS)).select("finding_id", "dep_id").join(locations.select("dep_id", "course", "unit_id").distinct(), "dep_id")
    return units.join(census, ["course", "unit_id"], "left").groupBy("finding_id").agg(F.coalesce(F.sum("images"), F.lit(0)).cast("long").alias("screenshots"))


def taught_job(locations: DataFrame, order: str, most: int = 6) -> DataFrame:
    """dep_id, job: what the material does with a thing, in its own unit names: the first distinct places."""
    where = F.coalesce(F.concat(F.lit("session "), F.col("session_no").cast("string")), F.col("evidence_source"))
    line = F.concat_ws(" / ", "course", where, F.substring("unit_name", 1, 60))
    first = locations.groupBy("dep_id", line.alias("line")).agg(F.min(order).alias("at"))
    nth = F.row_number().over(W.partitionBy("dep_id").orderBy("at", "line"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("dep_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("job"))
