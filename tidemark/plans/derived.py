"""Queries of the domain operators over whole driver tables: exports, workbooks, vendors' pages, registries, records and observations are
made from the tables' rows, and the SQL states what must come out from those rows alone, without the operators' patterns and rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.functions.text import strings
from tidemark.operators import catalogue, evidence, history, inventory, locate, observe, report, resolve, score, shred, upstream
from tidemark.plans.common import EVIDENCE_SQL, TENTHS_SQL, locations, spread, table, with_course
from tidemark.plans.impact import TIER_SQL
from tidemark.plans.web import HOST_SQL, OWNER_SQL
from tidemark.sources import published, snapshots, stages
from tidemark.sources.stages import heavy_parts

#: Customers that make one course: an export grows with them, so they are few.
_COURSE = 50


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as units of courses: k, course, name, segment."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return rows.select(k.alias("k"), _text(F.col("n_name"), "-", F.floor(k / _COURSE)).alias("course"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


_CUSTOMERS = f"c AS (SELECT c_custkey AS k, n_name || '-' || (c_custkey // {_COURSE}) AS course, c_name AS name, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey)"


# --- course exports: a customer is a unit, an order an object in it -----------------------------------------------------------------------


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a course: learning sets, quizzes and practice by turns, topics by market segment."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    rows = _customers(spark, sf_dir).join(orders, "k", "left").withColumn("orders", F.coalesce("orders", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>>")))
    kind, key = F.col("k") % 3, lambda o, p: _text(p, o["o_orderkey"])
    named = lambda **fields: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in fields.items()])
    learning = F.transform("orders", lambda o: named(learning_resource_id=key(o, "r"), learning_resource_type=F.when(o["o_orderstatus"] == "F", "INTERACTIVE_VIDEO").otherwise("READING"), object_type="LEARNING_RESOURCE", content=key(o, "Read "), short_text=o["o_orderpriority"]))
    asked = F.transform("orders", lambda o: named(question_id=key(o, "q"), object_type="CODING_QUESTIONS", solutions=F.array(named(solution_answer=key(o, "answer "))), test_cases=F.array(named(test_case_enum=_text("T_", o["o_orderstatus"])))))
    practice = F.transform("orders", lambda o: named(question_id=key(o, "x"), object_type="OBJECTIVE_QUESTIONS", content=key(o, "Which is "), options=F.array(named(content="this"), named(content=o["o_orderpriority"]))))
    unit = named(
        k=F.col("k"), unit_id=_text("u", F.col("k")), unit_type=F.when(kind == 0, "LEARNING_SET").when(kind == 1, "ASSESSMENT").otherwise("PRACTICE"), unit_name=F.when(F.col("k") % 4 != 0, F.col("name")).otherwise(""),
        order=F.col("k") % 10, question_tags=F.array(named(tag_name_enum=F.col("segment"))), contents=F.when(kind == 0, learning),
        exam_details=F.when(kind == 1, F.array(named(question_details=asked))), exam_sections=F.when(kind == 2, F.array(named(contents=practice))),
    )
    topics = rows.groupBy("course", F.col("segment").alias("topic_name")).agg(F.array_sort(F.collect_list(unit)).alias("units"))
    courses = topics.repartition(heavy_parts(spark), "course").groupBy("course").agg(F.array_sort(F.collect_list(F.struct("topic_name", "units"))).alias("topics"))
    return shred.exports(courses.select(_text(F.col("course"), ".json").alias("source_file"), "course", F.to_json(F.struct("topics")).alias("body")))


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh unit has a session of its own."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 7 == 0).select(_text("u", k).alias("unit_id"), (k % 100).cast("int").alias("session_no"))


def exported_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of all exports: names, running session numbers, paths."""
    return shred.units(_exports(spark, sf_dir)).select("course", "unit_id", "unit_name", "is_session", F.col("positional").cast("long").alias("running_no"), "base")


def exported_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text fields of all exports, from the three places that hold them, and their sessions, declared ones first."""
    rows = shred.records(_exports(spark, sf_dir), _declared(spark, sf_dir))
    return rows.select("course", "unit_id", F.col("session_no").cast("long").alias("session_no"), "content_id", "evidence_source", "field_path", "pooled", "body_text")


def exported_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course: units, sessions, pools of questions, pools read, and the gap between them (customers without orders)."""
    docs = stages.staged(_exports(spark, sf_dir))
    return shred.reconciled(docs, shred.records(docs))


def exported_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course, how many paths lead back to the text that they were found at, and how many don't."""
    docs = stages.staged(_exports(spark, sf_dir))
    rows = shred.dereferenced(shred.records(docs), docs)
    return rows.groupBy("course").agg(F.count_if(F.col("value") == F.col("body_text")).alias("found"), F.count_if(~F.col("value").eqNullSafe(F.col("body_text"))).alias("lost"))


#: Names to look for in located fields, and links that stand in for them.
_TERMS, _LINKS = ("READ", "an", "is", "a"), ("fi", "in")


def located_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all exports, and a cell of every customer's row in a workbook, as locations: what is there, in which question, or why not.

    Some paths lead nowhere (no such topic, a whole unit, a file that isn't there), as they would after an export has changed.
    """
    docs = stages.staged(_exports(spark, sf_dir))
    k = F.substring("unit_id", 2, 20).cast("long")
    rows = shred.records(docs).select("source_file", "field_path", k.alias("k"), F.regexp_extract("field_path", r"^(\$\.topics\[\d+\]\.units\[\d+\])", 1).alias("unit"))
    stale = F.when(F.col("k") % 5 == 0, F.replace("field_path", F.lit(".topics["), F.lit(".topics[9"))).when(F.col("k") % 7 == 0, F.col("unit")).otherwise(F.col("field_path"))
    fields = rows.select(F.when(F.col("k") % 11 == 0, F.lit("gone.json")).otherwise(F.col("source_file")).alias("source_file"), stale.alias("field_path"))
    c = F.col("k")
    book = _text(F.col("course"), ".xlsx")
    cells = _customers(spark, sf_dir).select(_text(F.col("course"), ".json").alias("source_file"), F.when(c % 4 == 0, _text(book, "::Tools")).when(c % 4 == 1, _text(book, "::Course Outline::outline ::row", c + 2)).when(c % 4 == 2, _text(book, "::Course Outline::Session Name::row", c + 2, "0000")).otherwise("not a path").alias("field_path"))
    places = fields.unionByName(cells).withColumns({"terms": strings(_TERMS), "urls": strings(_LINKS)})
    out = locate.located(places, stages.staged(locate.nodes(docs)), _cells(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"], s["length"])), " ")
    return out.groupBy("field_path", "source_file", "resolved", "reason", "matched_by", "excerpt", spans.alias("spans"), "title", "object_type").agg(F.count(F.lit(1)).alias("n"))


_UNITS = f"""{_CUSTOMERS},
u AS (SELECT *, dense_rank() OVER (PARTITION BY course ORDER BY segment) - 1 AS ti, row_number() OVER (PARTITION BY course, segment ORDER BY k) - 1 AS ui,
             k % 3 = 0 AND k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS is_session FROM c),
p AS (SELECT *, 'u' || k AS unit_id, CAST(sum(is_session::INT) OVER (PARTITION BY course ORDER BY ti, k % 10, ui) AS BIGINT) AS running_no, '$.topics[' || ti || '].units[' || ui || ']' AS base FROM u),
o AS (SELECT o_custkey AS k, o_orderkey AS ok, o_orderstatus AS st, o_orderpriority AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ci FROM orders),
f AS (SELECT p.*, ok, st, pr, ci FROM p JOIN o USING (k)),
t AS (
  SELECT *, 'r' || ok AS content_id, 'markdown' AS evidence_source, base || '.contents[' || ci || '].content' AS field_path, false AS pooled, 'Read ' || ok AS body_text FROM f WHERE k % 3 = 0
  UNION ALL SELECT *, 'r' || ok, 'title', base || '.contents[' || ci || '].short_text', false, pr FROM f WHERE k % 3 = 0
  UNION ALL SELECT *, 'q' || ok, 'solution_code', base || '.exam_details[0].question_details[' || ci || '].solutions[0].solution_answer', true, 'answer ' || ok FROM f WHERE k % 3 = 1
  UNION ALL SELECT *, 'q' || ok, 'test_case_enum', base || '.exam_details[0].question_details[' || ci || '].test_cases[0].test_case_enum', true, 'T_' || st FROM f WHERE k % 3 = 1
  UNION ALL SELECT *, 'x' || ok, 'markdown', base || '.exam_sections[0].contents[' || ci || '].content', true, 'Which is ' || ok FROM f WHERE k % 3 = 2
  UNION ALL SELECT *, 'x' || ok, 'markdown', base || '.exam_sections[0].contents[' || ci || '].options[0].content', true, 'this' FROM f WHERE k % 3 = 2
  UNION ALL SELECT *, 'x' || ok, 'markdown', base || '.exam_sections[0].contents[' || ci || '].options[1].content', true, pr FROM f WHERE k % 3 = 2
  UNION ALL SELECT *, NULL, NULL, NULL, NULL, '', 'question_tag', base || '.question_tags[0].tag_name_enum', false, segment FROM p)"""


# --- workbooks ----------------------------------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sheets a course: sessions, practice rows that name a session, tools."""
    rows = _customers(spark, sf_dir).withColumn("book", _text(F.col("course"), ".xlsx"))
    k, none = F.col("k"), F.lit(None).cast("string")
    sheets = {
        "Course Outline": [("Session Name", F.col("name")), (" SESSION  No. ", F.when(k % 11 == 0, "two").otherwise(_text(k % 30 + 1, ".0"))), ("Session ID", _text("s-", k)), ("Outline", F.when(k % 3 == 0, _text("Outline of ", F.col("name"))).otherwise("-")), ("Key Takeaway", _text("Learn ", F.col("segment")))],
        "Session-Practice Content Linked": [("Unit ID", _text("u", k)), ("Session ID", _text("s-", k + 1))],
        "Tools": [("Entity Name", F.col("name")), ("Tool@Version", F.when(k % 8 == 0, none).otherwise(_text("kit", k % 5, "@1.", k % 9, ", Suno (free)")))],
    }
    cell = lambda sheet, row, col, value: F.struct(F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("value"))
    body = rows.select("book", F.explode(F.array(*[cell(s, k + 2, i + 1, v) for s, columns in sheets.items() for i, (_, v) in enumerate(columns)])).alias("x"))
    heads = rows.select("book").distinct().select("book", F.explode(F.array(*[cell(s, F.lit(1), i + 1, F.lit(h)) for s, columns in sheets.items() for i, (h, _) in enumerate(columns)])).alias("x"))
    return heads.unionByName(body).select("book", "x.*").filter("value is not null")


def workbook_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sessions of all workbooks say, column by column."""
    return shred.outline_records(shred.outline(_cells(spark, sf_dir))).select("book", F.col("session_no").cast("long").alias("session_no"), "session_name", "column", "body_text")


def workbook_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practice units of all workbooks and the session whose id they name, if there is one."""
    cells = _cells(spark, sf_dir)
    return shred.session_of_unit(cells, shred.outline(cells)).select("book", "unit_id", F.col("session_no").cast("long").alias("session_no"))


def workbook_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.sheet_tools(_cells(spark, sf_dir)).select("book", "session", "name", "version", "qualifier")


# --- vendors' catalogues and models: a part is a model of one of seven vendors ----------------------------------------------------------------


def model_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a part: a table of retirements for every third one, one of live models for the others and every ninth."""
    k = F.col("p_partkey")
    date = F.when(k % 6 == 0, "2020-03-05").otherwise("2031-01-01")
    retired = _text("<table><tr><th>Deprecated Model</th><th>Shutdown Date</th><th>Recommended Replacement Model ID</th></tr><tr><td><code>m", k, "-8b</code></td><td>", date, "</td><td>m", k + 7, "-8b</td></tr></table>")
    price = F.when(k % 9 == 0, "Contact&nbsp;sales").otherwise("$0.10")
    live = _text("<table><caption>Live</caption><tr><th>MODEL ID</th><th>Price per 1M tokens</th><th>Rate limits</th></tr><tr><td>Model ", k, "</td></tr><tr><td><code>m", k, "-8b</code></td><td>", price, "</td><td>30</td></tr></table>")
    html = F.concat(F.lit("<p>Models</p>"), F.when(k % 3 == 0, retired).otherwise(""), F.when((k % 3 != 0) | (k % 9 == 0), live).otherwise(""))
    return spread(table(spark, sf_dir, "part")).select(_text("v", k % 7).alias("vendor"), _text("https://v.test/", k).alias("url"), html.alias("html"))


def vendor_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vendors' tables folded by id: a retirement outranks a live listing, which is noted beside it."""
    out = catalogue.catalogue(model_pages(spark, sf_dir)).filter(F.col("entry_id").rlike("^m[0-9]+-8b$"))
    return out.select("vendor", "entry_id", "status", "still_listed", "listed_price", "shutdown_date", F.array_join("replacement_ids", ",").alias("replacements"))


def _probed_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    deps = table(spark, sf_dir, "part").select(k.cast("string").alias("dep_id"), F.when(k % 10 == 7, _text("x", k, "-lite")).otherwise(_text("M", k, "-8B")).alias("canonical_name"))
    vendors = spark.createDataFrame([(f"v{i}", i, True, i != 6) for i in range(7)], "vendor string, ord int, ok boolean, supported boolean")
    listed = catalogue.catalogue(model_pages(spark, sf_dir))
    return observe.models(deps, listed, vendors, F.lit("2026-01-01").cast("date")), listed


def model_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models against their vendors' catalogues."""
    return _probed_models(spark, sf_dir)[0].select("dep_id", "status", F.array_join("signals", ",").alias("signals"), "provider")


def model_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named replacements of retired models that the same vendor still serves."""
    return observe.served_replacements(*_probed_models(spark, sf_dir))


_MODELS = """m AS (SELECT p_partkey AS k, 'v' || (p_partkey % 7) AS vendor, p_partkey % 3 = 0 AS dead, p_partkey % 9 = 0 AS twice, p_partkey % 10 <> 7 AND p_partkey % 7 <> 6 AS listed FROM part)"""


# --- packages and nodes ---------------------------------------------------------------------------------------------------------------------


def package_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as packages, against a registry's snapshot and the versions of the run before."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    dep, name = k.cast("string").alias("dep_id"), _text("pkg-", k)
    deps = part.select(dep, F.lit("pypi").alias("registry"), name.alias("registry_id"), F.when(k % 4 == 0, "1.2").otherwise("").alias("taught_version"))
    latest = _text("2.", k % 3)
    there = k % 5 != 0
    reg = part.filter(k % 10 != 5).select(F.lit("pypi").alias("registry"), name.alias("name"), there.alias("found"), F.lit(True).alias("reachable"), F.when(there, latest).alias("latest_version"), F.when(there, F.when(k % 8 == 0, "2020-01-01").otherwise("2025-01-01")).cast("timestamp").alias("released_at"), F.when(k % 11 == 0, True).alias("yanked"), F.lit(None).cast("boolean").alias("deprecated"))
    before = part.filter(k % 2 == 0).select(dep, F.when(k % 6 == 0, "1.9").otherwise(latest).alias("latest_version"))
    return observe.packages(deps, reg, before, F.lit("2025-06-01").cast("timestamp")).select("dep_id", "status", F.array_join("signals", ",").alias("signals"))


def node_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as workflow nodes, against the files and the rules of an upstream repository."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    deps = part.select(k.cast("string").alias("dep_id"), _text("n8n-nodes-base.part", k).alias("canonical_name"))
    paths = part.filter(k % 4 != 0).select(_text("packages/nodes-base/nodes/Part", k, "/Part", k, ".node.ts").alias("path"))
    ruled = part.filter(k % 10 == 1).select(_text("rules/", k, ".ts").alias("path"), _text("@BreakingChangeRule({ version: 'v2' }) id: string = 'r", k, "' title: 'Answers', severity: 'High', types ['n8n-nodes-base.part", k, "']").alias("body"))
    general = spark.createDataFrame([("rules/general.ts", "@BreakingChangeRule({ version: 'v3' }) title: 'Part13 waits longer'"), ("rules/none.ts", "export const x = 1")], "path string, body string")
    return observe.nodes(deps, upstream.node_index(paths), upstream.node_rules(ruled.unionByName(general)), True).select("dep_id", "status", "signal", "rule_id")


# --- the inventory of records made of documents -----------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: code, markdown, prose or a tag by turns."""
    d = F.col("doc_id")
    kind = F.when(d % 4 == 0, "solution_code").when(d % 4 == 1, "markdown").when(d % 4 == 2, "solution_prose").otherwise("question_tag")
    body = (
        F.when(d % 4 == 0, _text("import os, lib", d % 13, "\nfrom sklearn.svm import SVC\nconst x = require('@scope/kit", d % 3, "/deep');"))
        .when(d % 4 == 1, _text('See <a class="x" href="https://www.tool', d % 17, '.io/p#a">it</a>, https://arxiv.org/abs/', d, " and https://cdn.tool1.io/a.png; call gpt-", d % 5 + 3, "-mini.\n$ pip install pin", d % 6, "==1.", d % 6, "\n"))
        .when(d % 4 == 2, _text("We like Tool", d % 17, " here, not Tool", d % 17, "-x.")).otherwise(F.when(d % 8 == 3, _text("Tool", d % 17)).otherwise(_text("machine_made_", d)))
    )
    return table(spark, sf_dir, "documents").select(
        _text("course ", F.col("source")).alias("course"), F.col("lang").alias("topic_name"), _text("u", d).alias("unit_id"), _text("Unit ", d).alias("unit_name"), _text("c", d).alias("content_id"), _text("$[", d, "]").alias("field_path"),
        F.when(d % 2 == 0, "CODING_QUESTIONS").otherwise("LEARNING_RESOURCE").alias("object_type"), (d % 20).cast("int").alias("session_no"), kind.alias("evidence_source"), body.alias("body_text"),
    )


def corpus_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes over records of all documents: links make services, whose names are then found in prose and tags."""
    out = inventory.built(_records(spark, sf_dir))[0]
    return out.select("kind", "canonical_name", F.coalesce("taught_version", F.lit("")).alias("taught_version"), "watch_tier", "n_locations", F.array_join("official_domains", ",").alias("domains"))


def corpus_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many locations of each kind of evidence the inventory of all documents has, by course."""
    return inventory.built(_records(spark, sf_dir))[1].groupBy("course", "kind", "evidence_source").agg(F.count(F.lit(1)).alias("n"))


def segment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all customers that no entry explains, for review, the most frequent first; machine-made and short ones left out."""
    k = F.col("k")
    body = F.when(k % 3 == 0, _text("auto_tag_", k)).when(k % 7 == 0, "ab").otherwise(F.initcap("segment"))
    rows = _customers(spark, sf_dir).select("course", F.lit("").alias("topic_name"), F.lit("").alias("unit_id"), F.lit("").alias("unit_name"), F.lit("").alias("content_id"), k.cast("string").alias("field_path"), F.lit("UNIT_TAG").alias("object_type"), F.lit(1).alias("session_no"), F.lit("question_tag").alias("evidence_source"), body.alias("body_text"))
    entries = spark.createDataFrame([("service:machinery", "service", "Machinery", [], "1")], "entry_id string, kind string, canonical_name string, aliases array<string>, ord string")
    return report.review_queue(inventory.tag_mentions(rows, entries)[1]).select("name", "n", F.size("courses").cast("long").alias("courses"))


# --- findings over all parts -------------------------------------------------------------------------------------------------------------------


def _case(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as services: their line items are locations, their keys say what was observed and claimed."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    places = with_course(spark, sf_dir, locations(spark, sf_dir)).drop("kind").withColumns({"unit_id": F.lit("u"), "unit_name": F.lit("U")})
    tiers = places.groupBy("dep_id").agg(score.watch_tier(F.col("evidence_source"), score.graded(F.col("object_type"))).alias("watch_tier"))
    deps = part.select(k.alias("dep_id"), F.lit("service").alias("kind"), F.col("p_name").alias("canonical_name")).join(tiers, "dep_id")
    said = {0: ("broken", ["url_gone", "redirected_off_path"]), 1: ("changed", ["page_text_changed"]), 2: ("changed", ["new_release"]), 3: ("changed", ["free_tier_language_lost"]), 4: ("broken", []), 5: ("ok", [])}
    cases = spark.createDataFrame([(r, s, g) for r, (s, g) in said.items()], "r long, status string, signals array<string>")
    probes = part.select(k.alias("dep_id"), (k % 6).alias("r")).join(F.broadcast(cases), "r").drop("r")
    claim = lambda kind, quote, good: F.struct(F.lit(kind).alias("kind"), F.lit(quote).alias("quote"), _text(f"https://{kind}.io/", k).alias("source_url"), F.lit(good).alias("substantiates"))
    claims = F.array_compact(F.array(F.when(k % 5 == 0, claim("pricing", "It is no longer free for teams.", True)), F.when(k % 5 == 1, claim("pricing", "It costs five dollars.", True)), F.when(k % 7 == 0, claim("deprecation", "It is deprecated.", False)), F.when(k % 11 == 0, claim("deprecation", "It is deprecated.", True))))
    claims = part.select(k.alias("dep_id"), F.explode(claims).alias("c")).select("dep_id", "c.*")
    better = part.filter(k % 13 == 0).select(k.alias("dep_id"), _text("https://better.io/", k).alias("source_url"))
    return {"dependencies": deps, "locations": places, "probes": probes, "claims": claims, "alternatives": better}


def part_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole program over all parts: signals to news, news to findings, severities, and what depends on other findings."""
    out = score.findings(**_case(spark, sf_dir))
    return out.select("dep_id", "signal", "severity", "blast_radius", F.array_join("probe_signals", ",").alias("probe_signals"), F.array_join("evidence_urls", ",").alias("evidence"))


def part_findings_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings as each course sees them: counts and severities anew from the course's own locations."""
    case = _case(spark, sf_dir)
    return score.projected(score.findings(**case), case["dependencies"], case["locations"]).select("dep_id", "signal", "course", "local_severity", "blast_radius", "total_radius")


_RADIUS = f"CAST(round_even(sum({TENTHS_SQL}) / 10.0, 0) AS BIGINT)"
_RANK = "least(5, greatest(1, base + CASE WHEN watch_tier = 'critical' AND radius >= 8 THEN 1 WHEN watch_tier = 'mention-only' OR radius <= 1 THEN -1 ELSE 0 END))"
_FINDINGS = f"""d AS (SELECT l_partkey AS k, {TIER_SQL} AS watch_tier, {_RADIUS} AS radius FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1),
s AS (
  SELECT *, 'S1' AS signal, 5 AS base, CASE k % 6 WHEN 0 THEN 'url_gone' ELSE 'broken' END AS probe_signals, '' AS evidence, 0 AS extra FROM d WHERE k % 6 IN (0, 4)
  UNION ALL SELECT *, 'S8', 2, 'page_text_changed', '', 0 FROM d WHERE k % 6 = 1 AND watch_tier <> 'mention-only'
  UNION ALL SELECT *, 'S3', 4, CASE WHEN k % 6 = 3 THEN 'free_tier_language_lost' ELSE '' END, CASE WHEN k % 5 = 0 THEN 'https://pricing.io/' || k ELSE '' END, CASE WHEN k % 6 = 3 THEN 1 ELSE 0 END FROM d WHERE k % 6 = 3 OR k % 5 = 0
  UNION ALL SELECT *, 'S4', 4, '', 'https://deprecation.io/' || k, 0 FROM d WHERE k % 11 = 0
  UNION ALL SELECT *, 'S10', 2, '', 'https://better.io/' || k, 0 FROM d WHERE k % 13 = 0 AND k % 11 <> 0 AND k % 6 NOT IN (0, 4)),
n AS (SELECT ['info', 'low', 'medium', 'high', 'critical'] AS l)"""


# --- keys, search --------------------------------------------------------------------------------------------------------------------------------


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all parts' names."""
    raw = _text("  ", F.col("p_name"), "--", F.col("p_brand"), "! ", F.initcap("p_type"), " / .NET ")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", T.norm(F.col("raw")).alias("norm"), T.slug(F.col("raw")).alias("slug"), T.workbook_stem(F.concat("raw", F.lit("Course Contents.xlsx"))).alias("stem"))


def cited_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of all pages as open search hits, by how many URLs cite them; excluded sources never surface."""
    return evidence.discovered(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "url"))


def alias_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names, written in two ways, against entries that carry them as aliases."""
    supplier = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    entries = supplier.select(_text("service:", k).alias("entry_id"), F.lit("service").alias("kind"), _text("Org ", k).alias("canonical_name"), F.array("s_name", _text("o", k, ".io")).alias("aliases"), k.alias("ord"))
    spelled = F.when(k % 3 == 0, F.upper("s_name")).when(k % 3 == 1, _text("  o", k, ".IO ")).otherwise(_text("org-", k))
    names = supplier.select("s_suppkey", spelled.alias("name"), F.lit("service").alias("wanted_kind"))
    return resolve.resolved(names, resolve.alias_index(entries)).select("s_suppkey", "entry_id")


# --- research: probes and pages to claims, claims to findings, findings to the gate ----------------------------------------------------------


def _pages_of_suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as vendors with a domain of their own, and a snapshot of what their sites served."""
    supplier, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    domain = _text("org", k, ".io")
    subject = F.struct(F.array(domain).alias("official_domains"), _text("https://docs.org", k, ".io").alias("docs_url"), _text("https://org", k, ".io").alias("homepage"), F.lit("").alias("changelog_url"), F.lit("").alias("pricing_url"), none.alias("status_url"))
    subjects = supplier.select(k.cast("string").alias("dep_id"), _text("Org ", k).alias("name"), F.array().cast("array<string>").alias("aliases"), subject.alias("subject"))
    page = lambda path, status, body: F.struct(_text("https://", domain, path).alias("url"), F.lit(status).alias("status"), body.alias("body"))
    prices = F.lit("<nav>Menu</nav><p>Prices</p><p>The free tier allows twenty requests per minute for every account that is in good standing with us.</p>")
    ends = _text("<p>The Org ", k, " classic console has been deprecated and will stop working for everyone at the end of this year.</p>")
    pages = F.array_compact(F.array(F.when(k % 3 == 0, page("/pricing", 200, prices)), F.when(k % 3 == 1, page("/pricing", 404, prices)), F.when(k % 4 == 0, page("/deprecations", 200, ends)), F.when(k % 4 == 1, page("/deprecations", 200, F.lit("<p>Another thing has been deprecated and will stop working for everyone at the end of this year.</p>")))))
    return subjects, supplier.select(F.explode(pages).alias("p")).select("p.*")


def supplier_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims lifted from all suppliers' own pages, as far as the gate lets them exist."""
    subjects, fetches = _pages_of_suppliers(spark, sf_dir)
    return evidence.gathered(subjects, ["deprecation", "pricing"], fetches)[0].select("dep_id", "kind", "statement", "source_url", "quote", "tier", "substantiates")


def supplier_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round over all suppliers: pages to claims, claims to findings, and the gate, where a rejection holds while its evidence does."""
    subjects, fetches = _pages_of_suppliers(spark, sf_dir)
    claims = evidence.gathered(subjects, ["deprecation", "pricing"], fetches)[0].select("dep_id", "kind", "quote", "source_url", "substantiates")
    places = locations(spark, sf_dir).withColumn("dep_id", F.col("supplier").cast("string")).drop("kind")
    tiers = places.groupBy("dep_id").agg(score.watch_tier(F.col("evidence_source"), score.graded(F.col("object_type"))).alias("watch_tier"))
    deps = subjects.select("dep_id", F.lit("service").alias("kind"), F.col("name").alias("canonical_name")).join(tiers, "dep_id")
    probes = spark.createDataFrame([], "dep_id string, status string, signals array<string>")
    found = score.findings(deps, places, probes, claims).withColumn("fingerprint", H.evidence_fingerprint(F.col("signal"), F.col("evidence_urls"), F.col("probe_signals")))
    k = F.col("dep_id").cast("long")
    decided = found.filter(k % 8 == 0).select(k.alias("id"), "finding_id", F.lit("rejected").alias("verdict"), F.when(k % 16 == 0, F.col("fingerprint")).otherwise("another").alias("fingerprint"))
    return history.suppressed(found, decided).select("dep_id", "signal", "severity", F.array_join("evidence_urls", ",").alias("evidence"), F.when(F.col("held"), "held").otherwise("awaits review").alias("state"))


# --- artifacts ---------------------------------------------------------------------------------------------------------------------------------


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents written as JSON lines and read back by their schema, by course and kind of evidence."""
    path = stages.shared_path(spark)
    _records(spark, sf_dir).write.json(path)
    out = snapshots.records(spark, path)
    return out.groupBy("course", "evidence_source").agg(F.count(F.lit(1)).alias("n"), F.sum("session_no").alias("sessions"), F.sum(F.length("body_text")).alias("chars"), F.count_if(F.col("pooled").isNotNull()).alias("pooled"))


def latest_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact a year of orders by customer; then a partial refresh of the last one, which replaces what was examined and keeps the rest."""
    path, k = stages.shared_path(spark), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    totals = orders.groupBy(F.year("o_orderdate").alias("y"), k.alias("dep_id")).agg(F.count(F.lit(1)).alias("n"))
    years = [r["y"] for r in totals.select("y").distinct().orderBy("y").collect()]  # a handful
    for y in years:
        stages.write_artifact(totals.filter(F.col("y") == y).select("dep_id", "n"), path, f"{y}-12-31")
    examined = orders.select(k.alias("dep_id")).distinct().filter("dep_id % 3 = 0")
    stages.merged_artifact(spark, path, f"{years[-1] + 1}-01-31", examined.filter("dep_id % 6 = 0").select("dep_id", F.lit(-1).cast("long").alias("n")), examined)
    return stages.latest_artifact(spark, path).select("dep_id", "n")


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses and their roster committed together, three writers that began at the same version, and what every version holds.

    The second writer changes the roster that the first one changed, and gives way; the third adds sheets and goes on from the first; a
    commit that its validator refuses leaves nothing.
    """
    store = published.Tables(spark, stages.shared_path(spark))
    customers = _customers(spark, sf_dir).select("k", "course")
    roster = lambda rows: rows.groupBy("course").agg(F.count(F.lit(1)).alias("units"))
    begun = store.commit({"exports": customers, "roster": roster(customers)})
    few = customers.filter("k % 3 <> 0")
    store.commit({"exports": few, "roster": roster(few)}, begun)
    for changes, check in (({"roster": roster(customers)}, None), ({"sheets": customers.filter("k % 2 = 0")}, None), ({"roster": customers}, lambda staged: [] if "units" in staged["roster"].columns else ["no units"])):
        try:
            store.commit(changes, begun, check)
        except (published.Conflict, published.Refused):
            continue
    out = None
    for version in store.versions():
        for name in store.tables(version):
            rows = store.read(name, version)
            total = F.sum("units" if name == "roster" else "k").cast("long").alias("total")
            one = rows.agg(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), total)
            out = one if out is None else out.unionByName(one)
    return out


def overlaid_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as declared courses and suppliers as an overlay, both from JSON lines: what clashes by slug or title, or can't be read, stays out."""
    path, other = stages.shared_path(spark), stages.shared_path(spark)
    nation, supplier, k = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    line = lambda slug, title: F.to_json(F.struct(slug.alias("slug"), title.alias("title"), F.array(title).alias("workbook_keys"))).alias("value")
    nation.select(line(F.lower("n_name"), F.col("n_name"))).write.text(path)
    title = F.when(k % 4 == 0, _text("nation_", k)).otherwise(F.col("s_name"))
    supplier.select(F.when(k % 9 == 0, F.lit('{"slug": ')).otherwise(line(F.when(k % 5 == 0, _text("nation_", k)).otherwise(_text("s", k)), title)).alias("value")).write.text(other)
    declared, _ = snapshots.roster(spark, path)
    overlay, bad = snapshots.roster(spark, other)
    both, clashing = snapshots.overlaid(declared, overlay)
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return count(both, "courses").unionByName(count(clashing, "clashing")).unionByName(count(bad, "unreadable"))


QUERIES = {
    f.__name__: f
    for f in (
        stored_records, latest_artifacts, published_tables, overlaid_roster, supplier_claims, supplier_review, exported_units, exported_records, exported_pools, exported_paths, located_fields, workbook_outline, workbook_practice, workbook_tools, vendor_catalogue, model_fates, model_replacements, package_fates, node_fates,
        corpus_inventory, corpus_locations, segment_tags, part_findings, part_findings_projected, part_keys, cited_domains, alias_priority,
    )
}

ORACLE_SQL = {
    "supplier_claims": """
SELECT CAST(s_suppkey AS VARCHAR) AS dep_id, 'pricing' AS kind, 'Org ' || s_suppkey || ': its own pricing page describes plan or quota limits' AS statement, 'https://org' || s_suppkey || '.io/pricing' AS source_url,
  'The free tier allows twenty requests per minute for every account that is in good standing with us.' AS quote, 'AUTHORITATIVE' AS tier, true AS substantiates FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'deprecation', 'Org ' || s_suppkey || ': its own documentation uses deprecation language', 'https://org' || s_suppkey || '.io/deprecations',
  'The Org ' || s_suppkey || ' classic console has been deprecated and will stop working for everyone at the end of this year.', 'AUTHORITATIVE', true FROM supplier WHERE s_suppkey % 4 = 0""",
    "supplier_review": f"""
WITH d AS (SELECT l_suppkey AS k, {TIER_SQL} AS watch_tier, {_RADIUS} AS radius, 4 AS base FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1), n AS (SELECT ['info', 'low', 'medium', 'high', 'critical'] AS l)
SELECT CAST(k AS VARCHAR) AS dep_id, 'S4' AS signal, l[{_RANK}] AS severity, 'https://org' || k || '.io/deprecations' AS evidence, CASE WHEN k % 16 = 0 THEN 'held' ELSE 'awaits review' END AS state FROM d, n WHERE k % 4 = 0""",
    "stored_records": """
WITH d AS (SELECT doc_id AS d, 'course ' || source AS course, doc_id % 4 AS k FROM documents),
r AS (SELECT *, CASE k WHEN 0 THEN 'solution_code' WHEN 1 THEN 'markdown' WHEN 2 THEN 'solution_prose' ELSE 'question_tag' END AS evidence_source,
  CASE k WHEN 0 THEN 'import os, lib' || (d % 13) || chr(10) || 'from sklearn.svm import SVC' || chr(10) || 'const x = require(''@scope/kit' || (d % 3) || '/deep'');'
    WHEN 1 THEN 'See <a class="x" href="https://www.tool' || (d % 17) || '.io/p#a">it</a>, https://arxiv.org/abs/' || d || ' and https://cdn.tool1.io/a.png; call gpt-' || (d % 5 + 3) || '-mini.' || chr(10) || '$ pip install pin' || (d % 6) || '==1.' || (d % 6) || chr(10)
    WHEN 2 THEN 'We like Tool' || (d % 17) || ' here, not Tool' || (d % 17) || '-x.' ELSE CASE WHEN d % 8 = 3 THEN 'Tool' || (d % 17) ELSE 'machine_made_' || d END END AS body FROM d)
SELECT course, evidence_source, count(*) AS n, CAST(sum(d % 20) AS BIGINT) AS sessions, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS pooled FROM r GROUP BY 1, 2""",
    "latest_artifacts": """
WITH l AS (SELECT max(year(o_orderdate)) AS y FROM orders), t AS (SELECT o_custkey AS dep_id, count(*) AS n FROM orders, l WHERE year(o_orderdate) = y GROUP BY 1)
SELECT dep_id, n FROM t WHERE dep_id % 3 <> 0 UNION ALL SELECT DISTINCT o_custkey, CAST(-1 AS BIGINT) FROM orders WHERE o_custkey % 6 = 0""",
    "published_tables": f"""WITH {_CUSTOMERS},
v AS (SELECT unnest([1, 2, 3]) AS version), e AS (SELECT version, k, course FROM v, c WHERE version = 1 OR k % 3 <> 0), r AS (SELECT version, course, count(*) AS units FROM e GROUP BY 1, 2)
SELECT CAST(version AS BIGINT) AS version, 'exports' AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM e GROUP BY version
UNION ALL SELECT CAST(version AS BIGINT), 'roster', count(*), CAST(sum(units) AS BIGINT) FROM r GROUP BY version
UNION ALL SELECT 3, 'sheets', count(*), CAST(sum(k) AS BIGINT) FROM c WHERE k % 2 = 0""",
    "overlaid_roster": """
WITH n AS (SELECT lower(n_name) AS t FROM nation), s AS (SELECT s_suppkey % 9 = 0 AS bad, CASE WHEN s_suppkey % 5 = 0 THEN 'nation_' || s_suppkey ELSE 's' || s_suppkey END IN (FROM n) OR CASE WHEN s_suppkey % 4 = 0 THEN 'nation_' || s_suppkey ELSE lower(s_name) END IN (FROM n) AS clash FROM supplier)
SELECT 'courses' AS outcome, (SELECT count(*) FROM nation) + count(*) FILTER (NOT bad AND NOT clash) AS n FROM s UNION ALL SELECT 'clashing', count(*) FILTER (NOT bad AND clash) FROM s UNION ALL SELECT 'unreadable', count(*) FILTER (bad) FROM s""",
    "exported_units": f"WITH {_UNITS} SELECT course, unit_id, CASE WHEN k % 4 <> 0 THEN name WHEN k % 3 = 1 THEN 'Module Quiz' ELSE '(unnamed unit)' END AS unit_name, is_session, running_no, base FROM p",
    "exported_records": f"WITH {_UNITS} SELECT course, unit_id, CAST(CASE WHEN k % 7 = 0 THEN k % 100 WHEN running_no > 0 THEN running_no END AS BIGINT) AS session_no, content_id, evidence_source, field_path, pooled, body_text FROM t",
    "exported_pools": f"""WITH {_UNITS}, r AS (SELECT DISTINCT k FROM t WHERE pooled)
SELECT course, count(*) AS units, count(*) FILTER (is_session) AS sessions, count(*) FILTER (k % 3 > 0) AS pools, count(*) FILTER (k % 3 > 0 AND k IN (FROM r)) AS pools_read, count(*) FILTER (k % 3 > 0 AND k NOT IN (FROM r)) AS gap FROM p GROUP BY 1""",
    "exported_paths": f"WITH {_UNITS} SELECT course, count(*) AS found, CAST(0 AS BIGINT) AS lost FROM t GROUP BY 1",
    "located_fields": f"""WITH {_UNITS},
q AS (SELECT CASE WHEN k % 11 = 0 THEN 'gone.json' ELSE course || '.json' END AS source_file, CASE WHEN k % 5 = 0 THEN replace(field_path, '.topics[', '.topics[9') WHEN k % 7 = 0 THEN base ELSE field_path END AS field_path,
    CASE WHEN k % 11 = 0 THEN 'course_export_missing' WHEN k % 5 = 0 THEN 'path_not_found' WHEN k % 7 = 0 THEN 'not_a_text_field' END AS bad, body_text AS body, CASE WHEN content_id <> '' AND k % 3 = 0 THEN pr ELSE '' END AS title,
    CASE WHEN content_id = '' THEN '' WHEN k % 3 = 0 THEN 'LEARNING_RESOURCE' WHEN k % 3 = 1 THEN 'CODING_QUESTIONS' ELSE 'OBJECTIVE_QUESTIONS' END AS object_type FROM t
  UNION ALL SELECT course || '.json', CASE k % 4 WHEN 0 THEN course || '.xlsx::Tools' WHEN 1 THEN course || '.xlsx::Course Outline::outline ::row' || (k + 2) WHEN 2 THEN course || '.xlsx::Course Outline::Session Name::row' || (k + 2) || '0000' ELSE 'not a path' END,
    CASE k % 4 WHEN 0 THEN 'sheet_declaration' WHEN 2 THEN 'workbook_cell_missing' WHEN 3 THEN 'unparsable_path' END, CASE WHEN k % 3 = 0 THEN 'Outline of ' || name ELSE '-' END, 'outline  — Course Outline', 'SESSION_PPT' FROM c),
m AS (SELECT *, lower(body) AS low, CASE WHEN lower(body) LIKE '%read%' THEN 'read' WHEN lower(body) LIKE '%an%' THEN 'an' WHEN lower(body) LIKE '%is%' THEN 'is' END AS w, CASE WHEN lower(body) LIKE '%fi%' THEN 'fi' WHEN lower(body) LIKE '%in%' THEN 'in' END AS u FROM q)
SELECT field_path, source_file, bad IS NULL AS resolved, coalesce(bad, CASE WHEN coalesce(w, u) IS NULL THEN 'term_not_in_field' ELSE '' END) AS reason, CASE WHEN bad IS NOT NULL OR coalesce(w, u) IS NULL THEN '' WHEN w IS NOT NULL THEN 'name' ELSE 'referenced_url' END AS matched_by,
  CASE WHEN bad IS NULL THEN body ELSE '' END AS excerpt, CASE WHEN bad IS NULL AND coalesce(w, u) IS NOT NULL THEN (strpos(low, coalesce(w, u)) - 1) || '+' || length(coalesce(w, u)) ELSE '' END AS spans,
  CASE WHEN bad IS NULL THEN title ELSE '' END AS title, CASE WHEN bad IS NULL THEN object_type ELSE '' END AS object_type, count(*) AS n FROM m GROUP BY ALL""",
    "workbook_outline": f"""WITH {_CUSTOMERS}, s AS (SELECT course || '.xlsx' AS book, CAST(k % 30 + 1 AS BIGINT) AS session_no, name AS session_name, k, segment FROM c WHERE k % 11 <> 0)
SELECT book, session_no, session_name, 'Outline' AS "column", 'Outline of ' || session_name AS body_text FROM s WHERE k % 3 = 0 UNION ALL SELECT book, session_no, session_name, 'Key Takeaways', 'Learn ' || segment FROM s""",
    "workbook_practice": f"""WITH {_CUSTOMERS} SELECT a.course || '.xlsx' AS book, 'u' || a.k AS unit_id, CAST(b.k % 30 + 1 AS BIGINT) AS session_no
FROM c a LEFT JOIN c b ON b.course = a.course AND b.k = a.k + 1 AND b.k % 11 <> 0""",
    "workbook_tools": f"""WITH {_CUSTOMERS}, t AS (SELECT course || '.xlsx' AS book, name AS session, k FROM c WHERE k % 8 <> 0)
SELECT book, session, 'kit' || (k % 5) AS name, '1.' || (k % 9) AS version, '' AS qualifier FROM t UNION ALL SELECT book, session, 'Suno', '', 'free' FROM t""",
    "vendor_catalogue": f"""WITH {_MODELS} SELECT vendor, 'm' || k || '-8b' AS entry_id, CASE WHEN dead THEN 'deprecated' ELSE 'available' END AS status, twice AS still_listed,
  CASE WHEN twice THEN 'Contact sales' WHEN dead THEN '' ELSE '$0.10' END AS listed_price, CASE WHEN NOT dead THEN '' WHEN k % 6 = 0 THEN '2020-03-05' ELSE '2031-01-01' END AS shutdown_date, CASE WHEN dead THEN 'm' || (k + 7) || '-8b' ELSE '' END AS replacements FROM m""",
    "model_fates": f"""WITH {_MODELS} SELECT CAST(k AS VARCHAR) AS dep_id, CASE WHEN listed AND dead THEN CASE WHEN twice OR k % 6 = 0 THEN 'broken' ELSE 'changed' END ELSE 'ok' END AS status,
  CASE WHEN NOT listed THEN 'model_provider_unknown' WHEN NOT dead THEN 'model_listed_available' ELSE CASE WHEN twice THEN 'model_tier_restricted' WHEN k % 6 = 0 THEN 'model_shutdown_passed' ELSE 'model_deprecation_declared' END || ',vendor_named_replacement' END AS signals,
  CASE WHEN listed THEN vendor END AS provider FROM m""",
    "model_replacements": f"WITH {_MODELS} SELECT CAST(k AS VARCHAR) AS dep_id, 'm' || (k + 7) || '-8b' AS name FROM m WHERE dead AND listed AND k + 7 IN (SELECT k FROM m)",
    "package_fates": """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 <> 0 AS found, p_partkey % 11 = 0 AS bad, p_partkey % 6 = 0 AS released FROM part)
SELECT CAST(k AS VARCHAR) AS dep_id, CASE WHEN k % 10 = 0 THEN 'broken' WHEN NOT found THEN 'unreachable' WHEN bad OR released THEN 'changed' ELSE 'ok' END AS status,
  concat_ws(',', CASE WHEN k % 10 = 0 THEN 'registry_missing' END, CASE WHEN found AND bad THEN 'registry_deprecated' END, CASE WHEN found AND NOT bad AND released THEN 'new_release' END,
    CASE WHEN found AND k % 4 = 0 THEN 'major_behind_taught_pin' END, CASE WHEN found AND k % 8 = 0 THEN 'no_release_in_2y' END) AS signals FROM p""",
    "node_fates": """SELECT CAST(p_partkey AS VARCHAR) AS dep_id, CASE WHEN p_partkey % 4 = 0 THEN 'broken' WHEN p_partkey % 10 = 1 OR p_partkey = 13 THEN 'changed' ELSE 'ok' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN 'node_removed_upstream' WHEN p_partkey % 10 = 1 THEN 'breaking_change_declared' WHEN p_partkey = 13 THEN 'breaking_change_possible' ELSE '' END AS signal,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'r' || p_partkey WHEN p_partkey = 13 THEN 'general' END AS rule_id FROM part""",
    "corpus_inventory": """
WITH d AS (SELECT doc_id AS d FROM documents),
x AS (
  SELECT 'package' AS kind, 'lib' || (d % 13) AS name, '' AS v, '' AS dom, 3 AS tier FROM d WHERE d % 4 = 0 UNION ALL SELECT 'package', 'scikit-learn', '', '', 3 FROM d WHERE d % 4 = 0 UNION ALL SELECT 'package', '@scope/kit' || (d % 3), '', '', 3 FROM d WHERE d % 4 = 0
  UNION ALL SELECT 'service', 'Tool' || (d % 17), '', 'tool' || (d % 17) || '.io', 2 FROM d WHERE d % 4 = 1 UNION ALL SELECT 'model', 'gpt-' || (d % 5 + 3) || '-mini', '', '', 2 FROM d WHERE d % 4 = 1
  UNION ALL SELECT 'package', 'pin' || (d % 6), '1.' || (d % 6), '', 3 FROM d WHERE d % 4 = 1
  UNION ALL SELECT 'service', 'Tool' || (d % 17), '', '', 1 FROM d WHERE d % 4 = 2 AND d % 17 IN (SELECT d % 17 FROM d WHERE d % 4 = 1) UNION ALL SELECT 'service', 'Tool' || (d % 17), '', '', 1 FROM d WHERE d % 8 = 3 AND d % 17 IN (SELECT d % 17 FROM d WHERE d % 4 = 1))
SELECT kind, name AS canonical_name, max(v) AS taught_version, CASE max(tier) WHEN 3 THEN 'critical' WHEN 2 THEN 'standard' ELSE 'mention-only' END AS watch_tier, count(*) AS n_locations, max(dom) AS domains FROM x GROUP BY 1, 2""",
    "corpus_locations": """
WITH d AS (SELECT doc_id AS d, 'course ' || source AS course FROM documents), t AS (SELECT DISTINCT d % 17 AS m FROM d WHERE d % 4 = 1),
x AS (SELECT course, 'package' AS kind, 'solution_import' AS e, 3 AS n FROM d WHERE d % 4 = 0 UNION ALL SELECT course, 'service', 'link:a_href', 1 FROM d WHERE d % 4 = 1 UNION ALL SELECT course, 'model', 'model_id', 1 FROM d WHERE d % 4 = 1
  UNION ALL SELECT course, 'package', 'install_command', 1 FROM d WHERE d % 4 = 1 UNION ALL SELECT course, 'service', 'prose_name', 1 FROM d JOIN t ON d % 17 = m WHERE d % 4 = 2 UNION ALL SELECT course, 'service', 'question_tag', 1 FROM d JOIN t ON d % 17 = m WHERE d % 8 = 3)
SELECT course, kind, e AS evidence_source, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1, 2, 3""",
    "segment_tags": f"""WITH {_CUSTOMERS} SELECT upper(segment[1]) || lower(segment[2:]) AS name, count(*) AS n, count(DISTINCT course) AS courses FROM c WHERE k % 3 <> 0 AND k % 7 <> 0 AND segment <> 'MACHINERY' GROUP BY 1""",
    "part_findings": f"WITH {_FINDINGS} SELECT k AS dep_id, signal, l[least(5, {_RANK} + extra)] AS severity, radius AS blast_radius, probe_signals, evidence FROM s, n",
    "part_findings_projected": f"""WITH {_FINDINGS},
g AS (SELECT l_partkey AS k, n_name AS course, {_RADIUS} AS radius FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
j AS (SELECT s.k, signal, base, watch_tier, s.radius AS total, g.course, g.radius FROM s JOIN g USING (k))
SELECT k AS dep_id, signal, course, l[{_RANK}] AS local_severity, radius AS blast_radius, total AS total_radius FROM j, n""",
    "part_keys": r"""WITH p AS (SELECT p_partkey, lower('  ' || p_name || '--' || p_brand || '! ' || p_type || ' / .NET ') AS r FROM part)
SELECT p_partkey, trim(regexp_replace(r, '[^a-z0-9_+#.]+', ' ', 'g')) AS norm, trim(regexp_replace(r, '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(r, '[^a-z0-9]', '', 'g') AS stem FROM p""",
    "cited_domains": f"""
WITH p AS (SELECT url, min(page_id) AS ord, {HOST_SQL} AS h FROM pages GROUP BY ALL), q AS (SELECT ord, {OWNER_SQL} AS domain FROM p WHERE h <> '' AND NOT (contains(lower(url), 'best-') OR contains(lower(url), 'top-10') OR contains(lower(url), 'aggregator')))
SELECT domain, count(*) AS n, min(ord) AS first FROM q WHERE domain <> '' GROUP BY 1""",
    "alias_priority": "SELECT s_suppkey, 'service:' || s_suppkey AS entry_id FROM supplier",
}
