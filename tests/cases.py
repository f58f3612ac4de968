"""Unit cases of the engine's operators on a few literal rows each, with the rows that must come out: links, code, tables, exports, claims.

They are tests alone; the same operators run over whole tables in ``tidemark.plans``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import code as C
from tidemark.functions import ladders as L
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import catalogue, evidence, inventory, observe, report, resolve, score, shred, trust, upstream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    return "'" + str(v).replace("'", "''") + "'"


def expect(columns: str, *rows: tuple) -> Callable[[Query], Query]:
    """Registers a query and the rows that it must give."""
    names = columns.split()

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
        ORACLE_SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(f'"{n}"' for n in names)})"
        return f

    return keep


def _joined(array: str | F.Column, sep: str = ",") -> F.Column:
    return F.array_join(array, sep)


@expect(
    "name tier substantiates",
    ("own docs", "AUTHORITATIVE", True), ("own sub-host", "AUTHORITATIVE", True), ("look-alike host", "LEAD_ONLY", False), ("own forum host", "LEAD_ONLY", False), ("own forum path", "LEAD_ONLY", False),
    ("registry in its remit", "AUTHORITATIVE", True), ("registry beyond it", "CORROBORATING", False), ("registry, softer claim", "CORROBORATING", True), ("news", "CORROBORATING", False), ("news, softer claim", "CORROBORATING", True),
    ("directory", "LEAD_ONLY", False), ("content farm", "EXCLUDED", False), ("listicle", "EXCLUDED", False), ("unknown blog", "LEAD_ONLY", False), ("no host", "EXCLUDED", False), ("no subject", "LEAD_ONLY", False),
)
def trust_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ["acme.dev"]
    rows = [
        ("own docs", "https://acme.dev/docs", own, "pricing"), ("own sub-host", "https://status.acme.dev/", own, "existence"), ("look-alike host", "https://notacme.dev/docs", own, "pricing"), ("own forum host", "https://community.acme.dev/x", own, "deprecation"),
        ("own forum path", "https://acme.dev/t/123", own, "deprecation"), ("registry in its remit", "https://pypi.org/project/acme/", own, "version"), ("registry beyond it", "https://pypi.org/project/acme/", own, "pricing"), ("registry, softer claim", "https://pypi.org/project/acme/", own, "availability"),
        ("news", "https://www.theverge.com/acme", own, "deprecation"), ("news, softer claim", "https://www.theverge.com/acme", own, "alternative"), ("directory", "https://g2.com/acme", own, "alternative"), ("content farm", "https://www.guru99.com/acme.html", own, "alternative"),
        ("listicle", "https://blog.example.net/best-tools", own, "alternative"), ("unknown blog", "https://someone.example.net/acme", own, "deprecation"), ("no host", "acme", own, "deprecation"), ("no subject", "https://acme.dev/docs", None, "pricing"),
    ]
    df = spark.createDataFrame(rows, "name string, url string, own_domains array<string>, kind string")
    return trust.classified(df).select("name", "tier", "substantiates")


@expect("kind place url", ("pricing", 0, "https://acme.dev/plans"), ("pricing", 1, "https://acme.dev/pricing"), ("pricing", 2, "https://acme.dev/pricing/"), ("pricing", 3, "https://acme.dev/#pricing"), ("pricing", 4, "https://acme.dev/docs/pricing"), ("pricing", 5, "https://docs.acme.dev"), ("pricing", 6, "https://acme.dev"), ("availability", 0, "https://acme.dev"), ("availability", 1, "https://docs.acme.dev"))
def official_target_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("pricing",), ("availability",)], "kind string")
    subject = F.struct(F.array(F.lit("acme.dev")).alias("official_domains"), F.lit("https://docs.acme.dev").alias("docs_url"), F.lit("https://acme.dev").alias("homepage"), F.lit("").alias("changelog_url"), F.lit("https://acme.dev/plans").alias("pricing_url"), F.lit(None).cast("string").alias("status_url"))
    out = df.select("kind", F.posexplode(trust.official_targets(F.col("kind"), subject)).alias("place", "url"))
    return out.withColumn("place", F.col("place").cast("long"))


_BODY = (
    '<p>See <a class="x" href="https://console.acme.dev/keys#new">keys</a>, <a href=\'https://acme.dev/logo.png\'>logo</a> and '
    "[guide](https://guide.test-tool.io/start?x=1), ![shot](https://cdn.acme.dev/a.PNG) or plain https://plain.io/path). Again https://console.acme.dev/keys."
    '<iframe width=3 src="https://play.acme.dev/embed"></iframe> <img alt="" src="https://cdn.acme.dev/b.jpg?w=2"> mail me@x.io ftp://no.io/a "https://quoted.io"</p>'
)


@expect("url syntax", ("https://console.acme.dev/keys", "a_href"), ("https://play.acme.dev/embed", "iframe"), ("https://guide.test-tool.io/start?x=1", "markdown"), ("https://plain.io/path", "bare"))
def link_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(_BODY,), ("no links here",), (None,)], "body string")
    return df.select(F.explode(U.links(F.col("body"))).alias("l")).select("l.url", "l.syntax")


@expect("url", ("https://cdn.acme.dev/a.PNG",), ("https://cdn.acme.dev/b.jpg?w=2",))
def image_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_BODY,)], "body string").select(F.explode(U.images(F.col("body"))).alias("url"))


@expect(
    "url host owner service citation",
    ("https://User:pw@WWW.Console.Groq.com:8443/a?b", "console.groq.com", "groq.com", "Groq", False), ("http://jane.github.io/x", "jane.github.io", "jane.github.io", "Jane.github", True), ("https://shop.acme.co.uk", "shop.acme.co.uk", "acme.co.uk", "Acme.co", False),
    ("https://10.0.0.1/x", "10.0.0.1", "10.0.0.1", "10.0.0", False), ("https://cs.stanford.edu/a", "cs.stanford.edu", "stanford.edu", "Stanford", True), ("https://your-app.io", "your-app.io", "your-app.io", "Your App", True), ("https://news.bbc.co.uk/1", "news.bbc.co.uk", "bbc.co.uk", "Bbc.co", True),
    ("mailto:me@x.io", "", "", "", True), ("https://dev-tools.io/a b", "dev-tools.io", "dev-tools.io", "Dev Tools", False),
)
def host_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ["https://User:pw@WWW.Console.Groq.com:8443/a?b", "http://jane.github.io/x", "https://shop.acme.co.uk", "https://10.0.0.1/x", "https://cs.stanford.edu/a", "https://your-app.io", "https://news.bbc.co.uk/1", "mailto:me@x.io", "https://dev-tools.io/a b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", U.host(F.col("url"))).withColumn("owner", U.registrable(F.col("host")))
    return df.withColumns({"service": U.service_name(F.col("owner")), "citation": U.is_citation(F.col("url"))})


_CODE = "import os, numpy as np\nfrom sklearn.linear_model import Ridge\n  import requests, yaml\nfrom _private import x\nconst a = require('express/lib');\nimport b from '@scope/pkg/deep';\nimport c from './local'\nfrom langchain_core.tools import tool"


@expect("name registry", ("numpy", "pypi"), ("scikit-learn", "pypi"), ("requests", "pypi"), ("pyyaml", "pypi"), ("langchain-core", "pypi"), ("express", "npm"), ("@scope/pkg", "npm"))
def import_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_CODE,), (None,)], "code string").select(F.explode(C.imports(F.col("code"))).alias("p")).select("p.name", "p.registry")


_INSTALL = "```bash\n$ pip install -U gradio==6.6.0 requests>=2 in your terminal\n! python -m pip3 install chromadb \"uvicorn\"\n```\nThen npm install --save @acme/sdk left-pad and go on.\nIf response.status_code == 200 it works. pip install the package."


@expect("source name detail", ("install", "gradio", "pypi"), ("install", "requests", "pypi"), ("install", "chromadb", "pypi"), ("install", "uvicorn", "pypi"), ("pin", "gradio", "6.6.0"))
def install_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(_INSTALL,)], "body string")
    got = df.select(F.lit("install").alias("source"), F.explode(C.installs(F.col("body"))).alias("p")).select("source", F.col("p.name").alias("name"), F.col("p.registry").alias("detail"))
    return got.unionByName(df.select(F.lit("pin").alias("source"), F.explode(C.pins(F.col("body"))).alias("p")).select("source", F.col("p.name").alias("name"), F.col("p.version").alias("detail")))


@expect("model vendor", ("gemini-2.5-flash", "Google"), ("gpt-4o-mini", "OpenAI"), ("llama-3.3-70b-versatile", "Meta"), ("qwen2.5/qwen3-32b", "Alibaba"), ("text-embedding-3-small", "OpenAI"))
def model_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'Call "gemini-2.5-flash", or GPT-4o-mini. See the gemini-api docs, gpt-4-docs and claude-pricing. Use llama-3.3-70b-versatile; qwen2.5/qwen3-32b) and text-embedding-3-small, not gpt-x.'
    df = spark.createDataFrame([(text,)], "body string").select(F.explode(C.models(F.col("body"))).alias("model"))
    return df.withColumn("vendor", C.model_vendor(F.col("model")))


@expect("node package", ("n8n-nodes-base.webhook", "n8n-nodes-base"), ("@n8n/n8n-nodes-langchain.agent", "@n8n/n8n-nodes-langchain"))
def node_mention_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'Truncated {"type": "n8n-nodes-base.webhook", "typeVersion": 2 and bare @n8n/n8n-nodes-langchain.agent, not n8n-nodes-base.yourNode'
    df = spark.createDataFrame([(text,)], "body string").select(F.explode(C.node_mentions(F.col("body"))).alias("node"))
    return df.withColumn("package", C.node_package(F.col("node")))


@expect(
    "payload name version", ("list", "n8n-nodes-base.set", "3.4"), ("nested", "n8n-nodes-base.webhook", "2"), ("nested", "n8n-nodes-base.webhook", "1"), ("nested", "@n8n/n8n-nodes-langchain.agent", ""), ("single", "n8n-nodes-base.code", "2"),
    ("flat", "n8n-nodes-base.if", "1"), ("flat", "n8n-nodes-base.if", "2"), ("flat", "n8n-nodes-base.merge", ""), ("text", "n8n-nodes-base.wait", ""),
)
def node_payload_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of workflows in a list, under other keys, alone, at top level and nested, and in text that isn't JSON."""
    bodies = [
        ("list", '[{"nodes": [{"type": "n8n-nodes-base.set", "typeVersion": 3.4}, {"type": "n8n-nodes-base.yourNode", "typeVersion": 1}]}]'),
        ("nested", '{"data": {"workflow": {"nodes": [{"type": "n8n-nodes-base.webhook", "typeVersion": 2, "parameters": {"inner": {"type": "n8n-nodes-base.webhook", "typeVersion": 1}}}, {"type": "@n8n/n8n-nodes-langchain.agent"}]}}}'),
        ("single", ' {"type": "n8n-nodes-base.code", "typeVersion": 2, "name": null}'),
        ("flat", '{"nodes": [{"type": "n8n-nodes-base.if", "typeVersion": 1, "sub": [{"type": "n8n-nodes-base.if", "typeVersion": 2}]}], "note": "uses n8n-nodes-base.merge"}'),
        ("text", 'Cut {"type": "n8n-nodes-base.wait", "typeVersion": 1'),
    ]
    records = spark.createDataFrame(bodies, "content_id string, body_text string").withColumns({c: F.lit("") for c in ("course", "topic_name", "unit_id", "unit_name", "field_path", "object_type")} | {"session_no": F.lit(1)})
    return inventory.node_mentions(records).select(F.col("content_id").alias("payload"), "name", F.col("taught_version").alias("version"))


@expect("name version qualifier", ("n8n", "2.17.8", ""), ("Google Sheets", "", "free tier"), ("gradio", "6.6.0", "pinned"))
def tool_cell_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "n8n@2.17.8, Google Sheets (free tier)\nhttps://x.io/a, b\n- , N/A, gradio@6.6.0 (pinned), x"
    return spark.createDataFrame([(cell,), (None,)], "cell string").select(F.explode(T.tool_cell(F.col("cell"))).alias("t")).select("t.name", "t.version", "t.qualifier")


@expect("raw norm slug stem", ("  Twelve--Data API! ", "twelve data api", "twelve_data_api", "twelvedataapi"), ("C++ / .NET", "c++ .net", "c_net", "cnet"), ("Café Noir - Course Contents.xlsx", "café noir course contents.xlsx", "caf_noir_course_contents_xlsx", "cafnoir"), ("", "", "unknown", ""))
def key_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["  Twelve--Data API! ", "C++ / .NET", "Café Noir - Course Contents.xlsx", ""]
    raw = F.col("raw")
    return spark.createDataFrame([(r,) for r in rows], "raw string").select("raw", T.norm(raw).alias("norm"), T.slug(raw).alias("slug"), T.workbook_stem(raw).alias("stem"))


@expect("spec numbers again", ("3", "3", "3"), ("3-7", "3,4,5,6,7", "3-7"), (" 9-11, 3 ,5,4", "3,4,5,9,10,11", "3-5,9-11"), ("7-5", "5,6,7", "5-7"), ("x", None, None), ("", "", ""))
def session_spec_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(s,) for s in ("3", "3-7", " 9-11, 3 ,5,4", "7-5", "x", "")], "spec string").withColumn("n", L.session_numbers(F.col("spec")))
    return df.select("spec", _joined("n").alias("numbers"), F.when(F.col("n").isNotNull(), L.compacted(F.col("n"))).alias("again"))


def severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal at every tier and several radii."""
    signals = spark.createDataFrame([(f"S{i}",) for i in range(1, 12)], "signal string")
    grid = signals.withColumn("tier", F.explode(T.strings(["critical", "standard", "mention-only"]))).withColumn("radius", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 7, 8, 100)])))
    grid = grid.withColumn("severity", L.severity(F.col("signal"), F.col("tier"), F.col("radius")))
    retired = L.retirement_severity(F.col("signal"), F.col("tier"), F.col("radius"), F.lit(0), F.lit(0))
    return grid.select("signal", "tier", F.col("radius").cast("long").alias("radius"), "severity", retired.alias("retired"))


QUERIES["severity_matrix"] = severity_matrix
ORACLE_SQL["severity_matrix"] = """
WITH b AS (SELECT * FROM (VALUES ('S1', 5), ('S2', 4), ('S3', 4), ('S4', 4), ('S5', 3), ('S6', 3), ('S7', 4), ('S8', 2), ('S9', 3), ('S10', 2), ('S11', 2)) v(signal, base)),
g AS (SELECT signal, tier, radius, least(5, greatest(1, base + CASE WHEN tier = 'critical' AND radius >= 8 THEN 1 WHEN tier = 'mention-only' OR radius <= 1 THEN -1 ELSE 0 END)) AS s
      FROM b, (SELECT unnest(['critical', 'standard', 'mention-only']) AS tier), (SELECT unnest([0, 1, 2, 7, 8, 100]) AS radius)),
l AS (SELECT ['info', 'low', 'medium', 'high', 'critical'] AS n)
SELECT signal, tier, CAST(radius AS BIGINT) AS radius, n[s] AS severity, n[greatest(1, s - 1)] AS retired FROM g, l"""


@expect("dep_id status signals", ("gone", "broken", "registry_missing"), ("down", "unreachable", ""), ("new", "changed", "new_release,major_behind_taught_pin"), ("old", "ok", "no_release_in_2y"), ("bad", "changed", "registry_deprecated"), ("same", "ok", ""), ("never", "unreachable", ""))
def package_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = spark.createDataFrame([(d, "pypi", d, v) for d, v in (("gone", ""), ("down", ""), ("new", "1.2"), ("old", "3"), ("bad", "1"), ("same", "2.9"), ("never", ""))], "dep_id string, registry string, registry_id string, taught_version string")
    rows = [("pypi", "gone", False, True, None, None, None, None), ("pypi", "down", False, False, None, None, None, None), ("pypi", "new", True, True, "2.0", "2025-01-01", False, False), ("pypi", "old", True, True, "3.1", "2020-01-01", False, None), ("pypi", "bad", True, True, "1.9", "2025-01-01", True, False), ("pypi", "same", True, True, "2.9.1", "2025-01-01", None, None)]
    reg = spark.createDataFrame(rows, "registry string, name string, found boolean, reachable boolean, latest_version string, released_at string, yanked boolean, deprecated boolean").withColumn("released_at", F.col("released_at").cast("timestamp"))
    before = spark.createDataFrame([("new", "1.9"), ("same", "2.9.1")], "dep_id string, latest_version string")
    return observe.packages(deps, reg, before, F.lit("2025-06-01").cast("timestamp")).select("dep_id", "status", _joined("signals").alias("signals"))


def _tools(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    deps = spark.createDataFrame([(n, k, n, d, r) for n, k, d, r in (("Both", "tool", [], None), ("Node", "tool", [], ""), ("None", "tool", None, None), ("Owned", "tool", ["o.io"], None), ("Homed", "tool", [], "npm"), ("Loose", "tool", [], None), ("Service", "service", [], None), ("Stray", "tool", [], None), ("Node.js", "tool", [], None), ("Aka", "tool", [], None))], "dep_id string, kind string, canonical_name string, official_domains array<string>, registry string")
    places = spark.createDataFrame([(n, "sheet_pin") for n in ("Both", "Both", "Node", "None", "Owned", "Homed", "Service", "Stray", "Node.js", "Aka")] + [("Loose", "sheet_tool")], "dep_id string, evidence_source string")
    entries = spark.createDataFrame([("tool:both", "tool", "Both", [], "old", 1), ("package:both", "package", "both", ["bo"], "", 2), ("tool:node", "tool", "Node", ["Node.js", "Aka"], "", 3), ("tool:none", "tool", "None", [], "", 4), ("tool:loose", "tool", "Loose", [], "", 5)], "entry_id string, kind string, canonical_name string, aliases array<string>, notes string, ord int")
    entries = entries.withColumns({"official_domains": F.array().cast("array<string>")} | {c: F.lit("") for c in ("registry", "registry_id", "review_status")})
    return deps, places, entries


def _served(spark: SparkSession, unpinned: bool) -> tuple[DataFrame, DataFrame]:
    deps, places, entries = _tools(spark)
    reg = spark.createDataFrame([("npm", "Both", True, "9"), ("pypi", "Both", True, "1"), ("pypi", "Node", False, None), ("npm", "Node", True, "22"), ("npm", "Node.js", True, "3"), ("pypi", "None", False, None), ("pypi", "Loose", True, "5"), ("pypi", "Owned", True, "1"), ("pypi", "Stray", True, "1")], "registry string, name string, found boolean, latest_version string")
    return observe.registry_lookup(observe.unresolved_tools(deps, places, unpinned), entries, reg)


@expect(
    "flag name registry latest", ("pinned", "Both", "pypi", "1"), ("pinned", "Node", "npm", "22"), ("pinned", "None", "", ""), ("pinned", "Aka", "", ""),
    ("all", "Both", "pypi", "1"), ("all", "Node", "npm", "22"), ("all", "Loose", "pypi", "5"), ("all", "None", "", ""), ("all", "Aka", "", ""),
)
def package_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools without an authority that a registry serves, and those that none does (without a registry), pinned ones alone or all."""
    out = []
    for flag in ("pinned", "all"):
        served, rest = _served(spark, flag == "all")
        out += [served.select(F.lit(flag).alias("flag"), "name", "registry", F.col("latest_version").alias("latest")), rest.select(F.lit(flag), "name", F.lit(""), F.lit(""))]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@expect("entry_id kind registry registry_id review_status aliases noted", ("package:both", "package", "pypi", "Both", "approved", "bo", True), ("package:node", "package", "npm", "Node", "approved", "Aka,Node.js", True), ("tool:none", "tool", "", "", "", "", False), ("tool:loose", "tool", "", "", "", "", False))
def package_retyping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after served tools became packages under a new key; one of them meets an entry that has it already."""
    entries = observe.retyped(_tools(spark)[2], _served(spark, False)[0])
    return entries.select("entry_id", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("registry", "registry_id", "review_status")], _joined("aliases").alias("aliases"), F.coalesce(F.contains("notes", F.lit("retyped tool->package")), F.lit(False)).alias("noted"))


_PAGES = [
    ("groq", "https://g.test/deprecations", "<table><tr><th>Deprecated Model</th><th>Shutdown Date</th><th>Recommended Replacement Model ID</th></tr><tr><td><code>alpha-70b</code></td><td>03/05/25</td><td>vendor/beta-120b or gamma-32b</td></tr><tr><td>delta-8b</td><td>2031-01-01</td><td>alpha-70b</td></tr><tr><td><code>eps-1b</code></td><td></td><td></td></tr></table>"),
    ("groq", "https://g.test/models", "<table><caption>Live</caption><tr><th>MODEL ID</th><th>Price per 1M tokens</th><th>Rate limits</th></tr><tr><td><code>gamma-32b</code></td><td>$0.10</td><td>30</td></tr><tr><td><code>eps-1b</code></td><td>Contact&nbsp;sales</td><td></td></tr></table>"),
    ("other", "https://o.test/models", "<p>text</p><table><tr><th>Name</th><th>Endpoint</th></tr><tr><td>Zeta 2 Flash (Shut down)</td><td><code>zeta-2-flash</code></td></tr><tr><td>Zeta 3 (Preview)</td><td><code>zeta-3</code></td></tr><tr><td>Alpha</td><td>alpha-70b</td></tr></table><table><tr><th>Colour</th></tr><tr><td>red</td></tr></table>"),
]


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PAGES, "vendor string, url string, html string")


@expect(
    "vendor entry_id column_role status date replacements",
    ("groq", "alpha-70b", "id", "deprecated", "03/05/25", "vendor/beta-120b|gamma-32b"), ("groq", "vendor/beta-120b", "replacement", "available", "", ""), ("groq", "gamma-32b", "replacement", "available", "", ""), ("groq", "delta-8b", "id", "deprecated", "2031-01-01", "alpha-70b"),
    ("groq", "alpha-70b", "replacement", "available", "", ""), ("groq", "eps-1b", "id", "deprecated", "", ""), ("groq", "gamma-32b", "id", "available", "", ""), ("groq", "eps-1b", "id", "available", "", ""), ("other", "zeta-2-flash", "id", "shut down", "", ""), ("other", "zeta-3", "id", "preview", "", ""), ("other", "Alpha", "id", "available", "", ""),
)
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.parsed(_pages(spark)).select("vendor", "entry_id", "column_role", "status", "date", _joined("replacements", "|").alias("replacements"))


@expect("vendor entry_id status still_listed listed_price", ("groq", "alpha-70b", "deprecated", False, ""), ("groq", "delta-8b", "deprecated", False, ""), ("groq", "eps-1b", "deprecated", True, "Contact sales"), ("groq", "gamma-32b", "available", False, "$0.10"), ("other", "zeta-2-flash", "shut down", False, ""), ("other", "zeta-3", "preview", False, ""), ("other", "Alpha", "available", False, ""))
def catalogue_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.catalogue(_pages(spark)).select("vendor", "entry_id", "status", "still_listed", "listed_price")


def _probed_models(spark: SparkSession, readable: bool = True) -> DataFrame:
    deps = spark.createDataFrame([(d, d) for d in ("Alpha-70B", "delta-8b", "eps-1b", "gamma-32b", "zeta-2-flash", "zeta-3", "alpha-70b-lite")], "dep_id string, canonical_name string")
    vendors = spark.createDataFrame([("groq", 1, True, True), ("other", 2, True, True), ("down", 3, readable, True)], "vendor string, ord int, ok boolean, supported boolean")
    return observe.models(deps, catalogue.catalogue(_pages(spark)), vendors, F.lit("2026-01-01").cast("date"))


@expect("dep_id status signals provider", ("Alpha-70B", "broken", "model_shutdown_passed,vendor_named_replacement", "groq"), ("delta-8b", "changed", "model_deprecation_declared,vendor_named_replacement", "groq"), ("eps-1b", "broken", "model_tier_restricted", "groq"), ("gamma-32b", "ok", "model_listed_available", "groq"), ("zeta-2-flash", "broken", "model_shutdown_passed", "other"), ("zeta-3", "ok", "model_listed_available", "other"), ("alpha-70b-lite", "ok", "model_provider_unknown", None))
def model_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed_models(spark).select("dep_id", "status", _joined("signals").alias("signals"), "provider")


@expect("dep_id status", ("alpha-70b-lite", "inconclusive"))
def model_probes_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed_models(spark, readable=False).filter("status = 'inconclusive'").select("dep_id", "status")


@expect("dep_id name", ("Alpha-70B", "gamma-32b"))
def served_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.served_replacements(_probed_models(spark), catalogue.catalogue(_pages(spark)))


@expect("dep_id status signal rule_id", ("hook", "changed", "breaking_change_declared", "r1"), ("gone", "broken", "node_removed_upstream", None), ("py", "changed", "breaking_change_possible", "r2"), ("set", "ok", "", None))
def node_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = spark.createDataFrame([("hook", "n8n-nodes-base.webhook"), ("gone", "n8n-nodes-base.oldThing"), ("py", "n8n-nodes-base.codeRunner"), ("set", "n8n-nodes-base.set")], "dep_id string, canonical_name string")
    paths = spark.createDataFrame([(f"packages/nodes-base/nodes/{n}/{n}.node.ts",) for n in ("Webhook", "CodeRunner", "Set")] + [("packages/other/Nope.node.ts",)], "path string")
    bodies = [("rules/a.ts", "@BreakingChangeRule({ version: 'v2' }) id: string = 'r1' title: 'Webhook answers', description: 'x' + 'y', severity: 'High', types ['n8n-nodes-base.webhook'] action: 'Go'"), ("rules/b.ts", "@BreakingChangeRule({ version: 'v3' }) id: string = 'r2' title: 'Code runner drops Python' description: 'the code runner'"), ("rules/c.ts", "export const x = 1")]
    rules = upstream.node_rules(spark.createDataFrame(bodies, "path string, body string"))
    return observe.nodes(deps, upstream.node_index(paths), rules, True)


@expect("rule_id version title description severity nodes actions", ("r1", "v2", "Webhook answers", "x y", "high", "n8n-nodes-base.webhook", "Go"), ("b", "v3", "Later", "", "medium", "", ""))
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = [("rules/a.ts", "@BreakingChangeRule({ version: 'v2' }) id: string = 'r1' title: 'Webhook answers', description:\n 'x' +\n 'y', severity: 'High', types ['n8n-nodes-base.webhook'] action: 'Go'"), ("rules/b.ts", "@BreakingChangeRule({ version: 'v3' }) title: 'Later'"), ("rules/c.ts", "export const x = 1")]
    return upstream.node_rules(spark.createDataFrame(bodies, "path string, body string")).select("rule_id", "version", "title", "description", "severity", _joined("node_types").alias("nodes"), _joined("actions").alias("actions"))


_PROSE = "Our service is a place where people build things and share them with others every day of the week. " * 8


@expect("dep_id signals lost", ("first", "pricing_baseline_recorded", ""), ("lost", "free_tier_language_lost,pricing_restriction_language", "no credit card"), ("calm", "", ""))
def pricing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.hashing import simhash_of

    page = lambda x: f"{_PROSE}{x}"
    now = spark.createDataFrame([("first", page("Free tier for all.")), ("lost", page("Start with the free tier; projects of new accounts are billed.")), ("calm", page("Free plan, no credit card."))], "dep_id string, page string")
    near = [("lost", simhash_of(page("Start with the free tier; projects of new accounts are billed.")), ["free tier", "no credit card"]), ("calm", simhash_of(page("Free plan, no credit card.")), ["free plan"])]
    return observe.pricing(now, spark.createDataFrame(near, "dep_id string, text_hash string, free array<string>")).select("dep_id", _joined("signals").alias("signals"), _joined("lost").alias("lost"))


@expect("dep_id status signal", ("dead", "broken", "url_gone"), ("fine", "ok", ""), ("moved", "changed", "redirected_off_path"), ("sunset", "changed", "sunset_language_about_subject"), ("elsewhere", "ok", ""), ("blocked", "inconclusive", "blocked_by_host"), ("silent", "unreachable", ""), ("parked", "broken", "domain_parked"), ("robots", "inconclusive", "disallowed_by_robots"))
def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = "and much more text about other matters follows here in this place. " * 6
    pages = {
        "dead": (404, "https://dead.io/a", None, ""), "fine": (200, "https://fine.io/a", None, "<p>All is well here.</p>"), "moved": (200, "https://moved.io/", None, "<p>Home</p>"), "sunset": (200, "https://sunset.io/a", None, "<div>Acme sunset&amp;co has been deprecated.</div>"),
        "elsewhere": (200, "https://elsewhere.io/a", None, f"<p>elsewhere</p><p>{far}</p><p>The old node has been deprecated.</p>"), "blocked": (403, "https://blocked.io/a", None, ""), "silent": (None, None, "timeout", None), "parked": (200, "https://parked.io/a", None, "<nav>x</nav><p>This domain is for sale</p>"), "robots": (None, None, "disallowed_by_robots", None),
    }
    targets = spark.createDataFrame([(d, 0, f"https://{d}.io/a", [d]) for d in pages], "dep_id string, ord int, url string, terms array<string>")
    fetches = spark.createDataFrame([(f"https://{d}.io/a", *p) for d, p in pages.items()], "url string, status int, final_url string, error string, body string")
    seen = observe.url_observations(targets, fetches).withColumn("drift", F.lit(None).cast("int"))
    return observe.folded(seen)


@expect("sentence", ("The free tier of this service allows a small number of requests per day for everyone.",), ("You can sign up and create an account without giving any payment details at all.",))
def prose_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["The free tier of this service allows a small number of requests per day for everyone.", "Pricing | Acme | Home", "Is this really free for all of us now?", "Products Solutions Resources Company Pricing Login Docs Blog now.", '{"a": {"b": 1}, "text": "some words in it here"}', "Too short.", "You can sign up and create an account without giving any payment details at all."]
    return spark.createDataFrame([("\n".join(lines),)], "page string").select(F.explode(T.sentences(F.col("page"))).alias("sentence"))


def _subjects(spark: SparkSession) -> DataFrame:
    rows = [("acme", "Acme", ["acme sdk"], ["acme.dev"], "", "https://acme.dev", "", "https://acme.dev/pricing", ""), ("nohome", "Nohome", [], ["nohome.io"], "", "", "", "", "")]
    df = spark.createDataFrame(rows, "dep_id string, name string, aliases array<string>, official_domains array<string>, docs_url string, homepage string, changelog_url string, pricing_url string, status_url string")
    return df.select("dep_id", "name", "aliases", F.struct("official_domains", "docs_url", "homepage", "changelog_url", "pricing_url", "status_url").alias("subject"))


def _fetches(spark: SparkSession) -> DataFrame:
    ok = "<nav>Menu</nav><p>The free tier allows twenty requests per minute for every account that is in good standing with us.</p><p>Nothing else is said on this page about any of it.</p>"
    end = "<p>The Acme classic console has been deprecated and will stop working for everyone at the end of this year.</p><p>Please migrate to Boltwise today.</p>"
    rows = [("https://acme.dev/pricing", 200, ok), ("https://acme.dev/deprecations", 200, end), ("https://acme.dev/plans", 404, ""), ("https://acme.dev", 200, "<p>Short.</p>")]
    return spark.createDataFrame(rows, "url string, status int, body string")


@expect("dep_id kind source_url quote tier substantiates", ("acme", "pricing", "https://acme.dev/pricing", "The free tier allows twenty requests per minute for every account that is in good standing with us.", "AUTHORITATIVE", True), ("acme", "deprecation", "https://acme.dev/deprecations", "The Acme classic console has been deprecated and will stop working for everyone at the end of this year.", "AUTHORITATIVE", True))
def gathered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = evidence.gathered(_subjects(spark), ["deprecation", "pricing"], _fetches(spark))
    return claims.select("dep_id", "kind", "source_url", "quote", "tier", "substantiates")


@expect("dep_id kind reason", ("a", "pricing", "quote too short to verify"), ("b", "pricing", "no source"), ("c", "version", "excluded source"), ("d", "version", "empty statement"))
def claim_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "pricing", "s", "https://acme.dev", "short"), ("b", "pricing", "s", " ", "a quote that is long"), ("c", "version", "s", "https://guru99.com/x", "a quote that is long"), ("d", "version", "", "https://acme.dev", "a quote that is long"), ("e", "version", "s", "https://acme.dev", "a quote that is long")]
    df = spark.createDataFrame(rows, "dep_id string, kind string, statement string, source_url string, quote string").withColumn("own_domains", F.array(F.lit("acme.dev")))
    return evidence.gated(df)[1].select("dep_id", "kind", "reason")


@expect("dep_id successor", ("acme", "Boltwise"))
def successor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = evidence.read_pages(_subjects(spark), ["deprecation"], _fetches(spark)).join(_subjects(spark), "dep_id")
    return evidence.successor_leads(pages.select("dep_id", "url", "text", F.concat(F.array("name"), "aliases").alias("terms"))).select("dep_id", "successor")


@expect(
    "nom_id at verdict",
    (1, "good.io", "verified"), (2, "", "rejected_generic_token"), (3, "not a host", "rejected_malformed_domain"), (4, "toolify.ai", "rejected_excluded"), (5, "docs.acme.dev", "rejected_same_vendor"), (6, "", "vendor_named"), (7, "", "unresolved_name_only"),
    (8, "nowhere.io", "refuted_no_such_domain"), (9, "inside.io", "rejected_excluded"), (10, "dead.io", "refuted_dead"), (11, "wall.io", "unverifiable_blocked"), (12, "good.io", "verified"), (13, "empty.io", "refuted_no_evidence"), (14, "", "rejected_malformed_domain"),
)
def nomination_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark).select("nom_id", "at", "verdict")


def _judged(spark: SparkSession) -> DataFrame:
    noms = [(1, "Good", "good.io", "search"), (2, "OAuth", "", "model"), (3, "Odd", "not a host", "model"), (4, "List", "toolify.ai", "search"), (5, "Own", "docs.acme.dev", "model"), (6, "Next", "", "vendor_named"), (7, "Name", "", "model"), (8, "Ghost", "nowhere.io", "model"), (9, "In", "inside.io", "model"), (10, "Dead", "dead.io", "search"), (11, "Wall", "wall.io", "search"), (12, "Old", "old.io", "search"), (13, "Empty", "empty.io", "search"), (14, " ", "", "model")]
    df = spark.createDataFrame(noms, "nom_id long, name string, domain string, source string").withColumn("own_domains", F.array(F.lit("acme.dev")))
    dns = spark.createDataFrame([(d, "ok") for d in ("good.io", "dead.io", "wall.io", "old.io", "empty.io")] + [("inside.io", "private")], "domain string, safety string")
    said = "The free tier allows twenty requests per minute for every account that is in good standing with us."
    pages = [("good.io", 200, "", said), ("dead.io", 410, "", ""), ("wall.io", 403, "", ""), ("old.io", 200, "mid.io", ""), ("mid.io", 200, "good.io", ""), ("empty.io", 200, "", "Hello.")]
    fetches = spark.createDataFrame(pages, "domain string, status int, final_domain string, text string")
    return evidence.adjudicated(df, dns, fetches)


@expect("outcome n names", ("established", 3, "Good,Next,Old"), ("refuted", 3, "Dead,Empty,Ghost"), ("rejected", 6, ",In,List,OAuth,Odd,Own"), ("open", 2, "Name,Wall"))
def nomination_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.tallied(_judged(spark)).select("outcome", "n", _joined("names").alias("names"))


@expect("domain n first", ("tool-b.io", 2, 1), ("tool-a.io", 1, 0), ("g2.com", 1, 5))
def discovered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ["https://tool-a.io/x", "https://www.tool-b.io/", "https://app.tool-b.io/pricing", "https://guru99.com/best", "https://tool-a.io/x", "https://g2.com/p"]
    return evidence.discovered(spark.createDataFrame(list(enumerate(urls)), "ord long, url string"))


@expect("prompt_sha name domain", ("p1", "Boltwise", "boltwise.io"), ("p1", "Kite", ""), ("p1", "Moss", ""), ("p3", "Solo", ""))
def nominations_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = json.dumps({"nominations": [{"name": "Boltwise", "candidate_domain": "Boltwise.io"}, {"name": "x"}, {"name": "boltwise"}, {"name": "https://evil.io"}, {"name": "Kite", "candidate_domain": "https://kite.io/a"}, {"name": "Moss"}, {"name": "Fourth"}]})
    rows = [("p1", f"Sure:\n```json\n{one}\n```\nDone."), ("p2", "I can't."), ("p3", '{"nominations": [{"name": "Solo"}]} as asked')]
    return evidence.parsed_nominations(spark.createDataFrame(rows, "prompt_sha string, text string")).select("prompt_sha", "name", "domain")


@expect("finding_id outcome", ("good", "accepted"), ("lie", "invented source"), ("part", "missing part"), ("none", "not json"))
def rewrites_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = lambda what, why="w", when="n": json.dumps({"what_to_act": what, "why_to_act": why, "when_to_act": when})
    rows = [("good", reply("see https://acme.dev/x.")), ("lie", reply("see https://else.io/x")), ("part", reply("a", "")), ("none", "no")]
    df = spark.createDataFrame(rows, "finding_id string, reply string").withColumn("allowed", F.array(F.lit("https://acme.dev/x")))
    return evidence.judged_rewrites(df)


_COURSE = [{"topics": [
    {"topic_name": "T1", "units": [
        {"unit_id": "u2", "unit_name": "Second", "unit_type": "LEARNING_SET", "order": 2, "contents": [{"learning_resource_id": "r2", "learning_resource_type": "INTERACTIVE_VIDEO", "object_type": "LEARNING_RESOURCE", "content": "Open <a href=\"https://console.boltwise.io/keys\">Boltwise</a>\n$ pip install gradio==6.6.0", "title": "Intro"}]},
        {"unit_id": "u1", "unit_name": "First", "unit_type": "LEARNING_SET", "order": 1, "question_tags": [{"tag_name": "Boltwise"}, {"tag": "machine_made_tag"}, {"tag_name_enum": "Node Identification"}], "contents": [{"learning_resource_id": "r1", "learning_resource_type": "INTERACTIVE_VIDEO", "object_type": "LEARNING_RESOURCE", "short_text": "Boltwise is nice", "slides": [{"slide_url": "https://s.io/1"}]}]},
    ]},
    {"topic_name": "T2", "units": [
        {"unit_id": "q1", "unit_type": "ASSESSMENT", "exam_details": [{"question_details": [{"question_id": "x1", "object_type": "CODING_QUESTIONS", "solutions": [{"solution_answer": "import numpy\nimport gradio", "title_content": ""}], "test_cases": [{"test_case_enum": "GRADIO"}]}]}]},
        {"unit_id": "q2", "unit_type": "QUIZ", "exam_details": {"title": "Quiz Two"}, "exam_sections": [{"contents": [{"question_id": "x2", "object_type": "OBJECTIVE_QUESTIONS", "content": "Which model is gemini-2.5-flash?", "options": [{"content": "A"}, {"content": "B"}]}]}]},
        {"unit_id": "q3", "unit_type": "QUIZ", "exam_sections": [{"contents": []}]},
    ]},
]}]


def _docs(spark: SparkSession) -> DataFrame:
    return shred.exports(spark.createDataFrame([("a.json", "Course A", json.dumps(_COURSE))], "source_file string, course string, body string"))


def _declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("u2", 7)], "unit_id string, session_no int")


@expect("unit_id unit_name is_session positional base", ("u1", "First", True, 1, "$.topics[0].units[1]"), ("u2", "Second", True, 2, "$.topics[0].units[0]"), ("q1", "Module Quiz", False, 2, "$.topics[1].units[0]"), ("q2", "Quiz Two", False, 2, "$.topics[1].units[1]"), ("q3", "(unnamed unit)", False, 2, "$.topics[1].units[2]"))
def course_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.units(_docs(spark)).select("unit_id", "unit_name", "is_session", F.col("positional").cast("long").alias("positional"), "base")


@expect(
    "unit_id session_no content_id evidence_source field_path pooled",
    ("u2", 7, "r2", "markdown", "$.topics[0].units[0].contents[0].content", False), ("u1", 1, "r1", "title", "$.topics[0].units[1].contents[0].short_text", False), ("u1", 1, "r1", "url_field", "$.topics[0].units[1].contents[0].slides[0].slide_url", False),
    ("u1", 1, "", "question_tag", "$.topics[0].units[1].question_tags[0].tag_name_enum", False), ("u1", 1, "", "question_tag", "$.topics[0].units[1].question_tags[1].tag_name_enum", False), ("u1", 1, "", "question_tag", "$.topics[0].units[1].question_tags[2].tag_name_enum", False),
    ("q1", 2, "x1", "solution_code", "$.topics[1].units[0].exam_details[0].question_details[0].solutions[0].solution_answer", True), ("q1", 2, "x1", "test_case_enum", "$.topics[1].units[0].exam_details[0].question_details[0].test_cases[0].test_case_enum", True),
    ("q2", 2, "x2", "markdown", "$.topics[1].units[1].exam_sections[0].contents[0].content", True), ("q2", 2, "x2", "markdown", "$.topics[1].units[1].exam_sections[0].contents[0].options[0].content", True), ("q2", 2, "x2", "markdown", "$.topics[1].units[1].exam_sections[0].contents[0].options[1].content", True),
)
def course_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.records(_docs(spark), _declared(spark)).select("unit_id", F.col("session_no").cast("long").alias("session_no"), "content_id", "evidence_source", "field_path", "pooled")


@expect("course units sessions pools pools_read gap", ("Course A", 5, 2, 3, 2, 1))
def course_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark)
    return shred.reconciled(docs, shred.records(docs))


@expect("found n", (True, 8))
def course_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path leads back to its text in the export, whatever order the units are shown in."""
    docs = _docs(spark)
    rows = shred.records(docs).filter("evidence_source <> 'question_tag'")
    return shred.dereferenced(rows, docs).groupBy((F.col("value") == F.col("body_text")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = [
    ("B.xlsx", "Course Outline", 1, 1, "Session Name"), ("B.xlsx", "Course Outline", 1, 2, " SESSION  No. "), ("B.xlsx", "Course Outline", 1, 3, "Session ID"), ("B.xlsx", "Course Outline", 1, 4, "Key Takeaway"), ("B.xlsx", "Course Outline", 1, 5, "Outline"),
    ("B.xlsx", "Course Outline", 2, 1, "Start"), ("B.xlsx", "Course Outline", 2, 2, "1.0"), ("B.xlsx", "Course Outline", 2, 3, "s-1"), ("B.xlsx", "Course Outline", 2, 4, "Use Boltwise"), ("B.xlsx", "Course Outline", 2, 5, "ok"),
    ("B.xlsx", "Course Outline", 3, 1, "Later"), ("B.xlsx", "Course Outline", 3, 2, "two"), ("B.xlsx", "Course Outline", 4, 1, "End"), ("B.xlsx", "Course Outline", 4, 2, "3"), ("B.xlsx", "Course Outline", 4, 5, "Wrap up with Kite"),
    ("B.xlsx", "Session-Practice Content Linked", 1, 1, "Unit ID"), ("B.xlsx", "Session-Practice Content Linked", 1, 2, "Session ID"), ("B.xlsx", "Session-Practice Content Linked", 2, 1, "u1"), ("B.xlsx", "Session-Practice Content Linked", 2, 2, "s-1"), ("B.xlsx", "Session-Practice Content Linked", 3, 1, "u9"), ("B.xlsx", "Session-Practice Content Linked", 3, 2, "s-9"),
    ("B.xlsx", "Tools", 1, 1, "Entity Name"), ("B.xlsx", "Tools", 1, 2, "Tool@Version"), ("B.xlsx", "Tools", 2, 1, "Start"), ("B.xlsx", "Tools", 2, 2, "n8n@2.17.8, Suno"), ("B.xlsx", "Tools", 3, 2, "none"),
]


def _cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CELLS, "book string, sheet string, row int, col int, value string")


@expect("session_no session_name column body_text", (1, "Start", "Key Takeaways", "Use Boltwise"), (3, "End", "Outline", "Wrap up with Kite"))
def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.outline_records(shred.outline(_cells(spark))).select(F.col("session_no").cast("long").alias("session_no"), "session_name", "column", "body_text")


@expect("unit_id session_no", ("u1", 1), ("u9", None))
def practice_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark)
    return shred.session_of_unit(cells, shred.outline(cells)).select("unit_id", F.col("session_no").cast("long").alias("session_no"))


@expect("session name version", ("Start", "n8n", "2.17.8"), ("Start", "Suno", ""))
def sheet_tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.sheet_tools(_cells(spark)).select("session", "name", "version")


def _inventory(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return inventory.built(shred.records(_docs(spark), _declared(spark)).filter("evidence_source <> 'url_field'"))


@expect("kind canonical_name taught_version watch_tier n_locations domains", ("service", "Boltwise", "", "standard", 4, "boltwise.io,console.boltwise.io"), ("package", "gradio", "6.6.0", "critical", 2, ""), ("package", "numpy", "", "critical", 1, ""), ("model", "gemini-2.5-flash", "", "critical", 1, ""))
def inventory_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes over an export: a link makes a service, whose name is then found in a title and a tag that never linked it."""
    return _inventory(spark)[0].select("kind", "canonical_name", F.coalesce("taught_version", F.lit("")).alias("taught_version"), "watch_tier", "n_locations", _joined("official_domains").alias("domains"))


@expect("name n courses", ("Node Identification", 1, "Course A"))
def tag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.review_queue(_inventory(spark)[2]).select("name", "n", _joined("courses").alias("courses"))


def _case(spark: SparkSession) -> dict[str, DataFrame]:
    deps = spark.createDataFrame([("m", "model", "alpha-70b", "critical"), ("p", "package", "gradio", "critical"), ("w", "service", "Boltwise", "mention-only"), ("d", "service", "Deadtool", "standard"), ("n", "n8n_node", "n8n-nodes-base.webhook", "critical"), ("c", "service", "Calm", "standard"), ("r", "service", "Pricey", "critical"), ("s", "service", "Swap", "standard")], "dep_id string, kind string, canonical_name string, watch_tier string")
    place = lambda d, course, ev, ob="LEARNING_RESOURCE", cid="", s=None: (d, course, "u", "U", cid, ev, ob, s)
    rows = [place("m", "A", "model_id", "CODING_QUESTIONS", "q1", 2), place("m", "A", "model_id", "OBJECTIVE_QUESTIONS", "q2", 3), place("m", "B", "prose_name"), place("p", "A", "solution_import", "CODING_QUESTIONS", "q3", 1), place("p", "B", "install_command", s=4), place("w", "A", "prose_name"), place("d", "B", "link:a_href", s=5), place("d", "B", "link:bare", s=5), place("n", "A", "n8n_workflow", "CODING_QUESTIONS", "q4", 6), place("c", "A", "link:a_href"), place("r", "A", "link:a_href", "OBJECTIVE_QUESTIONS", "q5", 1), place("s", "A", "link:a_href"), place("s", "B", "link:a_href")]
    locations = spark.createDataFrame(rows, "dep_id string, course string, unit_id string, unit_name string, content_id string, evidence_source string, object_type string, session_no int")
    probes = spark.createDataFrame([
        ("m", "broken", ["model_shutdown_passed", "vendor_named_replacement"], None), ("p", "changed", ["new_release"], None), ("w", "changed", ["page_text_changed"], None), ("d", "broken", ["url_gone", "redirected_off_path"], None),
        ("n", "changed", ["breaking_change_possible"], "critical"), ("c", "ok", [], None), ("r", "changed", ["free_tier_language_lost", "pricing_page_changed"], None), ("s", "broken", [], None),
    ], "dep_id string, status string, signals array<string>, declared_severity string")
    claims = spark.createDataFrame([("c", "pricing", "It costs five dollars per month.", "https://calm.io/pricing", True), ("r", "pricing", "The plan is no longer free for teams.", "https://pricey.io/pricing", True), ("w", "deprecation", "Boltwise is deprecated since May.", "https://blog.io/x", False), ("m", "deprecation", "alpha-70b has been retired.", "https://g.test/deprecations", True)], "dep_id string, kind string, quote string, source_url string, substantiates boolean")
    alternatives = spark.createDataFrame([("c", "https://better.io"), ("d", "https://other.io")], "dep_id string, source_url string")
    return {"dependencies": deps, "locations": locations, "probes": probes, "claims": claims, "alternatives": alternatives}


@expect(
    "dep_id signal severity blast_radius probe_signals evidence",
    ("m", "S7", "critical", 8, "model_shutdown_passed", "https://g.test/deprecations"), ("d", "S1", "critical", 3, "url_gone", ""), ("n", "S9", "high", 10, "breaking_change_possible", ""),
    ("r", "S3", "critical", 4, "free_tier_language_lost,pricing_page_changed", "https://pricey.io/pricing"), ("s", "S1", "critical", 4, "broken", ""), ("c", "S10", "low", 2, "", "https://better.io"),
)
def findings_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules at once: half of the dependencies here must give nothing or lose a finding to a better one."""
    case = _case(spark)
    out = score.findings(case["dependencies"], case["locations"], case["probes"], case["claims"], case["alternatives"])
    return out.select("dep_id", "signal", "severity", "blast_radius", _joined("probe_signals").alias("probe_signals"), _joined("evidence_urls").alias("evidence"))


@expect("dep_id course local_severity blast_radius total_radius", ("m", "A", "critical", 8, 8), ("m", "B", "low", 0, 8), ("d", "B", "critical", 3, 3), ("n", "A", "high", 10, 10), ("r", "A", "high", 4, 4), ("s", "A", "critical", 2, 4), ("s", "B", "critical", 2, 4), ("c", "A", "low", 2, 2))
def findings_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark)
    found = score.findings(case["dependencies"], case["locations"], case["probes"], case["claims"], case["alternatives"])
    return score.projected(found, case["dependencies"], case["locations"]).select("dep_id", "course", "local_severity", "blast_radius", "total_radius")


@expect(
    "place line",
    (1, "CRITICAL · S7 Model deprecated or superseded — alpha-70b · blast radius 8 · alpha-70b is retired at its provider: replace the model id."), (3, "CRITICAL · S1 Dead / moved URL — Swap · blast radius 4 · Repoint or replace the dead links to Swap."),
    (2, "CRITICAL · S3 Free tier cut or now paid — Pricey · blast radius 4 · Check the free tier of Pricey against what the session asks for."), (4, "CRITICAL · S1 Dead / moved URL — Deadtool · blast radius 3 · Repoint or replace the dead links to Deadtool."),
    (5, "HIGH · S9 n8n node / version update — n8n-nodes-base.webhook · blast radius 10 · Import the workflow of n8n-nodes-base.webhook again and confirm what the node does."), (6, "LOW · S10 Better alternative available — Calm · blast radius 2 · Consider whether a better tool than Calm is there now."),
)
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark)
    found = score.findings(case["dependencies"], case["locations"], case["probes"], case["claims"], case["alternatives"])
    return report.digest_lines(report.noted(found, F.lit("2025-01-01").cast("date")))


@expect("dep_id due_by", ("m", "2025-01-08"), ("d", "2025-01-08"), ("n", "2025-01-31"), ("r", "2025-01-08"), ("s", "2025-01-08"), ("c", "2025-06-30"))
def notes_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark)
    found = score.findings(case["dependencies"], case["locations"], case["probes"], case["claims"], case["alternatives"])
    return report.noted(found, F.lit("2025-01-01").cast("date")).select("dep_id", F.col("due_by").cast("string").alias("due_by"))


@expect("course findings worst radius", ("A", 5, "critical", 26), ("B", 3, "critical", 5))
def course_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = _case(spark)
    found = score.findings(case["dependencies"], case["locations"], case["probes"], case["claims"], case["alternatives"])
    local = score.projected(found, case["dependencies"], case["locations"]).drop("severity").withColumnRenamed("local_severity", "severity")
    return report.overview(local)


@expect("claim_id violation", (2, "tier differs"), (3, "cannot substantiate"))
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "https://acme.dev/x", "pricing", "AUTHORITATIVE", True), (2, "https://g2.com/x", "pricing", "AUTHORITATIVE", True), (3, "https://pypi.org/project/x", "pricing", "CORROBORATING", True), (4, "https://pypi.org/project/x", "version", "AUTHORITATIVE", True)]
    df = spark.createDataFrame(rows, "claim_id long, source_url string, kind string, tier string, substantiates boolean").withColumn("own_domains", F.array(F.lit("acme.dev")))
    return report.audit(df)


@expect("signal_id dep_id", ("s1", "a"), ("s1", "b"), ("s2", "b"))
def signal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = spark.createDataFrame([("a", "Alpha-70B", ["alpha"], "", ["x.io"]), ("b", "beta", [], "beta-pkg", ["b.io"]), ("c", "gamma", [], "", ["c.io"])], "dep_id string, canonical_name string, aliases array<string>, registry_id string, official_domains array<string>")
    signals = spark.createDataFrame([("s1", ["ALPHA", "beta_pkg", "Beta-Pkg"], ["c.io"]), ("s2", ["unknown"], ["b.io"])], "signal_id string, refs array<string>, domains array<string>")
    return resolve.references(signals, deps)


@expect("spans excerpt", ("0-10,20-24", "line two has groq cloud here"))
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("groq cloud and also groq", ["groq", "Groq Cloud"], "line one\nline two has groq cloud here")], "t string, words array<string>, page string")
    shown = _joined(F.transform(T.longest_first_spans("t", "words"), lambda s: F.concat_ws("-", s["start"], s["end"])))
    return df.select(shown.alias("spans"), T.excerpt(F.col("page"), F.lit("groq cloud"), 18).alias("excerpt"))


@expect("pair ratio", ("a", 1000), ("b", 750), ("c", 0))
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("a", "same", "same"), ("b", "abcd", "bcde"), ("c", "xy", "ab")], "pair string, x string, y string")
    return df.select("pair", F.round(T.similarity("x", "y") * 1000).cast("long").alias("ratio"))


@expect("dep_id job", ("d", "B / session 5 / U"), ("m", "A / session 2 / U\nA / session 3 / U\nB / prose_name / U"))
def taught_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _case(spark)["locations"].withColumn("at", F.concat_ws("/", "course", "session_no", "content_id"))
    return score.taught_job(places, "at").filter("dep_id IN ('m', 'd')")


@expect("dep_id screenshots", ("x", 34), ("y", 0))
def screenshots_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit counts once, however often a finding touches it; other classes of finding have no pictures."""
    found = spark.createDataFrame([("f1", "x", "S5"), ("f2", "y", "S8"), ("f3", "x", "S1")], "finding_id string, dep_id string, signal string")
    places = spark.createDataFrame([("x", "A", "u1"), ("x", "A", "u1"), ("x", "A", "u2"), ("y", "B", "u9")], "dep_id string, course string, unit_id string")
    census = spark.createDataFrame([("A", "u1", 30), ("A", "u2", 4), ("B", "u1", 7)], "course string, unit_id string, images int")
    return score.screenshots_at_risk(found, places, census).join(found, "finding_id").select("dep_id", "screenshots")


@expect("source_file reasons warnings", ("a.json", "questions not read", ""), ("b.json", "not JSON", ""), ("c.json", "no records,title is taken", ""), ("d.json", "", "no sessions"))
def course_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = {"topics": [{"topic_name": "T", "units": [{"unit_id": "u", "unit_name": "U", "contents": [{"content": "text"}]}]}]}
    rows = [("a.json", "Course A", json.dumps(_COURSE)), ("b.json", "B", "{not"), ("c.json", "Course C", '{"topics": []}'), ("d.json", "D", json.dumps(plain))]
    raw = spark.createDataFrame(rows, "source_file string, course string, body string")
    out = shred.validated(raw, spark.createDataFrame([("c", "COURSE C")], "slug string, title string"))
    return out.select("source_file", _joined("reasons").alias("reasons"), _joined("warnings").alias("warnings"))
