"""What an upstream repository ships and declares: node types from its file paths, breaking changes from its rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_index(paths: DataFrame) -> DataFrame:
    """Node types that a repository's file paths ship."""
    base, chain = (F.regexp_extract("path", f"^{p}.*/([A-Za-z][A-Za-z0-9_]*)[.]node[.]ts$", 1) for p in ("packages/nodes-base/nodes/", "packages/@n8n/nodes-langchain/nodes/"))
    low = lambda s: F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1000))
    node = F.when(base != "", F.concat(F.lit("n8n-nodes-base."), low(base))).when(chain != "", F.concat(F.lit("@n8n/n8n-nodes-langchain."), low(chain)))
    return paths.select(node.alias("node")).filter("node IS NOT NULL").distinct()


def node_rules(files: DataFrame) -> DataFrame:
    """rule_id, version, title, description, severity, node_types, actions of rule files; files without version and title are none."""
    body = F.col("body")
    text = lambda key: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(body, rf"\b{key}\s*:\s*((?:'[^']*'|\"[^\"]*\")(?:\s*\+?\s*(?:'[^']*'|\"[^\"]*\"))*)", 1), r"['\"]\s*\+?\s*['\"]", " "), "^['\"]|['\"]$", ""))
    version = F.regexp_extract(body, r"@BreakingChangeRule\(\{\s*version:\s*'([^']+)'", 1)
    named = F.regexp_extract(body, r"\bid\s*:\s*\w+\s*=\s*'([^']+)'", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    nodes = F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"'((?:@[\w.\-]+/)?n8n-nodes[\w.\-]*\.[\w.]+)'"), 1)))
    rows = files.select(F.coalesce(F.nullif(named, F.lit("")), F.nullif(text("id"), F.lit("")), stem).alias("rule_id"), version.alias("version"), text("title").alias("title"), text("description").alias("description"), F.lower(F.coalesce(F.nullif(text("severity"), F.lit("")), F.lit("medium"))).alias("severity"), nodes.alias("node_types"), F.regexp_extract_all(body, F.lit(r"\baction:\s*'([^']+)'"), 1).alias("actions"))
    return rows.filter("version <> '' OR title <> ''")
