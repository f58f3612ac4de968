"""What code and commands depend on: imports, installs, pins, models, workflow nodes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tidemark.functions import constants as K
from tidemark.functions.text import strings
from tidemark.functions.urls import first_each


def valid_name(name: Column, registry: str) -> Column:
    plain = name.rlike(r"^[a-z][a-z0-9]*([._-][a-z0-9]+)*(\[[\w,]+\])?$")
    scoped = name.rlike(r"^@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*$")
    shape = F.when(name.startswith("@"), scoped).otherwise(plain) if registry == "npm" else plain
    return (F.length(name) >= 2) & ~name.isin(*K.NOT_A_PACKAGE) & shape


def _pairs(names: Column, registry: str) -> Column:
    return F.transform(F.filter(names, lambda n: valid_name(n, registry)), lambda n: F.struct(n.alias("name"), F.lit(registry).alias("registry")))


def imports(code: Column) -> Column:
    """Array of (name, registry): distributions that Python and JavaScript imports need, each once, in order."""
    code = F.coalesce(code, F.lit(""))
    lines = F.regexp_extract_all(code, F.lit(K.IMPORT_PATTERN), 1)
    modules = F.flatten(F.transform(lines, lambda x: F.when(x.startswith("from"), F.array(F.regexp_extract(x, r"^from\s+([\w.]+)", 1))).otherwise(F.split(F.regexp_replace(x, r"^import\s+", ""), r"\s*,\s*"))))
    tops = F.filter(F.transform(modules, lambda m: F.substring_index(F.trim(m), ".", 1)), lambda m: (m != "") & ~m.isin(*K.STDLIB) & ~m.startswith("_"))
    known = F.create_map(*[F.lit(x) for kv in K.IMPORT_TO_DIST.items() for x in kv])
    python = F.transform(tops, lambda m: F.coalesce(F.try_element_at(known, m), F.lower(m)))
    specs = F.regexp_extract_all(code, F.lit(K.JS_IMPORT_PATTERN), 1)
    js = F.transform(specs, lambda s: F.lower(F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))))
    return first_each(F.concat(_pairs(python, "pypi"), _pairs(js, "npm")), lambda p: p)


def _arguments(rest: Column) -> Column:
    """The package arguments of a command: they end at the first word that can't be one."""
    words = F.filter(F.slice(F.filter(F.split(rest, r"\s+"), lambda w: w != ""), 1, K.MOST_INSTALL_ARGUMENTS), lambda w: ~w.startswith("-"))
    names = F.transform(words, lambda w: F.btrim(F.regexp_replace(F.lower(w), "(==|>=|~=).*$", ""), F.lit("\"'()[],")))
    bad = F.transform(names, lambda n: (n == "") | n.isin(*K.NOT_A_PACKAGE) | ~n.rlike(r"^[a-z@][\w.\-/]*(\[[\w,]+\])?$"))
    end = F.array_position(bad, True)
    return F.when(end == 0, names).otherwise(F.slice(names, 1, F.greatest(end - 1, F.lit(0)).cast("int")))


def installs(text: Column) -> Column:
    """Array of (name, registry) from install commands."""
    text = F.coalesce(text, F.lit(""))
    of = lambda pattern, registry: _pairs(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), _arguments)), registry)
    return F.concat(of(K.PIP_PATTERN, "pypi"), of(K.NPM_PATTERN, "npm"))


def pins(text: Column) -> Column:
    """Array of (name, version) pinned inside install commands, the last of each name."""
    text = F.coalesce(text, F.lit(""))
    rests = F.concat(*[F.regexp_extract_all(text, F.lit(p), 2) for p in (K.PIP_PATTERN, K.NPM_PATTERN)])
    pin = r"(?<![\w.])([A-Za-z][\w.\-]*\s*==\s*\d[\w.]*)"
    found = F.flatten(F.transform(rests, lambda r: F.regexp_extract_all(r, F.lit(pin), 1)))
    parts = F.transform(found, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "==", 1))).alias("name"), F.trim(F.substring_index(x, "==", -1)).alias("version")))
    fine = F.filter(parts, lambda p: valid_name(p["name"], "pypi") & (F.contains(p["version"], F.lit(".")) | (F.length(p["version"]) > 1)))
    return F.reverse(first_each(F.reverse(fine), lambda p: p["name"]))


def models(text: Column) -> Column:
    """Sorted distinct model ids: of a known family, with a digit, not a page about models."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.MODEL_PATTERN), 1)
    names = F.transform(raw, lambda m: F.rtrim(F.lower(F.regexp_replace(m, "[.,;:)\\]}'\"]+$", "")), F.lit("-/")))
    stop = strings(K.MODEL_NOT)
    fine = lambda m: (F.length(m) > 4) & m.rlike("[0-9]") & ~F.exists(stop, lambda w: F.array_contains(F.split(m, "-"), w) | m.endswith(w))
    return F.array_sort(F.array_distinct(F.filter(names, fine)))


def model_vendor(name: Column) -> Column:
    """The first family whose prefix fits a model id, or its part before a slash."""
    out = None
    for prefix, vendor in K.MODEL_VENDORS.items():
        out = (F if out is None else out).when(name.startswith(prefix), vendor)
    return out


def node_mentions(text: Column) -> Column:
    """Node types named in text that isn't JSON: shaped like JSON first, then bare; placeholders dropped."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(K.NODE_PATTERN), 1), F.regexp_extract_all(text, F.lit(K.BARE_NODE_PATTERN), 1))
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(F.substring_index(t, ".", -1)).isin(*K.PLACEHOLDER_NODES)))


def _walked_nodes(text: str | None) -> list[dict] | None:
    try:
        doc = json.loads(text) if (text or "").lstrip()[:1] in ("{", "[") else None
    except (ValueError, RecursionError):
        return None
    if doc is None:
        return None
    out, stack = [], [doc]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("type"), str) and "n8n-nodes" in x["type"]:
                v = x.get("typeVersion")
                out.append({"type": x["type"], "version": "" if v is None else str(v)})
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return out


@F.pandas_udf(ArrayType(StructType().add("type", StringType()).add("version", StringType())))
def json_nodes(text: pd.Series) -> pd.Series:
    """Every object of a JSON text, at any depth and in order, whose type names a node, with its own version; null if the text isn't JSON."""
    return text.map(_walked_nodes)


def node_package(node: Column) -> Column:
    head = F.regexp_replace(node, r"\.[^.]*$", "")
    return F.when(head.startswith("@") | head.startswith("n8n-nodes"), head).otherwise("")


def major(version: Column) -> Column:
    return F.split_part(version, F.lit("."), F.lit(1))
