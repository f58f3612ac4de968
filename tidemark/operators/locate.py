"""Where a finding's text stands: the field, its enclosing question, an excerpt around the match, or the reason why there is none.

Exports are shredded once to a table of nodes (``nodes``); locations meet it on (file, path), and the question that encloses them on
(file, longest prefix that is a content object). No document ever stands beside a location. Paths into workbooks meet the cells instead, by
header. Every location gives a row, and what can't be resolved says why: ``sheet_declaration`` (a sheet, no cell), ``unparsable_path``,
``course_export_missing``, ``path_not_found``, ``not_a_text_field``, ``workbook_cell_missing``; ``term_not_in_field`` is resolved, without a match.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Characters around a match, and at the head of a field without one.
WINDOW, NO_MATCH_HEAD = 420, 600
#: Arrays whose elements are content objects.
CONTAINERS = ("contents", "question_details")
#: Nodes in a batch, which documents share, and characters of documents after which one is sent.
_NODES_A_BATCH, _CHARS_A_BATCH = 4096, 1 << 21
KINDS = ("object", "array", "text", "null")
_PATH = r"^\$(\[\d+\]|\.[A-Za-z_][A-Za-z0-9_]*)+$"
_CELL = r"^([^:]+\.xlsx)::([^:]+)::([^:]+)::row(\d+)$"
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@functools.lru_cache(1 << 14)
def _step(key: str) -> str:
    return f".{key}" if _PLAIN.fullmatch(key) else f"[{json.dumps(key)}]"


def walked(doc: object, kinds: tuple[str, ...] = KINDS) -> tuple[list[str], list[str], list[str | None]]:
    """Paths, kinds and values of every node of a document that is of one of the kinds, to any depth."""
    paths: list[str] = []
    found: list[str] = []
    values: list[str | None] = []
    stack: list[tuple[str, object]] = [("$", doc)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, str):
            kind, value = "text", node
        elif isinstance(node, dict):
            kind, value = "object", None
            stack += [(path + _step(k), v) for k, v in node.items()]
        elif isinstance(node, list):
            kind, value = "array", None
            stack += [(f"{path}[{i}]", v) for i, v in enumerate(node)]
        elif node is None:
            kind, value = "null", None
        else:
            kind, value = "text", json.dumps(node)
        if kind in kinds:
            paths.append(path)
            found.append(kind)
            values.append(value)
    return paths, found, values


def nodes(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """source_file, path, kind and value of every node of docs(source_file, doc variant) that is of one of the kinds. One pass, a document at a time."""
    rows = docs.filter("doc IS NOT NULL").select("source_file", F.to_json("doc").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        chars = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = body.as_py()
                found = walked(json.loads(text, parse_int=str, parse_float=str), kinds)
                chars += len(text)
                for column, more in zip(held, ([name] * len(found[0]), *found), strict=True):
                    column += more
                if len(held[0]) >= _NODES_A_BATCH or chars > _CHARS_A_BATCH:
                    yield from _batches(held)
                    held, chars = [[], [], [], []], 0
        yield from _batches(held)

    return rows.mapInArrow(run, "source_file string, path string, kind string, value string")


def _batches(held: list[list]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(held[0]), _NODES_A_BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(column[i : i + _NODES_A_BATCH], pa.string()) for column in held], ["source_file", "path", "kind", "value"])


def enclosing(path: Column) -> Column:
    """The path of the content object that a path leads through or to, the innermost one; empty for none."""
    return F.regexp_extract(path, rf"^(.*\.(?:{'|'.join(CONTAINERS)})\[\d+\])(?:[.\[].*)?$", 1)


def containers(found: DataFrame) -> DataFrame:
    """source_file, container, title, object_type, content_type of all content objects of nodes."""
    named = r"^(.*)\.(title|short_text|object_type|content_type)$"
    rows = found.filter((F.col("kind") == "text") & F.col("path").rlike(named)).select("source_file", F.regexp_extract("path", named, 1).alias("container"), F.regexp_extract("path", named, 2).alias("field"), "value")
    rows = rows.filter(enclosing(F.col("container")) == F.col("container"))
    of = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    return rows.groupBy("source_file", "container").agg(F.coalesce(F.nullif(of("title"), F.lit("")), of("short_text")).alias("title"), of("object_type").alias("object_type"), of("content_type").alias("content_type"))


def excerpted(rows: DataFrame) -> DataFrame:
    """rows(text, terms, urls, ...) with matched_by, excerpt, offset, truncated and spans, counted from the excerpt's start."""
    text, no_text = F.col("text"), F.col("text").isNull()
    named, linked = T.term_spans(text, F.col("terms")), T.term_spans(text, F.col("urls"))
    rows = rows.withColumn("__named", named).withColumn("__all", F.when(F.size("__named") > 0, F.col("__named")).otherwise(linked))
    by = F.when(no_text | (F.size("__all") == 0), "").when(F.size("__named") > 0, "name").otherwise("referenced_url")
    some, first = F.size("__all") > 0, F.try_element_at("__all", F.lit(1))
    at = first["start"]
    low = F.greatest(F.lit(0), at - WINDOW // 3)
    newline = F.instr(F.reverse(F.substr(text, low + 1, at - low)), F.lit("\n"))  # places back from the match
    start = F.when(some, F.when((newline > 0) & (newline < WINDOW), at - newline + 1).otherwise(low)).otherwise(0)
    end = F.when(some, F.least(F.length(text), first["end"] + WINDOW)).otherwise(F.least(F.length(text), F.lit(NO_MATCH_HEAD)))
    rows = rows.withColumns({"matched_by": by, "offset": F.when(no_text, 0).otherwise(start).cast("int"), "__end": end})
    inside = F.filter("__all", lambda s: (s["start"] >= F.col("offset")) & (s["start"] < F.col("__end")))
    rows = rows.withColumns({
        "excerpt": F.when(no_text, "").otherwise(F.substr(text, F.col("offset") + 1, F.col("__end") - F.col("offset"))), "truncated": F.coalesce((F.col("offset") > 0) | (F.col("__end") < F.length(text)), F.lit(False)),
        "spans": F.transform(inside, lambda s: F.struct((s["start"] - F.col("offset")).alias("start"), (s["end"] - s["start"]).alias("length"))),
    })
    return rows.drop("__named", "__all", "__end")


def located(locations: DataFrame, found: DataFrame, cells: DataFrame) -> DataFrame:
    """locations(source_file, field_path, terms, urls) with resolved, reason, matched_by, excerpt, offset, truncated, spans and the enclosing object.

    found: ``nodes`` of the exports, written once; cells(book, sheet, row, col, value), with headers in row 1.
    """
    path = F.col("field_path")
    is_json, is_cell = path.rlike(_PATH), path.rlike(_CELL)
    in_json = locations.filter(F.coalesce(is_json, F.lit(False)))
    files = found.filter("path = '$'").select("source_file", F.lit(True).alias("__there"))
    at = found.select("source_file", F.col("path").alias("field_path"), "kind", "value")
    rows = in_json.join(files, "source_file", "left").join(at, ["source_file", "field_path"], "left").withColumn("container", enclosing(path))
    rows = rows.join(containers(found), ["source_file", "container"], "left")
    reason = F.when(F.col("__there").isNull(), "course_export_missing").when(F.col("kind").isNull(), "path_not_found").when(F.col("kind") != "text", "not_a_text_field")
    names = [*locations.columns, "text", "reason", "title", "object_type", "content_type"]
    fields = rows.withColumns({"reason": reason, "text": F.when(reason.isNull(), F.col("value"))}).select(*names)
    in_cell = locations.filter(F.coalesce(is_cell & ~is_json, F.lit(False))).withColumns({"book": F.regexp_extract(path, _CELL, 1), "sheet": F.regexp_extract(path, _CELL, 2), "head": T.header(F.regexp_extract(path, _CELL, 3)), "row": F.regexp_extract(path, _CELL, 4).try_cast("int")})  # no sheet has a row beyond an int
    heads = cells.filter("row = 1").groupBy("book", "sheet", T.header(F.col("value")).alias("head")).agg(F.min("col").alias("col"))
    whole = in_cell.join(heads, ["book", "sheet", "head"], "left").join(cells, ["book", "sheet", "row", "col"], "left")
    title = F.concat(F.regexp_extract(path, _CELL, 3), F.lit(" — "), F.col("sheet"))
    shown = whole.withColumns({"text": F.col("value"), "reason": F.when(F.col("value").isNull(), "workbook_cell_missing"), "title": title, "object_type": F.lit("SESSION_PPT"), "content_type": F.lit("WORKBOOK")}).select(*names)
    neither = locations.filter(~F.coalesce(is_json | is_cell, F.lit(False)))
    lost = neither.withColumns({"text": F.lit(None).cast("string"), "reason": F.when(F.contains(F.coalesce(path, F.lit("")), F.lit("::")), "sheet_declaration").otherwise("unparsable_path"), **{c: F.lit(None).cast("string") for c in names[-3:]}}).select(*names)
    out = excerpted(fields.unionByName(shown).unionByName(lost))
    resolved = F.col("text").isNotNull()
    told = {c: F.when(resolved, F.coalesce(c, F.lit(""))).otherwise("") for c in names[-3:]}
    return out.withColumns({"resolved": resolved, "reason": F.when(resolved & (F.col("matched_by") == ""), "term_not_in_field").otherwise(F.coalesce("reason", F.lit(""))), **told}).drop("text")
