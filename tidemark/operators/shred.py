"""Course exports and workbooks shredded into addressable rows.

An export is one JSON document. It is parsed to a variant and exploded level by level; every row carries the path that leads to it, built
from the array's own indices, so a path finds its value again (``dereferenced``) whatever order units are shown in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as K
from tidemark.functions import text as T
from tidemark.sources.stages import heavy_parts

_EMPTY = "array<variant>"


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _items(v: str, path: str) -> Column:
    """The array at a path, empty for anything else."""
    return F.coalesce(_get(v, path, _EMPTY), F.array().cast(_EMPTY))


def exports(raw: DataFrame) -> DataFrame:
    """source_file, course, doc (variant) of raw(source_file, course, body); a list of one document counts as that document."""
    parsed = raw.withColumn("v", F.try_parse_json("body"))
    return parsed.select("source_file", "course", F.coalesce(_get("v", "$[0]", "variant"), F.col("v")).alias("doc"))


def units(docs: DataFrame) -> DataFrame:
    """One row a unit, with its place, whether it opens a session, and the running session number of its course."""
    topics = docs.repartition(heavy_parts(docs.sparkSession), "source_file").select("source_file", "course", F.posexplode(_items("doc", "$.topics")).alias("ti", "topic"))
    rows = topics.select("source_file", "course", "ti", _get("topic", "$.topic_name").alias("topic_name"), F.posexplode(_items("topic", "$.units")).alias("ui", "unit"))
    video = F.exists(_items("unit", "$.contents"), lambda c: F.coalesce(_get(c, "$.learning_resource_type") == "INTERACTIVE_VIDEO", F.lit(False)))
    kind = _get("unit", "$.unit_type")
    label = F.coalesce(F.nullif(_get("unit", "$.unit_name"), F.lit("")), F.nullif(_get("unit", "$.exam_details.title"), F.lit("")), F.when(kind == "ASSESSMENT", "Module Quiz"), F.lit("(unnamed unit)"))
    order = W.partitionBy("source_file").orderBy("ti", F.coalesce(_get("unit", "$.order", "int"), F.lit(0)), "ui")
    rows = rows.withColumns({"is_session": F.coalesce((kind == "LEARNING_SET") & video, F.lit(False)), "unit_name": label, "unit_type": F.coalesce(kind, F.lit("")), "unit_id": F.coalesce(_get("unit", "$.unit_id"), F.lit(""))})
    rows = rows.withColumn("positional", F.sum(F.col("is_session").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    return rows.withColumn("base", F.concat(F.lit("$.topics["), F.col("ti"), F.lit("].units["), F.col("ui"), F.lit("]")))


_CARRIED = ("source_file", "course", "topic_name", "unit_id", "unit_name", "unit_type", "session_no", "base")


def contents(numbered: DataFrame) -> DataFrame:
    """Every content object of numbered units, from the three places that hold them, with its path and whether it was pooled."""

    def of(rows: DataFrame, items: Column, path: list, pooled: bool) -> DataFrame:
        out = rows.select(*_CARRIED, *[c for c in rows.columns if c in ("si", "ei")], F.posexplode(items).alias("ci", "content"))
        return out.select(*_CARRIED, F.concat(F.col("base"), *path).alias("path"), "content", F.lit(pooled).alias("pooled"))

    i = lambda c: F.col(c).cast("string")
    plain = of(numbered, _items("unit", "$.contents"), [F.lit(".contents["), i("ci"), F.lit("]")], False)
    sections = numbered.select(*_CARRIED, F.posexplode(_items("unit", "$.exam_sections")).alias("si", "section"))
    inside = of(sections, _items("section", "$.contents"), [F.lit(".exam_sections["), i("si"), F.lit("].contents["), i("ci"), F.lit("]")], True)
    exams = numbered.select(*_CARRIED, F.posexplode(_items("unit", "$.exam_details")).alias("ei", "exam"))
    asked = of(exams, _items("exam", "$.question_details"), [F.lit(".exam_details["), i("ei"), F.lit("].question_details["), i("ci"), F.lit("]")], True)
    return plain.unionByName(inside).unionByName(asked)


def _text_fields() -> Column:
    """Array of (text, path, evidence) of a content object, strongest evidence first."""

    def each(array: str, fields: tuple[tuple[str, str], ...]) -> Column:
        items = _items("content", f"$.{array}")
        one = lambda x, i: F.array(*[F.struct(_get(x, f"$.{f}").alias("text"), F.concat(F.lit(f".{array}["), i.cast("string"), F.lit(f"].{f}")).alias("at"), F.lit(e).alias("evidence_source")) for f, e in fields])
        return F.flatten(F.transform(items, one))

    single = lambda f, e: F.array(F.struct(_get("content", f"$.{f}").alias("text"), F.lit(f".{f}").alias("at"), F.lit(e).alias("evidence_source")))
    found = F.concat(
        each("solutions", (("solution_answer", "solution_code"), ("title_content", "solution_prose"), ("description_content", "solution_prose"), ("evaluation_prompt", "solution_prose"))),
        each("test_cases", (("test_case_enum", "test_case_enum"),)), each("codes", (("code_content", "solution_code"),)),
        single("content", "markdown"), single("short_text", "title"), each("options", (("content", "markdown"),)),
        single("answer_explanation.content", "markdown"), each("slides", (("slide_url", "url_field"),)),
    )
    return F.filter(found, lambda x: F.coalesce(x["text"], F.lit("")) != "")


_RECORD = ("source_file", "course", "topic_name", "unit_id", "unit_name", "unit_type", "session_no", "content_id", "object_type", "title", "body_text", "field_path", "evidence_source", "pooled")


def records(docs: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """All text fields of exports as rows. declared(unit_id, session_no) wins over the position for a unit's session."""
    numbered = units(docs)
    if declared is not None:
        numbered = numbered.join(declared.select("unit_id", F.col("session_no").alias("declared")), "unit_id", "left")
    told = F.col("declared") if declared is not None else F.lit(None).cast("int")
    numbered = numbered.withColumn("session_no", F.coalesce(told, F.when(F.col("positional") > 0, F.col("positional"))))
    made = contents(numbered).withColumn("t", F.explode(_text_fields()))
    fields = made.withColumns({
        "content_id": F.coalesce(_get("content", "$.question_id"), _get("content", "$.learning_resource_id"), F.lit("")), "object_type": F.coalesce(_get("content", "$.object_type"), F.lit("")),
        "title": F.coalesce(_get("content", "$.title"), _get("content", "$.short_text"), F.lit("")), "body_text": F.col("t.text"), "field_path": F.concat("path", F.col("t.at")), "evidence_source": F.col("t.evidence_source"),
    }).select(*_RECORD)
    tags = numbered.select(*_CARRIED, F.posexplode(_items("unit", "$.question_tags")).alias("qi", "tag"))
    name = F.coalesce(F.nullif(_get("tag", "$.tag_name_enum"), F.lit("")), F.nullif(_get("tag", "$.tag_name"), F.lit("")), F.nullif(_get("tag", "$.tag"), F.lit("")))
    tags = tags.withColumns({"content_id": F.lit(""), "object_type": F.lit("UNIT_TAG"), "title": F.col("unit_name"), "body_text": name, "field_path": F.concat("base", F.lit(".question_tags["), F.col("qi"), F.lit("].tag_name_enum")), "evidence_source": F.lit("question_tag"), "pooled": F.lit(False)})
    return fields.unionByName(tags.filter("body_text is not null").select(*_RECORD))


def reconciled(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """course, units, sessions, pools, pools_read, gap: a pool of questions that gave no row is a gap and must not be."""
    has_pool = (F.size(_items("unit", "$.exam_sections")) > 0) | (F.size(_items("unit", "$.exam_details")) > 0)
    seen = units(docs).withColumn("pool", has_pool)
    read = rows.filter("pooled").select("course", "unit_id").distinct().withColumn("read", F.lit(True))
    joined = seen.join(read.hint("merge"), ["course", "unit_id"], "left")  # looks as small as the documents' file to the planner
    out = joined.groupBy("course").agg(F.count(F.lit(1)).alias("units"), F.count_if("is_session").alias("sessions"), F.count_if("pool").alias("pools"), F.count_if(F.col("pool") & F.col("read").isNotNull()).alias("pools_read"))
    return out.withColumn("gap", F.col("pools") - F.col("pools_read"))


def validated(raw: DataFrame, roster: DataFrame) -> DataFrame:
    """source_file, reasons, warnings of candidate exports raw(source_file, course, body): why a course can't be added, and what is odd about it.

    roster(slug, title): courses that are there already; a title must differ from all of them, but for case.
    """
    docs = exports(raw)
    found = records(docs)
    counts = found.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    gaps = reconciled(docs, found).select("course", "sessions", "gap")
    clash = roster.select(F.lower("title").alias("t")).distinct().withColumn("clash", F.lit(True))
    rows = docs.join(counts, "source_file", "left").join(gaps, "course", "left").join(clash, F.lower("course") == F.col("t"), "left")
    reasons = F.array_compact(F.array(F.when(F.col("doc").isNull(), "not JSON"), F.when(F.col("doc").isNotNull() & F.col("n").isNull(), "no records"), F.when(F.col("gap") > 0, "questions not read"), F.when(F.col("clash"), "title is taken")))
    warnings = F.array_compact(F.array(F.when(F.col("n").isNotNull() & (F.col("sessions") == 0), "no sessions")))
    return rows.select("source_file", reasons.alias("reasons"), warnings.alias("warnings"))


def dereferenced(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with value: what their field_path points at in the export they came from. Documents are shredded once; none stands beside a row."""
    from tidemark.operators.locate import nodes

    found = nodes(docs, ("text",)).select("source_file", F.col("path").alias("field_path"), "value")
    return rows.join(found.hint("merge"), ["source_file", "field_path"], "left")  # looks as small as the documents' file to the planner


# --- workbooks, as long tables of cells(book, sheet, row, col, value); row 1 holds the headers ------------------------------------------------

def sheet_rows(cells: DataFrame, aliases: dict[str, tuple[str, ...]] = K.OUTLINE_HEADERS) -> DataFrame:
    """book, sheet, row and a column for each field: headers are known by their names, never by their place."""
    heads = cells.filter("row = 1").select("book", "sheet", "col", T.header(F.col("value")).alias("head"))
    names = cells.sparkSession.createDataFrame([(a, f) for f, al in aliases.items() for a in al], "head string, field string")
    columns = heads.join(F.broadcast(names), "head").groupBy("book", "sheet", "field").agg(F.min("col").alias("col"))  # names: a few dozen
    body = cells.filter("row > 1").join(columns, ["book", "sheet", "col"])
    return body.groupBy("book", "sheet", "row").pivot("field", list(aliases)).agg(F.first(F.trim("value")))


def outline(cells: DataFrame, sheet: str = "Course Outline") -> DataFrame:
    """book, session_no, session_id, session_name, topic_name, outline, takeaways, row of the rows whose session number is a number."""
    rows = sheet_rows(cells.filter(F.col("sheet") == sheet))
    number = F.col("session_no").try_cast("double").cast("int")
    return rows.withColumn("session_no", number).filter("session_no is not null").select("book", "session_no", "session_id", "session_name", "topic_name", "outline", "takeaways", "row")


def outline_records(sessions: DataFrame) -> DataFrame:
    """The slide text of sessions, one row for each of the two columns that says something."""
    long = sessions.select("book", "row", "session_no", "session_name", F.expr("stack(2, 'Outline', outline, 'Key Takeaways', takeaways) AS (column, body_text)"))
    return long.filter("length(trim(body_text)) >= 3").withColumn("field_path", F.concat_ws("::", "book", F.lit("Course Outline"), "column", F.concat(F.lit("row"), F.col("row"))))


def session_of_unit(cells: DataFrame, sessions: DataFrame, sheet: str = "Session-Practice Content Linked") -> DataFrame:
    """book, unit_id, session_no of practice rows; null session_no where no session has the row's id."""
    rows = sheet_rows(cells.filter(F.col("sheet") == sheet))
    by_id = sessions.filter("session_id <> ''").groupBy("book", "session_id").agg(F.max_by("session_no", "row").alias("session_no"))
    return rows.filter("unit_id <> ''").select("book", "unit_id", "session_id").join(by_id, ["book", "session_id"], "left").select("book", "unit_id", "session_no")


def sheet_tools(cells: DataFrame) -> DataFrame:
    """book, sheet, row, session, name, version, qualifier of every tool column, flattened."""
    heads = cells.filter("row = 1").select("book", "sheet", "col", T.header(F.col("value")).alias("head"))
    tools = heads.filter(F.col("head").isin(*K.TOOL_HEADERS))
    better = tools.filter("head <> 'entity name'").select("book", "sheet").distinct().withColumn("better", F.lit(True))
    tools = tools.join(better, ["book", "sheet"], "left").filter("better IS NULL OR head <> 'entity name'").select("book", "sheet", "col")
    sessions = heads.filter(F.col("head").isin(*K.SESSION_HEADERS)).join(tools, ["book", "sheet", "col"], "left_anti").groupBy("book", "sheet").agg(F.min("col").alias("col"))
    body = cells.filter("row > 1")
    named = body.join(sessions, ["book", "sheet", "col"]).select("book", "sheet", "row", F.trim("value").alias("session"))
    found = body.join(tools, ["book", "sheet", "col"]).select("book", "sheet", "row", F.explode(T.tool_cell(F.col("value"))).alias("t"))
    return found.join(named, ["book", "sheet", "row"], "left").select("book", "sheet", "row", F.coalesce("session", F.lit("")).alias("session"), "t.name", "t.version", "t.qualifier")
