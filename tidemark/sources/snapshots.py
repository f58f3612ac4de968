"""Tables of the outside world, as snapshots with fixed schemas, and the small files beside them.

Whatever needs a network enters here: a run reads what was fetched and can be repeated.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "fetches": "run_id string, url string, status int, final_url string, redirects array<string>, error string, body string, fetched_at timestamp",
    "dns": "domain string, safety string",
    "registry_packages": "registry string, name string, found boolean, reachable boolean, latest_version string, released_at timestamp, yanked boolean, deprecated boolean",
    "repo_paths": "path string",
    "vendor_pages": "vendor string, url string, html string, fetched_at timestamp",
    "search_hits": "query string, ord long, title string, url string, snippet string",
    "replies": "prompt_sha string, provider string, model string, text string",
    "decisions": "id long, finding_id string, dep_id string, signal string, verdict string, reason string, fingerprint string, at timestamp",
    "records": "source_file string, course string, topic_name string, unit_id string, unit_name string, unit_type string, session_no int, content_id string, object_type string, title string, body_text string, field_path string, evidence_source string, pooled boolean",
}


def snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet snapshot with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Content records from JSON lines; no rows is an error, since a wrong field name reads as nothing."""
    out = spark.read.schema(SCHEMAS["records"]).json(path)
    if out.isEmpty():
        raise ValueError(f"no records in {path}")
    return out


def course_exports(spark: SparkSession, path: str) -> DataFrame:
    """source_file, course, body of whole-file exports; the course is the file's stem."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("body"))
    return rows.select("source_file", F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1).alias("course"), "body")


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Courses (slug, title, workbook_keys) of a JSON-lines roster, and its lines that can't be read."""
    schema = "slug string, title string, workbook_keys array<string>, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    bad = F.col("_corrupt_record").isNotNull() | F.col("slug").isNull()
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad).select("_corrupt_record")


def overlaid(declared: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared courses and the overlay's that clash with none of them by slug or title; and those that do."""
    more = overlay.join(declared.select("slug"), "slug", "left_anti").join(declared.select(F.lower("title").alias("t")), F.lower("title") == F.col("t"), "left_anti")
    return declared.unionByName(more), overlay.join(more.select("slug"), "slug", "left_anti")


ENTRY = "kind string, canonical_name string, aliases array<string>, homepage string, docs_url string, changelog_url string, pricing_url string, status_url string, official_domains array<string>, registry string, registry_id string, vendor string, watch_tier string, review_status string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries of a JSON or YAML file on the driver, with their order."""
    with open(path) as f:
        text = f.read()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml  # an option of the environment; JSON needs nothing

        raw = yaml.safe_load(text)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    rows = [tuple(e.get(n) for n in names) + (i,) for i, e in enumerate((raw or {}).get("tools") or [])]
    out = spark.createDataFrame(rows, ENTRY + ", ord int")
    return out.withColumn("entry_id", F.concat_ws(":", "kind", F.lower("canonical_name")))


def save_registry(entries: DataFrame, path: str) -> None:
    """Entries sorted by kind and name, without empty fields, as JSON: a dictionary of names, small by nature."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    rows = entries.orderBy("kind", F.lower("canonical_name")).select(*names).toLocalIterator()
    with open(path, "w") as f:
        json.dump({"tools": [{k: v for k, v in r.asDict().items() if v} for r in rows]}, f, indent=1, ensure_ascii=False)


def merged_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two registries as one: arrays united, the first non-empty value of each other field kept, the earlier order kept."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    rank = F.struct("__n", "ord")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", rank)).alias(c)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    scalars = [c for c in old.columns if c not in ("entry_id", "ord", "aliases", "official_domains")]
    return both.groupBy("entry_id").agg(*[first(c) for c in scalars], united("aliases"), united("official_domains"), F.min_by("ord", rank).alias("ord"))
