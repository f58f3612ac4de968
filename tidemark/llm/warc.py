"""Not-modified revisit resolution for WARC records.

A revisit record (HTTP 304) says that a page had not changed; its body is that of the latest earlier full response for the same
canonical URL. Resolution is an as-of join in two levels: within a URL's time bucket a running window finds the last full response,
and a running window over one row a bucket carries it from earlier buckets. So a URL with a third of all records is spread over its
buckets, and no join emits pairs of records.

A match holds if its validators agree: entity tags where both sides have one (compared weakly), else Last-Modified, else the payload
digest. The headers of a match are the response's, updated with those of the 304 that a cache may take from it: all but the ones that
describe the stored body.

Outcomes: ``full`` (a full response, which stands for itself), ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (no
validator on both sides), ``missing`` (no earlier full response), ``other`` (neither a full response nor a revisit).

Defined cases: a null or unparsable URL is kept as it is, and a null one matches nothing; null headers are none; records of one moment
are ordered by record_id; repeated records each give a row; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Headers of the stored body; a 304 must not change them.
OF_BODY = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
URL = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:[?]([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, query without tracking and in order; no scheme or fragment."""
    text = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, URL, 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(text, URL, 2), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(text, URL, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(text.rlike(URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(text)


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve(records: DataFrame, bucket: str = "hour") -> DataFrame:
    """record_id, canonical_url, outcome, resolved_id, payload_digest, headers from (record_id, warc_type, target_uri, warc_date, http_status, headers, payload_digest)."""
    none = F.create_map().cast("map<string,string>")
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), "warc_type", canonical_url(F.col("target_uri")).alias("url"), "warc_date",
        F.transform_keys(F.coalesce("headers", none), lambda k, _: F.lower(k)).alias("headers"), "payload_digest",
        ((F.col("warc_type") == "response") & (F.col("http_status") == 200)).alias("full"),
    ).withColumn("full", F.coalesce("full", F.lit(False))).withColumn("bucket", F.date_trunc(bucket, "warc_date"))
    found = F.struct("record_id", "headers", "payload_digest")
    keyed = rows.filter("url is not null")
    own = W.partitionBy("url", "bucket").orderBy(F.col("warc_date").asc_nulls_first(), F.col("record_id").asc_nulls_first(), ~F.col("full")).rowsBetween(W.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last(F.when(F.col("full"), found), ignorenulls=True).over(own))
    last = F.max_by(F.when(F.col("full"), found), F.when(F.col("full"), F.struct("warc_date", "record_id")))
    by_bucket = W.partitionBy("url").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    carried = keyed.groupBy("url", "bucket").agg(last.alias("last")).select(F.col("url").alias("u"), F.col("bucket").alias("k"), F.last("last", ignorenulls=True).over(by_bucket).alias("carried")).filter("carried is not null")
    joined = near.join(carried, (near["url"] == carried["u"]) & near["bucket"].eqNullSafe(carried["k"]), "left").withColumn("match", F.coalesce("near", "carried")).drop("near", "carried", "u", "k")
    unkeyed = rows.filter("url is null").withColumn("match", F.lit(None).cast(joined.schema["match"].dataType))
    return joined.unionByName(unkeyed).select("record_id", F.col("url").alias("canonical_url"), *_judged())


def _judged() -> list[Column]:
    revisit = F.coalesce(F.col("warc_type") == "revisit", F.lit(False))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    mine, theirs = F.col("headers"), F.col("match.headers")
    agree = F.coalesce(
        weak(_header(mine, "etag")) == weak(_header(theirs, "etag")),
        _header(mine, "last-modified") == _header(theirs, "last-modified"),
        F.col("payload_digest") == F.col("match.payload_digest"),
    )
    outcome = F.when(F.col("full"), "full").when(~revisit, "other").when(F.col("match").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter(mine, lambda k, _: ~k.isin(*OF_BODY))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(update, k)), update)
    good = outcome == "resolved"
    return [
        outcome.alias("outcome"),
        F.when(F.col("full"), F.col("record_id")).when(good, F.col("match.record_id")).alias("resolved_id"),
        F.when(F.col("full"), F.col("payload_digest")).when(good, F.col("match.payload_digest")).alias("payload_digest"),
        F.when(good, merged).otherwise(mine).alias("headers"),
    ]


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Records for a table of pages (page_id, url, html), which holds full captures alone: each page's response, a second after the one
    before, and a recheck of the same URL a day later, whose validators follow from page_id: most agree, some are stale or left out."""
    page, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    at = F.timestamp_seconds(F.lit(1704067200) + page)
    base = pages.select("page_id", "url", F.sha2(body.cast("binary"), 256).alias("digest"), F.length(body).cast("string").alias("size"), at.alias("at"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.date_format("at", "yyyy-MM-dd HH:mm")
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60"))
    again = F.map_filter(F.create_map(
        F.lit("ETag"), F.when(page % 5 == 0, None).when(page % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag)),
        F.lit("Last-Modified"), F.when(page % 25 == 0, None).when(page % 10 == 0, F.lit("never")).otherwise(day),
        F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("Content-Length"), F.lit("0"),
    ), lambda _, v: v.isNotNull())
    cols = lambda nth, kind, when, status, headers, digest: base.select((page * 2 + nth).alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"), when.alias("warc_date"), F.lit(status).alias("http_status"), headers.alias("headers"), digest.alias("payload_digest"))
    return cols(0, "response", F.col("at"), 200, response, F.col("digest")).unionByName(cols(1, "revisit", F.col("at") + F.expr("INTERVAL 1 DAY"), 304, again, F.lit(None).cast("string")))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl_log(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return out.withColumn("headers", header_text(F.col("headers")))


QUERIES = {"op4_warc_revisits": op4_warc_revisits}

ORACLE_SQL = {
    "op4_warc_revisits": r"""
WITH p AS (SELECT page_id, trim(url) AS url, sha256(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
                  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS ts FROM pages),
q AS (SELECT *, '"' || digest[1:16] || '"' AS tag, strftime(ts, '%Y-%m-%d %H:%M') AS day,
      regexp_matches(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS ok,
      regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 1) AS host,
      regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 2) AS path,
      regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:[?]([^#]*))?', 3) AS query FROM p),
u AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS args FROM q),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(regexp_replace(lower(host), '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                || CASE WHEN args <> '' THEN '?' || args ELSE '' END ELSE url END AS canonical_url FROM u),
r AS (
  SELECT page_id * 2 AS record_id, 'response' AS kind, canonical_url, ts AS t, digest, tag AS etag, day AS modified, size FROM c
  UNION ALL
  SELECT page_id * 2 + 1, 'revisit', canonical_url, ts + INTERVAL 1 DAY, NULL,
         CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END,
         CASE WHEN page_id % 25 = 0 THEN NULL WHEN page_id % 10 = 0 THEN 'never' ELSE day END, '0' FROM c),
m AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'digest': digest, 'etag': etag, 'modified': modified, 'size': size} END IGNORE NULLS)
               OVER (PARTITION BY canonical_url ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r),
j AS (SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', ''), modified = f.modified, digest = f.digest) AS agree FROM m),
o AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN canonical_url IS NULL OR f IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT record_id, canonical_url, outcome,
       CASE WHEN outcome = 'full' THEN record_id WHEN outcome = 'resolved' THEN f.id END AS resolved_id,
       CASE WHEN outcome = 'full' THEN digest WHEN outcome = 'resolved' THEN f.digest END AS payload_digest,
       concat_ws(chr(10),
         CASE WHEN kind = 'response' THEN 'cache-control: max-age=60' ELSE 'cache-control: max-age=3600' END,
         'content-length: ' || CASE WHEN outcome = 'resolved' THEN f.size ELSE size END,
         CASE WHEN outcome IN ('full', 'resolved') THEN 'content-type: text/html' END,
         'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, f.etag) ELSE etag END,
         'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(modified, f.modified) ELSE modified END) AS headers
FROM o
"""
}
