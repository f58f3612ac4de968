"""Evidence gathered round by round: planning, reading and replanning over what suppliers' sites would serve, made of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import budget, evidence, frontier, report, resolve, search, trust
from tidemark.plans.common import locations, spread, table, with_course
from tidemark.plans.web import HOST_SQL, OWNER_SQL, TITLE_SQL
from tidemark.sources import stages

ROUNDS = 4
KINDS = ["deprecation"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as subjects, and all pages as what the sites of a quarter of them serve, dealt out by page_id.

    A site's pages are p0, p1, ...; page i links to the next two, back to the first, and to another host. p4 of every second site says in
    prose that the subject ends, p3 of every third one in a table, which also lists a longer id. p1 of every fifth can't be read.
    """
    supplier = spread(table(spark, sf_dir, "supplier"))
    sited = F.lit(int(supplier.count()) // 4 + 1)
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    domains = F.when(k % 11 == 0, none).otherwise(F.array(_text("org", k, ".io")))
    subject = F.struct(domains.alias("official_domains"))
    seeds = F.when(k % 13 == 5, none).otherwise(F.array(_text("https://docs.org", k, ".io/p0")))
    subjects = supplier.select(
        k.cast("string").alias("dep_id"), _text("Org ", k).alias("name"), F.array(_text("ORG-", k)).alias("aliases"), subject.alias("subject"), domains.alias("domains"), seeds.alias("seeds"),
        (k % 13 == 5).alias("publishes_nothing"), F.when(k % 7 == 3, "no provider").alias("error"),
    )
    p = F.col("page_id")
    rows = spread(table(spark, sf_dir, "pages")).withColumn("k", p % sited).withColumn("i", F.floor(p / sited))
    i, own = F.col("i"), F.col("k")
    link = lambda n: _text('<a href="https://docs.org', own, ".io/p", n, '">more</a> ')
    links = F.concat(F.lit("<p>"), link(i + 1), link(i + 2), link(F.lit(0)), _text('<a href="https://mirror.test/', own, "/p", i, '">mirror</a></p>'))
    ends = F.when((i == 4) & (own % 2 == 0), _text("<p>The Org ", own, " classic console has been deprecated and will stop working for everyone at the end of this year.</p>")).otherwise("")
    retired = _text("<table><tr><th>Deprecated Model</th><th>Shutdown Date</th></tr><tr><td><code>org-", own, "-lite</code></td><td>2031-01-01</td></tr><tr><td><code>org-", own, "</code></td><td>2031-02-0", own % 9 + 1, "</td></tr></table>")
    body = F.concat(links, ends, F.when((i == 3) & (own % 3 == 0), retired).otherwise(""), F.regexp_replace("html", "https?:", ""))
    fetches = rows.select(_text("https://docs.org", own, ".io/p", i).alias("url"), F.when((i == 1) & (own % 5 == 0), 404).otherwise(200).alias("status"), body.alias("body"))
    return subjects, fetches


def _reader(pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """Both readers on every page: tables and prose, one claim for each quote."""
    tabled, _ = evidence.table_claims(pages, subjects, KINDS)
    texts = pages.select("dep_id", F.explode(T.strings(KINDS)).alias("kind"), "url", T.main_text(F.col("html")).alias("text"))
    prose, _ = evidence.gated(evidence.lifted(texts, subjects, KINDS))
    return evidence.merged_claims(tabled, prose)


def _rounds(spark: SparkSession, sf_dir: str, stop_after: int | None = None, path: str | None = None) -> tuple[str, int]:
    subjects, fetches = sites(spark, sf_dir)
    path = path or stages.shared_path(spark)
    return path, frontier.run(subjects, fetches, frontier.link_planner(), _reader, path, ROUNDS, stop_after=stop_after)


def frontier_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the search ended for each supplier, and after how much reading. The run is left off after its second round and goes on from its state."""
    path, _ = _rounds(spark, sf_dir, 2)
    path, n = _rounds(spark, sf_dir, None, path)
    return frontier.endings(spark, path, n)


def frontier_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found, by which reader and in which round."""
    path, n = _rounds(spark, sf_dir)
    return frontier.claims(spark, path, n).select("dep_id", "kind", "source_url", "statement", "quote", "tier", "reader", F.col("round").cast("long").alias("round"))


def table_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all kinds from the tables of all vendors' pages of models, whichever round would find them; each page is read for three ids."""
    from tidemark.plans.derived import model_pages

    k = F.col("p_partkey")
    part = spread(table(spark, sf_dir, "part"))
    domains = F.struct(F.array(F.lit("v.test")).alias("official_domains"))
    ids = lambda name, shift: part.select(_text(name, k).alias("dep_id"), _text("M", k + shift, "-8B").alias("name"), F.array(_text("m", k + shift)).alias("aliases"), domains.alias("subject"), _text("https://v.test/", k).alias("url"))
    subjects = ids("own", 0).unionByName(ids("next", 7)).unionByName(ids("other", 1))
    pages = subjects.select("dep_id", "url").join(model_pages(spark, sf_dir), "url")
    found, refused = evidence.table_claims(pages, subjects.drop("url"), ["deprecation", "pricing", "availability"])
    fine = found.select("dep_id", "kind", "statement", F.col("substantiates").alias("cited"))
    return fine.unionByName(refused.select("dep_id", "kind", F.col("reason").alias("statement"), F.lit(False).alias("cited")))


MAX_CALLS, MAX_SPEND = 25, 250_000_000


def call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of a model, a month a day of the ledger: which are paid, answered from the cache or refused, and what was spent before."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey") % 40
    day = F.date_format("o_orderdate", "yyyy-MM")
    calls = orders.select(F.col("o_orderkey").alias("call_id"), day.alias("day"), F.col("o_orderdate").alias("at"), F.concat_ws("/", day, key.cast("string")).alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    cached = calls.filter(F.col("key").endswith("/0")).select("key")
    return budget.ledger(calls, cached, MAX_CALLS, MAX_SPEND).select("call_id", "outcome", F.col("charged").cast("long").alias("charged"), F.when(F.col("outcome") == "paid", F.col("spent_before")).alias("spent_before"))


def digest_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as findings in the order of the digest, each with its place."""
    orders = table(spark, sf_dir, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    severity = F.element_at(T.strings(K.SEVERITIES), 6 - rank)
    rows = orders.select(severity.alias("severity"), F.col("o_custkey").cast("int").alias("blast_radius"), F.format_string("%012d", "o_orderkey").alias("finding_id"), F.lit("S1").alias("signal"), F.lit("Change").alias("label"), F.col("o_orderkey").cast("string").alias("canonical_name"), F.lit("look").alias("what"), F.when(F.col("o_orderstatus") == "F", "unchanged").otherwise("new").alias("diff_class"))
    return report.digest_lines(rows)


def domain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every tenth page, its title asked of all pages of its own domain (of none, for every fiftieth): the five best and their tiers."""
    page, path = F.col("page_id"), stages.shared_path(spark)
    pages = stages.staged(table(spark, sf_dir, "pages").select("page_id", "url", U.registrable(U.host(F.col("url"))).alias("domain"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"), T.page_title(F.col("html")).alias("title")))
    search.write_index(spark, pages, path)
    domains = F.when(page % 50 == 0, F.array().cast("array<string>")).otherwise(F.array("domain"))
    queries = pages.filter(page % 10 == 0).select(page.alias("query_id"), F.col("title").alias("text"), domains.alias("domains"))
    found = search.searched(queries, *search.read_index(spark, path))
    tiers = trust.classified(pages.select("page_id", "url", F.array("domain").alias("own_domains"), F.lit("version").alias("kind"))).select("page_id", "tier")
    out = found.join(tiers, "page_id").select("query_id", F.col("rank").cast("long").alias("rank"), "page_id", "score", "tier")
    none = search.refused(queries).select("query_id", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("long").alias("score"), F.lit("refused").alias("tier"))
    return out.unionByName(none)


def runs_by_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs each course's history has, after the runs without courses were given theirs: orders as runs, their parts as what was asked."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("part"))
    parts = lines.groupBy("o_orderkey").agg(F.collect_set("part").alias("parts"))
    courses = F.when(k % 5 == 0, F.array(_text("Course ", k % 4), F.lit("")))
    deps = F.when(k % 5 == 3, F.array(_text("gone", k))).when(k % 5 != 1, F.col("parts"))
    jobs = table(spark, sf_dir, "orders").join(parts, "o_orderkey", "left").select(k.alias("run_id"), courses.alias("courses"), deps.alias("dep_ids"))
    taught = with_course(spark, sf_dir, locations(spark, sf_dir)).filter("dep_id % 3 <> 0").select(F.col("dep_id").cast("string").alias("dep_id"), "course")
    had = jobs.filter("run_id % 2 = 0").select("run_id", F.lit("old").alias("slug"))
    return resolve.backfilled(jobs, had, taught).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


def agents_by_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of agents that concern one nation (customers, with their orders as findings), its findings, and how many wait for review."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.struct(_text("nation ", F.col("o_orderkey") % 25).alias("course"), F.col("o_orderkey").alias("finding")).alias("f"))
    runs = orders.groupBy("run_id").agg(F.collect_list("f").alias("findings")).withColumn("awaiting_review", F.col("run_id") % 3 == 0)
    mine = resolve.agents_runs(runs, "nation 7")
    return mine.select("run_id", F.size("findings").cast("long").alias("findings"), F.aggregate("findings", F.lit(0).cast("long"), lambda a, f: a + f["finding"]).alias("total"), "awaiting_review")


def declared_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that vendors declare for all parts, as models or nodes: what becomes a claim, and which can only be noted."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    part = spread(table(spark, sf_dir, "part"))
    model = k % 3 == 0
    deps = part.select(k.cast("string").alias("dep_id"), F.when(model, "model").otherwise("n8n_node").alias("kind"), _text("Part ", k).alias("canonical_name"), F.array(F.lit("owner.io")).alias("official_domains"))
    url = F.when(k % 4 == 0, "https://docs.owner.io/changes").when(k % 4 == 1, "https://www.npmjs.com/package/x").when(k % 4 == 3, "https://server.io/deprecations").otherwise("")
    changes = part.select(
        k.cast("string").alias("dep_id"), _text("Change ", k).alias("title"), F.when(k % 10 != 0, "of what it says").otherwise(none).alias("description"), F.lit("3.0").alias("version"), url.alias("doc_url"), F.when(k % 5 == 0, "Server").alias("provider"),
        F.array(F.lit("server.io")).alias("provider_domains"), (k % 2 == 0).alias("still_listed"), F.lit("https://owner.io/models").alias("listed_url"), _text("m", k, " | $0.10 | 30 a minute").alias("listed_quote"), F.when(k % 7 == 0, "$0.10").alias("listed_price"),
    )
    claims, notes = evidence.declared(deps, changes)
    return claims.select("dep_id", "kind", "statement", "tier").unionByName(notes.select("dep_id", F.lit("note").alias("kind"), F.col("note").alias("statement"), none.alias("tier")))


QUERIES = {f.__name__: f for f in (frontier_endings, frontier_claims, table_evidence, call_ledger, digest_of_orders, domain_search, runs_by_course, agents_by_course, declared_changes)}

#: Tiers of pages for a subject that owns their domain.
TIERS_OF_OWN_PAGES = f"""SELECT page_id, CASE WHEN h = '' OR contains(lower(url), 'best-') OR contains(lower(url), 'top-10') OR contains(lower(url), 'aggregator') THEN 'EXCLUDED'
  WHEN regexp_matches(h, '^(community|forum|forums|discuss|answers|ask|support-community|users|help-community)[.]') OR regexp_matches(lower(url), '/(t|questions|discussions|threads|topic|forum|community)/|/viewtopic') THEN 'LEAD_ONLY'
  ELSE 'AUTHORITATIVE' END AS tier FROM (SELECT page_id, url, {HOST_SQL} AS h FROM pages)"""

#: One row a subject and round, in lists of page numbers: what was visited, what the last round read, how it stands.
_LOOP = f"""
RECURSIVE n AS (SELECT CAST(count(*) // 4 + 1 AS BIGINT) AS g FROM supplier), have AS (SELECT page_id % g AS k, list(page_id // g) AS pages FROM pages, n GROUP BY 1),
loop(k, pages, round, visited, planned, reads, rejected, status, plan_size) AS (
  SELECT s_suppkey, coalesce(pages, []), 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), 'open', CAST(0 AS BIGINT) FROM supplier LEFT JOIN have ON have.k = s_suppkey
  UNION ALL
  SELECT k, pages, round + 1, list_concat(visited, kept), kept, good, off,
    CASE WHEN k % 11 = 0 THEN 'no_source' WHEN k % 7 = 3 THEN 'blocked' WHEN len(kept) = 0 AND k % 13 = 5 THEN 'silence' WHEN len(kept) = 0 THEN 'exhausted'
      WHEN (list_contains(good, 4) AND k % 2 = 0) OR (list_contains(good, 3) AND k % 3 = 0) THEN 'done' WHEN round + 1 >= {ROUNDS} THEN 'exhausted' ELSE 'open' END, len(kept)
  FROM (SELECT *, list_filter(kept, lambda i: list_contains(pages, i) AND NOT (i = 1 AND k % 5 = 0)) AS good FROM (
    SELECT *, CASE WHEN k % 11 = 0 OR k % 7 = 3 THEN CAST([] AS BIGINT[]) ELSE list_filter(said, lambda i: i >= 0 AND NOT list_contains(visited, i)) END AS kept,
      CASE WHEN k % 11 = 0 THEN 0 ELSE len(list_filter(said, lambda i: i < 0)) END AS off FROM (
      SELECT *, list_slice(CASE WHEN round = 0 THEN CASE WHEN k % 13 = 5 THEN [] ELSE [0] END ELSE list_filter(links, lambda x, nth: list_position(links, x) = nth) END, 1, 4) AS said FROM (
        SELECT *, flatten(list_transform(reads, lambda i: [i + 1, i + 2, 0, -1 - i])) AS links FROM loop WHERE status = 'open')))))
"""

ORACLE_SQL = {
    "frontier_endings": f"""WITH {_LOOP}
SELECT CAST(k AS VARCHAR) AS dep_id, arg_max(status, round) AS status, CAST(max(round) AS BIGINT) AS rounds, CAST(sum(len(planned)) AS BIGINT) AS n_visited, CAST(sum(len(reads)) AS BIGINT) AS n_read,
  CAST(sum(len(planned) - len(reads)) AS BIGINT) AS n_unreadable, CAST(sum(rejected) AS BIGINT) AS n_rejected,
  CAST(sum(CASE WHEN list_contains(reads, 4) AND k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN list_contains(reads, 3) AND k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_claims
FROM loop WHERE round > 0 GROUP BY k""",
    "frontier_claims": f"""WITH {_LOOP}
SELECT CAST(k AS VARCHAR) AS dep_id, 'deprecation' AS kind, 'https://docs.org' || k || '.io/p4' AS source_url, 'Org ' || k || ': its own documentation uses deprecation language' AS statement,
  'The Org ' || k || ' classic console has been deprecated and will stop working for everyone at the end of this year.' AS quote, 'AUTHORITATIVE' AS tier, 'prose' AS reader, CAST(round AS BIGINT) AS round
FROM loop WHERE list_contains(reads, 4) AND k % 2 = 0
UNION ALL
SELECT CAST(k AS VARCHAR), 'deprecation', 'https://docs.org' || k || '.io/p3', 'Org ' || k || ' is listed as deprecated in a table on the vendor''s own page, shutdown 2031-02-0' || (k % 9 + 1),
  'org-' || k || ' | 2031-02-0' || (k % 9 + 1), 'AUTHORITATIVE', 'table', CAST(round AS BIGINT)
FROM loop WHERE list_contains(reads, 3) AND k % 3 = 0""",
    "table_evidence": """WITH p AS (SELECT p_partkey AS k, ' in a table on the vendor''s own page' AS place FROM part)
SELECT 'own' || k AS dep_id, 'deprecation' AS kind, 'M' || k || '-8B is listed as deprecated' || place || ', shutdown ' || CASE WHEN k % 6 = 0 THEN '2020-03-05' ELSE '2031-01-01' END AS statement, true AS cited FROM p WHERE k % 3 = 0
UNION ALL SELECT 'own' || k, 'pricing', 'M' || k || '-8B appears in a table with plan or quota columns' || place, true FROM p WHERE k % 3 <> 0 OR k % 9 = 0
UNION ALL SELECT 'next' || k, 'availability', 'M' || (k + 7) || '-8B is listed as available' || place, true FROM p WHERE k % 3 = 0""",
    "call_ledger": f"""
WITH c AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS day, o_orderdate AS told, o_custkey % 40 AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders),
f AS (SELECT *, key <> 0 AND row_number() OVER (PARTITION BY day, key ORDER BY told, id) = 1 AS opening FROM c),
s AS (SELECT *, coalesce(sum(CASE WHEN opening THEN 1 END) OVER w, 0) AS calls_before, coalesce(sum(CASE WHEN opening THEN cost END) OVER w, 0) AS spent FROM f WINDOW w AS (PARTITION BY day ORDER BY told, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, bool_or(opening AND calls_before < {MAX_CALLS} AND spent < {MAX_SPEND}) OVER (PARTITION BY day, key) AS bought FROM s),
o AS (SELECT *, CASE WHEN key = 0 OR (bought AND NOT opening) THEN 'cached' WHEN bought THEN 'paid' ELSE 'refused' END AS outcome FROM p)
SELECT id AS call_id, outcome, CASE WHEN outcome = 'paid' THEN cost ELSE 0 END AS charged, CASE WHEN outcome = 'paid' THEN CAST(spent AS BIGINT) END AS spent_before FROM o""",
    "digest_of_orders": f"""
WITH o AS (SELECT *, 5 - CAST(o_orderpriority[1] AS INT) AS rank FROM orders WHERE o_orderstatus <> 'F')
SELECT row_number() OVER (ORDER BY rank DESC, o_custkey DESC, o_orderkey) AS place,
  upper((['{"', '".join(K.SEVERITIES)}'])[rank + 1]) || ' · S1 Change — ' || o_orderkey || ' · blast radius ' || o_custkey || ' · look' AS line FROM o""",
    "domain_search": f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS h, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, {TITLE_SQL} AS title FROM pages), p AS (SELECT *, {OWNER_SQL} AS domain FROM h),
t AS (SELECT page_id, domain, term, count(*) AS tf FROM (SELECT page_id, domain, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)')) AS term FROM p) GROUP BY 1, 2, 3),
l AS (SELECT page_id, sum(tf) AS len FROM t GROUP BY 1), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM p) AS mean),
w AS (SELECT page_id, domain, term, CAST(round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * 1000000) AS BIGINT) AS weight FROM t JOIN l USING (page_id) JOIN d USING (term), n),
q AS (SELECT DISTINCT page_id AS query_id, domain, unnest(regexp_extract_all(lower(title), '([a-z0-9]+)')) AS term FROM p WHERE page_id % 10 = 0 AND page_id % 50 <> 0),
s AS (SELECT query_id, page_id, CAST(sum(weight) AS BIGINT) AS score FROM q JOIN w USING (domain, term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s)
SELECT query_id, rank, r.page_id, score, tier FROM r JOIN ({TIERS_OF_OWN_PAGES}) AS g ON g.page_id = r.page_id WHERE rank <= 5
UNION ALL SELECT page_id, NULL, NULL, NULL, 'refused' FROM pages WHERE page_id % 50 = 0""",
    "runs_by_course": """
WITH j AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 <> 0),
t AS (SELECT DISTINCT l_partkey AS part, n_name AS course FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_partkey % 3 <> 0),
f AS (SELECT k, 'course_' || k % 4 AS slug FROM j WHERE k % 5 = 0
  UNION SELECT k, trim(regexp_replace(lower(course), '[^a-z0-9]+', '_', 'g'), '_') FROM j JOIN lineitem ON l_orderkey = k JOIN t ON part = l_partkey WHERE k % 5 IN (2, 4)),
a AS (SELECT k, slug FROM f UNION ALL SELECT k, '*' FROM j WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0)
SELECT slug, count(*) AS n FROM a GROUP BY 1""",
    "agents_by_course": "SELECT o_custkey AS run_id, count(*) AS findings, CAST(sum(o_orderkey) AS BIGINT) AS total, o_custkey % 3 = 0 AS awaiting_review FROM orders WHERE o_orderkey % 25 = 7 GROUP BY 1",
    "declared_changes": """
WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS model, length('Change ' || p_partkey || CASE WHEN p_partkey % 10 <> 0 THEN ' of what it says' ELSE '' END) >= 12 AS quotable FROM part),
c AS (SELECT k, model, CASE WHEN k % 4 = 0 OR model THEN 'AUTHORITATIVE' END AS tier, CASE k % 4 WHEN 1 THEN 'npmjs.com' WHEN 3 THEN 'server.io' END AS host FROM p WHERE k % 4 <> 2 AND quotable)
SELECT CAST(k AS VARCHAR) AS dep_id, CASE WHEN tier IS NULL THEN 'note' WHEN model THEN 'deprecation' ELSE 'implementation' END AS kind,
  CASE WHEN tier IS NULL THEN 'declared_change_unciteable:' || host WHEN model THEN 'Change ' || k ELSE 'n8n declares: Change ' || k || ' (n8n 3.0)' END AS statement, tier FROM c
UNION ALL SELECT CAST(k AS VARCHAR), 'pricing', 'Part ' || k || ' is still listed by ' || CASE WHEN k % 5 = 0 THEN 'Server' ELSE 'the provider' END || ' at ' || CASE WHEN k % 7 = 0 THEN '$0.10' ELSE 'quote-only' END || ' pricing', 'AUTHORITATIVE' FROM p WHERE k % 2 = 0""",
}
