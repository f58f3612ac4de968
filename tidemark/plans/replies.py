"""Foreign text over whole tables: models' replies, nominations, rewrites, claims and signals, made of the driver's rows, and documents as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import evidence, report, resolve, score, trust
from tidemark.plans.agents import TIERS_OF_OWN_PAGES
from tidemark.plans.common import locations, table, with_course


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def replies_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as models' replies that nominate names: fenced, amid prose, refused, or with the only good name beyond the rows that count."""
    k = F.col("o_orderkey")
    good = _text('{"nominations": [{"name": " Tool ', k, '", "candidate_domain": "Tool', k % 9, '.io"}, {"name": "x"}, {"name": "tool ', k, '"}, {"name": "https://evil.io"}, {"name": "Kite", "candidate_domain": "https://kite.io/a"}, {"name": "Moss"}, {"name": "Fourth"}]}')
    late = _text('{"nominations": [', '{"name": "y"}, ' * 20, '{"name": "Good"}]}')
    reply = F.when(k % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```\nDone."))).when(k % 4 == 1, F.concat(good, F.lit(" as asked"))).when(k % 4 == 2, "I can't.").otherwise(late)
    return evidence.parsed_nominations(table(spark, sf_dir, "orders").select(k.cast("string").alias("prompt_sha"), reply.alias("text"))).select("prompt_sha", "name", "domain")


def rewrites_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rewrites of findings: honest ones, invented sources, missing parts and no JSON at all."""
    k = F.col("o_orderkey")
    part = lambda what, why: F.to_json(F.struct(what.alias("what_to_act"), F.lit(why).alias("why_to_act"), F.lit("now").alias("when_to_act")))
    reply = F.when(k % 4 == 0, part(_text("see https://acme.dev/", k, "/."), "since")).when(k % 4 == 1, part(_text("see https://else.io/", k), "since")).when(k % 4 == 2, part(F.lit("do"), " ")).otherwise("no")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("finding_id"), reply.alias("reply"), F.array(_text("https://acme.dev/", k)).alias("allowed"))
    return evidence.judged_rewrites(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("finding_id").cast("long")).alias("total"))


def _nominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nominations of every kind, nations as the domains that there are."""
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    kinds = [(_text("Good ", k), _text("Good", k % 25, ".io"), "search"), (F.lit("OAuth"), F.lit(""), "model"), (F.lit("Odd"), F.lit("not a host"), "model"), (F.lit("Own"), F.lit("docs.acme.dev"), "model"), (_text("Next ", k), F.lit(""), "vendor_named"), (F.lit("Name"), F.lit(""), "model"), (F.lit("Ghost"), _text("nowhere", k, ".io"), "model"), (F.lit("Dead"), F.when(k % 16 == 15, _text("old", k % 25, ".io")).otherwise(_text("dead", k % 25, ".io")), "search")]
    row = lambda x: F.struct(x[0].alias("name"), x[1].alias("domain"), F.lit(x[2]).alias("source"))
    picked = F.element_at(F.array(*[row(x) for x in kinds]), (k % 8 + 1).cast("int"))
    noms = table(spark, sf_dir, "orders").select(k.alias("nom_id"), picked.alias("x")).select("nom_id", "x.*").withColumn("own_domains", F.array(F.lit("acme.dev")))
    said = F.lit("The free tier allows twenty requests per minute for every account that is in good standing with us.")
    page = lambda name, status, to, text: F.struct(_text(name, n, ".io").alias("domain"), F.lit(status).alias("status"), to.alias("final_domain"), text.alias("text"))
    sites = table(spark, sf_dir, "nation").select(F.explode(F.array(page("good", 200, F.lit(""), said), page("dead", 410, F.lit(""), F.lit("")), page("old", 200, _text("good", n, ".io"), F.lit("")))).alias("p")).select("p.*")
    return evidence.adjudicated(noms, sites.select("domain", F.lit("ok").alias("safety")), sites)


def nominations_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every nomination, and where it led."""
    return _nominated(spark, sf_dir).select("nom_id", "at", "verdict")


def nominations_tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.tallied(_nominated(spark, sf_dir)).select("outcome", "n", F.array_join("names", ",").alias("names"))


def claims_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as claims on their own domain, of which some were stored with another tier, and some claim what theirs can't settle."""
    page = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(page.alias("claim_id"), F.col("url").alias("source_url"), F.array(U.registrable(U.host(F.col("url")))).alias("own_domains"), F.lit("pricing").alias("kind"))
    again = trust.tier(F.col("source_url"), F.col("own_domains"), F.col("kind"))
    stored = rows.withColumn("tier", F.when(F.col("claim_id") % 5 == 0, "CORROBORATING").otherwise(again)).withColumn("substantiates", (F.col("claim_id") % 3 == 0) | (F.col("tier") == "AUTHORITATIVE"))
    return report.audit(stored)


def signals_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals that name a supplier, name none but share its domain, or name one beside another's domain, which then doesn't count."""
    supplier, e = table(spark, sf_dir, "supplier"), F.col("event_id")
    n = F.lit(supplier.count())
    empty = F.array().cast("array<string>")
    deps = supplier.select(F.col("s_suppkey").cast("string").alias("dep_id"), F.col("s_name").alias("canonical_name"), F.array(_text("Alias--", F.col("s_suppkey"))).alias("aliases"), F.lit("").alias("registry_id"), F.array(_text("org", F.col("s_suppkey"), ".io")).alias("official_domains"))
    named, other = _text("ALIAS ", e % n), F.array(_text("org", (e + 1) % n, ".io"))
    signals = table(spark, sf_dir, "events").select(e.cast("string").alias("signal_id"), F.when(e % 3 == 1, F.array(F.lit("unknown"))).otherwise(F.array(named, named, F.lit("unknown"))).alias("refs"), F.when(e % 3 == 0, empty).otherwise(other).alias("domains"))
    return resolve.references(signals, deps)


def neutral_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and pages' code without characters that could open or close a prompt's sections."""
    docs = table(spark, sf_dir, "documents").select(_text("d", F.col("doc_id")).alias("id"), "text").unionByName(table(spark, sf_dir, "pages").select(_text("p", F.col("page_id")).alias("id"), F.col("html").alias("text")))
    return docs.select("id", F.sha2(T.neutral(F.col("text")), 256).alias("digest"))


def jobs_taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all line items do with a part, in the first six places: nation, month and the start of an order's line."""
    places = with_course(spark, sf_dir, locations(spark, sf_dir)).withColumn("unit_name", F.substring("content_id", 1, 3)).select(F.col("dep_id").cast("string").alias("dep_id"), "course", "session_no", "evidence_source", "unit_name", "content_id")
    return score.taught_job(places, "content_id")


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in documents, the longer one first: how many places, how much of the text they cover, and where the first one is."""
    spans = T.term_spans(F.col("text"), T.strings(("license", "Public License", "e", "licensed")))
    rows = table(spark, sf_dir, "documents").filter("contains(lower(text), 'licens')").select("doc_id", spans.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("covered"), F.coalesce(F.try_element_at("s", F.lit(1))["start"].cast("long"), F.lit(-1).cast("long")).alias("first"))


QUERIES = {f.__name__: f for f in (replies_parsed, rewrites_gated, nominations_judged, nominations_tallied, claims_audited, signals_resolved, neutral_texts, jobs_taught, document_spans)}

_JUDGED = """
j AS (SELECT o_orderkey AS k, CASE k % 8 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected_generic_token' WHEN 2 THEN 'rejected_malformed_domain' WHEN 3 THEN 'rejected_same_vendor' WHEN 4 THEN 'vendor_named' WHEN 5 THEN 'unresolved_name_only'
    WHEN 6 THEN 'refuted_no_such_domain' ELSE CASE WHEN k % 16 = 15 THEN 'verified' ELSE 'refuted_dead' END END AS verdict,
  CASE k % 8 WHEN 0 THEN 'good' || k % 25 || '.io' WHEN 2 THEN 'not a host' WHEN 3 THEN 'docs.acme.dev' WHEN 6 THEN 'nowhere' || k || '.io' WHEN 7 THEN CASE WHEN k % 16 = 15 THEN 'good' ELSE 'dead' END || k % 25 || '.io' ELSE '' END AS at_domain,
  CASE k % 8 WHEN 0 THEN 'Good ' || k WHEN 1 THEN 'OAuth' WHEN 2 THEN 'Odd' WHEN 3 THEN 'Own' WHEN 4 THEN 'Next ' || k WHEN 5 THEN 'Name' WHEN 6 THEN 'Ghost' ELSE 'Dead' END AS name FROM orders)"""

ORACLE_SQL = {
    "replies_parsed": """SELECT CAST(o_orderkey AS VARCHAR) AS prompt_sha, unnest(['Tool ' || o_orderkey, 'Kite', 'Moss']) AS name, unnest(['tool' || o_orderkey % 9 || '.io', '', '']) AS domain FROM orders WHERE o_orderkey % 4 < 2""",
    "rewrites_gated": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'invented source' WHEN 2 THEN 'missing part' ELSE 'not json' END AS outcome, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1""",
    "nominations_judged": f"WITH {_JUDGED} SELECT k AS nom_id, at_domain AS at, verdict FROM j",
    "nominations_tallied": f"""WITH {_JUDGED},
o AS (SELECT name, CASE WHEN verdict IN ('verified', 'vendor_named') THEN 'established' WHEN verdict LIKE 'refuted%' THEN 'refuted' WHEN verdict LIKE 'rejected%' THEN 'rejected' ELSE 'open' END AS outcome FROM j)
SELECT outcome, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 6), ',') AS names FROM o GROUP BY 1""",
    "claims_audited": f"""
WITH t AS ({TIERS_OF_OWN_PAGES}), s AS (SELECT page_id, tier AS again, CASE WHEN page_id % 5 = 0 THEN 'CORROBORATING' ELSE tier END AS tier FROM t)
SELECT page_id AS claim_id, CASE WHEN tier <> again THEN 'tier differs' ELSE 'cannot substantiate' END AS violation FROM s WHERE tier <> again OR ((page_id % 3 = 0 OR tier = 'AUTHORITATIVE') AND again <> 'AUTHORITATIVE')""",
    "signals_resolved": """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT CAST(event_id AS VARCHAR) AS signal_id, CAST(CASE WHEN event_id % 3 = 1 THEN (event_id + 1) % n ELSE event_id % n END AS VARCHAR) AS dep_id FROM events, n""",
    "neutral_texts": r"""
WITH d AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)
SELECT id, sha256(trim(regexp_replace(translate(coalesce(text, ''), '<>`{}', '     '), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS digest FROM d""",
    "jobs_taught": """
WITH l AS (SELECT l_partkey AS p, n_name || ' / session ' || month(l_shipdate) || ' / ' || substr(l_orderkey || '-' || l_linenumber, 1, 3) AS line, min(l_orderkey || '-' || l_linenumber) AS told
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY told, line) AS nth FROM l)
SELECT CAST(p AS VARCHAR) AS dep_id, string_agg(line, chr(10) ORDER BY nth) AS job FROM r WHERE nth <= 6 GROUP BY p""",
    "document_spans": """
WITH m AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), 'public license|licensed|license') AS found FROM documents WHERE contains(lower(text), 'licens'))
SELECT doc_id, CAST(len(found) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(found, lambda x: length(x))), 0) AS BIGINT) AS covered,
  CAST(CASE WHEN len(found) = 0 THEN -1 ELSE strpos(low, found[1]) - 1 END AS BIGINT) AS first FROM m""",
}
