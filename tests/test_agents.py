"""Evidence round by round, tables as evidence, the ledger, search: against small cases and brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import budget, evidence, frontier, prefix, score, search

SUBJECT = "dep_id string, name string, aliases array<string>, subject struct<official_domains: array<string>>"


def subjects(spark, *rows):
    """rows: (dep_id, domains, seeds, publishes_nothing, error)"""
    df = spark.createDataFrame([r + (None,) * (5 - len(r)) for r in rows], "dep_id string, domains array<string>, seeds array<string>, publishes_nothing boolean, error string")
    return df.select("*", F.lit("Gizmo").alias("name"))


def pages(spark, bodies):
    return spark.createDataFrame([(u, 200 if b else 404, b) for u, b in bodies.items()], "url string, status int, body string")


def reader(found, _):
    """A page that says so is a claim."""
    return found.filter(F.contains("html", F.lit("deprecated"))).select("dep_id", "url")


def link(*urls):
    return "".join(f'<a href="{u}">x</a> ' for u in urls)


SITE = {"https://a.test/0": link("https://a.test/1", "https://evil.test/x", "https://a.test.evil/x"), "https://a.test/1": link("https://a.test/0", "https://docs.a.test/2"), "https://docs.a.test/2": "it is deprecated", "https://evil.test/x": "deprecated", "https://b.test/0": "nothing here"}
FIVE = [("a", ["a.test"], ["https://a.test/0"]), ("b", ["b.test"], ["https://b.test/0"]), ("none", [], ["https://a.test/0"]), ("quiet", ["q.test"], [], True), ("mute", ["m.test"], ["https://m.test/0"], None, "no provider"), ("gone", ["a.test"], ["https://a.test/404"])]


def test_endings_stay_apart_and_a_stopped_run_goes_on(spark, tmp_path):
    own, fetched = subjects(spark, *FIVE), pages(spark, SITE)
    plan = frontier.link_planner()
    assert frontier.run(own, fetched, plan, reader, f"{tmp_path}/x", 4, stop_after=1) == 1
    assert {r["dep_id"] for r in frontier.endings(spark, f"{tmp_path}/x", 1).filter("status = 'open'").collect()} == {"a", "b", "gone"}
    n = frontier.run(own, fetched, plan, reader, f"{tmp_path}/x", 4)
    got = {r["dep_id"]: (r["status"], r["rounds"], r["n_read"], r["n_unreadable"], r["n_rejected"]) for r in frontier.endings(spark, f"{tmp_path}/x", n).collect()}
    assert got == {"a": ("done", 3, 3, 0, 2), "b": ("exhausted", 2, 1, 0, 0), "none": ("no_source", 1, 0, 0, 0), "quiet": ("silence", 1, 0, 0, 0), "mute": ("blocked", 1, 0, 0, 0), "gone": ("exhausted", 2, 0, 1, 0)}
    assert [tuple(r) for r in frontier.claims(spark, f"{tmp_path}/x", n).collect()] == [("a", "https://docs.a.test/2", 3)]
    # a round whose state was never finished doesn't count, and is done again
    (tmp_path / "x/state/3/_SUCCESS").unlink()
    assert frontier.run(own, fetched, plan, reader, f"{tmp_path}/x", 4) == n
    assert {r["dep_id"]: r["status"] for r in frontier.endings(spark, f"{tmp_path}/x", n).collect()} == {k: v[0] for k, v in got.items()}


def test_replanning_is_bounded_and_does_not_repeat(spark, tmp_path):
    replies = {1: ["https://a.test/404"], 2: ["https://a.test/404", " https://a.test/405", "https://a.test/405"], 3: ["https://a.test/0"]}
    plan = lambda own, _, n: own.select("dep_id", F.array(*[F.lit(u) for u in replies[n]]).alias("urls"), F.lit(False).alias("publishes_nothing"), F.lit(None).cast("string").alias("error"))
    n = frontier.run(subjects(spark, FIVE[0]), pages(spark, SITE), plan, reader, str(tmp_path), 2)
    assert n == 2
    state = spark.read.parquet(f"{tmp_path}/state/1", f"{tmp_path}/state/2").orderBy("round").collect()
    assert [r["planned"] for r in state] == [["https://a.test/404"], ["https://a.test/405"]] and state[1]["status"] == "exhausted"


TABLE = """<html><body><main><h1>Model Deprecation</h1><table>
<tr><th>Model</th><th>Shutdown date</th><th>Recommended replacement</th></tr>
<tr><td>gizmo-1</td><td>08/16/26</td><td>gizmo-2 or gizmo-3</td></tr><tr><td>gizmo-1-lite</td><td>09/01/26</td><td>gizmo-2-lite</td></tr></table></main></body></html>"""
TINY = "<table><tr><th>Model</th><th>Status</th></tr><tr><td>gizmo-1</td><td>x</td></tr></table>"


def claims(spark, html, name="Gizmo-1", domains=("gizmo.example",), kinds=("deprecation", "pricing", "availability"), url="https://gizmo.example/d"):
    own = spark.createDataFrame([("d", name, [], (list(domains),))], SUBJECT)
    return evidence.table_claims(spark.createDataFrame([("d", url, html)], "dep_id string, url string, html string"), own, list(kinds))


def test_a_row_of_a_table_becomes_a_claim_of_exactly_its_id(spark):
    found, refused = claims(spark, TABLE)
    (c,) = found.collect()
    assert c["kind"] == "deprecation" and "08/16/26" in c["statement"] and c["quote"].startswith("gizmo-1 | 08/16/26") and c["substantiates"]
    assert refused.count() == 0
    assert claims(spark, TABLE, kinds=("pricing",))[0].count() == 0
    lead = claims(spark, TABLE, domains=("owner.example",))[0].collect()
    assert [r["tier"] for r in lead] == ["LEAD_ONLY"] and not lead[0]["substantiates"]


def test_a_row_too_short_to_quote_is_refused_by_name(spark):
    found, refused = claims(spark, TINY)
    assert found.count() == 0 and [r["reason"] for r in refused.collect()] == ["quote too short to verify"]


def test_one_claim_a_quote_tables_first(spark):
    base = ("d", "deprecation", "table says", "https://g.test/d", "q" * 90, "AUTHORITATIVE", True)
    tabled = spark.createDataFrame([(*base, 0, 0), (*base[:4], "other quote", *base[5:], 1, 0)], "dep_id string, kind string, statement string, source_url string, quote string, tier string, substantiates boolean, ord int, nth int")
    prose = spark.createDataFrame([("d", "deprecation", "prose says", "https://g.test/d", "q" * 85, "AUTHORITATIVE", True), ("d", "deprecation", "lead", "https://g.test/d", "z" * 20, "LEAD_ONLY", False), ("e", *base[1:])], "dep_id string, kind string, statement string, source_url string, quote string, tier string, substantiates boolean")
    got = sorted((r["dep_id"], r["statement"], len(r["quote"]), r["reader"]) for r in evidence.merged_claims(tabled, prose).collect())
    assert got == [("d", "table says", 11, "table"), ("d", "table says", 90, "table"), ("e", "table says", 90, "prose")]


@pytest.mark.parametrize("seed", [0, 1])
def test_prefix_sums_are_running_sums(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randrange(10**6), rng.randrange(-5, 50)) for _ in range(3000)]
    rows = [(g, i, v) for (g, i), v in {(g, i): v for g, i, v in rows}.items()]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = {(r["g"], r["i"]): (r["s"], r["n"]) for r in prefix.prefix_sums(df, [F.col("i").desc()], {"s": F.col("v"), "n": F.lit(1)}, ["g"]).collect()}
    want, so_far = {}, collections.Counter()
    for g, i, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        want[g, i] = (so_far[g, "s"], so_far[g, "n"])
        so_far[g, "s"] += v
        so_far[g, "n"] += 1
    assert got == want
    places = {r["i"]: r["place"] for r in prefix.numbered(df.dropDuplicates(["i"]), [F.col("i").asc()]).collect()}
    assert sorted(places, key=places.get) == sorted(places) and sorted(places.values()) == list(range(1, len(places) + 1))
    assert prefix.numbered(df.limit(0), [F.col("i").asc()]).count() == 0


@pytest.mark.parametrize(("calls", "spend"), [(5, 10**9), (10**9, 300), (7, 400), (0, 10)])
def test_ledger_is_a_replay(spark, calls, spend):
    rng = random.Random(calls)
    rows = [(n, f"d{rng.randrange(3)}", rng.randrange(40), rng.randrange(12), rng.randrange(100)) for n in range(200)]
    rows = [(n, day, at, f"{day}/{key}", cost) for n, day, at, key, cost in rows]
    kept = {f"d{i}/0" for i in range(3)}
    want, books = {}, collections.defaultdict(lambda: [0, 0, set(kept)])
    for n, day, _, key, cost in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        book = books[day]
        if key in book[2]:
            want[n] = ("cached", 0)
        elif book[0] < calls and book[1] < spend:
            want[n] = ("paid", cost)
            book[0] += 1
            book[1] += cost
            book[2].add(key)
        else:
            want[n] = ("refused", 0)
    got = budget.ledger(spark.createDataFrame(rows, "call_id long, day string, at int, key string, cost long"), spark.createDataFrame([(k,) for k in kept], "key string"), calls, spend)
    assert {r["call_id"]: (r["outcome"], r["charged"]) for r in got.collect()} == want
    assert {r["day"]: (r["calls"], r["spent"]) for r in budget.days(got).collect()} == {d: (b[0], b[1]) for d, b in books.items()}


def test_search_is_brute_force_and_opens_few_blocks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(3, 30), weights=[1 / (j + 1) for j in range(60)])) for i in range(400)}
    domain = {i: f"d{i % 3}.test" for i in texts}
    df = spark.createDataFrame([(i, domain[i], t) for i, t in texts.items()], "page_id long, domain string, text string")
    blocks, places = search.postings(df, 16)
    asked = [(n, " ".join(rng.sample(vocabulary, 3)), [f"d{n % 3}.test"]) for n in range(12)] + [(90, "w0", []), (91, "w0 w0", ["d0.test", "d1.test"]), (92, "nothing", ["d0.test"]), (93, "w1", None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, domains array<string>")
    words = {i: re.findall("[a-z0-9]+", t) for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    spread = collections.Counter(w for ws in words.values() for w in set(ws))
    weight = lambda i, w: round(math.log(1 + (len(words) - spread[w] + 0.5) / (spread[w] + 0.5)) * words[i].count(w) * 2.2 / (words[i].count(w) + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) * 1e6)
    want = {}
    for n, text, own in asked:
        scores = {i: sum(weight(i, w) for w in set(text.split()) if w in words[i]) for i in words if domain[i] in (own or [])}
        want[n] = sorted(((-s, i) for i, s in scores.items() if s))[:5]
    got = collections.defaultdict(list)
    for r in search.searched(queries, blocks, places).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["page_id"]))
    assert {n: got.get(n, []) for n, *_ in asked} == want
    assert {r["query_id"] for r in search.refused(queries).collect()} == {90, 93}
    hits = queries.select("query_id", F.explode("domains").alias("domain"), F.explode(search.terms_of(F.col("text"))).alias("term")).dropDuplicates().join(blocks, ["term", "domain"]).withColumn("block", F.struct("domain", "block"))
    assert search.opened(hits, 1).count() < hits.select("query_id", "block").distinct().count()


def test_a_declared_change_that_cannot_be_cited_is_noted_not_attached(spark):
    deps = spark.createDataFrame([("n", "n8n_node", "x.chat", ["n8n.io"]), ("m", "model", "llama", ["owner.io"])], "dep_id string, kind string, canonical_name string, official_domains array<string>")
    rows = [("n", "Embedded chat now uses a JSON format", "https://www.npmjs.com/package/x", []), ("n", "Webhooks must name their method", "https://docs.n8n.io/b", []), ("m", "Retired on the first of May", "https://server.io/d", ["server.io"]), ("m", "Retired, says nobody in particular", "https://server.io/d", []), ("n", "short", "https://docs.n8n.io/c", []), ("n", "Has no page of its own at all", "", [])]
    more = ("", "3.0", "", False, "", "", "")
    changes = spark.createDataFrame([(d, t, *more[:2], u, *more[2:3], p, *more[3:]) for d, t, u, p in rows], "dep_id string, title string, description string, version string, doc_url string, provider string, provider_domains array<string>, still_listed boolean, listed_url string, listed_quote string, listed_price string")
    claims, notes = evidence.declared(deps, changes)
    assert sorted((r["dep_id"], r["kind"], r["source_url"]) for r in claims.collect()) == [("m", "deprecation", "https://server.io/d"), ("n", "implementation", "https://docs.n8n.io/b")]
    assert sorted(map(tuple, notes.collect())) == [("m", "declared_change_unciteable:server.io"), ("n", "declared_change_unciteable:npmjs.com")]
    places = spark.createDataFrame([("n", "C", "u", 1, "n8n_workflow", "CODING_QUESTIONS", "q", "n8n_node")], "dep_id string, course string, unit_id string, session_no int, evidence_source string, object_type string, content_id string, kind string").drop("kind")
    probes = spark.createDataFrame([("n", "ok", ["breaking_change_declared"], "low")], "dep_id string, status string, signals array<string>, declared_severity string")
    found = score.findings(deps.withColumn("watch_tier", F.lit("critical")), places, probes, claims.filter("dep_id = 'n'"), notes=notes).collect()
    assert {u for r in found for u in r["evidence_urls"]} == {"https://docs.n8n.io/b"}
    assert [r["probe_signals"] for r in found if "breaking_change_declared" in r["probe_signals"]] == [["breaking_change_declared", "declared_change_unciteable:npmjs.com"]]
