"""Fetching, costs, suites and agreement against plain Python."""

import ipaddress
import itertools
import random
import urllib.robotparser
from difflib import SequenceMatcher
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from tidemark.functions import net as N
from tidemark.operators import catalogue, measure


def python_public(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return False
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast)


def test_addresses_are_public_as_the_registry_says(spark):
    rng = random.Random(7)
    near = [f"{a}.{b}.{c}.{d}" for a, b, c in ((9, 255, 255), (10, 0, 0), (100, 64, 0), (127, 0, 0), (169, 254, 1), (172, 15, 255), (172, 16, 0), (172, 32, 0), (192, 0, 0), (192, 0, 2), (192, 168, 3), (198, 17, 255), (198, 18, 0), (198, 51, 100), (203, 0, 113), (223, 255, 255), (224, 0, 0), (255, 255, 255)) for d in (0, 9, 10, 255)]
    some = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    given = [str(ipaddress.IPv6Address((0x2000 << 112) | rng.getrandbits(125))) for _ in range(200)]
    six = ["::1", "::", "fe80::1", "fc00::1", "ff02::1", "2001:db8::1", "2001:4860:4860::8888", "2606:4700::1111", "2001:3::1", "2001:20::1", "2001:10::1", "2001:4:112::1", "2001:4:113::1", "2002::1", "3fff:1000::1", "2000::1"]
    odd = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", None]
    every = [*near, *some, *given, *six, *odd]
    got = [r["p"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(every)], "i int, a string").orderBy("i").select(N.is_public(F.col("a")).alias("p")).collect()]
    assert {a: g for a, g in zip(every, got)} == {a: python_public(a) if a else False for a in every}
    assert not spark.range(1).select(N.is_public(F.lit("3fff::1")).alias("p")).first()["p"]  # for documentation; not every Python knows that block


@pytest.mark.parametrize(("url", "addresses", "want"), [("https://a.io/x", ["8.8.8.8"], "ok"), ("https://a.io/x", ["8.8.8.8", "10.0.0.1"], "private"), ("https://a.io", [], "unresolvable"), ("https://a.io", None, "unresolvable"), ("ftp://a.io", ["8.8.8.8"], "bad_scheme"), ("https:///x", ["8.8.8.8"], "bad_scheme"), (None, ["8.8.8.8"], "bad_scheme"), ("https://a.io", ["?"], "private")])
def test_url_safety(spark, url, addresses, want):
    df = spark.createDataFrame([(url, addresses)], "u string, a array<string>")
    assert df.select(N.safety(F.col("u"), F.col("a")).alias("s")).first()["s"] == want


def test_robots_files(spark):
    body = "User-agent: tidemark\nCrawl-delay: 3\nDisallow: /private\n\nUser-agent: *\nAllow: /private/open\nDisallow: /private\n"
    cases = [(u, b, s, a) for u in ("https://a.io/", "https://a.io/private/x", "https://a.io/private/open", None) for b, s in ((body, 200), (body, 404), (None, None), ("User-agent: *\nDisallow: /" + " " * 500_000, 200)) for a in ("tidemark/1.0", "other")]

    def parser(b, s):
        p = urllib.robotparser.RobotFileParser()
        p.parse(b.splitlines() if s == 200 and b and len(b) < 500_000 else [])
        return p

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, u string, b string, s int, a string").orderBy("i")
    got = df.select(N.robots_allow("u", "b", "s", "a").alias("x"), N.crawl_delay("b", "s", "a").alias("d")).collect()
    assert [(r["x"], r["d"]) for r in got] == [(parser(b, s).can_fetch(a, u or ""), parser(b, s).crawl_delay(a)) for u, b, s, a in cases]


def test_costs_tolerate_a_vendor_prefix_and_say_so_when_unpriced(spark):
    prices = spark.createDataFrame([("alpha", 1.0, 5.0), ("v/beta", 2.0, 2.0)], "model string, usd_in double, usd_out double")
    replies = spark.createDataFrame([(i, m, 1000, 500) for i, m in enumerate(["alpha", " ALPHA ", "any/alpha", "v/beta", "beta", "w/v/beta", None, ""])], "i int, model string, tokens_in long, tokens_out long")
    got = [(r["cost_basis"], r["cost_usd"]) for r in measure.costed(replies, prices).orderBy("i").collect()]
    paid, flat = ("estimated", (1000 * 1.0 + 500 * 5.0) / 1e6), ("estimated", 1500 * 2.0 / 1e6)
    assert got == [paid, paid, paid, flat, ("unpriced", 0.0), flat, ("unpriced", 0.0), ("unpriced", 0.0)]
    assert measure.costed(replies.limit(0), prices).count() == 0


def test_a_providers_repeats_are_compared_in_pairs(spark):
    rng = random.Random(2)
    rows = [(f"p{p}", c, r, " ".join(rng.choices("abcdefg", k=12)) if (c + r) % 5 else None) for p in range(2) for c in range(4) for r in range(4)]
    want = {}
    for p in ("p0", "p1"):
        ratios = [round(SequenceMatcher(None, a[3], b[3]).ratio(), 3) for c in range(4) for a, b in itertools.combinations([x for x in rows if x[:2] == (p, c) and x[3]], 2)]
        want[p] = (len(ratios), round(fmean(ratios), 3))
    got = measure.self_similarity(spark.createDataFrame(rows, "provider string, case long, repeat long, said string"))
    assert {r["provider"]: (r["pairs"], r["mean_self_similarity"]) for r in got.collect()} == want


def test_suites_without_cases_pass_and_others_need_their_share(spark):
    cases = spark.createDataFrame([("trust", True), ("trust", False), ("own", True), ("own", None)], "suite string, ok boolean")
    got = {r["suite"]: (r["cases"], r["passed"], r["rate"], r["met"]) for r in measure.suite_rates(cases, spark.createDataFrame([("trust",), ("own",), ("findings",)], "suite string")).collect()}
    assert got == {"trust": (2, 1, 0.5, False), "own": (2, 1, 0.5, False), "findings": (0, 0, 1.0, True)}


def test_hosts_are_fetched_at_their_own_pace(spark):
    targets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3), ("b", 2), ("c", 9)], "host string, ord int")
    out = measure.spaced(targets, spark.createDataFrame([("b", 4.0), ("c", 0.5)], "host string, delay double"), F.col("ord"))
    assert {(r["host"], r["ord"]): r["at_s"] for r in out.collect()} == {("a", 1): 0.0, ("a", 2): 1.5, ("a", 3): 3.0, ("b", 1): 0.0, ("b", 2): 4.0, ("c", 9): 0.0}


def test_tables_with_several_ids_statuses_and_short_rows(spark):
    page = """<table><tr><th>Model</th><th>Endpoint</th><th>Lifecycle</th></tr><tr><td>A 1 (Shut down)</td><td><code>a-1</code> <code>a-1b</code></td><td></td></tr>
      <tr><td>B 2 (Preview)</td></tr><tr><td></td><td></td><td>live</td></tr><tr><td>see c/d-2 and e.f-3</td><td></td><td>Shutdown</td></tr></table>
      <table><tr><th>Legacy model</th><th>Use instead</th></tr><tr><td>old-1</td><td>new-2 or new-3, x / newer-4</td></tr></table><table><tr><th>Colour</th></tr><tr><td>red</td></tr></table>"""
    got = catalogue.parsed(spark.createDataFrame([("v", "u", page), ("v", "none", None), ("v", "empty", "")], "vendor string, url string, html string")).orderBy("ord", "nth")
    assert [(r["entry_id"], r["column_role"], r["status"], r["replacements"]) for r in got.collect()] == [
        ("a-1", "id", "shut down", []), ("a-1b", "id", "shut down", []), ("B 2", "id", "preview", []), ("c/d-2", "id", "shut down", []), ("e.f-3", "id", "shut down", []),
        ("old-1", "id", "deprecated", ["new-2", "new-3", "newer-4"]), ("new-2", "replacement", "available", []), ("new-3", "replacement", "available", []), ("newer-4", "replacement", "available", []),
    ]
