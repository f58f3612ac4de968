"""What may be fetched, and how politely: addresses, robots files and delays, over snapshots of what was resolved and fetched."""

from __future__ import annotations

import urllib.robotparser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from tidemark.functions import constants as K


def _quad(a: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(a, r"\.")
    value = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    return F.when(a.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255), value)


def is_public(address: Column) -> Column:
    """Whether an address may be fetched from: not private, loopback, link-local, reserved or multicast. What can't be read isn't public."""
    a = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    v4 = _quad(a)
    within = F.lit(False)
    for first, bits in K.NOT_PUBLIC_V4:
        size = 1 << (32 - bits)
        low = int.from_bytes(bytes(int(x) for x in first.split(".")), "big")
        within = within | v4.between(low, low + size - 1)
    for one in K.PUBLIC_AMONG_V4:
        within = within & (a != one)
    # of IPv6 only 2000::/3 is given out; the first three groups tell the blocks in it that aren't
    group = lambda i: F.conv(F.coalesce(F.nullif(F.try_element_at(F.split(F.regexp_replace(a, "::.*$", ":0:0:0"), ":"), F.lit(i)), F.lit("")), F.lit("0")), 16, 10).cast("long")
    g1, g2, g3 = group(1), group(2), group(3)
    special = (g1 == 0x2001) & (g2 < 0x200) & ~(g2 == 3) & ~g2.between(0x20, 0x3F) & ~((g2 == 4) & (g3 == 0x112))
    v6 = g1.between(0x2000, 0x3FFF) & ~special & ~((g1 == 0x2001) & (g2 == 0xDB8)) & (g1 != 0x2002) & ~((g1 == 0x3FFF) & (g2 < 0x1000))
    return F.when(v4.isNotNull(), ~within).when(F.contains(a, F.lit(":")), F.coalesce(v6, F.lit(False))).otherwise(F.lit(False))


def safety(url: Column, addresses: Column) -> Column:
    """ok, bad_scheme, unresolvable (no addresses) or private (any address that isn't public)."""
    good = F.lower(F.coalesce(url, F.lit(""))).rlike("^https?://[^/?#]*[^/?#:@]")
    return F.when(~good, "bad_scheme").when(F.coalesce(F.size(addresses), F.lit(0)) < 1, "unresolvable").when(F.forall(addresses, is_public), "ok").otherwise("private")


def _parsers(bodies: pd.Series, statuses: pd.Series) -> list[urllib.robotparser.RobotFileParser]:
    """A parser a row, one a distinct file; a file that wasn't served, or is too long, restricts nothing."""
    seen: dict[str, urllib.robotparser.RobotFileParser] = {}
    out = []
    for body, status in zip(bodies, statuses, strict=True):
        text = body if status == 200 and body is not None and len(body) < K.ROBOTS_MOST_CHARS else ""
        if text not in seen:
            seen[text] = urllib.robotparser.RobotFileParser()
            seen[text].parse(text.splitlines())
        out.append(seen[text])
    return out


@F.pandas_udf(BooleanType())
def robots_allow(url: pd.Series, body: pd.Series, status: pd.Series, agent: pd.Series) -> pd.Series:
    """Whether a host's robots file lets an agent fetch a URL. Rules apply in file order within an agent's group, which is a parser's work."""
    return pd.Series([p.can_fetch(a, u or "") for p, u, a in zip(_parsers(body, status), url, agent, strict=True)], dtype="bool")


@F.pandas_udf(DoubleType())
def crawl_delay(body: pd.Series, status: pd.Series, agent: pd.Series) -> pd.Series:
    """Seconds that a robots file asks an agent, or else everyone, to wait between requests; null for none."""
    found = (p.crawl_delay(a) or p.crawl_delay("*") for p, a in zip(_parsers(body, status), agent, strict=True))
    return pd.Series([float(x) if x else None for x in found], dtype="float64")


def interval(delay: Column) -> Column:
    """Seconds between two requests to a host: its own delay, but a courtesy gap at least."""
    return F.greatest(F.lit(K.LEAST_INTERVAL_S), F.coalesce(delay, F.lit(0.0)))
