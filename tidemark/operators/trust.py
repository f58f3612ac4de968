"""Source authority: which tier a URL has for a claim of a kind about a subject, and what a tier may settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import urls as U
from tidemark.functions.text import strings


def is_forum(url: Column) -> Column:
    """A forum or question page, even on a vendor's own host."""
    h, low = U.host(url), F.lower(F.coalesce(url, F.lit("")))
    return F.exists(strings(K.FORUM_HOSTS), lambda p: h.startswith(p)) | F.exists(strings(K.FORUM_PATHS), lambda p: F.contains(low, p))


def tier(url: Column, own_domains: Column, kind: Column) -> Column:
    """One ordered cascade: the first rule that holds decides. own_domains: array of the subject's domains, null for no subject."""
    h = U.host(url)
    above = U.suffixes(h)
    under = lambda domains: F.arrays_overlap(above, strings(domains))
    low = F.lower(F.coalesce(url, F.lit("")))
    hinted = F.exists(strings(K.EXCLUDED_HINTS), lambda x: F.contains(low, x))
    own = F.coalesce(F.arrays_overlap(above, F.transform(own_domains, lambda d: F.lower(d))), F.lit(False))
    out = F.when(h == "", "EXCLUDED").when(under(K.EXCLUDED) | hinted, "EXCLUDED").when(is_forum(url), "LEAD_ONLY").when(own, "AUTHORITATIVE")
    for registry, kinds in K.REGISTRY_KINDS.items():
        settles = kind.isNull() | kind.isin(*kinds)
        out = out.when(under([registry]) & settles, "AUTHORITATIVE").when(under([registry]), "CORROBORATING")
    return out.when(under(K.LEAD_ONLY), "LEAD_ONLY").when(under(K.CORROBORATING), "CORROBORATING").otherwise("LEAD_ONLY")


def substantiates(tier_: Column, kind: Column) -> Column:
    return F.when(kind.isin(*K.STRICT_KINDS), tier_ == "AUTHORITATIVE").otherwise(tier_.isin("AUTHORITATIVE", "CORROBORATING"))


def official_domains(domains: Column, urls: list[Column]) -> Column:
    """A subject's domains and the hosts of its own URLs, sorted."""
    hosts = F.array(*[U.host(u) for u in urls])
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(domains, F.array().cast("array<string>")), hosts), lambda d: d != "")))


def with_provider(domains: Column, provider: Column, kind: Column) -> Column:
    """A model's serving provider speaks for it too; for other kinds owner and server are one."""
    extra = F.filter(F.transform(F.coalesce(provider, F.array().cast("array<string>")), lambda d: F.lower(F.trim(d))), lambda d: d != "")
    return F.when((kind == "model") & (F.size(extra) > 0), F.array_sort(F.array_union(domains, extra))).otherwise(domains)


def official_targets(kind: Column, subject: Column) -> Column:
    """Ordered distinct URLs to read for a claim: the explicit one, well-known paths on each domain, then docs and home page.

    subject: a struct of official_domains, docs_url, homepage, changelog_url, pricing_url, status_url.
    """
    url = lambda name: F.coalesce(subject[name], F.lit(""))
    explicit = (
        F.when(kind.isin("version", "deprecation"), url("changelog_url")).when(kind == "pricing", url("pricing_url"))
        .when(kind == "existence", F.when(url("status_url") != "", url("status_url")).otherwise(url("homepage")))
        .when(kind == "implementation", url("docs_url")).when(kind.isin("availability", "alternative"), url("homepage")).otherwise("")
    )
    paths = F.when(kind == "version", strings(K.WELL_KNOWN["changelog"])).when(kind == "deprecation", strings(K.WELL_KNOWN["deprecation"])).when(kind == "pricing", strings(K.WELL_KNOWN["pricing"])).when(kind == "existence", strings(K.WELL_KNOWN["status"])).otherwise(F.array().cast("array<string>"))
    guessed = F.flatten(F.transform(subject["official_domains"], lambda d: F.transform(paths, lambda p: F.concat(F.lit("https://"), d, p))))
    return F.filter(F.array_distinct(F.concat(F.array(explicit), guessed, F.array(url("docs_url"), url("homepage")))), lambda u: u != "")


def classified(rows: DataFrame, url: str = "url", domains: str = "own_domains", kind: str = "kind") -> DataFrame:
    """rows with tier, tier_rank and substantiates."""
    out = rows.withColumn("tier", tier(F.col(url), F.col(domains), F.col(kind)))
    return out.withColumn("tier_rank", (F.array_position(strings(K.TIERS), F.col("tier")) - 1).cast("int")).withColumn("substantiates", substantiates(F.col("tier"), F.col(kind)))


def host_suffix_join(rows: DataFrame, domains: DataFrame, host_col: str = "host", domain_col: str = "domain") -> DataFrame:
    """Rows joined to the longest listed domain that their host is or lies below.

    Hosts are exploded into their suffixes, so the join is an equi-join on the suffix and not a comparison of all pairs.
    """
    hosts = rows.select(host_col).distinct()
    matched = hosts.select(host_col, F.explode(U.suffixes(F.col(host_col))).alias(domain_col)).join(domains, domain_col)
    best = matched.groupBy(host_col).agg(F.max_by(F.struct(*domains.columns), F.length(domain_col)).alias("__best"))
    joined = rows.join(best.withColumnRenamed(host_col, "__host"), rows[host_col].eqNullSafe(F.col("__host")), "left")
    return joined.select(*[rows[c] for c in rows.columns], *[F.col("__best")[c].alias(c) for c in domains.columns])
