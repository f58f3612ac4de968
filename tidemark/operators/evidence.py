"""Evidence: official pages to sentences to claims, the gate that a claim must pass, and the ladder that a candidate must climb.

Pages come from a ``fetches`` snapshot (url, status, final_url, error, body) and hosts from a ``dns`` snapshot (domain, safety), so every
step can be run again. A candidate that isn't in the snapshot doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import constants as K
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import catalogue, trust
from tidemark.sources.stages import staged

MOST_PAGES, MOST_ATTEMPTS, MOST_QUOTES, SHORTEST_QUOTE = 3, 9, 2, 12
#: Claims about interfaces, versions and ends concern one of several things on a page, so they must name it.
ABOUT_MANY = ("deprecation", "version", "implementation")


def gated(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims that may exist, with tier and substantiates, and the rest with a reason.

    candidates(dep_id, kind, statement, source_url, quote, own_domains).
    """
    rows = candidates.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("statement", "source_url", "quote")})
    rows = rows.withColumn("tier", trust.tier(F.col("source_url"), F.col("own_domains"), F.col("kind")))
    reason = (
        F.when(F.col("statement") == "", "empty statement").when(F.col("source_url") == "", "no source")
        .when(F.length("quote") < SHORTEST_QUOTE, "quote too short to verify").when(F.col("tier") == "EXCLUDED", "excluded source")
    )
    rows = rows.withColumn("reason", reason)
    fine = rows.filter("reason IS NULL").drop("reason").withColumn("substantiates", trust.substantiates(F.col("tier"), F.col("kind")))
    return fine, rows.filter("reason IS NOT NULL").select("dep_id", "kind", "source_url", "reason")


def statement(kind: Column, name: Column, quote: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.CLAIM_ENDINGS.items() for x in kv])
    return F.concat(name, F.coalesce(F.try_element_at(known, kind), F.concat(F.lit(": "), F.substring(quote, 1, 80))))


def read_pages(subjects: DataFrame, kinds: list[str], fetches: DataFrame) -> DataFrame:
    """dep_id, kind, ord, url, text of the pages that are read for each kind: the first three that can be, of the first nine tried.

    The live reader stops as soon as it has enough; over a snapshot that is a rank among the targets.
    subjects(dep_id, name, aliases, subject struct as in trust.official_targets).
    """
    asked = subjects.withColumn("kind", F.explode(T.strings(kinds))).select("dep_id", "kind", F.posexplode(trust.official_targets(F.col("kind"), F.col("subject"))).alias("ord", "url"))
    pages = fetches.filter("status BETWEEN 200 AND 299 AND body IS NOT NULL").select("url", T.main_text(F.col("body")).alias("text"))
    tried = asked.filter(F.col("ord") < MOST_ATTEMPTS).join(pages, "url").filter("text <> ''")
    nth = F.row_number().over(W.partitionBy("dep_id", "kind").orderBy("ord"))
    return tried.withColumn("nth", nth).filter(F.col("nth") <= MOST_PAGES).drop("nth")


def lifted(pages: DataFrame, subjects: DataFrame, kinds: list[str]) -> DataFrame:
    """Candidates for the gate: sentences of pages(dep_id, kind, url, text) that are about a kind and, where a page could be about more, the subject."""
    pages = pages.join(subjects, "dep_id")
    terms = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    own_site = F.exists(terms, lambda t: T.site_is_product(t, U.registrable(U.host(F.col("url")))))
    must_name = F.col("kind").isin(*ABOUT_MANY) | ~own_site
    found = T.sentences(F.col("text"))
    quotes = None
    for kind in kinds:
        one = T.relevant(found, K.CLAIM_WORDS.get(kind, ()), terms, must_name)
        quotes = (F if quotes is None else quotes).when(F.col("kind") == kind, one)
    rows = pages.select("dep_id", "kind", "name", "url", F.col("subject.official_domains").alias("own_domains"), F.explode(F.slice(quotes, 1, MOST_QUOTES)).alias("quote"))
    return rows.select("dep_id", "kind", statement(F.col("kind"), F.col("name"), F.col("quote")).alias("statement"), F.col("url").alias("source_url"), "quote", "own_domains")


def gathered(subjects: DataFrame, kinds: list[str], fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims lifted from subjects' own pages, and what the gate refused."""
    return gated(lifted(read_pages(subjects, kinds, fetches), subjects, kinds))


def table_claims(pages: DataFrame, subjects: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims from rows of tables that list a subject under exactly one of its ids, case aside, and what the gate refused.

    Vendors often state a retirement in a table alone. What a row carries gives its kind: a retired status is a deprecation, a price or a
    rate limit is pricing, any other listing is availability. A longer id that holds a subject's is another thing.
    pages(dep_id, url, html); subjects as for ``read_pages``. The gate's columns, with the row's place (ord, nth).
    """
    listed = catalogue.parsed(pages.select(F.col("dep_id").alias("vendor"), "url", "html")).withColumnRenamed("vendor", "dep_id")
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.lower(n)))
    ids = subjects.select("dep_id", "name", F.col("subject.official_domains").alias("own_domains"), F.explode(F.filter(names, lambda n: n != "")).alias("id"))
    rows = listed.withColumn("id", F.lower("entry_id")).join(ids, ["dep_id", "id"])
    retired, priced = F.col("status").isin(*K.RETIRED), (F.col("price") != "") | (F.col("rate_limit") != "")
    rows = rows.withColumn("kind", F.when(retired, "deprecation").when(priced, "pricing").otherwise("availability")).filter(F.col("kind").isin(*kinds))
    said = F.when(retired | ~priced, F.concat(F.lit(" is listed as "), "status")).otherwise(" appears in a table with plan or quota columns")
    ends = F.when(F.col("date") != "", F.concat(F.lit(", shutdown "), "date")).otherwise("")
    told = F.concat("name", said, F.lit(" in a table on the vendor's own page"), ends)
    read = staged(rows.select("dep_id", "kind", told.alias("statement"), F.col("url").alias("source_url"), "quote", "own_domains", "ord", "nth"))  # pages are read once for both results
    return gated(read)


def merged_claims(tabled: DataFrame, prose: DataFrame) -> DataFrame:
    """Substantiating claims of both readers, one for each subject, URL, kind and first 80 characters of the quote: a table's before prose."""
    place = lambda df, rank: df.filter("substantiates").withColumn("place", F.struct(F.lit(rank).alias("reader"), *([F.col("ord"), F.col("nth")] if rank == 0 else [F.lit(0).alias("ord"), F.lit(0).alias("nth")]), F.col("quote")))
    names = ["statement", "quote", "tier"]
    keys = ["dep_id", "kind", "source_url"]
    both = place(tabled, 0).select(*keys, *names, "place").unionByName(place(prose, 1).select(*keys, *names, "place"))
    one = both.groupBy(*keys, F.substring("quote", 1, 80).alias("start")).agg(F.min_by(F.struct(*names, "place"), "place").alias("c"))
    return one.select(*keys, *[F.col(f"c.{n}").alias(n) for n in names], F.when(F.col("c.place.reader") == 0, "table").otherwise("prose").alias("reader"))


def declared(dependencies: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims that vendors' declared changes make, and notes on those that can't be cited.

    A change with a page and a text of its own is a claim: of a model a deprecation, else of how something is implemented. For a model, a
    provider whose own catalogue named it speaks too (``trust.with_provider``). A claim that can't settle its kind isn't attached: the note
    ``declared_change_unciteable:<domain>`` stands for it. A vendor that still lists what it retires is quoted for that as well.

    dependencies(dep_id, kind, canonical_name, official_domains); changes(dep_id, title, description, version, doc_url, provider,
    provider_domains, still_listed, listed_url, listed_quote, listed_price). Claims as ``gated`` gives them; notes (dep_id, note).
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = changes.join(dependencies.select("dep_id", F.col("kind").alias("of_kind"), "canonical_name", "official_domains"), "dep_id")
    rows = rows.withColumn("own_domains", trust.with_provider(F.col("official_domains"), F.col("provider_domains"), F.col("of_kind")))
    model = F.col("of_kind") == "model"
    quote = F.array_join(F.filter(F.array(text(F.col("title")), text(F.col("description"))), lambda x: x != ""), " ")
    said = F.when(model, text(F.col("title"))).otherwise(F.concat(F.lit("n8n declares: "), text(F.col("title")), F.lit(" (n8n "), text(F.col("version")), F.lit(")")))
    change = F.struct(F.when(model, "deprecation").otherwise("implementation").alias("kind"), said.alias("statement"), text(F.col("doc_url")).alias("source_url"), quote.alias("quote"), F.lit(True).alias("strict"))
    listed = F.concat("canonical_name", F.lit(" is still listed by "), F.coalesce(F.nullif("provider", F.lit("")), F.lit("the provider")), F.lit(" at "), F.coalesce(F.nullif("listed_price", F.lit("")), F.lit("quote-only")), F.lit(" pricing"))
    sighting = F.struct(F.lit("pricing").alias("kind"), listed.alias("statement"), text(F.col("listed_url")).alias("source_url"), text(F.col("listed_quote")).alias("quote"), F.lit(False).alias("strict"))
    both = F.array(change, F.when(F.coalesce("still_listed", F.lit(False)) & (text(F.col("listed_url")) != ""), sighting))
    each = rows.select("dep_id", "own_domains", F.explode(F.array_compact(both)).alias("c")).select("dep_id", "own_domains", "c.*").filter((F.col("source_url") != "") & (F.length("quote") >= SHORTEST_QUOTE))
    claims = staged(gated(each)[0])  # the gate is the work; claims and notes both start from what it wrote
    loose = claims.filter(F.col("strict") & ~F.col("substantiates"))
    notes = loose.select("dep_id", F.concat(F.lit("declared_change_unciteable:"), U.host(F.col("source_url"))).alias("note")).distinct()
    return claims.filter(~F.col("strict") | F.col("substantiates")).drop("strict"), notes


def successor_leads(pages: DataFrame) -> DataFrame:
    """dep_id, url, successor, quote: names that a deprecation notice, or the sentence after it, puts forward.

    pages(dep_id, url, text, terms). The next sentence is read before the prose filter, which would drop the shortest notices.
    """
    raw = pages.select("dep_id", "url", "terms", F.posexplode(T.raw_sentences(F.col("text"))).alias("i", "s"))
    w = W.partitionBy("dep_id", "url").orderBy("i")
    rows = raw.withColumn("after", F.coalesce(F.lead("s").over(w), F.lit("")))
    named = F.filter(F.transform("terms", lambda t: F.lower(t)), lambda t: F.length(t) > 2)
    notice = T.is_prose(F.col("s")) & (F.length("s") >= 20) & F.exists(T.strings(K.SUNSET_STRONG), lambda p: F.contains(F.lower(F.col("s")), p)) & F.exists(named, lambda t: F.contains(F.lower(F.col("s")), t))
    after = F.when(F.length("after") >= 20, F.col("after")).otherwise(F.lit(""))
    own = F.transform(T.successors(F.col("s"), F.col("terms")), lambda n: F.struct(n.alias("successor"), F.substring("s", 1, 300).alias("quote")))
    nexts = F.transform(T.successors(after, F.col("terms")), lambda n: F.struct(n.alias("successor"), F.substring(F.concat_ws(" ", "s", "after"), 1, 300).alias("quote")))
    leads = rows.filter(notice).select("dep_id", "url", "i", F.explode(F.concat(own, nexts)).alias("l")).select("dep_id", "url", "i", "l.*")
    nth = F.row_number().over(W.partitionBy("dep_id", F.lower("successor")).orderBy("url", "i"))
    return leads.withColumn("nth", nth).filter("nth = 1").select("dep_id", "url", "successor", "quote")


_HOST = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"


def adjudicated(nominations: DataFrame, dns: DataFrame, fetches: DataFrame, hops: int = 2) -> DataFrame:
    """nominations with verdict and final domain: shape, then name, then DNS, then the page itself, each rung only for what passed the last.

    nominations(nom_id, name, domain, source, own_domains), fetches keyed by domain here: (domain, status, final_domain, error, text).
    At most two redirects to another host are followed, so they are two joins.
    """
    name, dom = F.trim(F.coalesce("name", F.lit(""))), F.lower(F.trim(F.coalesce("domain", F.lit(""))))
    rows = nominations.withColumns({"name": name, "domain": dom})
    own = F.exists("own_domains", lambda o: (F.col("domain") == o) | F.col("domain").endswith(F.concat(F.lit("."), o)))
    shape = (
        F.when((F.col("name") == "") | (F.length("name") > 60), "rejected_malformed_domain").when(F.lower("name").isin(*K.GENERIC), "rejected_generic_token")
        .when((F.col("domain") != "") & ~F.col("domain").rlike(_HOST), "rejected_malformed_domain")
        .when((F.col("domain") != "") & (trust.tier(F.concat(F.lit("https://"), F.col("domain")), F.lit(None).cast("array<string>"), F.lit(None).cast("string")) == "EXCLUDED"), "rejected_excluded")
        .when((F.col("domain") != "") & own, "rejected_same_vendor").when((F.col("domain") == "") & (F.col("source") == "vendor_named"), "vendor_named").when(F.col("domain") == "", "unresolved_name_only")
    )
    rows = rows.withColumn("verdict", shape).join(dns.select(F.col("domain").alias("d"), "safety"), F.col("domain") == F.col("d"), "left").drop("d")
    safe = F.coalesce("safety", F.lit("unresolvable"))
    rows = rows.withColumn("verdict", F.coalesce("verdict", F.when(safe == "unresolvable", "refuted_no_such_domain").when(safe != "ok", "rejected_excluded"))).withColumn("at", F.col("domain"))
    page = fetches.select(F.col("domain").alias("p"), F.col("status").alias("p_status"), F.col("final_domain").alias("p_final"), F.col("text").alias("p_text"))
    for hop in range(hops + 1):
        rows = rows.drop("p", "p_status", "p_final", "p_text").join(page, F.col("at") == F.col("p"), "left")
        moved = (F.coalesce("p_final", F.lit("")) != "") & (F.col("p_final") != F.col("at")) & (F.col("p_final") != F.col("domain"))
        if hop < hops:
            rows = rows.withColumn("at", F.when(F.col("verdict").isNull() & moved & ~F.coalesce(F.col("p_status").isin(404, 410), F.lit(False)), F.col("p_final")).otherwise(F.col("at")))
    gone, blocked = F.coalesce(F.col("p_status").isin(404, 410), F.lit(False)), F.coalesce(F.col("p_status").isin(401, 403, 429, 451), F.lit(False))
    said = T.sentences(F.col("p_text"))
    words = (*K.CLAIM_WORDS["pricing"], *K.CLAIM_WORDS["availability"])
    checkable = F.size(F.filter(said, lambda s: F.exists(T.strings(words), lambda k: F.contains(F.lower(s), k)))) > 0
    page_verdict = F.when(gone, "refuted_dead").when(blocked | F.col("p_status").isNull() | (F.col("p_status") >= 500), "unverifiable_blocked").when(checkable, "verified").otherwise("refuted_no_evidence")
    return rows.withColumn("verdict", F.coalesce("verdict", page_verdict)).select("nom_id", "name", "at", "verdict")


def discovered(hits: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """domain, n, first of open search hits(ord, url): candidates by how often they are cited; excluded sources never surface."""
    none = F.lit(None).cast("array<string>")
    rows = hits.withColumn("tier", trust.tier(F.col("url"), none, F.lit(None).cast("string"))).filter("tier <> 'EXCLUDED'")
    rows = rows.groupBy("url").agg(F.min("ord").alias("ord")).withColumn("domain", U.registrable(U.host(F.col("url")))).filter("domain <> ''")
    rows = rows.filter(~F.col("domain").isin(*exclude)) if exclude else rows
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.col("n").desc(), "first")


def parsed_nominations(replies: DataFrame, most: int = 3) -> DataFrame:
    """prompt_sha, place, name, domain of models' replies: at most three of the first twenty rows, rejected rather than repaired."""
    rows = replies.select("prompt_sha", F.posexplode(F.coalesce(F.try_variant_get(T.json_reply(F.col("text")), "$.nominations", "array<variant>"), F.array().cast("array<variant>"))).alias("place", "v")).filter("place < 20")
    name = F.trim(F.coalesce(F.try_variant_get("v", "$.name", "string"), F.lit("")))
    domain = F.lower(F.trim(F.coalesce(F.try_variant_get("v", "$.candidate_domain", "string"), F.lit(""))))
    rows = rows.select("prompt_sha", "place", name.alias("name"), F.when(domain.rlike(_HOST), domain).otherwise("").alias("domain")).filter("length(name) BETWEEN 2 AND 40 AND NOT contains(name, '/')")
    first = F.row_number().over(W.partitionBy("prompt_sha", F.lower("name")).orderBy("place"))
    rows = rows.withColumn("first", first).filter("first = 1").drop("first")
    nth = F.row_number().over(W.partitionBy("prompt_sha").orderBy("place"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def judged_rewrites(rewrites: DataFrame) -> DataFrame:
    """finding_id, outcome: a rewrite must have all three parts and name no URL that isn't among the evidence. rewrites(finding_id, reply, allowed array)."""
    v = T.json_reply(F.col("reply"))
    parts = [F.trim(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))) for k in ("what_to_act", "why_to_act", "when_to_act")]
    urls = F.regexp_extract_all(F.concat_ws(" ", *parts), F.lit(r"(https?://[^\s,)\]]+)"), 1)
    known = F.array_join("allowed", " ")
    honest = F.forall(urls, lambda u: F.contains(known, F.rtrim(u, F.lit("/.,);"))))
    empty = (parts[0] == "") | (parts[1] == "") | (parts[2] == "")
    return rewrites.select("finding_id", F.when(v.isNull(), "not json").when(empty, "missing part").when(~honest, "invented source").otherwise("accepted").alias("outcome"))


def tallied(judged: DataFrame, examples: int = 6) -> DataFrame:
    """outcome, n, names: nominations by what became of them (established, refuted, rejected, open), with a few names each."""
    verdict = F.col("verdict")
    outcome = F.when(verdict.isin("verified", "vendor_named"), "established").when(verdict.startswith("refuted"), "refuted").when(verdict.startswith("rejected"), "rejected").otherwise("open")
    return judged.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, examples).alias("names"))
