"""URL, host and link expressions. All are built-in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K

_AUTHORITY = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_SUFFIXES = "|".join(re.escape(s) for s in K.MULTI_SUFFIXES)
MEDIA = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp|tiff?|mp4|mp3|wav|pdf|zip|csv|ipynb|srt|vtt)$"
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp)(\?|$)"
#: syntax: pattern whose first group is the raw target, strongest first
LINK_PATTERNS = {
    "a_href": r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]+"|'[^']+'|[^\s>"']+)""",
    "iframe": r"""(?i)<iframe\s[^>]*?src\s*=\s*("[^"]+"|'[^']+')""",
    "markdown": r"""!?\[[^\]]*\]\(\s*<?([^)\s>]+)>?\s*(?:"[^"]*")?\s*\)""",
    "img": r"""(?i)<img\s[^>]*?src\s*=\s*("[^"]+"|'[^']+')""",
    "bare": r"""(?<![\w"'=(])(https?://[^\s\)\]\}'"<>\\`|]+)""",
}


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; empty for anything that has none."""
    authority = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":.*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def registrable(name: Column) -> Column:
    """The part of a host that tells who owns it: two labels, or three under a shared suffix. Addresses stay as they are."""
    h = F.btrim(F.lower(F.coalesce(name, F.lit(""))), F.lit("."))
    shared = F.regexp_extract(h, rf"(?:^|\.)([^.]+\.(?:{_SUFFIXES}))$", 1)
    return F.when(h.rlike(r"^[0-9.]*$"), h).when(shared != "", shared).when(h.isin(*K.MULTI_SUFFIXES), h).otherwise(F.substring_index(h, ".", -2))


def normalised(url: Column) -> Column:
    """http(s) URLs without swept-up punctuation and fragment; empty for the rest."""
    text = F.rtrim(F.trim(F.coalesce(url, F.lit(""))), F.lit(K.URL_TRAIL))
    return F.when(text.rlike("^(?i)https?:"), F.regexp_replace(F.regexp_replace(text, "#.*$", ""), r"\?$", "")).otherwise("")


def suffixes(name: Column) -> Column:
    """A host and all domains above it: [a.b.c, b.c, c]. An equi-join or an overlap on these replaces a suffix comparison."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def within(name: Column, domains: Column | list[str] | tuple[str, ...]) -> Column:
    """Whether a host is one of these domains or below one."""
    listed = domains if isinstance(domains, Column) else F.array(*[F.lit(d) for d in domains])
    return F.coalesce(F.arrays_overlap(suffixes(name), listed), F.lit(False))


def first_each(items: Column, key) -> Column:
    """Items of an array whose key didn't come before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def _found(text: Column, syntax: str) -> Column:
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK_PATTERNS[syntax]), 1)
    return F.transform(raw, lambda r: F.struct(normalised(F.regexp_replace(r, "^[\"']|[\"']$", "")).alias("url"), F.lit(syntax).alias("syntax")))


def links(text: Column, internal: tuple[str, ...] = ()) -> Column:
    """Array of (url, syntax): external links that aren't media, each URL once, under its strongest syntax."""
    found = F.concat(*[_found(text, s) for s in LINK_PATTERNS])
    path = lambda u: F.regexp_replace(u, r"\?.*$", "")
    kept = F.filter(found, lambda x: (x["url"] != "") & ~path(x["url"]).rlike(MEDIA) & ~(within(host(x["url"]), internal) if internal else F.lit(False)))
    return F.when(F.contains(text, F.lit("http")), first_each(kept, lambda x: x["url"])).otherwise(F.filter(found, lambda x: F.lit(False)))


def images(text: Column) -> Column:
    """Distinct image URLs from markdown and img tags."""
    urls = F.concat(*[F.transform(_found(text, s), lambda x: x["url"]) for s in ("markdown", "img")])
    return F.array_distinct(F.filter(urls, lambda u: u.rlike(IMAGE)))


def service_name(domain: Column) -> Column:
    """A display name for a registrable domain: a known one, or its stem with capitals."""
    known = F.create_map(*[F.lit(x) for kv in K.SERVICE_NAMES.items() for x in kv])
    words = F.split(F.trim(F.replace(F.regexp_replace(domain, r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))), " +")
    made = F.array_join(F.transform(words, lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))).otherwise(w)), " ")
    return F.coalesce(F.try_element_at(known, domain), made)


def is_citation(url: Column) -> Column:
    """A link to read, not a thing to watch: news, references, schools and governments, placeholders, pages of hosted docs."""
    d = host(url)
    reg = registrable(d)
    listed = [*K.EXCLUDED, *K.CORROBORATING, *K.LEAD_ONLY, *K.NEWS]
    placeholder = r"(?i)((^|\.)(your|my|example|sample|test|placeholder|yourapp|myapp|company)[-.]|^(your|my)[\w-]*\.)"
    docs = F.lit(False)
    for h in K.DOCS_HOSTS:
        docs = docs | d.endswith(h) | (reg == h)
    return (d == "") | reg.isin(*listed) | d.isin(*listed) | d.rlike(r"\.(edu|gov|gov\.in|ac\.in)$") | d.rlike(placeholder) | docs
