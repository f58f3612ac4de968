"""Text expressions: keys, slugs, phrases, sentences, page text. Built-in functions but for what HTML needs."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tidemark.functions import constants as K


def norm(name: Column) -> Column:
    """Alias key: lower case, everything but word characters, + and # and . folded to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w+#.]+", " "), r"\s+", " "))


def slug(title: Column) -> Column:
    out = F.btrim(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", F.lit("unknown")).otherwise(out)


def workbook_stem(name: Column) -> Column:
    """A workbook's name without its usual words, extension and punctuation."""
    low = F.lower(name)
    for word in ("course contents", "contents", ".xlsx"):
        low = F.replace(low, F.lit(word), F.lit(""))
    return F.regexp_replace(low, "[^a-z0-9]", "")


def header(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " ")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a text holds, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(strings(phrases), lambda p: F.contains(low, p))


def places(text: Column, part: Column) -> Column:
    """All places (from 1) where a part starts in a text, overlapping ones left out as in a left-to-right search."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * F.length(part) + 1)
    return F.when((F.size(pieces) > 1) & (F.length(part) > 0), ends).otherwise(F.array().cast("array<int>"))


def hits_near(text: Column, phrases: tuple[str, ...], terms: Column, near: int = K.NEAR_CHARS) -> Column:
    """The phrases that start within ``near`` characters of the start of one of the subject's terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spots = F.flatten(F.transform(F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: places(low, F.lower(t))))
    return F.filter(strings(phrases), lambda p: F.exists(places(low, p), lambda x: F.exists(spots, lambda s: F.abs(x - s) <= near)))


def raw_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def is_prose(s: Column) -> Column:
    """Whether a piece of page text reads as a sentence: no data, no title, no question, enough words, few capitals."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")))
    return (
        ~s.rlike(K.MACHINE_PATTERN) & ~s.rlike(K.TITLE_PATTERN) & ((F.length(s) >= 90) | s.rlike(r"""[.!?]["')\]]?$""")) & ~s.endswith("?")
        & (F.regexp_count(s, F.lit(r"[A-Za-z][a-z']+")) >= 5) & (capitals / F.greatest(F.size(words), F.lit(1)) <= 0.45)
        & s.rlike(r"[a-z]{3}[ ,][a-z]{2}")
    )


def prose_of(pieces: Column, least: int = 20) -> Column:
    return F.filter(pieces, lambda s: (F.length(s) >= least) & is_prose(s))


def sentences(text: Column, least: int = 20) -> Column:
    return prose_of(raw_sentences(text), least)


def relevant(found: Column, keywords: tuple[str, ...], terms: Column, require_subject: Column, most: int = 300) -> Column:
    """Sentences on a topic and, where a page could be about several things, on the subject."""
    named = F.filter(F.transform(terms, lambda t: F.lower(t)), lambda t: F.length(t) > 2)
    on_topic = lambda s: F.exists(strings(keywords), lambda k: F.contains(F.lower(s), k))
    on_subject = lambda s: ~require_subject | (F.size(named) == 0) | F.exists(named, lambda t: F.contains(F.lower(s), t))
    return F.transform(F.filter(found, lambda s: on_topic(s) & on_subject(s)), lambda s: F.substring(s, 1, most))


def successors(sentence: Column, own_names: Column) -> Column:
    """Names that a deprecation notice puts forward, without generic nouns and the subject's own names."""
    found = F.transform(F.regexp_extract_all(sentence, F.lit(K.SUCCESSOR_PATTERN), 1), lambda n: F.rtrim(F.trim(n), F.lit(".,;:!?)")))
    low = F.transform(own_names, lambda t: F.lower(t))
    generic = strings(K.GENERIC)
    fine = lambda n: ~F.array_contains(generic, F.replace(F.lower(n), F.lit(" "), F.lit(""))) & ~F.exists(low, lambda t: F.contains(t, F.lower(n)) | F.contains(F.lower(n), t))
    return F.array_distinct(F.filter(found, fine))


def site_is_product(name: Column, registrable_domain: Column) -> Column:
    """Whether a whole site is about one thing: one of name and domain stem starts with the other."""
    stem = F.replace(F.substring_index(registrable_domain, ".", 1), F.lit("-"), F.lit(""))
    flat = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    return (stem != "") & (flat != "") & (flat.startswith(stem) | stem.startswith(flat))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML character references resolved; there is no built-in for it."""
    return text.map(html.unescape, na_action="ignore")


def main_text(page: Column) -> Column:
    """Visible prose of a page: chrome dropped, block ends as line ends, tags stripped, references resolved, white space collapsed."""
    body = F.regexp_replace(F.coalesce(page, F.lit("")), K.CHROME_PATTERN, "\n")
    body = F.regexp_replace(body, K.BLOCK_END_PATTERN, "\n")
    body = unescaped(F.regexp_replace(body, "<[^>]+>", " "))
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_title(page: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 160)


def tool_cell(cell: Column) -> Column:
    """Array of (name, version, qualifier) from a cell of tools: lines and commas, ``@version``, trailing ``(note)``."""
    lines = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("(?i)^https?://"))
    items = F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))), lambda x: x != "")
    note, pin = r"\s*\(([^)]*)\)\s*$", r"@([\w.\-]+)$"
    bare = lambda x: F.trim(F.regexp_replace(x, note, ""))
    parts = F.transform(items, lambda x: F.struct(F.trim(F.regexp_replace(bare(x), pin, "")).alias("name"), F.regexp_extract(bare(x), pin, 1).alias("version"), F.regexp_extract(x, note, 1).alias("qualifier")))
    return F.filter(parts, lambda p: ~F.lower(p["name"]).isin(*K.NOT_A_TOOL) & (F.length(p["name"]) >= 2))


def neutral(text: Column) -> Column:
    """Foreign text without characters that could open or close a prompt's sections."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "<>`{}", "     "), r"\s+", " "))


def json_reply(text: Column) -> Column:
    """The JSON object of a model's reply, fenced or amid prose; null if there is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^.*?```(?:json)?\s*|```.*$", "")
    return F.try_parse_json(F.regexp_extract(F.when(F.contains(text, F.lit("```")), bare).otherwise(text), r"(?s)(\{.*\})", 1))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def term_spans(text: Column, terms: Column) -> Column:
    """Array of (start from 0, end), by place: occurrences of terms of two characters or more, case aside, none within a longer term's.

    A fold over all occurrences, the longest term first, in the JVM.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    wanted = F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(t)), lambda t: F.length(t) >= 2))
    one = lambda t: F.transform(places(low, t), lambda p: F.struct((-F.length(t)).alias("n"), t.alias("t"), (p - 1).alias("start"), (p - 1 + F.length(t)).alias("end")))
    every = F.array_sort(F.flatten(F.transform(wanted, one)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
    taken = F.aggregate(every, none, lambda a, x: F.when(F.exists(a, lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"])), a).otherwise(F.concat(a, F.array(span(x)))))
    return F.array_sort(taken)


def spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Non-overlapping places of words in a text, the longest word first."""
    taken: list[tuple[int, int]] = []
    low = text.lower()
    for w in sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w)):
        for m in re.finditer(re.escape(w), low):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append((m.start(), m.end()))
    return sorted(taken)


@F.udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])), useArrow=True)
def longest_first_spans(text: str, words: list[str]):
    """Greedy in the order of length, so each choice depends on the ones before: no relational form."""
    return spans(text or "", list(words) if words is not None else [])


def excerpt(text: Column, part: Column, around: int = 120) -> Column:
    """A window around the first match, opened at a line start where one is near."""
    at = F.instr(F.lower(text), F.lower(part))
    low = F.greatest(F.lit(1), at - around)
    head = F.substr(text, low, at - low)
    line = F.instr(F.reverse(head), F.lit("\n"))
    start = F.when(line > 0, at - line + 1).otherwise(low)
    return F.when(at > 0, F.substr(text, start, F.least(F.lit(2 * around), F.length(text)))).otherwise(F.lit(""))
