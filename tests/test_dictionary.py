"""Dictionary matching against one alternation of all words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dictionary

TEXTS = ["Use node.js, not node or js-node. C++ and c#!", "", None, "tool tool-x .tool tool. (tool) xtool toolx", "general public license; public license", "++ a+b a + b", "naïve café — 日本 日本語", "gpl.gpl v2 gpl-v2 gpl_v2"]
WORDS = ["node.js", "node", "js", "c++", "c#", "tool", "general public license", "public license", "license", "++", "a+b", "café", "日本", "gpl", "gpl v2", "v2"]


def alternation(text, words):
    """What Java's alternation finds: word characters of its bounds are ASCII alone."""
    pattern = r"(?<![A-Za-z0-9_.\-])(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?![A-Za-z0-9_\-])"
    return list(dict.fromkeys(re.findall(pattern, (text or "").lower()))) if words else []


def found(spark, texts, words):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, text string, found_before string")
    own = spark.createDataFrame([(w,) for w in words], "w string")
    return {r["i"]: r["found"] for r in dictionary.matched(df, "text", own, "w").collect()}


def test_equals_the_alternation(spark):
    assert found(spark, TEXTS, WORDS) == {i: alternation(t, WORDS) for i, t in enumerate(TEXTS)}
    assert found(spark, TEXTS, []) == {i: [] for i in range(len(TEXTS))}


@pytest.mark.parametrize("seed", range(3))
def test_random_words_and_texts(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("ab.+# -_é") for _ in range(n)).strip()
    words = {re.sub(" +", " ", make(rng.randint(1, 6)).replace("-", "")).strip() for _ in range(60)} - {""}
    texts = [make(rng.randint(0, 60)) for _ in range(60)]
    assert found(spark, texts, words) == {i: alternation(t, words) for i, t in enumerate(texts)}


def test_a_million_words(spark):
    words = spark.range(1_000_000).select(F.concat(F.lit("thing "), F.col("id").cast("string"), F.lit(" of"), (F.col("id") % 1000).cast("string")).alias("w"))
    texts = spark.createDataFrame([(1, "a Thing 7 of7, thing 999999 of999 and thing 8 of9"), (2, "thing of")], "i long, t string")
    got = {r["i"]: r["found"] for r in dictionary.matched(texts, "t", words, "w").collect()}
    assert got == {1: ["thing 7 of7", "thing 999999 of999"], 2: []}


def test_nothing_of_the_dictionary_comes_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    texts, words = spark.createDataFrame([("a b",)], "t string"), spark.createDataFrame([("b",)], "w string")
    assert dictionary.matched(texts, "t", words, "w").count() == 1


@pytest.mark.parametrize("seed", range(2))
def test_containment_by_grams_is_containment(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [*(make(rng.randint(0, 25)) for _ in range(50)), None, "same", "same"]
    words = [*(make(rng.randint(0, 8)) for _ in range(60)), None, "same", "same"]
    a = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    b = spark.createDataFrame(list(enumerate(words)), "j long, w string")
    got = sorted((r["i"], r["j"]) for r in dictionary.containing(a, "t", b, "w").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if t and w and w in t)
