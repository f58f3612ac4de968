"""Finding the words of a dictionary in texts, whatever the size of either.

The result is that of one alternation of all words, longest first, on word bounds; but no such pattern is built, and the dictionary goes
neither through the driver nor whole into a task. A word that occurs on word bounds brings each of its runs of word characters as a whole
run of the text, so texts and words meet on runs:

1. every word stands under the one of its runs that the fewest words share (a word without any: under its first character);
2. texts are exploded into their distinct runs and joined with these, an equi-join by broadcast of the words while they are few and by a
   shuffle beyond, split where a run is hot; the exploded texts are never what is broadcast;
3. each text then meets its candidates alone, once, and is searched with an alternation of those that it holds: words that it doesn't
   hold can't change what the whole alternation would find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stages import staged

#: Words that are sent to all tasks at most.
_FEW_WORDS = 1 << 16
_RUN, _OTHER = r"(\w+)", r"([^\w\s])"


def _runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), 1))


def _signs(text: Column) -> Column:
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_OTHER), 1)), lambda c: F.concat(F.lit("sign:"), c))


def placed(words: DataFrame, word: str) -> DataFrame:
    """run, word: every word once, under its rarest run."""
    own = words.select(F.col(word).alias("word")).filter("word <> ''").distinct()
    each = own.select("word", F.explode(F.when(F.size(_runs(F.col("word"))) > 0, _runs(F.col("word"))).otherwise(F.slice(_signs(F.col("word")), 1, 1))).alias("run"))
    shared = each.join(each.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run")
    return shared.groupBy("word").agg(F.min_by("run", F.struct("n", "run")).alias("run")).select("run", "word")


def _met(pieces: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Pieces of texts joined with placed words. What a text explodes into looks as small as the text's file to the planner, so the side to broadcast is settled here."""
    words = staged(words)
    few = words.limit(_FEW_WORDS + 1).count() <= _FEW_WORDS
    return pieces.join(F.broadcast(words) if few else words.hint("merge"), key)


def matched(texts: DataFrame, text: str, words: DataFrame, word: str, before: str = r"[\w.\-]", after: str = r"[\w\-]") -> DataFrame:
    """texts with ``found``: the words in each text, lower-cased, in order of first occurrence, each once; empty for none.

    before, after: characters that may not stand before and after a word. Words are in lower case, and hold nothing between their runs of
    word characters that the text would not hold alike. A null text holds nothing.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    key = F.sha2(low.cast("binary"), 256)
    runs = texts.select(key.alias("__key"), F.explode(F.concat(_runs(low), _signs(low))).alias("run"))
    candidates = _met(runs, placed(words, word), "run").groupBy("__key").agg(F.collect_set("word").alias("__words"))  # words of one text
    joined = texts.withColumn("__key", key).join(candidates.hint("merge"), "__key", "left")  # both grow with the texts
    held = F.filter("__words", lambda w: F.contains(low, w))
    longest = F.transform(F.array_sort(F.transform(held, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: F.concat(F.lit("\\Q"), x["w"], F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?<!{before})("), F.array_join(longest, "|"), F.lit(f")(?!{after})"))
    found = F.when(F.size(held) > 0, F.array_distinct(F.regexp_extract_all(low, pattern, 1))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("found", F.when(F.col("__words").isNull(), F.array().cast("array<string>")).otherwise(found)).drop("__key", "__words")


#: Characters of a gram: a word stands under one of its grams, a shorter one under itself.
GRAM = 5


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one size; none for a shorter text."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Every pair of a row of texts and a row of words whose word stands anywhere in the text, by an equi-join on grams; empty words stand in none.

    A word is placed under the one of its grams of five characters that the fewest words share, or under itself if it is shorter; texts are
    exploded into their distinct grams of every size up to five that a word has; what meets is verified. Case counts; nulls meet nothing.
    """
    own = words.select(F.col(word).alias("__w")).filter("__w <> ''").distinct()
    each = own.select("__w", F.explode(F.when(F.length("__w") < GRAM, F.array("__w")).otherwise(_grams(F.col("__w"), GRAM))).alias("__gram"))
    shared = each.join(each.groupBy("__gram").agg(F.count(F.lit(1)).alias("n")), "__gram")
    placed_words = shared.groupBy("__w").agg(F.min_by("__gram", F.struct("n", "__gram")).alias("__gram"))
    bodies = texts.select(F.col(text).alias("__t")).distinct()
    grams = bodies.select("__t", F.explode(F.concat(*[_grams(F.col("__t"), n) for n in range(1, GRAM + 1)])).alias("__gram"))
    pairs = _met(grams, placed_words, "__gram").filter(F.contains("__t", F.col("__w"))).select("__t", "__w").distinct()
    return texts.join(pairs, texts[text] == pairs["__t"]).drop("__t").join(words, F.col("__w") == words[word]).drop("__w")
