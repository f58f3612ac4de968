"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions alone.

A shingle is ``n`` words in a row (a shorter text is one shingle of all its words; a text without words has none); words are runs of
anything but ASCII white space, as they stand. A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's shingles, ascending.
The k smallest of two sketches together are the sketch of both texts, so sketches merge across the parts of a text (``sketch`` works on
parts of PART words), across texts (``merged``) and across rows (``merged_by``), in any order. From two sketches follow

* ``resemblance``: the part of the k smallest hashes of both that both hold, the Jaccard similarity of the shingle sets, exact up to k
  distinct shingles together, else with a standard error of sqrt(J (1 - J) / k), 0.03 at most for k = 256;
* ``distinct``: the number of distinct shingles, from the k-th smallest hash, within 1 / sqrt(k - 2), or exact below k;
* ``containment``: the part of the first one's shingles that the second has, from the two above.

``paired`` puts each row beside the next document in descending doc_id. Texts are shuffled once, on blocks of 64 ids; within a block
the next text is the row before in order, and a block's last row gets the first of the next block there is, which ``next_ids`` finds
among narrow rows, radix level by radix level, with no group above 64. So sparse ids cost a second shuffle of the block ends, and no
order is ever made in one task.

Defined cases: null texts are empty; two texts without words resemble each other fully and contain each other, a text with words none of
these; rows that repeat a doc_id share its next document, and stand as the smallest of their texts for the one before; a null doc_id comes
last (ids lie above -2**63); a sole document is its own next one; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

N, K = 5, 256
#: Words of a part: a longer text is sketched part by part.
PART = 1 << 15
#: Ids of a block are 2**RADIX in a row.
RADIX = 6

_EDGE = " \t\n\x0b\x0c\r"
_WHITE = "[\\x20\\x09-\\x0D]+"
_NONE = "CAST(array() AS array<bigint>)"


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_EDGE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE))


def _shingles(name: str, first: str, n: int) -> str:
    """The hashes of the shingles that start at up to PART words from place ``first`` (from 0) of the array column ``name``."""
    rest = ", ".join(["w", *[f"{name}[{first} + i + {j}]" for j in range(1, n)]])
    return f"transform(slice({name}, {first} + 1, least({PART}, greatest(size({name}) - {n - 1} - {first}, 0))), (w, i) -> xxhash64({rest}))"


def with_sketch(df: DataFrame, text: str, out: str, n: int = N, k: int = K) -> DataFrame:
    """df with the sketch of a text column: an array of at most k hashes, ascending."""
    df = df.withColumn("__words", words(F.col(text)))
    small = f"slice(sort_array(array_distinct({_shingles('__words', '0', n)})), 1, {k})"
    parts = f"sequence(0, int((size(__words) - {n}) div {PART}))"
    step = f"slice(sort_array(array_distinct(concat(a, {_shingles('__words', f'p * {PART}', n)}))), 1, {k})"
    long = f"aggregate({parts}, {_NONE}, (a, p) -> {step})"
    whole = " ".join(f"WHEN {m} THEN array(xxhash64({', '.join(f'__words[{j}]' for j in range(m))}))" for m in range(1, n))
    few = f"CASE size(__words) {whole} ELSE {_NONE} END"
    sketch = f"CASE WHEN size(__words) < {n} THEN {few} WHEN size(__words) <= {PART} THEN {small} ELSE {long} END"
    return df.withColumn(out, F.expr(sketch)).drop("__words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for all rows of each group. Hashes are made distinct before they are ranked, and ranks above k go map-side."""
    each = df.select(*keys, F.explode(sketch).alias("hash")).distinct()
    least = each.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("hash"))).filter(F.col("nth") <= k)
    made = least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch))  # at most k a group
    groups = df.select(*keys).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & groups[c].eqNullSafe(made[c])
    return groups.join(made, same, "left").select(*[groups[c] for c in keys], F.coalesce(made[sketch], F.expr(_NONE)).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both).cast("double"))


def distinct(a: Column, k: int = K) -> Column:
    """Distinct shingles of the text or texts behind a sketch."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + F.lit(1.0)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    found = F.when(F.size(a) == 0, F.when(F.size(b) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(shared / F.greatest(distinct(a, k), F.lit(1.0)))
    return F.least(found, F.lit(1.0))


def fingerprint(a: Column) -> Column:
    """A sketch as a string: its hashes in 16 hex digits each, packed as base64. ``sketch_of`` is the way back."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def sketch_of(printed: Column) -> Column:
    digits = F.hex(F.unbase64(printed))
    at = F.when(F.length(digits) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(digits) - 15, F.lit(16)))
    unsigned = F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(16)), 16, -10).cast("long"))
    return unsigned


def next_ids(ids: DataFrame, scratch: _text.Scratch) -> DataFrame:
    """(block, next_id) for each block of ids (one long column ``id``, distinct, no nulls): the largest id below the block, null for none.

    Level by level, blocks of 2**RADIX blocks are ranked within their own group of at most 2**RADIX; what lies below a group's last block
    is asked of the next level. 64-bit ids need eleven levels at most, and each has fewer rows than the one before.
    """
    level = ids.groupBy(F.shiftright("id", RADIX).alias("block")).agg(F.max("id").alias("top"))
    levels = [scratch.write(level)]
    while not levels[-1].filter("block NOT IN (0, -1)").isEmpty():
        up = levels[-1].groupBy(F.shiftright("block", RADIX).alias("block")).agg(F.max("top").alias("top"))
        levels.append(scratch.write(up))
    out = None
    for level in reversed(levels):
        group = F.shiftright("block", RADIX)
        near = level.select("block", group.alias("up"), F.lead("top").over(W.partitionBy(group).orderBy(F.col("block").desc())).alias("near"))
        if out is None:  # blocks 0 and -1 alone are left, groups of their own
            out = near.select("block", F.when(F.col("block") == 0, level.filter("block = -1").select("top").scalar()).alias("next_id"))
        else:
            above = out.select(F.col("block").alias("up"), F.col("next_id").alias("far"))
            out = near.join(above, "up", "left").select("block", F.coalesce("near", "far").alias("next_id"))
    return out


def paired(docs: DataFrame, scratch: _text.Scratch) -> DataFrame:
    """doc_id, text, sketch of every row, with next_text and next_sketch of the next document in descending doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = rows.agg(F.min("doc_id")).first()[0]  # one value; null ids take the place below it
    low = 0 if low is None else low - 1
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(low).cast("long")))
    ids = scratch.write(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    own = F.when(F.col("id") != low, F.col("id")).alias("doc_id")
    if ids.filter("n > 1").isEmpty():
        return neighbours(rows.select("id", "text"), ids, scratch).select(own, "text", "sketch", "next_text", "next_sketch")
    # one row an id goes round; all rows of the id then get what follows it
    least = rows.groupBy("id").agg(F.min("text").alias("text"))
    follow = neighbours(least, ids, scratch).select("id", "next_text", "next_sketch").join(ids, "id")
    joined = _text.hot_join(rows.select("id", "text"), scratch.write(follow, narrow=False), ["id"])
    return with_sketch(joined, "text", "sketch").select(own, "text", "sketch", "next_text", "next_sketch")


def neighbours(rows: DataFrame, ids: DataFrame, scratch: _text.Scratch) -> DataFrame:
    """``paired`` for rows(id, text) of distinct ids without null."""
    links = scratch.write(next_ids(ids, scratch))
    dealt = rows.withColumn("block", F.shiftright("id", RADIX)).repartition("block")
    down, up = (W.partitionBy("block").orderBy(F.col("id").desc()), W.partitionBy("block").orderBy("id"))
    inner = with_sketch(dealt, "text", "sketch").withColumns({"next_text": F.lead("text").over(down), "next_sketch": F.lead("sketch").over(down)})
    inner = inner.filter("next_text IS NOT NULL").drop("block")
    ends = dealt.withColumn("nth", F.row_number().over(up)).filter("nth = 1").drop("nth")
    tops = dealt.withColumn("nth", F.row_number().over(down)).filter("nth = 1").select(F.col("id").alias("next_id"), F.col("text").alias("next_text"))
    first = ids.agg(F.max("id")).scalar()
    asked = ends.join(links, "block").withColumn("next_id", F.coalesce("next_id", first)).join(tops, "next_id")
    outer = with_sketch(with_sketch(asked, "text", "sketch"), "next_text", "next_sketch")
    return inner.unionByName(outer.select(*inner.columns))


def edited(text: Column, other: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many of the other text, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses, estimated distinct shingles and containments."""
    scratch = _text.Scratch()
    rows = paired(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited", "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch").drop("edited")
    own, new, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(new).alias("edited_fingerprint"), resemblance(own, new).alias("near_edited"), resemblance(own, following).alias("near_next"),
        distinct(own).alias("n_shingles"), containment(own, new).alias("kept_in_edited"),
    )


QUERIES = {"op12_fingerprints": op12_fingerprints}
ORACLE_SQL: dict[str, str] = {}
