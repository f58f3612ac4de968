"""N-gram Jaccard self-join: MinHash banding for candidates, full n-gram sets for the decision.

Words are runs of anything but ASCII white space, as they stand; an n-gram is ``n`` words in a row (a shorter text is one n-gram of all
its words). Two texts are linked when the Jaccard similarity of their n-gram sets is at least ``threshold``.

1. One pass over whole texts makes each row's set digest and its band hashes. ``banding`` chooses the bands for a target recall at the
   threshold (0.9999 by default, of 8 rows a band: pairs of similarity 0.5 share a band in one case of six, of 0.3 hardly ever).
2. Rows with equal sets are one class; from here on a class is one row. Narrow rows (band hash, node) are shuffled on the band hash; a
   class is tied to the smallest one of each bucket it shares, and components of these ties are the units of work.
3. Texts are shuffled once, to be verified on full sets. A component that fits into one task is verified as a whole. A larger one is cut,
   whichever way compares fewer pairs: by set size (sets that differ by more than the threshold can't match) and hash into blocks, of
   which those within reach of each other meet; or bucket by bucket, full buckets salted into blocks that meet, where a pair counts only
   in the first bucket it shares. All pairs of a task are counted by matrix products, never emitted: a task leaves each row's number of
   links and a spanning forest of the linked rows.
4. The components of the forests, so of verified links alone, are the classes of near copies.

The result has one row a document: doc_id, class_id (smallest doc_id of its component of linked texts), rep_id (smallest doc_id with the
same n-gram set), n_ngrams, n_links (how many other documents are linked to it, copies counted).

Defined cases: a text without words has no n-grams and links to nothing, so it is a class of its own; repeated rows are copies of each
other and each gives a row; a null doc_id counts as after all others; an empty table gives an empty result; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import _text
from tidemark.llm.graph import components

N, THRESHOLD, RECALL, BAND_ROWS = 5, 0.8, 0.9999, 8
#: Rows and n-grams that a verifying task holds at most, about.
BLOCK_ROWS, BLOCK_GRAMS = 1024, 1 << 19
#: Rows of a task's matrices that are worked on together.
ROWS_AT_ONCE = 256


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS) -> tuple[int, int]:
    """Bands and rows a band such that a pair at the threshold shares a band with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def ngram_hashes(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts of a block, and each text's offset among them (0, 1 or words - n + 1 a text)."""
    starts, ends, first = _text.words(raw, offs)
    h = _text.word_hashes(raw, starts, ends)
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offset = np.zeros(len(have) + 1, dtype=np.int64)
    np.cumsum(have, out=offset[1:])
    at = np.repeat(first[:-1] - offset[:-1], have) + np.arange(offset[-1])
    reach = np.minimum(np.repeat(count, have), n)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(n, dtype=np.uint64)])
    for k in range(n):
        out = np.where(k < reach, _text.mix((out ^ padded[at + k]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1)), out)
    return out, offset


def sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, and their offsets."""
    grams, at = ngram_hashes(raw, offs, n)
    of = _text.spread(np.diff(at))
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[first], np.searchsorted(of[first], np.arange(len(offs)))


def signatures(grams: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures, 32 bits each, of the texts that have n-grams (others: all ones): odd multiples on either half of a hash."""
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    rng = np.random.Generator(np.random.Philox(20))
    a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    halves = (grams >> np.uint64(32)).astype(np.uint32), grams.astype(np.uint32)
    for k in range(size):
        out[some, k] = np.minimum.reduceat(halves[k % 2] * a[k] + b[k], at[:-1][some])
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, set_id (digest of the n-gram set; null without words), node (its first half), n_ngrams, bands (hashes that differ by band)."""
    texts = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(2))
            for a, b, part, own in _text.blocks(raw, offs):
                grams, at = sets(part, own, n)
                size = np.diff(at)
                data = memoryview(grams).cast("B")
                ids = [hashlib.blake2b(data[8 * at[i] : 8 * at[i + 1]], digest_size=16).digest() if size[i] else None for i in range(b - a)]
                node = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in ids]
                sig = signatures(grams, at, bands * rows).astype(np.uint64).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = _text.mix((key ^ sig[:, :, r]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r + 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(node, pa.int64()), pa.array(size.astype(np.int64)), lists], ["doc_id", "text_key", "set_id", "node", "n_ngrams", "bands"])

    return texts.mapInArrow(run, "doc_id long, text_key long, set_id binary, node long, n_ngrams long, bands array<long>")


def shared_buckets(rows_signed: DataFrame, scratch: _text.Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, node) of the rows in buckets of more than one node, and (key, least, n) of these buckets."""
    banded = rows_signed.filter("node is not null").select(F.explode("bands").alias("key"), "node")
    span = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n"))
    buckets = scratch.write(span.filter("least <> most").select("key", "least", "n"))
    shared = _text.maybe_in(buckets.select("key"))
    return banded.filter(shared(F.col("key"))), buckets


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one key from rows sorted by it; only one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(batch.schema.get_field_index(key)).to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def common_counts(grams: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct n-grams each pair of rows has in common. Rare n-grams add their pairs; frequent ones are multiplied as a matrix, a slab at a time."""
    order = np.argsort(grams, kind="stable")
    g, r = grams[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    many = np.diff(np.concatenate([first, [len(g)]]))
    out = np.zeros((rows, rows), dtype=np.float32)
    rare, at_once = 12, 1 << 20
    for d in range(2, rare + 1):
        at = first[many == d]
        step = max(1, at_once // (d * d))
        for s in range(0, len(at), step):
            own = r[at[s : s + step, None] + np.arange(d)]
            np.add.at(out.reshape(-1), (own[:, :, None] * rows + own[:, None, :]).reshape(-1), np.float32(1))
    wide = np.flatnonzero(many > rare)
    slab = max(256, (1 << 21) // max(rows, 1))
    for s in range(0, len(wide), slab):
        own = wide[s : s + slab]
        x = np.zeros((rows, len(own)), dtype=np.float32)
        x[r[np.repeat(first[own], many[own]) + np.arange(many[own].sum()) - np.repeat(np.cumsum(many[own]) - many[own], many[own])], np.repeat(np.arange(len(own)), many[own])] = 1
        for a in range(0, rows, ROWS_AT_ONCE):
            out[a : a + ROWS_AT_ONCE] += x[a : a + ROWS_AT_ONCE] @ x.T
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    for i in range(len(linked)):
        if label[i] != i:
            continue
        todo = [i]
        free = label > i
        free[i] = False
        free &= label == np.arange(len(linked))
        while todo:
            reached = np.flatnonzero(linked[todo].any(axis=0) & free)
            free[reached] = False
            label[reached] = i
            todo = list(reached)
    return label


def linked_rows_of(common: np.ndarray, sizes: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs reach the threshold (of different sides, where there are two), and each row's number of linked documents; some rows at a time."""
    n = len(sizes)
    linked, links = np.zeros((n, n), dtype=bool), np.zeros(n, dtype=np.int64)
    size = sizes.astype(np.float64)
    for a in range(0, n, ROWS_AT_ONCE):
        own = common[a : a + ROWS_AT_ONCE]
        union = size[a : a + ROWS_AT_ONCE, None] + size[None, :] - own
        part = own >= (threshold - 1e-9) * union
        part[np.arange(len(part)), np.arange(a, a + len(part))] = False
        if side.any():
            part &= side[a : a + ROWS_AT_ONCE, None] != side[None, :]
        linked[a : a + ROWS_AT_ONCE], links[a : a + ROWS_AT_ONCE] = part, part @ weight
    return linked, links


def shares_earlier(keys: np.ndarray, at: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each pair of rows shares a band before the one at which they meet here."""
    out = np.zeros(len(pairs[0]), dtype=bool)
    for s in range(0, len(out), 1 << 14):
        i, j = pairs[0][s : s + (1 << 14)], pairs[1][s : s + (1 << 14)]
        same = keys[i] == keys[j]
        out[s : s + (1 << 14)] = same.argmax(axis=1) < at[i]
    return out


def verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """cid, links, root from rows (task, cid, side, key, bands, weight, text): links counted within a task, or between its sides 1 and 2.

    Where a task is part of a bucket (key), a pair that shares an earlier band counts there, not here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            ids = table["cid"].to_numpy()
            side, weight = table["side"].to_numpy(), table["weight"].to_numpy()
            raw, offs = _text.text_bytes(table["text"])
            parts, sizes = [], np.zeros(len(ids), dtype=np.int64)
            for a, b, part, own in _text.blocks(raw, offs):
                grams, at = sets(part, own, n)
                parts.append(grams)
                sizes[a:b] = np.diff(at)
            common = common_counts(np.concatenate(parts), _text.spread(sizes), len(ids))
            linked, links = linked_rows_of(common, sizes, side, weight, threshold)
            if (key := table["key"][0].as_py()) is not None:
                keys = np.concatenate([c.flatten().to_numpy() for c in table["bands"].chunks]).reshape(len(ids), -1)
                pairs = np.nonzero(linked)
                again = shares_earlier(keys, (keys == key).argmax(axis=1), pairs)
                linked[pairs[0][again], pairs[1][again]] = False
                links = linked @ weight
            root = forest(linked)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])], ["cid", "links", "root"])

    return members.mapInArrow(run, "cid long, links long, root long")


def tasks_of(members: DataFrame, banded: DataFrame, threshold: float, block_rows: int, block_grams: int, scratch: _text.Scratch) -> DataFrame:
    """cid, task, side, key from members (cid, node, root, n_ngrams) and their buckets (key, node): the tasks in which each class is verified."""
    step = F.floor(F.log(F.col("n_ngrams").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    sized = members.withColumn("step", step)
    steps = scratch.write(sized.groupBy("root", "step").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_ngrams").alias("grams")))
    nearby = steps.select("root", F.explode(F.array("step", F.col("step") - 1)).alias("step"), F.col("rows").alias("r"))
    small = (F.col("rows") <= block_rows) & (F.col("grams") <= block_grams)
    whole = scratch.write(steps.groupBy("root").agg(F.sum("rows").alias("rows"), F.sum("grams").alias("grams")).withColumn("easy", small))
    easy = whole.filter("easy and rows > 1").select("root", F.col("rows").alias("n"))
    none = F.lit(None).cast("long").alias("key")
    text = lambda c: c.cast("string")
    out = _text.hot_join(sized, easy, ["root"]).select("cid", F.concat(F.lit("c/"), text(F.col("root"))).alias("task"), F.lit(0).alias("side"), none)
    hard = whole.filter("not easy").select("root", F.col("rows").alias("n"))
    if hard.isEmpty():
        return out
    large = scratch.write(_text.hot_join(sized, hard, ["root"]))
    # which way compares fewer pairs: steps that are within reach of each other, or buckets
    reach = nearby.groupBy("root", "step").agg(F.sum("r").alias("r")).join(steps.select("root", "step", "rows"), ["root", "step"]).groupBy("root").agg(F.sum(F.col("r").cast("double") * F.col("rows")).alias("by_step"))
    held = scratch.write(large.select("node", "cid", "root", "n_ngrams").join(banded, "node"))
    filled = scratch.write(held.groupBy("key").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n"), F.sum("n_ngrams").alias("grams")).filter("n > 1"))
    pairs = filled.groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("by_bucket"))
    loose = scratch.write(hard.join(reach, "root").join(pairs, "root").filter("by_bucket < by_step").select("root", "n"))
    # by step: a block meets the blocks of its own step and of the next one
    parts = F.ceil(F.greatest(F.col("rows") / (block_rows / 2), F.col("grams") / (block_grams / 2))).cast("int")
    tight = hard.join(loose, "root", "left_anti").select("root")
    blocks = steps.join(tight, "root").select("root", "step", "rows", parts.alias("parts"))
    after = blocks.select("root", (F.col("step") - 1).alias("step"), F.col("parts").alias("after"))
    before = blocks.select("root", (F.col("step") + 1).alias("step"), F.col("parts").alias("before"))
    dealt = scratch.write(blocks.join(after, ["root", "step"], "left").join(before, ["root", "step"], "left").na.fill(0, ["after", "before"]))
    rows = _text.hot_join(large, dealt, ["root", "step"], "rows").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    own, step = F.col("own"), F.col("step")
    name = lambda step, a, b, kind: F.concat_ws("/", F.lit(kind), text(F.col("root")), text(step), text(a), text(b))
    # an empty range has no tasks; a block alone in its step is a task with itself
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda x: x < n)
    side = lambda x: F.when(x == own, 0).when(own < x, 1).otherwise(2).alias("side")
    within = F.transform(upto(F.col("parts")), lambda x: F.struct(name(step, F.least(own, x), F.greatest(own, x), "in").alias("task"), side(x)))
    up = F.transform(upto(F.col("after")), lambda x: F.struct(name(step, own, x, "up").alias("task"), F.lit(1).alias("side")))
    down = F.transform(upto(F.col("before")), lambda x: F.struct(name(step - 1, x, own, "up").alias("task"), F.lit(2).alias("side")))
    out = out.unionByName(rows.select("cid", F.explode(F.concat(within, up, down)).alias("t")).select("cid", "t.task", "t.side", none))
    # by bucket: a block meets all blocks of its bucket
    blocks = scratch.write(filled.join(loose.select("root"), "root", "left_semi").select("key", "n", F.when((F.col("n") <= block_rows) & (F.col("grams") <= block_grams), 1).otherwise(F.ceil(F.greatest(F.col("n") / (block_rows / 2), F.col("grams") / (block_grams / 2)))).cast("int").alias("parts")))
    rows = _text.hot_join(held.select("cid", "key"), blocks, ["key"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    bucket = lambda a, b: F.concat_ws("/", F.lit("b"), text(F.col("key")), text(a), text(b))
    met = F.transform(upto(F.col("parts")), lambda x: F.struct(bucket(F.least(own, x), F.greatest(own, x)).alias("task"), side(x)))
    return out.unionByName(rows.select("cid", "key", F.explode(met).alias("t")).select("cid", "t.task", "t.side", "key"))


def linked_rows(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, text_key, root, class_id, rep_id, n_ngrams, n_links for every row of docs; root: a name of the class, null for texts without words."""
    bands, rows = banding(threshold, recall, band_rows)
    scratch = _text.Scratch()
    signs = _text.materialise(signed(docs, n, bands, rows, id_col, text_col))
    narrow = signs.select("doc_id", "text_key", "set_id", "node", "n_ngrams")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = narrow.filter("set_id is not null").groupBy("set_id").agg(F.min("node").alias("node"), F.min("n_ngrams").alias("n_ngrams"), F.count(F.lit(1)).alias("weight"), rep.alias("rep"))
    # numbers that are unique and stay, once written
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("cid"), "set_id", "node", "n_ngrams", "weight", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")))
    banded, buckets = shared_buckets(signs, scratch)
    ties = _text.hot_join(banded, buckets, ["key"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    members = scratch.write(components(ties, scratch=scratch).join(classes.drop("set_id"), "node"))
    tasks = scratch.write(tasks_of(members.select("cid", "node", "root", "n_ngrams"), banded.distinct(), threshold, block_rows, block_grams, scratch))
    # one text a class; verifying reads texts, not sets: they shuffle at half the size
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    wanted = _text.maybe_in(members.select(F.xxhash64("rep_id", "rep_key")))
    texts = texts.filter(wanted(F.xxhash64("id", "key")))
    found = texts.join(members, texts["id"].eqNullSafe(members["rep_id"]) & (texts["key"] == members["rep_key"]))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("id", "key", "cid").orderBy("cid"))).filter("nth = 1").select("cid", "weight", "text")
    dealt = tasks.join(found, "cid")
    if tasks.filter("key is not null").isEmpty():
        dealt = dealt.withColumn("bands", F.lit(None).cast("array<long>"))
    else:  # where tasks are buckets, band hashes go along
        inside = scratch.write(tasks.filter("key is not null").select("cid").distinct().join(classes.select("cid", "set_id"), "cid"))
        mine = _text.maybe_in(inside.select(F.xxhash64("set_id")))
        bands_of = signs.filter("set_id is not null").filter(mine(F.xxhash64("set_id"))).groupBy("set_id").agg(F.first("bands").alias("bands")).join(inside, "set_id").drop("set_id")
        dealt = dealt.join(bands_of, "cid", "left").withColumn("bands", F.when(F.col("key").isNotNull(), F.col("bands")))
    dealt = dealt.repartition("task").sortWithinPartitions("task", "cid")
    links = scratch.write(verified(dealt, n, threshold))
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch=scratch).withColumnRenamed("node", "cid")
    known = classes.select("cid", "set_id", "rep_id", "weight").join(linked, "cid", "left").join(sums, "cid", "left")
    known = scratch.write(known.select("set_id", "rep_id", "weight", F.coalesce("root", "cid").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    firsts = scratch.write(known.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    known = _text.materialise(_text.hot_join(known, firsts, ["root"]), narrow=True)
    scratch.clear()
    worded = _text.hot_join(narrow.filter("set_id is not null"), known, ["set_id"], "weight").select("doc_id", "text_key", "root", "class_id", "rep_id", "n_ngrams", "n_links")
    alone = narrow.filter("set_id is null").select("doc_id", "text_key", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), "n_ngrams", F.lit(0).cast("long").alias("n_links"))
    return _text.few(worded.unionByName(alone))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, rep_id, n_ngrams, n_links for every row of docs."""
    return linked_rows(docs, **options).drop("text_key", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each class the one with the smallest doc_id, and all texts without words."""
    rows = _text.materialise(linked_rows(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_key", "root"), narrow=True)
    worded = rows.filter("root is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    stays = _text.materialise(worded.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")), narrow=True)
    # rows of classes of their own stay as they are; only the others' texts are shuffled, to be told apart exactly
    shared = _text.hot_join(worded, stays.filter("n > 1").select("root", "n"), ["root"])
    doubted = _text.maybe_in(_text.materialise(shared.select(F.xxhash64("doc_id", "text_key")), narrow=True))
    stays = stays.select(F.col("first.doc_id").alias("keep"), F.col("first.text_key").alias("keep_key")).filter(doubted(F.xxhash64("keep", "keep_key")))
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    told = docs.filter(doubted(own) & ~wordless).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    joined = told.join(stays, told["id"].eqNullSafe(stays["keep"]) & (told["key"] == stays["keep_key"]))
    joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("id", "key").orderBy("key"))).filter("nth = 1")
    return _text.compacted(docs.filter(~doubted(own) | wordless).unionByName(joined.select("row.*")), like=docs)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_text.table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE_SQL: dict[str, str] = {}
