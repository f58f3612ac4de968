"""Merkle manifest of a dataset by superblock reduction: a leaf a row, a tree a source, a tree over the sources' roots.

1. ``leaves`` hashes every row in built-in functions; from here on rows are narrow (digests of 32 bytes).
2. ``numbered`` gives every leaf its place in its tree: rows are dealt out by ranges of (tree, order), numbered within their part, and
   moved by the counts of earlier parts. No tree, however large, is sorted or counted in one task.
3. ``reduced`` buckets places by fanout**k. A bucket's k levels are collapsed in one ``applyInPandas`` group of at most fanout**k nodes,
   which leaves the lower half of each member's proof and the bucket's root; bucket roots are reduced in the same way until every tree
   has one node, so n leaves take log(n) / k / log(fanout) rounds. Lower and upper proofs are then concatenated from the top down.
4. The subroots are numbered and reduced as one more tree, whose proofs are appended to their rows'.

``manifest`` gives each row its place, leaf, proof (siblings of 32 bytes, lowest level first, left to right) and the roots. ``folded``
recomputes the root from any leaf and the proof kept for it, so a changed row is found without any other row.

Digests are SHA-256; where they are hashed again they go in as lowercase hex. A last run of fewer nodes, even of one, is hashed too; a
tree of one leaf is that leaf. Defined cases: nulls are leaves' ``-``, apart from every text; a null source is a tree of its own, the
first; a null doc_id comes first in its tree; rows of equal doc_id are ordered by leaf; rows equal in both are told apart by place alone,
so each gets one of their proofs; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

FANOUT = 3
#: Levels of a superblock: a task's group has at most FANOUT ** LEVELS = 729 nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value: no two rows of values read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]), 256))


def tree_of(source: Column) -> Column:
    """A name that sorts as the source does, null first, and is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def numbered(rows: DataFrame, group: str, order: list[str], scratch: _text.Scratch) -> DataFrame:
    """rows with place (from 0, in the given order within the group) and size (rows of the group); the group column is never null."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    at = dealt.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(at).to_numpy(zero_copy_only=False)
            new = np.ones(n, dtype=bool)
            new[0], new[1:] = names[0] != last, names[1:] != names[:-1]
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place = np.arange(n) - starts
            if not new[0]:
                run_on = np.flatnonzero(new)
                place[: run_on[0] if len(run_on) else n] += seen
            last, seen = names[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "nth"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = scratch.write(dealt.mapInArrow(run, f"{kinds}, nth long"))
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))  # one row for each group of each part
    own = W.partitionBy(group)
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(group, "part", before.alias("before"), F.sum("n").over(own).alias("size"))
    return placed.join(offsets, [group, "part"]).withColumn("place", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def depth(size: Column, fanout: int = FANOUT) -> Column:
    """Levels above the leaves: the least d with fanout**d >= size."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(F.lit(p))
        p *= fanout
    return F.size(F.filter(F.array(*powers), lambda x: x < size))


def _hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def collapsed(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> tuple[bytes, list[bytes]]:
    """The root of a bucket's nodes after so many levels, and each node's siblings up to it."""
    own: list[list[bytes]] = [[] for _ in nodes]
    width = 1
    for _ in range(levels):
        sides = [b"".join(nodes[j - j % fanout : j] + nodes[j + 1 : j - j % fanout + fanout]) for j in range(len(nodes))]
        for i, proof in enumerate(own):
            proof.append(sides[i // width])
        nodes = [_hash(nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
        width *= fanout
    return nodes[0], [b"".join(p) for p in own]


def reduced(nodes: DataFrame, scratch: _text.Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes(tree, place, size, digest, ...) with their proofs; and each tree's root, as (tree, root, size).

    Rounds go on until every tree is one node. Each round's rows are written, so a lost executor costs its tasks only.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)

    def fold(schema: str):  # noqa: ANN202
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place", kind="stable")
            root, proofs = collapsed([bytes(x) for x in group["digest"]], int(group["steps"].iloc[0]), fanout)
            return group.assign(proof=proofs, root=[root] + [None] * (len(group) - 1))

        return lambda df: df.groupBy("tree", "bucket").applyInPandas(run, schema)

    more = ", steps int, width long, bucket long, proof binary, root binary"
    first = nodes.withColumn("leaves", F.col("size"))
    kinds += ", leaves long"
    live, rounds = first.filter("size > 1"), []
    done = [first.filter("size = 1").select("tree", F.col("digest").alias("root"), "leaves")]
    while not live.isEmpty():
        steps = F.least(F.lit(levels), depth(F.col("size"), fanout))
        sized = live.withColumn("steps", steps).withColumn("width", F.pow(F.lit(float(fanout)), "steps").cast("long")).withColumn("bucket", F.expr("place div width"))
        rounds.append(scratch.write(fold(kinds + more)(sized)))
        roots = rounds[-1].filter("root IS NOT NULL").select("tree", F.col("bucket").alias("place"), F.expr("(size + width - 1) div width").alias("size"), F.col("root").alias("digest"), "leaves")
        done.append(roots.filter("size = 1").select("tree", F.col("digest").alias("root"), "leaves"))
        live, kinds = roots.filter("size > 1"), "tree string, place long, size long, digest binary, leaves long"
    proofs = None
    for r in reversed(rounds):
        if proofs is not None:
            above = proofs.select("tree", F.col("place").alias("bucket"), F.col("proof").alias("upper"))
            r = r.join(above, ["tree", "bucket"], "left").withColumn("proof", F.concat("proof", F.coalesce("upper", F.lit(b""))))
        proofs = r
    alone = nodes.filter("size = 1").withColumn("proof", F.lit(b""))
    rows = alone if proofs is None else proofs.select(*nodes.columns, "proof").unionByName(alone)
    tops = done[0]
    for d in done[1:]:
        tops = tops.unionByName(d)
    return rows, tops.withColumnRenamed("leaves", "size")


def manifest(leaved: DataFrame, scratch: _text.Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaved(doc_id, tree, digest, ...) with place, size, proof, its tree's subroot, place, number of trees and proof above, and the root."""
    rows, roots = reduced(numbered(leaved, "tree", ["doc_id", "digest"], scratch), scratch, fanout, levels)
    members = scratch.write(roots).select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("root").alias("digest"), F.col("size").alias("n"))
    above, root = reduced(numbered(members, "tree", ["member"], scratch), scratch, fanout, levels)
    keyed = above.select(F.col("member").alias("tree"), F.col("place").alias("top_place"), F.col("size").alias("top_size"), F.col("digest").alias("subroot"), F.col("proof").alias("top_proof"), "n")
    last = root.first()  # one digest
    return _text.hot_join(rows, scratch.write(keyed), ["tree"]).withColumn("root", F.lit(bytes(last["root"]) if last else None).cast("binary"))


def fold_up(node: bytes, place: int, size: int, proof: bytes, fanout: int = FANOUT) -> bytes:
    """The root of a tree of ``size`` leaves from the leaf at a place and its siblings."""
    at = 0
    while size > 1:
        start = place - place % fanout
        n = min(fanout, size - start) - 1
        sides = [proof[at + 32 * i : at + 32 * i + 32] for i in range(n)]
        sides.insert(place - start, node)
        node = _hash(sides)
        at, place, size = at + 32 * n, place // fanout, -(-size // fanout)
    return node


def folded(rows: DataFrame, node: str, keep: list[str], fanout: int = FANOUT) -> DataFrame:
    """The kept columns, folded_root (from the digest in column ``node`` and the row's proofs) and proof_sha256, in Arrow batches."""
    ways = ["place", "size", "proof", "top_place", "top_size", "top_proof"]
    rows = rows.select(*keep, F.col(node).alias("node"), *ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, proofs = [], []
            for node, place, size, proof, top_place, top_size, top_proof in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(7)), strict=True):
                made.append(fold_up(fold_up(node, place, size, proof, fanout), top_place, top_size, top_proof, fanout))
                proofs.append(hashlib.sha256((proof + top_proof).hex().encode()).hexdigest())
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary()), pa.array(proofs)], [*keep, "folded_root", "proof_sha256"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, folded_root binary, proof_sha256 string")


def tampered(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest of each row, and the digest that it has after half of all rows have lost their line ends (by crc32 of doc_id)."""
    own = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.col("text").contains("\n")
    altered = leaf([*own[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    return docs.select(F.col("doc_id"), tree_of(F.col("source")).alias("tree"), leaf(own).alias("digest"), F.when(hit, altered).alias("altered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, checked against rows of which half have lost their line ends."""
    scratch = _text.Scratch()
    rows = manifest(tampered(_text.table(spark, sf_dir, "documents").select(*FIELDS)), scratch)
    out = folded(rows.withColumn("seen", F.coalesce("altered", "digest")), "seen", ["doc_id", "digest", "subroot", "root"])
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof_sha256", text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle": op11_merkle}

_FRAMED = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FRAMED(c) for c in (*FIELDS[:-1], text)) + ")"

ORACLE_SQL = {
    "op11_merkle": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_LEAF("text")} AS leaf,
         CASE WHEN {_text.crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS seen
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM d),
up(tree, level, place, size, digest) AS (
  SELECT tree, 0, place, size, leaf FROM n
  UNION ALL
  SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY tree, level, place // 3, size),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1),
top(level, place, size, digest) AS (
  SELECT 0, place, size, subroot FROM s
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE size > 1 GROUP BY level, place // 3, size),
f(doc_id, tree, level, place, size, seen, proof) AS (
  SELECT doc_id, tree, 0, place, size, seen, '' FROM n
  UNION ALL
  SELECT f.doc_id, f.tree, f.level + 1, f.place // 3, (f.size + 2) // 3,
         sha256(string_agg(CASE WHEN u.place = f.place THEN f.seen ELSE u.digest END, '' ORDER BY u.place)),
         f.proof || coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (u.place <> f.place), '')
  FROM f JOIN up AS u ON u.tree = f.tree AND u.level = f.level AND u.place // 3 = f.place // 3
  WHERE f.size > 1 GROUP BY f.doc_id, f.tree, f.level, f.place, f.size, f.seen, f.proof),
g(doc_id, level, place, size, seen, proof) AS (
  SELECT f.doc_id, 0, s.place, s.size, f.seen, f.proof FROM f JOIN s ON s.tree = f.tree WHERE f.size = 1
  UNION ALL
  SELECT g.doc_id, g.level + 1, g.place // 3, (g.size + 2) // 3,
         sha256(string_agg(CASE WHEN t.place = g.place THEN g.seen ELSE t.digest END, '' ORDER BY t.place)),
         g.proof || coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place <> g.place), '')
  FROM g JOIN top AS t ON t.level = g.level AND t.place // 3 = g.place // 3
  WHERE g.size > 1 GROUP BY g.doc_id, g.level, g.place, g.size, g.seen, g.proof)
SELECT n.doc_id, n.leaf, s.subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.seen AS folded_root, g.seen = r.digest AS verified
FROM n JOIN s ON s.tree = n.tree JOIN g ON g.doc_id = n.doc_id AND g.size = 1 CROSS JOIN (SELECT digest FROM top WHERE size = 1) AS r
"""
}
