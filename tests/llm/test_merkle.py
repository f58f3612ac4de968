"""The manifest against a plain Merkle tree, on odd tables, several fanouts and superblocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import _text, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, size int, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout=3):
    """The root, and each leaf's siblings, level by level, left to right."""
    proofs, at = ["" for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, j in enumerate(at):
            proofs[i] += "".join(x for k, x in enumerate(leaves) if k // fanout == j // fanout and k != j)
        leaves = [sha("".join(leaves[k : k + fanout])) for k in range(0, len(leaves), fanout)]
        at = [j // fanout for j in at]
    return leaves[0], proofs


def expected(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]], fanout)
    root, above = tree([trees[s][0] for s in sources], fanout) if sources else (None, [])
    for s, up in zip(sources, above, strict=True):
        for r, proof in zip(by[s], trees[s][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None and "\n" in r[4]
            out.append((r[0], leaf(r), trees[s][0], root, sha(proof + up), not hit))
    return out


SOURCES = ["a", "b", "é", None, "", "Z"]
CASES = {
    "many": [(i, "hot" if i % 3 else SOURCES[i % 6], "en", i, f"t{i}\nx" if i % 5 else None) for i in range(900)],
    "powers": [(i, f"s{n}", None, None, "") for n in (1, 2, 3, 4, 9, 10, 27, 28) for i in range(n)],
    "repeated": [(1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "y\n"), (None, "a", None, None, "\n"), (None, None, None, None, None)],
    "one": [(-5, "a", "en", 3, "a\nb")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_query_against_brute_force(spark, tmp_path, case):
    rows = CASES[case]
    spark.createDataFrame([(*r, "own", 1, 1, "own") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified").collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 1), (3, 5), (5, 2)])
def test_superblocks_of_any_shape(spark, fanout, levels):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaved = df.select("doc_id", merkle.tree_of(F.col("source")).alias("tree"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("digest"))
    scratch = _text.Scratch()
    out = merkle.folded(merkle.manifest(leaved, scratch, fanout, levels), "digest", ["doc_id", "digest", "subroot", "root"], fanout)
    got = [(r["doc_id"], r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof_sha256"], r["folded_root"] == r["root"]) for r in out.collect()]
    scratch.clear()
    assert sorted(got) == sorted((*x[:5], True) for x in expected(rows, fanout))
