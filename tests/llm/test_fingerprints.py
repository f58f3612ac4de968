"""Fingerprints against plain Python: the same hashes, exact neighbours, estimates within their error."""

import base64
import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import _text, fingerprints

SF = "/root/testdata/sf0.001"


def shingles(text, n=fingerprints.N):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def hashed(shingle):
    h = 42
    for w in shingle:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text, k=fingerprints.K):
    return sorted({hashed(s) for s in shingles(text)})[:k]


def printed(values):
    return base64.b64encode(b"".join((v & (1 << 64) - 1).to_bytes(8, "big") for v in values)).decode()


def likeness(a, b, k=fingerprints.K):
    both = sorted({*a, *b})[:k]
    return sum(x in set(a) & set(b) for x in both) / len(both) if both else 1.0


def edit(text, other):
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def expected(rows):
    """rows: (doc_id, text). What the query gives, by its docstring."""
    least = {}
    for i, t in rows:
        t = t or ""
        least[i] = min(least.get(i, t), t, key=lambda x: x.encode())
    order = sorted((i for i in least if i is not None), reverse=True) + [None] * (None in least)
    following = {i: least[order[(at + 1) % len(order)]] for at, i in enumerate(order)}
    out = []
    for i, t in rows:
        t, other = t or "", following[i]
        new = edit(t, other)
        a, b = sketch(t), sketch(new)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, sketch(other))))
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def run(spark, rows, tmp_path, schema="doc_id long, text string, lang string, block string, sketch int"):
    spark.createDataFrame([(*r, None, "b", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in fingerprints.op12_fingerprints(spark, str(tmp_path)).select(*COLUMNS).collect()]


def test_whole_table_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = fingerprints.op12_fingerprints(spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(expected(docs))


@pytest.mark.parametrize("ids", [[7], [0, 255, 256, 511, 70_000, 1 << 40, (1 << 63) - 1], [-1, 0, 1, -300, 300, -(1 << 50)], [5, 5, 5, 4, 4, 900], [None, 3, 2], [None, None], []], ids=str)
def test_neighbours_of_any_ids(spark, tmp_path, ids):
    texts = ["a b c d e f g", "", None, " one\ttwo\r\nthree ", "é b c d e f g h é", "x", "  "]
    rows = [(i, texts[n % len(texts)]) for n, i in enumerate(ids)]
    key = lambda r: repr(r)
    assert sorted(run(spark, rows, tmp_path), key=key) == sorted(expected(rows), key=key)


def test_long_texts_are_sketched_in_parts(spark, monkeypatch):
    text = " ".join(f"w{i % 977}-{i % 61}" for i in range(1000))
    monkeypatch.setattr(fingerprints, "PART", 64)
    for cut in (64, 66, 67, 68, 69, 128, 1000):
        part = " ".join(text.split()[:cut])
        got = fingerprints.with_sketch(spark.createDataFrame([(part,)], "t string"), "t", "s").first()["s"]
        assert got == sketch(part)


def test_sketches_merge_and_estimate(spark):
    words = [f"word{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
    row = df.select(fingerprints.resemblance(F.col("sa"), F.col("sb")), fingerprints.containment(F.col("sa"), F.col("sb")), fingerprints.distinct(F.col("sa")), fingerprints.sketch_of(fingerprints.fingerprint(F.col("sa"))), "sa", fingerprints.merged(F.col("sa"), F.col("sb")), "sb").first()
    assert abs(row[0] - 1 / 3) < 0.1 and abs(row[1] - 0.5) < 0.12 and abs(row[2] / 3996 - 1) < 0.2
    assert row[3] == row[4] and row[5] == sorted({*row[4], *row[6]})[: fingerprints.K]


def test_merged_by_groups(spark):
    rows = [("x", "a b c d e f"), ("x", "a b c d e g"), ("y", ""), (None, "q r s"), ("x", "a b c d e f")]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "g string, t string"), "t", "s")
    got = {r[0]: r[1] for r in fingerprints.merged_by(df, ["g"], "s").collect()}
    assert got == {"x": sorted({*sketch(rows[0][1]), *sketch(rows[1][1])}), "y": [], None: sketch("q r s")}
    small = {r[0]: r[1] for r in fingerprints.merged_by(df, ["g"], "s", 1).collect()}
    assert small["x"] == sorted({*sketch(rows[0][1]), *sketch(rows[1][1])})[:1]


def test_no_python_on_the_main_path(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = fingerprints.op12_fingerprints(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    _text.Scratch().clear()
