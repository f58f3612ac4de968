"""Words, rows and columns keep their identity: crafted long words, repeated ids under colliding fingerprints, clashing names, no leftovers."""

import hashlib
import pathlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _text, exact_dedup, lm_scoring, ngram_join, packing, quality, token_counts

SIZES = [64, 512, 1024, 2048, 4096, 65536]


def twins(n):
    """A Thue-Morse word and its complement: their sums over any odd base agree modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(int(i), t, "s") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, source string")


@pytest.mark.parametrize("n", SIZES)
def test_hashes_tell_twins_apart_wherever_they_stand(n):
    x, y = twins(n)
    raw, offs = _text.text_bytes(pa.array([f"{x} {y} z {x}", f"z {y}"]))
    starts, ends, _ = _text.words(raw, offs)
    h = _text.word_hashes(raw, starts, ends)
    assert h[0] == h[3] != h[1] == h[5] and h[2] == h[4]


@pytest.mark.parametrize("n", SIZES[2:])
def test_ngram_join_keeps_twins_apart(spark, n):
    x, y = twins(n)
    got = ngram_join.near_copies(frame(spark, [f"{x} p q r s t", f"{y} p q r s t"])).collect()
    assert sorted((r["doc_id"], r["rep_id"], r["n_links"]) for r in got) == [(0, 0, 0), (1, 1, 0)]


def test_features_count_twins_as_two_words():
    x, y = twins(1024)
    table = lambda t: quality.statistics(*_text.text_bytes(pa.array([t])))
    assert not np.allclose(table(f"{x} {y}"), table(f"{x} {x}"))


@pytest.mark.parametrize("n", SIZES[2:])
def test_known_words_are_those_of_the_training_rows(spark, n):
    x, y = twins(n)
    fold = lambda want: next(i for i in range(1000) if (zlib.crc32(str(i).encode()) % 7 == 2) == want)
    got = lm_scoring.scored(frame(spark, [f"{x} one", f"{y} two"], [fold(False), fold(True)])).toPandas().set_index("doc_id")
    assert got.n_known[fold(True)] == 1 and got.n_known[fold(False)] == 3  # the end is known


@pytest.mark.parametrize("n", SIZES[2:5])
def test_ids_of_twins_are_the_tokenizers(spark, n):
    from tokenizers import Tokenizer

    x, y = twins(n)
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(f"{x} {y}", add_special_tokens=False).ids + [1]
    got = packing.pack(frame(spark, [f"{x} {y}"])).orderBy("piece").collect()
    data = np.array(ids, dtype="<u4")
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(data[s : s + 4096].tobytes()) for s in range(0, len(ids), 4096)]


@pytest.mark.parametrize("ids", [[3, 3], [None, None], [3, 3, 3, 1], [None, None, 2]], ids=str)
def test_colliding_rows_of_one_id_stay_two(spark, ids):
    texts = ["ab cd", "dc ba", "ab cd", "dc ba"][: len(ids)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = exact_dedup.exact_groups(df, chunk=7, primes=(3, 2)).collect()
    assert {r["text_sha256"]: r["group_size"] for r in got} == {h: texts.count(t) for t in set(texts) for h in [hashlib.sha256(t.encode()).hexdigest()]}
    assert sum(r["kept"] for r in got) == 2


def test_trees_beside_columns_of_their_names(spark):
    docs = frame(spark, ["write to a.b@c.de now", None]).withColumns({"leaf_chars": F.lit("own"), "LEAF_TOKENS": F.lit(1)})
    kept = token_counts.indexed(docs)
    assert kept.columns[-2:] == ["_leaf_chars", "_leaf_tokens"]
    strip = lambda df: sorted(tuple(r[c] for c in ("doc_id", "tokens_before", "n_tokens", "n_chars", "n_edits")) for r in df.collect())
    assert strip(token_counts.recounted(kept, kept_trees=True)) == strip(token_counts.recounted(docs))


@pytest.mark.parametrize("query", [token_counts.op6_token_counts, packing.op10_best_fit_packing])
def test_copies_of_texts_and_ids_are_deleted(spark, query):
    top = re.sub("/[^/]*$", "", _text.shared_dir(spark)).removeprefix("file:")
    folders = lambda: {str(f) for f in pathlib.Path(re.sub("^/+", "/", top)).glob("tidemark-*")}

    before = folders()
    rows = query(spark, "/root/testdata/sf0.001")
    left = folders() - before
    assert rows.count() and {re.sub("^file:/+", "/", p).rsplit("/", 1)[0] for p in rows.inputFiles()} == left
