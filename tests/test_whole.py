"""Whole jobs: results over all rows, against brute force or small cases."""

import hashlib
import random
import re
import sys
from itertools import combinations

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import hashing as H
from tidemark.plans import impact, web

SF = "/root/testdata/sf0.001"


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("together", [2048, 5])
def test_near_hashes_are_all_pairs_within_eight_bits(spark, together):
    rng = random.Random(1)
    hashes = {0xF << 60, 0x7FFF << 49}
    for _ in range(12):
        base = rng.getrandbits(64)
        hashes |= {base, base ^ 0x0001000100010001, base ^ 0x0303030300000000}  # a bit in each quarter; eight bits
        hashes |= {base ^ sum(1 << j for j in rng.sample(range(64), k)) for k in range(1, 10) for _ in range(2)}
    ids = {i: f"{h:016x}" for i, h in enumerate(rng.sample(sorted(hashes), len(hashes)))}
    want = sorted((b, a, apart(ids[a], ids[b])) for a, b in combinations(ids, 2) if apart(ids[a], ids[b]) <= 8)
    got = web.near_hashes(spark.createDataFrame(list(ids.items()), "doc_id long, h string"), together)
    assert sorted(map(tuple, got.collect())) == want


def test_near_duplicate_simhash_links_every_near_pair(spark, tmp_path):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    rows = [(i, " ".join([*words[:i % 7], f"other{chr(97 + i % 9)}", *words[i % 7:]])) for i in range(40)] + [(90, "too short"), (91, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), SF):
        hashes = {}
        for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
            if h := H.simhash_of(r["text"]):
                hashes.setdefault(h, []).append(r["doc_id"])
        first = {h: min(ids) for h, ids in hashes.items()}
        want = [(d, first[h], 0) for h, ids in hashes.items() for d in ids if d != first[h]]
        want += [(max(first[a], first[b]), min(first[a], first[b]), apart(a, b)) for a, b in combinations(first, 2) if apart(a, b) <= 8]
        got = sorted(map(tuple, web.near_duplicate_simhash(spark, folder).select("doc_id", "of", "bits").collect()))
        assert got == sorted(want)


def plain_simhash(text):
    """As the reference has it: the volatile pattern tried everywhere, a count and 64 votes a shingle."""
    words = re.findall(K.SKETCH_WORD_PATTERN, re.sub(K.VOLATILE_PATTERN, " ", (text or "").lower(), flags=re.I))
    votes = [0] * 64
    for s in zip(words, words[1:], words[2:]):
        h = int.from_bytes(hashlib.blake2b(" ".join(s).encode(), digest_size=8).digest(), "big")
        votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
    return f"{sum(1 << i for i, v in enumerate(votes) if v > 0):016x}" if len(words) > 2 else ""


def test_simhash_leaves_out_all_that_is_volatile():
    volatile = ["0123456789abcdef", "DEADBEEF" * 2, "2024-01-02T03:04", "2024-01-02 03:04:05", "1234567890", "nonce=a-word-here", "NONCE=\u00e9t\u00e9", "csrf-token=some-word", "c\u017frf=other-word"]
    volatile += ["".join(chr(zero + int(c)) if c.isdigit() else c for c in "2024-01-02 03:04") for zero in (0x660, 0x966, 0xFF10, 0x1D7CE)]
    kept = ["0123456789abcde", "2024-01-02", "123456789", "12345678901234", "nonce", "csrf", "x2024-01-02 03:04", "-'tis", "a-'b", "caf\u00e9 \ud800 na\u00efve"]
    for i, odd in enumerate([*volatile, *kept]):
        text = f"Some plain words, {odd} and then{odd}some more of them\n{odd}"
        assert H.simhash_of(text) == plain_simhash(text)
        assert i >= len(volatile) or H.may_be_volatile(text.lower().encode())
    assert not H.may_be_volatile("plain caf\u00e9, 12345 words of 2024-01".encode())
    digits = {chr(c).encode()[0] for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()}
    assert digits == set(H._DIGIT_LEADS)
    assert {c for c in map(chr, range(128, sys.maxunicode + 1)) if re.fullmatch("[0-9a-fnonce=csrft]", c.lower(), re.I)} == {"\u017f"}


def test_near_duplicate_simhash_hashes_each_text_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    hashed = H.simhash_of

    @F.pandas_udf("string")
    def counting(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return text.map(hashed)

    monkeypatch.setattr(H, "simhash", counting)
    web.near_duplicate_simhash(spark, SF).collect()
    assert seen.value == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_near_hashes_meet_where_their_keys_are(spark):
    same = [(i, f"{i:016x}") for i in range(300)]  # two parts of three are equal in all
    got = web.near_hashes(spark.createDataFrame([*same, (None, f"{300:016x}"), (7, f"{301:016x}")], "doc_id long, h string"), 20)
    assert not re.search("SortMergeJoin|ShuffledHashJoin|NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())  # keyed hashes meet in one shuffle
    pairs = [(*sorted((a, b)), (x ^ y).bit_count()) for (a, x), (b, y) in combinations([*((i, i) for i in range(300)), (7, 301)], 2) if a != b and (x ^ y).bit_count() <= 8]
    assert sorted(map(tuple, got.select("of", "doc_id", "bits").collect())) == sorted(pairs)
    assert web.near_hashes(spark.createDataFrame([], "doc_id long, h string")).collect() == []


@pytest.mark.parametrize("compared", [1, 7, 1 << 20])
def test_near_pairs_are_the_same_in_any_portions(monkeypatch, compared):
    monkeypatch.setattr(H, "_COMPARED", compared)
    rng = random.Random(2)
    base = rng.getrandbits(63)
    x = sorted({base ^ sum(1 << j for j in rng.sample(range(63), k)) for k in (0, 1, 2, 3, 5, 9) for _ in range(6)})
    keyed = pa.Table.from_batches(H.near_keys([pa.record_batch({"doc_id": pa.array(range(len(x))), "x": pa.array(x)})]))
    placed = pa.table({"doc_id": keyed["doc_id"], "x": keyed["x"], "place": keyed["key"], "side": pa.array([2] * len(keyed), pa.int8())})
    got = [tuple(r.values()) for b in H.near_pairs(placed.to_batches(max_chunksize=100)) for r in b.to_pylist()]
    assert sorted(got) == sorted((b, a, apart(f"{x[a]:x}", f"{x[b]:x}")) for a, b in combinations(range(len(x)), 2) if (x[a] ^ x[b]).bit_count() <= 8)
    assert list(H.near_pairs(iter([]))) == []


def test_walk_takes_all_events_and_depths(spark, tmp_path):
    deep = '{"k":' * 12 + "1" + "}" * 12
    spark.createDataFrame([(i, "t", deep if i == 900 else '{"k": 1}', 2.0) for i in (1, 900)], "event_id long, event_type string, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["path"]: (r["n"], r["depth"]) for r in web.variant_walk_all(spark, str(tmp_path)).collect()}
    assert got["$.b[1].v"] == (2, 3) and got["$.a.props.k"] == (2, 3)
    assert got["$.a.props" + ".k" * 12] == (1, 14)
    assert len(got) == 8 + 12


def test_all_orders_and_hosts(spark, tmp_path):
    spark.createDataFrame([(6, "2020-01-02"), (6000, "2021-03-04"), (6005, "2021-03-04")], "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    assert dict(map(tuple, web.shutdown_parse_all(spark, str(tmp_path)).collect())) == {6: "2020-01-02", 6000: "2021-03-04", 6005: None}
    spark.createDataFrame([(i, f"http://h{i % 30}.io/") for i in range(60)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in web.host_counts_all(spark, str(tmp_path)).collect()] == [(f"h{i}.io", 2, i) for i in range(30)]


def line_items(spark, path, rows):
    """rows: (order, part, supplier, flag, status, quantity, ship date); order i is of nation i."""
    spark.createDataFrame([(o, p, s, 1, f, t, q, d) for o, p, s, f, t, q, d in rows], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate string").write.parquet(f"{path}/lineitem.parquet")
    orders = sorted({r[0] for r in rows})
    spark.createDataFrame([(i, i) for i in orders], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, i) for i in orders], "c_custkey long, c_nationkey long").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in orders], "n_nationkey long, n_name string").write.parquet(f"{path}/nation.parquet")


def test_tiers_come_from_all_locations(spark, tmp_path):
    rows = [(1, 1, 1, "A", "O", 50.0, "2020-01-01"), (1, 4, 1, "A", "O", 1.0, "2020-01-01"), (1, 4, 1, "R", "F", 1.0, "2020-02-01"), (1, 5, 1, "R", "F", 1.0, "2020-02-01"), (1, 8, 1, "A", "F", 1.0, "2020-02-01")]
    line_items(spark, tmp_path, rows)
    assert sorted(map(tuple, impact.part_tiers_all(spark, str(tmp_path)).collect())) == [("critical", 2, 2), ("mention-only", 1, 1), ("standard", 1, 2)]


def test_other_courses_come_from_all_sessions(spark, tmp_path):
    line_items(spark, tmp_path, [(1, 1, 7, "A", "O", 1.0, "2020-03-01"), (2, 1, 7, "A", "O", 50.0, "2020-05-01"), (3, 2, 7, "N", "O", 1.0, "2020-12-01"), (3, 2, 8, "N", "O", 1.0, "2020-03-01")])
    got = sorted(tuple(r[c] for c in ("supplier", "course", "others", "radius_elsewhere")) for r in impact.projection_also_in_all(spark, str(tmp_path)).collect())
    assert got == [(7, "N1", 2, 6), (7, "N2", 2, 3), (7, "N3", 2, 7)]


def test_builtin_sketch_is_a_vote_of_shingle_hashes(spark):
    """The sketch of built-in functions against xxHash itself."""
    import re

    import xxhash

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 5) + rng.choice(["", "-x", "'s"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "Two Words", "Three whole words"]

    def sketch(text):
        words = re.findall(r"[a-z][a-z'\-]{2,}", (text or "").lower())
        hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(len(words) - 2)]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return (value - (1 << 64) if value >> 63 else value) if hashes else None

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(H.simhash_native(F.col("t")).alias("h"))
    assert [r["h"] for r in rows.collect()] == [sketch(t) for t in texts]
