"""The pipeline's stages against brute force on the smallest tables, each on what its predecessor kept."""

import collections
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        seen[name] = kept.toPandas()
        if name != "packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(seen[name], schema=docs.schema)
    start = docs.toPandas()
    scores = quality.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    assert sorted(seen["quality"].doc_id) == sorted(scores[scores.predicted == 1].doc_id)
    first = {}
    for r in seen["quality"].sort_values("doc_id").itertuples():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(seen["exact_dedup"].doc_id) == sorted(first.values())
    texts = dict(zip(start.doc_id, start.text))
    rows = sorted(seen["exact_dedup"].doc_id)
    sets = {i: frozenset(zip(*[WORD.findall(texts[i])[k:] for k in range(5)])) or frozenset([tuple(WORD.findall(texts[i]))]) for i in rows}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = collections.defaultdict(list)
    for i in rows:
        for g in sets[i]:
            at[g].append(i)
    both = collections.Counter((a, b) for x in at.values() for a in x for b in x if a < b)
    for (a, b), c in both.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert sorted(seen["ngram_join"].doc_id) == sorted({find(i) for i in rows})
    copies = collections.Counter(seen["mixing"].doc_id)
    assert set(copies) <= set(seen["ngram_join"].doc_id) and max(copies.values()) <= 2
    assert collections.Counter(seen["packing"][seen["packing"].piece == 0].doc_id) == copies


PLACED = ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            docs = docs.checkpoint()
    want = sorted(map(tuple, docs.select(*PLACED).collect()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(*PLACED).collect())) == want and len(want) > 100


#: Names that operators use themselves.
EXTRA = ["row", "id", "key", "size", "words", "copies", "sha", "root", "task", "part", "nth", "__id", "__sha", "__keep", "__key"]


def corpus(spark, path, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in EXTRA})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return df


def test_odd_rows_and_clashing_columns_go_through(spark, tmp_path):
    prose = [" ".join(f"word{(i * 7 + k) % 50}" for k in range(60)) + "." for i in range(12)]
    texts = [None, "", "  ", *prose, prose[0], prose[1] + " more", "漢字 " * 30, "x" * 30_000, None]
    rows = [(i, t, None if i == 4 else "en", None if i % 5 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)] + [(3, prose[0], "en", "s1", 1), (None, "an id is missing here", "en", "s0", 1), (None, None, None, None, None)]
    df = corpus(spark, tmp_path, rows, [(None, 1, 0), (5, None, 0)])  # nothing to learn from: all stay
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).checkpoint()
        assert kept.columns == df.columns
        for r in kept.collect():
            for c in EXTRA:
                assert r[c] == f"{c} {'none' if r['doc_id'] is None else r['doc_id']}", (name, c)
        if name == "exact_dedup":
            ids = [r["doc_id"] for r in kept.collect()]
            assert ids.count(0) == 1 and ids.count(3) == 1 and ids.count(None) == 1 and not {1, 15, 19} & set(ids)
        if name == "ngram_join":
            assert 16 not in [r["doc_id"] for r in kept.collect()]
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(packed) and (packed.length <= 4096).all()


def test_an_empty_table_gives_nothing(spark, tmp_path):
    corpus(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == [*PLACED, "sequence_id", "offset"]
