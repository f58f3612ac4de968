"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over whole texts gives each document a short vector of transformed shares (capitals, symbols, repeats, ...). Class means and
covariances come from moment sums over all labelled training rows, which add up over tasks; each class covariance is shrunk towards
the pooled one and that towards its diagonal, so rare classes and constant statistics stay invertible. A score is the logistic of the
difference of two log densities, each a Mahalanobis distance through its class's Cholesky factor, which is computed once and kept.

Labels, lang, source and doc_id are never inputs of a score; labels are read only for rows outside the held-out fold.

Defined cases: a null text counts as empty and is scored like any other; a null doc_id is in the held-out fold and is never joined to a
label; null labels are left out; repeated label rows count as often as they are there; without labels of both classes every score is
0.5; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
STATISTICS = ("log_words", "word_bytes", "word_spread", "capitals", "symbols", "stops", "repeats", "variety", "lines", "marks")

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_CLASS[list(b".,'\"-")] = 3
_CLASS[10] = 5


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a block."""

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    kind = _CLASS[raw]
    n = np.diff(offs).astype(float)
    upper, lower, stops, symbols, lines = (per_text(kind == k, offs) for k in range(1, 6))
    starts, ends, first = _text.words(raw, offs)
    count = np.diff(first).astype(float)
    length = (ends - starts).astype(float)
    hashes = _text.word_hashes(raw, starts, ends)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = False
    of = _text.spread(np.diff(first))
    own = np.sort((hashes & np.uint64((1 << 44) - 1)) | (of.astype(np.uint64) << np.uint64(44)))
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = own[1:] != own[:-1]
    distinct = per_text(fresh, first)
    marked = per_text(_CLASS[raw[ends - 1]] == 4 if len(ends) else np.zeros(0), first)
    words = np.maximum(count, 1)
    mean = per_text(length, first) / words
    spread = np.sqrt(np.maximum(per_text(length**2, first) / words - mean**2, 0))
    letters, size, some = upper + lower + 30, n + 60, count + 6  # shares of short texts lean towards none
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), np.sqrt(upper / letters), np.sqrt(symbols / size), np.sqrt(stops / size),
        np.sqrt(per_text(same, first) / some), np.log1p(distinct) / np.log1p(words), np.sqrt(lines / size), np.sqrt(marked / some),
    ])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text."""
    rows = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(1))
            for a, b, part, at in _text.blocks(raw, offs):
                x = statistics(part, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["doc_id", "stats"])

    return rows.mapInArrow(run, "doc_id long, stats array<double>")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, half log-determinants and log priors of the classes 0 and 1; None: nothing learnt."""

    parts: tuple[tuple[np.ndarray, np.ndarray, float, float], ...] | None

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
        """moments: by class, the count, the sum and the sum of outer products."""
        if set(moments) != {0, 1}:
            return cls(None)
        total = sum(n for n, _, _ in moments.values())
        means = {k: s / n for k, (n, s, _) in moments.items()}
        own = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()}
        pooled = sum(n * own[k] for k, (n, _, _) in moments.items()) / total
        pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled) + 1e-3)
        parts = []
        for k in (0, 1):
            n = moments[k][0]
            # few rows of a class lean on the pooled covariance
            s = max(shrink, 1 / (1 + n / (10 * len(pooled))))
            lower = np.linalg.cholesky((1 - s) * own[k] + s * pooled)
            parts.append((means[k], np.linalg.inv(lower), float(np.log(np.diag(lower)).sum()), float(np.log(n / total))))
        return cls(tuple(parts))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        low, high = (prior - half - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half, prior in self.parts)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def learned(stats: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, **options) -> Discriminant:
    """Fitted on all labelled rows outside the held-out fold, by moment sums that tasks add up."""
    width = len(STATISTICS)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    rows = stats.join(marks.filter(fold(F.col("doc_id"), folds) != held_out), "doc_id").select("label", "stats")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(1 + width + width * width) for k in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for k in (0, 1):
                own = x[label == k]
                held[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k, v in held.items():
            if v[0]:
                yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(v), pa.int32()), "at": pa.array(np.arange(len(v)), pa.int32()), "v": v})

    cells = rows.mapInArrow(sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in cells.collect():  # two classes by 1 + width + width squared numbers
        found.setdefault(r["label"], np.zeros(1 + width + width * width))[r["at"]] = r["v"]
    return Discriminant.fit({k: (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)) for k, v in found.items()}, **options)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    stats = _text.materialise(described(docs, id_col, text_col))
    model = learned(stats, labels, folds, held_out)
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    out = _text.few(stats).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject; each row is scored where it is, in one more pass over its text."""
    model = learned(_text.materialise(described(docs, id_col, text_col)), labels)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(at))
            for a, b, part, own in _text.blocks(raw, offs):
                yield batch.slice(a, b - a).filter(pa.array(model.score(statistics(part, own)) >= threshold))

    return _text.compacted(docs).mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_text.table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
