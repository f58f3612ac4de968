"""Exact dedup by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space; null counts as empty) and cut into chunks. Every chunk gets a
polynomial hash modulo two primes, all chunks of a block of texts in one vectorised pass; chunk hashes combine into the text's
fingerprint by length-shifted arithmetic (``combine``), so a huge document is hashed chunk by chunk, in any grouping, without a copy
of it. Rows whose length and fingerprint agree are then compared chunk by chunk with the row that stays; a row that differs is split
off into the group of its own SHA-256. So the groups are exact whatever the fingerprint does. Groups that hold a large part of all rows
are joined by broadcast (``_text.hot_join``), so their members stay where they are.

Defined cases: null and empty texts are one group; a null doc_id orders after all others; repeated rows each give a row, of which one
is kept; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

CHUNK = 1 << 18
#: Primes below 2**31 and bases: a byte times a power stays below 2**39, and a chunk's sum below 2**63.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1234567891)
#: Members of a group that are compared in one task with one copy of the row that stays.
MEMBERS_A_COPY = 256

WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def squeeze(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes and their offsets."""
    white = _text.SPACE[raw]
    again = np.zeros(len(raw), dtype=bool)
    again[1:] = white[1:] & white[:-1]
    again[offs[:-1][offs[:-1] < len(raw)]] = False
    out = np.where(white, np.uint8(32), raw)[~again]
    sums = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(~again, out=sums[1:])
    return out, sums[offs]


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """The hash of a concatenation from the hashes of its parts: the left one is shifted by the right one's length."""
    return (left * pow(base, right_length, prime) + right) % prime


class Fingerprinter:
    def __init__(self, chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES) -> None:
        self.chunk, self.primes, self.bases = chunk, primes, bases
        self.powers = []
        for p, b in zip(primes, bases, strict=True):
            row = np.empty(chunk, dtype=np.int64)
            x = 1
            for i in range(min(chunk, 1024)):
                row[i] = x
                x = x * b % p
            done = min(chunk, 1024)
            while done < chunk:  # doubling: the powers so far, shifted
                step = min(done, chunk - done)
                row[done : done + step] = row[:step] * pow(b, done, p) % p
                done += step
            self.powers.append(row)

    def chunk_hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of adjoining, non-empty chunks that cover raw."""
        place = np.repeat(ends, ends - starts) - 1 - np.arange(len(raw))
        values = raw.astype(np.int64) + 1
        return [np.add.reduceat(values * row[place], starts) % p for row, p in zip(self.powers, self.primes, strict=True)]

    def texts(self, raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Fingerprints of all texts of a block, one array for each prime."""
        lengths = np.diff(offs)
        parts = -(-lengths // self.chunk)
        of = _text.spread(parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = offs[:-1][of] + nth * self.chunk
        ends = np.minimum(starts + self.chunk, offs[1:][of])
        out = [np.zeros(len(lengths), dtype=np.int64) for _ in self.primes]
        if not len(of):
            return out
        for k, hashes in enumerate(self.chunk_hashes(raw, starts, ends)):
            first = np.cumsum(parts) - parts
            some = parts > 0
            out[k][some] = hashes[first[some]]
            for i in np.flatnonzero(parts > 1):
                h = int(out[k][i])
                for c in range(first[i] + 1, first[i] + parts[i]):
                    h = combine(h, int(hashes[c]), int(ends[c] - starts[c]), self.bases[k], self.primes[k])
                out[k][i] = h
        return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, n_bytes, fp1, fp2, text_sha256 of each row, in one pass over the texts."""
    rows = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(chunk, primes)
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(1))
            for a, b, part, at in _text.blocks(raw, offs):
                part, at = squeeze(part, at)
                view = memoryview(np.ascontiguousarray(part))
                sha = [hashlib.sha256(view[at[i] : at[i + 1]]).hexdigest() for i in range(b - a)]
                fp = maker.texts(part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(fp[0]), pa.array(fp[1]), pa.array(sha)], ["doc_id", "n_bytes", "fp1", "fp2", "text_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, fp1 long, fp2 long, text_sha256 string")


def _chunks(texts: DataFrame, chunk: int) -> DataFrame:
    """doc_id, n_bytes, fp1, fp2, text_sha256, chunk_no, piece: the normalised bytes of each row in chunks, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(batch.num_columns - 1))
            keys = batch.select(range(batch.num_columns - 1))
            for a, b, part, at in _text.blocks(raw, offs):
                part, at = squeeze(part, at)
                data = part.tobytes()
                row, no, piece = [], [], []
                for i in range(b - a):
                    for k, s in enumerate(range(int(at[i]), int(at[i + 1]), chunk)):
                        row.append(a + i)
                        no.append(k)
                        piece.append(data[s : min(s + chunk, int(at[i + 1]))])
                if row:
                    own = keys.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(no, pa.int64()), pa.array(piece, pa.binary())], [*own.schema.names, "chunk_no", "piece"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, fp1 long, fp2 long, text_sha256 string, copies int, keeper boolean, chunk_no long, piece binary")


KEY = ("n_bytes", "fp1", "fp2")


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> F.Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def differing(docs: DataFrame, prints: DataFrame, groups: DataFrame, id_col: str, text_col: str, chunk: int, scratch: _text.Scratch) -> DataFrame:
    """fp key and text_sha256 of the rows that differ from the row that stays in their fingerprint's group: normally none.

    Only rows of groups with more than one member read their texts again. A group's members are dealt out over tasks, and the row that
    stays is copied once for every MEMBERS_A_COPY of them, so neither a large group nor a huge text meets in one task.
    """
    many = groups.filter("n > 1").select(*KEY, F.col("keep.row").alias("keep_row"), F.ceil(F.col("n") / MEMBERS_A_COPY).cast("int").alias("copies"), "n")
    flagged = _text.hot_join(prints, many, list(KEY)).select("doc_id", *KEY, "text_sha256", "copies", (F.col("row") == F.col("keep_row")).alias("keeper"))
    # rows that share doc_id and text are one here; the row that stays is told by its number, as others may have its doc_id
    flagged = scratch.write(flagged.groupBy("doc_id", *KEY, "text_sha256").agg(F.first("copies").alias("copies"), F.max("keeper").alias("keeper")))
    copied = _text.maybe_in(flagged.select(F.xxhash64("doc_id")))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter(copied(F.xxhash64("__id")))
    own = texts.join(flagged, texts["__id"].eqNullSafe(flagged["doc_id"])).filter(F.sha2(normalised(F.col("__text")).cast("binary"), 256) == F.col("text_sha256"))
    pieces = _chunks(own.select("doc_id", *KEY, "text_sha256", "copies", "keeper", "__text"), chunk)
    left = pieces.filter("not keeper").withColumn("salt", F.pmod(F.xxhash64("text_sha256", "doc_id"), F.col("copies")).cast("int"))
    right = pieces.filter("keeper").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = right.select(*KEY, "chunk_no", "salt", F.col("piece").alias("kept_piece"))
    return left.join(right, [*KEY, "chunk_no", "salt"]).filter("piece <> kept_piece").select(*KEY, "text_sha256").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every row of docs."""
    prints = _text.materialise(fingerprints(docs, id_col, text_col, chunk, primes).withColumn("row", F.monotonically_increasing_id()))
    # of equal texts the smallest doc_id stays, of its rows the first one; rows have numbers, which stay once written
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")
    rows, key = prints, list(KEY)
    groups = _text.materialise(rows.groupBy(*key).agg(keep, F.count(F.lit(1)).alias("n")), narrow=True)
    scratch = _text.Scratch()
    apart = _text.materialise(differing(docs, prints, groups, id_col, text_col, chunk, scratch).withColumn("variant", F.col("text_sha256")), narrow=True)
    scratch.clear()
    if not apart.isEmpty():
        rows = prints.join(apart, [*KEY, "text_sha256"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
        key = [*KEY, "variant"]
        groups = _text.materialise(rows.groupBy(*key).agg(keep, F.count(F.lit(1)).alias("n")), narrow=True)
    joined = _text.hot_join(rows, groups.withColumn("group_size", F.col("n")), key)
    return _text.few(joined).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "n_bytes")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = _text.materialise(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), narrow=True)
    # a row whose doc_id no dropped row has stays as it is; only the others' texts are shuffled, to be told apart exactly
    dropped = _text.maybe_in(groups.filter("not kept").select(F.xxhash64("doc_id")))
    own = F.xxhash64(F.col(id_col).cast("long"))
    stays = groups.filter("kept").filter(dropped(F.xxhash64("doc_id"))).select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("keep_sha"))
    rows = docs.filter(dropped(own)).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha"))
    joined = rows.join(stays, rows["id"].eqNullSafe(stays["keep"]) & (rows["sha"] == stays["keep_sha"]))
    joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("sha", "id").orderBy("sha"))).filter("nth = 1")
    return _text.compacted(docs.filter(~dropped(own)).unionByName(joined.select("row.*")), like=docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_text.table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256,
       CAST(strlen(norm) AS BIGINT) AS n_bytes
FROM t WINDOW g AS (PARTITION BY norm)
"""
}
