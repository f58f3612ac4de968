"""Packing documents into sequences of at most ``capacity`` tokens by the linear grouping scheme.

One pass tokenises every whole text (each distinct word of a task once) and cuts what is longer than a sequence; it leaves one narrow
row a piece. All that packing needs is the histogram of piece lengths, of at most ``capacity`` entries at any input size, so the plan
is made on the driver: large lengths are sorted and rounded up within groups of equal cardinality, few-size configurations are
optimised by column generation, actual pieces are substituted for the rounded ones, and the rest is placed best-fit, longest first.
The plan is a list of intervals (length, ranks from, how many, first sequence, offset), as bounded as the histogram; a piece finds its
interval by its length and its rank among the pieces of that length. Any ranking will do, so each task numbers its own pieces of a length
as it cuts them, and a running sum over tasks gives the rank that each task starts from. Pieces and their ids are never shuffled for it,
however many of them share a length, as long as these starts (one a task and length) fit a broadcast of ``STARTS``; beyond, they are
joined by task and length.

Defined cases: a null or empty text is a document of one token, the end token; repeated rows and repeated or null doc_ids are
documents of their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm import _text

CAPACITY = 4096
END_ID = 1
#: Words of which a task keeps the ids; beyond it starts anew.
KEPT_WORDS = 1_000_000
#: Between a letter and one of these marks the tokenizer's pre-tokens always end, so what follows counts as a word of its own.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b".,!?;:%&*#$")] = True
#: Starts of ranks that are broadcast at most, 16 bytes each.
STARTS = 1 << 20


@functools.lru_cache(maxsize=1)
def loaded(path: str):
    """The tokenizer of a file, loaded once a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of whole texts by a tokenizer that splits at white space and drops it: distinct words are encoded once and gathered.

    New words are encoded together, joined by the digit 0, which is a pre-token and an id of its own; words that hold it, and any that
    don't come back in step, are encoded alone.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = loaded(path)
        self.digit = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def folded(self, raw: np.ndarray) -> np.ndarray:
        """ASCII capitals in lower case, as the tokenizer makes them, but before bytes that could compose with them or where special tokens may be."""
        if not len(raw) or (raw == 0x7C).any() and b"<|" in raw.tobytes():
            return raw
        capital = (raw >= 65) & (raw <= 90)
        capital[:-1] &= raw[1:] < 128
        return raw + capital.astype(np.uint8) * np.uint8(32)

    def alone(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        zeros = np.fromiter((b"0" in w for w in words), bool, len(words))
        plain = np.flatnonzero(~zeros)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rest = list(np.flatnonzero(zeros))
        for at in range(0, len(plain), 512):
            own = plain[at : at + 512]
            ids = np.array(self.tokenizer.encode(b" 0 ".join([words[i] for i in own]).decode(), add_special_tokens=False).ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.digit)
            if len(marks) != len(own) - 1:
                rest.extend(own)
                continue
            counts = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
            parts.append((own, counts, ids[ids != self.digit]))
        if rest:
            lists = self.alone([words[i] for i in rest])
            parts.append((np.array(rest), np.array([len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.uint32)))
        order = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, *(p[2] for p in parts)])
        keys = np.concatenate([self.known, hashes[order]])
        sort = np.argsort(keys)
        self.known = keys[sort]
        self.starts = np.concatenate([self.starts, starts])[sort]
        self.counts = np.concatenate([self.counts, counts])[sort]

    def texts(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block one after another, and each text's offset among them."""
        raw = self.folded(raw)
        cuts = np.flatnonzero(LETTER[raw[:-1]] & MARK[raw[1:]]) + 1
        starts, ends, first = _text.words(raw, offs, cuts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        codes, distinct = pd.factorize(_text.word_hashes(raw, starts, ends))
        seen = np.empty(len(distinct), dtype=np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]  # each distinct word's first place
        if len(self.known) > KEPT_WORDS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            data = raw.tobytes()
            self.learn(distinct[new], [data[starts[i] : ends[i]] for i in seen[new]])
            at = np.searchsorted(self.known, distinct)
        counts = self.counts[at][codes]
        before = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=before[1:])
        ids = self.pool[np.repeat(self.starts[at][codes] - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[first]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBERED = PIECES + ", part int, nth long"


def numbered(lengths: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """Each length's number among the equal ones, from so_far on, which is moved on."""
    order = np.argsort(lengths, kind="stable")
    many = np.bincount(lengths, minlength=len(so_far))
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(so_far, many)
    so_far += many
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs, numbered (nth) among those of its length in its task (part); with_ids adds the ids as
    little-endian unsigned 32-bit integers."""
    rows = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_no = WordEncoder(tokenizer), TaskContext.get().partitionId()
        so_far = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            raw, offs = _text.text_bytes(batch.column(1))
            for a, b, part, at in _text.blocks(raw, offs):
                ids, place = encoder.texts(part, at)
                data = ids.astype("<u4").tobytes()
                row, nth, start, length, crc, held = [], [], [], [], [], []
                for i in range(b - a):
                    own = data[4 * place[i] : 4 * place[i + 1]] + END_ID.to_bytes(4, "little")
                    for k, s in enumerate(range(0, len(own), 4 * capacity)):
                        cut = own[s : s + 4 * capacity]
                        row.append(a + i)
                        nth.append(k)
                        start.append(s // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            held.append(cut)
                out = [batch.column(0).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                out += [pa.array(np.full(len(row), part_no, dtype=np.int32)), pa.array(numbered(np.array(length), so_far))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(held, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return rows.mapInArrow(run, NUMBERED + (", ids binary" if with_ids else ""))


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack, with repeats, of most value."""
    s = np.array(sizes)
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    low = int(s.min())
    order = np.argsort(s)
    s_up, v_up = s[order], values[order]
    fits = np.searchsorted(s_up, np.arange(capacity + 1), side="right")
    for c in range(low, capacity + 1):
        k = fits[c]
        gain = best[c - s_up[:k]] + v_up[:k]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[i], order[i]
        else:
            best[c], took[c] = best[c - 1], -1
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c >= low:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Patterns of few sizes and how often each is used, by column generation on the fractional problem."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    use = demand / np.diag(basis)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = best_pattern(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, pattern.astype(float))
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        step = max(0.0, float(ratio[out]))
        use = np.maximum(use - step * way, 0)
        use[out] = step
        basis[:, out] = pattern
    return [(basis[:, j].astype(np.int64), float(use[j])) for j in range(k) if use[j] > 1e-9]


class Bins:
    """Sequences in runs of like content, and the intervals that say which pieces lie where."""

    def __init__(self, capacity: int, histogram: dict[int, int]) -> None:
        self.capacity, self.left = capacity, dict(histogram)
        self.next = dict.fromkeys(histogram, 0)
        self.intervals: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rests: list[int] = []
        self.count = 0

    def put(self, length: int, run: int, many: int, offset: int) -> None:
        """The next pieces of a length, one in each of many sequences from run on."""
        self.intervals.append((length, self.next[length], many, run, offset))
        self.next[length] += many
        self.left[length] -= many

    def keep(self, rest: int, run: int, many: int) -> None:
        if many and rest:
            if rest not in self.open:
                insort(self.rests, rest)
                self.open[rest] = []
            self.open[rest].append((run, many))

    def fill(self, length: int, run: int, many: int, rest: int) -> int:
        """Pieces of a length into many sequences with that rest, each as full as it gets, while they last; returns how many stay untouched."""
        each = rest // length
        whole = min(many, self.left[length] // each)
        for i in range(each if whole else 0):
            self.put(length, run, whole, self.capacity - rest + i * length)
        self.keep(rest - each * length, run, whole)
        over = self.left[length]
        if whole < many and over:
            for i in range(over):
                self.put(length, run + whole, 1, self.capacity - rest + i * length)
            self.keep(rest - over * length, run + whole, 1)
            whole += 1
        return many - whole

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            i = bisect_left(self.rests, length)
            if i == len(self.rests):
                each = self.capacity // length
                many = -(-self.left[length] // each)
                self.fill(length, self.count, many, self.capacity)
                self.count += many
                return
            rest = self.rests[i]
            run, many = self.open[rest].pop()
            if not self.open[rest]:
                del self.open[rest]
                self.rests.pop(i)
            stay = self.fill(length, run, many, rest)
            self.keep(rest, run + many - stay, stay)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, small: int | None = None) -> tuple[np.ndarray, int]:
    """The intervals (length, first rank, how many, first sequence, offset) that place all pieces, and the number of sequences."""
    small = capacity // 8 if small is None else small
    bins = Bins(capacity, histogram)
    if histogram.get(capacity):
        bins.fill(capacity, 0, histogram[capacity], capacity)
        bins.count = histogram[capacity]
    large = sorted((x for x in histogram if small < x < capacity and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        members: list[list[list[int]]] = [[]]  # of each group, (length, how many), longest first
        room = size = -(-total // min(groups, total))
        for x in large:
            n = histogram[x]
            while n:
                if not room:
                    members.append([])
                    room = size
                took = min(n, room)
                members[-1].append([x, took])
                n, room = n - took, room - took
        sizes = [m[0][0] for m in members]
        demand = np.array([sum(n for _, n in m) for m in members], dtype=float)
        merged = sorted(set(sizes), reverse=True)  # groups of one rounded length are one size
        index = {s: i for i, s in enumerate(merged)}
        need = np.zeros(len(merged))
        items: list[list[list[int]]] = [[] for _ in merged]
        for s, d, m in zip(sizes, demand, members, strict=True):
            need[index[s]] += d
            items[index[s]] += m
        for pattern, use in sorted(configurations(merged, need, capacity), key=lambda x: -x[1]):
            many = int(use + 1e-6)
            runs = [(bins.count, many, 0)] if many else []
            bins.count += many
            for g in np.flatnonzero(pattern):
                for _ in range(pattern[g]):
                    after = []
                    for run, n, used in runs:  # the group's actual pieces take the slot; a run splits where the length changes
                        while n and items[g]:
                            x, have = items[g][0]
                            took = min(n, have)
                            bins.put(x, run, took, used)
                            after.append((run, took, used + x))
                            run, n = run + took, n - took
                            if took == have:
                                items[g].pop(0)
                            else:
                                items[g][0][1] -= took
                        if n:
                            after.append((run, n, used))
                    runs = after
            for run, n, used in runs:
                bins.keep(capacity - used, run, n)
    for x in sorted((x for x in histogram if bins.left[x]), reverse=True):
        bins.best_fit(x)
    out = np.array(bins.intervals, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], bins.count


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = 64, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, starts: int = STARTS, scratch: _text.Scratch | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with_ids adds the ids, little-endian unsigned 32-bit integers.

    scratch: holds what is written on the way and still read by the result.
    """
    scratch = scratch or _text.Scratch()
    cut = scratch.write(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, id_col, text_col, with_ids), narrow=False)
    tops = scratch.write(cut.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")))
    histogram = {r["length"]: r["n"] for r in tops.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = tops.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    intervals, _ = plan(histogram, capacity, groups)
    held = ["ids"] if with_ids else []
    spark = docs.sparkSession
    if tops.count() <= starts:
        table = bases.toPandas().sort_values(["part", "length"])
        keys = (table["part"].to_numpy().astype(np.int64) << 20) + table["length"].to_numpy()
        shared = spark.sparkContext.broadcast((intervals, keys, table["base"].to_numpy()))
        rows = _text.compacted(cut)
    else:
        shared = spark.sparkContext.broadcast((intervals, None, None))
        rows = cut.join(bases, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("base")).select(*cut.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, base = shared.value
        ends = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, part, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "part", "nth"))
            if keys is not None:
                rank = rank + base[np.searchsorted(keys, (part.astype(np.int64) << 20) + length)]
            own = table[np.searchsorted(ends, (length << 44) + rank, side="right") - 1]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in held]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4]), *kept], [*batch.schema.names[:5], "sequence_id", "offset", *held])

    return rows.mapInArrow(place, f"{PIECES}, sequence_id long, offset long" + (", ids binary" if with_ids else ""))


def digests(packed: DataFrame) -> DataFrame:
    """The contract's columns of packed pieces that carry their ids: the checksum is taken of the ids as placed."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = _text.Scratch()
    return scratch.result(digests(pack(_text.table(spark, sf_dir, "documents"), with_ids=True, scratch=scratch)))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
