"""Language-model scoring with an Elias-Fano n-gram trie.

The model interpolates trigrams, bigrams and add-one unigrams, each order with the three discounts that its own counts of counts give. All
counts are of all training tokens. The trie has a level an order, each a set of shards in the shared folder that tasks map into memory:

* unigrams: sorted 64-bit word hashes; a word's place is its id. Its count.
* bigrams and trigrams: a monotone Elias-Fano sequence of pointers, where each context (a word, or a bigram's place) has the place at which
  its children end, and the children's words, packed in as many bits as ids take and sorted within their context. A look-up selects its
  context's two pointers and searches the successor of its word between them. Next to the words lie the smoothed probabilities, quantised
  to one byte each with a code book a shard, and next to the pointers the weight that each context leaves to the shorter ones.

Counting leaves sorted, delta-coded blocks a shard, not a row an n-gram, each n-gram with the probability of its shorter context in a
byte (steps of a twentieth of log10), so that smoothing a shard looks nothing up elsewhere; a shard is a range of (context, word) that holds about
``SHARD_TOKENS`` tokens, cut within a context where that one alone is larger. Keys within a block or shard are numbered from its own first
context, so nothing overflows however many n-grams there are. Neither model nor counts ever come to the driver, and no task holds more
than a shard or a block of text; of the mapped shards those used last stay open.

Words are told apart by 64-bit hashes of their bytes (``_text.word_hashes``; cryptographic ones from 64 bytes on): among a billion distinct
words, unless made to collide, two share one in about three corpora of a hundred.

Defined cases: a null or empty text is one end token; a null doc_id is not in fold 2 and so trains; repeated rows count each time; an
empty table, or one without training rows, gives a model of no words (N = V = 0, every word unknown); other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text, elias_fano
from tidemark.llm.ngram_join import grouped

FOLDS, HELD_OUT = 7, 2
ORDER = 3
SHARD_TOKENS = 2_000_000
#: Text whose n-grams are looked up together: fewer, larger look-ups in each shard.
BLOCK_BYTES = 2 << 20
#: N-grams that a counting task gathers before it counts them.
GATHERED = 2_000_000
#: Steps of log10 a unit in which the shorter context's probability travels with a counted n-gram: 256 of them reach to 10 ** -12.75.
STEPS = 20
#: The hash that stands for the end token.
END = np.uint64(0x45D9F3B3335B369D)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the texts' offsets among them."""
    raw = _text.lower_ascii(raw)
    starts, ends, first = _text.words(raw, offs)
    out = np.full(len(starts) + len(offs) - 1, END, dtype=np.uint64)
    out[np.arange(len(starts)) + _text.spread(np.diff(first))] = _text.word_hashes(raw, starts, ends)
    return out, first + np.arange(len(offs))


def pack(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray | None = None) -> bytes:
    """Sorted keys, their counts and codes, delta-coded in planes of bytes and compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    codes = np.zeros(len(keys), dtype=np.uint8) if codes is None else codes
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.vstack([steps, counts.astype("<u4").view(np.uint8).reshape(-1, 4).T, codes])).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(13, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(planes[8:12].T).view("<u4").ravel(), planes[12]


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts, codes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first), codes[order[first]]


def first_at(context: np.ndarray, word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where in sorted (context, word) pairs each bound (context, word) falls."""
    out = np.searchsorted(context, bounds[:, 0])
    for i in np.flatnonzero(bounds[:, 1] > 0):  # a context that is cut
        end = int(np.searchsorted(context, bounds[i, 0], side="right"))
        out[i] += np.searchsorted(word[out[i] : end], bounds[i, 1])
    return out


class Counter:
    """Counts (context, word) pairs, words below size, in bounded memory and gives them out by shard, numbered from the shard's first context."""

    def __init__(self, bounds: np.ndarray, size: int) -> None:
        self.bounds, self.size, self.held, self.many = bounds, size, [], 0

    def add(self, context: np.ndarray, word: np.ndarray, shorter: np.ndarray) -> Iterator[pa.RecordBatch]:
        """shorter: log10 of each word's probability after the shorter context, the same wherever a pair occurs."""
        self.held.append((context, (word << 8) | np.clip(np.round(shorter * -STEPS), 0, 255).astype(np.int64)))
        self.many += len(word)
        if self.many > GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.many:
            return
        distinct, place = sorted_distinct(np.concatenate([c for c, _ in self.held]))
        keys = place * np.int64(self.size << 8)
        at = 0
        for _, w in self.held:
            keys[at : at + len(w)] += w
            at += len(w)
        self.held, self.many = [], 0
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.diff(np.append(first, len(keys)))
        codes = (keys & 255).astype(np.uint8)
        context, word = np.divmod(keys >> 8, self.size)
        context = distinct[context]
        cuts = [0, *first_at(context, word, self.bounds).tolist(), len(keys)]
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                low = int(self.bounds[s - 1, 0]) if s else 0
                block = pack(((context[a:b] - low) * self.size + word[a:b]).astype(np.uint64), counts[a:b], codes[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])


class WordCounter:
    """Counts word hashes in bounded memory and gives them out by shard."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.bounds, self.held, self.many = bounds, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.many += len(hashes)
        if self.many > GATHERED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.many:
            return
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.many = [], 0
        cuts = [0, *np.searchsorted(keys, self.bounds), len(keys)]
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(keys[a:b], counts[a:b])], pa.binary())], ["shard", "block"])


def shards(blocks: DataFrame, many: int) -> DataFrame:
    return blocks.repartition(min(many, 4096), "shard").sortWithinPartitions("shard")


def sorted_distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them; hashing first, since only the distinct ones are sorted."""
    codes, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], place[codes]


class Places:
    """What stands at each token: distinct ids, sorted, and each token's place among them (-1: none)."""

    def __init__(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.at = ids, at

    @classmethod
    def of(cls, ids: np.ndarray, back: np.ndarray) -> Places:
        """From ids that rise but for -1s among them, and tokens' places in these."""
        some = ids >= 0
        return cls(ids[some], np.where(some, np.cumsum(some, dtype=np.int32) - 1, np.int32(-1))[back])

    def before(self, starts: np.ndarray, first: int) -> Places:
        """What stands before each token; before a text's first one, the id at place ``first``."""
        at = np.empty_like(self.at)
        at[1:] = self.at[:-1]
        at[starts] = first
        return Places(self.ids, at)


class Vocabulary:
    """Ids and counts of words, from mapped shards by the hash's range."""

    def __init__(self, store: elias_fano.Store, bounds: np.ndarray, bases: np.ndarray) -> None:
        self.store, self.bounds, self.bases = store, bounds, bases

    def shard(self, s: int) -> dict[str, np.ndarray]:
        return self.store.load(f"words-{s}")

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, Places]:
        """Ids (-1: unknown) and counts of hashes in any order, and their places."""
        distinct, back = sorted_distinct(hashes)
        ids = np.full(len(distinct), -1, dtype=np.int64)
        counts = np.zeros(len(distinct), dtype=np.int64)
        cuts = [0, *np.searchsorted(distinct, self.bounds), len(distinct)]
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b or self.bases[s + 1] == self.bases[s]:
                continue
            own = self.shard(s)
            at = np.minimum(np.searchsorted(own["keys"], distinct[a:b]), len(own["keys"]) - 1)
            hit = own["keys"][at] == distinct[a:b]
            ids[a:b] = np.where(hit, at + self.bases[s], -1)
            counts[a:b] = np.where(hit, own["counts"][at], 0)
        return ids[back], counts[back], Places.of(ids, back)

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.bases, ids, side="right") - 1
        out = np.zeros(len(ids), dtype=np.int64)
        for s in np.unique(shard):
            own = shard == s
            out[own] = self.shard(int(s))["counts"][ids[own] - self.bases[s]]
        return out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offs = _text.text_bytes(batch.column(batch.num_columns - 1))
        for a, b, part, own in _text.blocks(raw, offs, BLOCK_BYTES):
            yield batch.slice(a, b - a), *tokens(part, own)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and their code book: means over 256 equal steps of the range, or the values themselves if there are no more.

    No value is off by more than a step, a 256th of the range; groups of equal size would leave the sparse ends far coarser.
    """
    book = np.unique(values[:: max(1, len(values) // 4096)].astype(np.float32))
    if len(book) <= 256:
        book, codes = np.unique(values.astype(np.float32), return_inverse=True)
    if len(book) > 256:
        low, high = values.min(), values.max()
        codes = np.minimum((values - low) * (256 / (high - low)), 255).astype(np.int64)
        book = np.bincount(codes, weights=values, minlength=256) / np.maximum(np.bincount(codes, minlength=256), 1)
    return codes.astype(np.uint8), book.astype(np.float32)


def small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each, and the places and values of those that need more."""
    over = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "over_at": over, "over": counts[over]}


def whole_counts(own: dict[str, np.ndarray], places: np.ndarray) -> np.ndarray:
    out = np.asarray(own["counts"][places], dtype=np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = own["over"][np.searchsorted(own["over_at"], places[large])]
    return out


class Level:
    """The n-grams of one order over two: pointers, words, probabilities and contexts' weights, from mapped shards by range."""

    def __init__(self, store: elias_fano.Store, order: int, size: int, bounds: np.ndarray) -> None:
        self.store, self.order, self.size, self.bounds = store, order, size, bounds
        self.shards = np.zeros(0, dtype=np.int64)  # those that hold anything, the ids before each, and their first contexts
        self.bases, self.firsts = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def name(self, kind: str, s: int) -> str:
        return f"{kind}{self.order}-{s}"

    def known(self, stats: list[dict]) -> None:
        stats = sorted(stats, key=lambda r: r["shard"])
        self.shards = np.array([r["shard"] for r in stats], dtype=np.int64)
        self.bases = np.concatenate([[0], np.cumsum([r["grams"] for r in stats])]).astype(np.int64)
        self.firsts = np.array([r["first"] for r in stats], dtype=np.int64)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) of sorted distinct (context, word) pairs, and log10 of their probabilities."""
        ids = np.full(len(word), -1, dtype=np.int64)
        prob = np.zeros(len(word))
        cuts = np.concatenate([[0], first_at(context, word, self.bounds), [len(word)]])
        for nth, s in enumerate(self.shards.tolist()):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a == b:
                continue
            own = self.store.load(self.name("index", s))
            _, contexts, first, width = own["meta"].tolist()
            a, b = a + int(np.searchsorted(context[a:b], first)), a + int(np.searchsorted(context[a:b], first + contexts))
            if a == b:
                continue
            change = np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]])
            at, many = context[a:b][change] - first, np.diff(np.append(np.flatnonzero(change), b - a))
            pointers = elias_fano.Sequence(own, "pointer.")
            start = np.where(at > 0, pointers.at(np.maximum(at - 1, 0)), np.uint64(0)).astype(np.int64)
            end = pointers.at(at).astype(np.int64)
            place = elias_fano.successor(own["words"], width, np.repeat(start, many), np.repeat(end, many), word[a:b].astype(np.uint64), self.size)
            hit = np.flatnonzero(place >= 0)
            ids[a + hit] = place[hit] + self.bases[nth]
            own = self.store.load(self.name("values", s))
            prob[a + hit] = own["book"][own["codes"][place[hit]]]
        return ids, prob

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the mass that sorted contexts leave to shorter ones. Any shard that has a context has its weight."""
        out = np.zeros(len(contexts))
        nth = np.searchsorted(self.firsts, contexts, side="right") - 1
        cuts = np.searchsorted(nth, np.arange(len(self.shards) + 1))
        for k in np.unique(nth[nth >= 0]).tolist():
            a, b = int(cuts[k]), int(cuts[k + 1])
            own = self.store.load(self.name("values", int(self.shards[k])))["weights"]
            at = contexts[a:b] - self.firsts[k]
            there = at < len(own)
            out[a:b][there] = own[at[there]]
        return out

    def pieces(self, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) of the ids from first to last."""
        for k in range(int(np.searchsorted(self.bases, first, side="right")) - 1, len(self.shards)):
            if self.bases[k] > last:
                break
            yield int(self.shards[k]), max(0, first - int(self.bases[k])), min(int(self.bases[k + 1]), last + 1) - int(self.bases[k])

    def counts_in(self, first: int, last: int) -> np.ndarray:
        return np.concatenate([whole_counts(self.store.load(self.name("counts", s)), np.arange(a, b)) for s, a, b in self.pieces(first, last)])


class Trie:
    """All levels, as tasks see them."""

    def __init__(self, words: Vocabulary, total: int) -> None:
        self.words, self.total, self.size, self.levels = words, total, int(words.bases[-1]), []

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.size + 1)

    def step(self, level: Level, before: Places, ids: np.ndarray, shorter: np.ndarray) -> tuple[Places, np.ndarray]:
        """Each token's n-gram and log10 of its probability: its own, or the context's weight times the shorter context's.

        Where a context is known, an unknown word is looked up as word 0, for its context's weight alone.
        """
        some = np.flatnonzero(before.at >= 0)
        pairs, back = sorted_distinct(before.at[some] * np.int64(self.size) + np.maximum(ids[some], 0))
        nth, word = np.divmod(pairs, self.size)
        found, prob = level.find(before.ids[nth], word)
        weight = level.weights(before.ids)[nth]
        known = ids[some] >= 0
        grams, out = Places.of(found, back), shorter.copy()
        at = np.full(len(ids), -1, dtype=np.int32)
        at[some] = np.where(known, grams.at, np.int32(-1))
        out[some] = np.where(known & (found >= 0)[back], prob[back], out[some] + weight[back])
        return Places(grams.ids, at), out

    def steps(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Places, np.ndarray]]:
        """For each order from one on: ids and counts of tokens, the contexts that the next order has, log10 of each token's probability.

        A longer context starts where the text has one; before the first word stands an end.
        """
        ids, counts, places = self.words.look_up(hashes)
        out = np.log10(self.unigram(counts))
        before = places.before(at[:-1], int(places.at[at[-1] - 1]) if len(at) > 1 else -1)
        yield ids, counts, before, out
        for level in self.levels:
            grams, out = self.step(level, before, ids, out)
            before = grams.before(at[:-1], -1)
            yield ids, counts, before, out


def like_parts(counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Where contexts with these counts are cut into parts of about so many tokens: their places, and how far inside each."""
    so_far = np.cumsum(counts)
    parts = max(1, round(int(so_far[-1]) / tokens))
    aims = so_far[-1] * np.arange(parts) // parts
    at = np.searchsorted(so_far, aims, side="right")
    return at, (aims - (so_far[at] - counts[at])) / counts[at]


def bounds_of(stats: list[dict], bases: dict[int, int], size: int) -> np.ndarray:
    """The (context, word) pairs at which the next level's shards begin, after the first one."""
    cuts = {(bases[r["shard"]] + i, int(f * size)) for r in stats for i, f in zip(r["at"], r["inside"], strict=True)}
    return np.array(sorted(cuts - {(0, 0)}), dtype=np.int64).reshape(-1, 2)


_CUTS = "at array<long>, inside array<double>"


def _cut_columns(counts: np.ndarray, tokens: int) -> list[pa.Array]:
    at, inside = like_parts(counts, tokens)
    return [pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([inside.tolist()], pa.list_(pa.float64()))]


def count_words(docs: DataFrame, bounds: np.ndarray, store: elias_fano.Store, shard_tokens: int) -> list[dict]:
    """Writes the unigram shards; of each its number of words, of tokens, and the places that cut its contexts into like parts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(bounds)
        for _, hashes, _ in blocks_of(batches):
            yield from counter.add(hashes)
        yield from counter.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "shard"):
            s = table["shard"][0].as_py()
            keys, counts, _ = merged([unpack(x) for x in table["block"].to_pylist()])
            store.save(f"words-{s}", {"keys": keys, "counts": counts})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), *_cut_columns(counts, shard_tokens)], ["shard", "words", "tokens", "at", "inside"])

    out = shards(docs.select("text").mapInArrow(gather, "shard int, block binary"), len(bounds) + 1).mapInArrow(write, f"shard int, words long, tokens long, {_CUTS}")
    return [r.asDict() for r in out.collect()]  # a few numbers a shard


def discounts(kinds: np.ndarray) -> np.ndarray:
    """What is taken from counts of 1, 2 and 3 or more, from how many pairs have counts of 1, 2, 3 and 4."""
    n = np.maximum(kinds.astype(float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    own = np.array([k - (k + 1) * y * n[k] / n[k - 1] if kinds[k - 1] else 0.5 * k for k in (1, 2, 3)])
    return np.clip(own, [0.1, 0.2, 0.3], [0.999, 1.9, 2.9])


def trained(docs: DataFrame, store: elias_fano.Store, order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """The trie of all texts of docs (column text), built in one shuffle of counted blocks a level."""
    pieces = min(4096, max(8, docs.rdd.getNumPartitions()))
    word_bounds = np.array([(i << 64) // pieces for i in range(1, pieces)], dtype=np.uint64)
    stats = count_words(docs, word_bounds, store, shard_tokens)
    bases = np.zeros(pieces + 1, dtype=np.int64)
    for r in stats:
        bases[r["shard"] + 1] = r["words"]
    bases = np.cumsum(bases)
    trie = Trie(Vocabulary(store, word_bounds, bases), sum(r["tokens"] for r in stats))
    if not trie.size:
        return trie
    starts = {r["shard"]: int(bases[r["shard"]]) for r in stats}
    for k in range(2, order + 1):
        level = Level(store, k, trie.size, bounds_of(stats, starts, trie.size))
        stats = count_grams(docs, trie, level, shard_tokens)
        level.known(stats)
        starts = dict(zip(level.shards.tolist(), level.bases.tolist(), strict=False))
        if stats:
            smooth(docs.sparkSession, trie, level, stats)
            trie.levels.append(level)
    for level in trie.levels:  # counts have done their work
        for s in level.shards.tolist():
            store.remove(level.name("counts", s))
    return trie


def count_grams(docs: DataFrame, trie: Trie, level: Level, shard_tokens: int) -> list[dict]:
    """Writes a level's keys and counts; of each shard what the driver must know, a few numbers."""
    size, bounds = trie.size, level.bounds

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bounds, size)
        for _, hashes, at in blocks_of(batches):
            for ids, _, before, shorter in trie.steps(hashes, at):  # the last one counts
                pass
            some = before.at >= 0
            yield from counter.add(before.ids[before.at[some]], ids[some], shorter[some])
        yield from counter.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "shard"):
            s = table["shard"][0].as_py()
            keys, counts, codes = merged([unpack(x) for x in table["block"].to_pylist()])
            context, word = np.divmod(keys.astype(np.int64), size)
            context += int(bounds[s - 1, 0]) if s else 0
            first, width = int(context[0]), max(1, (size - 1).bit_length())
            ends = np.cumsum(np.bincount(context - first)).astype(np.uint64)
            arrays = {f"pointer.{k}": v for k, v in elias_fano.encode(ends, len(keys) + 1).items()}
            arrays |= {"meta": np.array([len(keys), len(ends), first, width], dtype=np.int64), "words": elias_fano.pack_low(word.astype(np.uint64), width)}
            level.store.save(level.name("index", s), arrays)
            level.store.save(level.name("counts", s), small_counts(counts) | {"shorter": codes})
            kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            edges = [[v, *(int(((context == v) & m).sum()) for m in (counts == 1, counts == 2, counts > 2))] for v in sorted({first, int(context[-1])})]
            own = [pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([first], pa.int64()), pa.array([kinds], pa.list_(pa.int64())), pa.array([edges], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*own, *_cut_columns(counts, shard_tokens)], ["shard", "grams", "first", "kinds", "edges", "at", "inside"])

    blocks = docs.select("text").mapInArrow(gather, "shard int, block binary")
    out = shards(blocks, len(bounds) + 1).mapInArrow(write, f"shard int, grams long, first long, kinds array<long>, edges array<array<long>>, {_CUTS}")
    return [r.asDict() for r in out.collect()]


def smooth(spark: SparkSession, trie: Trie, level: Level, stats: list[dict]) -> None:
    """Writes a level's probabilities and weights, from its counts, its contexts' counts and the probabilities of the level below."""
    taken = discounts(np.sum([r["kinds"] for r in stats], axis=0))
    shared: dict[int, np.ndarray] = {}  # contexts at a shard's edge may go on in the next one
    for r in stats:
        for v, *kinds in r["edges"]:
            shared[v] = shared.get(v, np.zeros(3, dtype=np.int64)) + np.array(kinds)
    words, below = trie.words, trie.levels[-1] if trie.levels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                own = level.store.load(level.name("index", s))
                n, _, first, _ = own["meta"].tolist()
                children = np.diff(elias_fano.Sequence(own, "pointer.").values().astype(np.int64), prepend=0)
                context, last = _text.spread(children), first + len(children) - 1
                own = level.store.load(level.name("counts", s))
                counts = whole_counts(own, np.arange(n))
                kind = np.minimum(counts, 3) - 1
                many = np.bincount(context * 3 + kind, minlength=3 * len(children)).reshape(-1, 3)
                for v in (first, last):
                    many[v - first] = shared[v]
                have = np.maximum(below.counts_in(first, last) if below else words.counts_of(np.arange(first, last + 1)), 1)
                weight = np.clip(many @ taken / have, 1e-9, 1)
                prob = (counts - taken[kind]) / have[context] + weight[context] * 10 ** (own["shorter"] / -STEPS)
                codes, book = quantised(np.log10(prob))
                level.store.save(level.name("values", s), {"codes": codes, "book": book, "weights": np.log10(weight).astype(np.float32)})
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], ["shard"])

    rows = spark.createDataFrame([(int(s),) for s in level.shards], "shard int").repartition(min(4096, max(1, len(level.shards))), "shard")
    rows.mapInArrow(run, "shard int").count()


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    rows = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    store = elias_fano.Store(_text.shared_dir(docs.sparkSession))
    trie = trained(rows.filter("not held_out").select("text"), store, order, shard_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, at in blocks_of(batches):
            base = known = None
            for _, counts, _, last in trie.steps(hashes, at):
                if base is None:
                    base, known = np.add.reduceat(last, at[:-1]), np.add.reduceat((counts > 0).astype(np.int64), at[:-1])
            own = np.add.reduceat(last, at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(known), pa.array(np.full(len(base), trie.total)), pa.array(base), pa.array(own)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_text.table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_scoring": op9_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
