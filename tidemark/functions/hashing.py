"""Ids, fingerprints and similarity hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import constants as K


def short_id(*parts: Column, separator: str = "\x1f") -> Column:
    """The first 16 hex digits of the SHA-256 of joined parts; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def dep_id(kind: Column, name: Column) -> Column:
    return short_id(kind, F.lower(name))


def fingerprint(*parts: Column) -> Column:
    return short_id(*parts, separator="|")


def evidence_fingerprint(signal: Column, urls: Column, signals: Column) -> Column:
    """One fingerprint of a finding for scoring and triage alike: its signal, sorted distinct URLs, sorted distinct probe signals."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return fingerprint(signal, joined(urls), joined(signals))


def split_half(key: Column) -> Column:
    """'learn' or 'score' by the parity of the first 8 hex digits of the key's SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 2 == 0, "learn").otherwise("score")


_VOLATILE = re.compile(K.VOLATILE_PATTERN, re.I)
_WORD = re.compile(K.SKETCH_WORD_PATTERN.encode())  # matches ASCII alone, so it finds the same in UTF-8
#: First bytes in UTF-8 of all digits outside ASCII.
_DIGIT_LEADS = b"\xd9\xdb\xdf\xe0\xe1\xea\xef\xf0"
#: Bytes to kinds, a blank for the rest: hex digits; digits, dashes and what may start other digits.
_AS_HEX = bytes(48 if b in b"0123456789abcdef" else 32 for b in range(256))
_AS_DIGITS = bytes(48 if b in b"0123456789" else 33 if b in _DIGIT_LEADS else 45 if b == 45 else 32 for b in range(256))


def may_be_volatile(raw: bytes) -> bool:
    """False for lower-case UTF-8 in which the volatile pattern surely finds nothing: it tries each of its forms at each place, these look for
    what a form can't do without. Another form in the pattern needs its mark here."""
    if b"0" * 16 in raw.translate(_AS_HEX) or b"nonce=" in raw or b"csrf" in raw or "c\u017frf".encode() in raw:  # a long s is an s to re.I
        return True
    digits = raw.translate(_AS_DIGITS)
    return b"0" * 10 in digits or b"0000-00-00" in digits or b"!" in digits


def simhash_of(text: str | None, shingle: int = 3) -> str:
    """64 weighted bit votes over word shingles, as 16 hex digits; empty for too few words."""
    lower = (text or "").lower()
    raw = lower.encode("utf-8", "surrogatepass")
    if may_be_volatile(raw):
        raw = _VOLATILE.sub(" ", lower).encode("utf-8", "surrogatepass")
    words = _WORD.findall(raw)
    if len(words) < shingle:
        return ""
    hashed, digest = hashlib.blake2b, hashlib.blake2b.digest
    digests = b"".join([digest(hashed(b" ".join(s), digest_size=8)) for s in zip(*(words[i:] for i in range(shingle)), strict=False)])
    votes = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(digests) // 8).tobytes().hex()


@F.pandas_udf(StringType())
def simhash(text: pd.Series) -> pd.Series:
    """The keyed hash behind it has no built-in form."""
    return text.map(simhash_of)


def simhash_native(text: Column, shingle: int = 3) -> Column:
    """The same sketch with xxhash64 for the hash, in built-in functions: bit votes of word shingles, as a long; null for too few words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.SKETCH_WORD_PATTERN), 0)
    n = F.size(words) - (shingle - 1)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, shingle), " ")))
    bits = F.sequence(F.lit(0), F.lit(63))
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1))
    value = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.when(vote(b) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))
    return F.when(n > 0, value)


def bits(hex16: Column) -> Column:
    """The 64 bits of 16 hex digits as a signed long."""
    return F.when(F.length(hex16) == 16, F.conv(hex16, 16, -10).cast("long"))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; null if either is missing."""
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


#: Bits of a hash's three parts from the low end: of two hashes at most 8 bits apart, some part is at most 2 apart.
PARTS = ((0, 21), (21, 21), (42, 22))
#: Keys of a hash: each part as it is, and with each one of its bits flipped.
KEYS = sum(n + 1 for _, n in PARTS)
_COMPARED = 1 << 20  # pairs that are compared at once


def near_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, x, key of doc_id, x: the keys of each hash, the part's number above 22 bits of the part's value or one a bit off it."""
    for batch in batches:
        x = batch.column("x").to_numpy()
        keys = [i << 22 | ((x >> low & (1 << n) - 1) ^ m) for i, (low, n) in enumerate(PARTS) for m in (0, *(1 << j for j in range(n)))]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(batch.column("doc_id").to_numpy(), KEYS)), pa.array(np.tile(x, KEYS)), pa.array(np.concatenate(keys))], ["doc_id", "x", "key"])


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, of, bits of doc_id, x, place, side: pairs at most eight bits apart within each place, a key in its low 24 bits. side: 2 where all
    rows of a place meet each other, else 0 or 1, which meet. Of the keys two hashes share, the first such part's makes the link: the one that
    is no bit off both, or else as few bits off the smaller id's as can be."""
    rows = list(batches)
    if not rows:
        return
    doc, x, place, side = (c.to_numpy() for c in pa.Table.from_batches(rows).columns)
    key = place & (1 << 24) - 1
    part = key >> 22
    low, size = (np.array(v)[part] for v in zip(*PARTS, strict=True))
    flip = (x >> low & (1 << size) - 1) ^ (key & (1 << 22) - 1)
    order = np.lexsort((flip, place))
    doc, x, place, side, part, flip = (a[order] for a in (doc, x, place, side, part, flip))
    at, n = np.arange(len(x)), len(x)
    new_place = np.diff(place, prepend=place[:1] - 1) != 0
    ends = lambda new: np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    # two that have the same bit flipped share the part itself, and meet there
    after = np.where(flip == 0, at + 1, ends(new_place | (np.diff(flip, prepend=-1) != 0)))
    met = np.cumsum(ends(new_place) - after)
    begin = 0
    while begin < n:
        done = met[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(met, done + _COMPARED, "right")))
        times = np.diff(met[begin:end], prepend=done)
        a = np.repeat(at[begin:end], times)
        b = np.arange(len(a)) + np.repeat(after[begin:end] - (met[begin:end] - times - done), times)
        begin = end
        bits = np.bitwise_count((x[a] ^ x[b]).view(np.uint64))
        near = bits <= K.SIMHASH_FAR
        a, b, bits = a[near], b[near], bits[near]
        differ = x[a] ^ x[b]
        once = ((side[a] != side[b]) | (side[a] == 2)) & np.where(flip[b] == 0, doc[a] != doc[b], doc[a] < doc[b])
        for i, (first, width) in enumerate(PARTS[:-1]):
            once &= (part[a] <= i) | (np.bitwise_count((differ >> first & (1 << width) - 1).view(np.uint64)) > 2)
        a, b, bits = a[once], b[once], bits[once]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[a], doc[b])), pa.array(np.minimum(doc[a], doc[b])), pa.array(bits.astype(np.int64))], ["doc_id", "of", "bits"])


def row_set_hash(*cols: str) -> Column:
    """Aggregate: a hash of a group's rows that doesn't depend on their order."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256)
