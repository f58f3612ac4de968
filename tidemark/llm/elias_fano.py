"""Elias-Fano sequences over memory-mapped arrays, with vectorised selects and successor search, and the files they lie in.

A monotone sequence of n values up to u keeps the low ``l = floor(log2(u / n))`` bits of each value packed, and the high parts as a bit
vector: a one for every value and a zero after each high part. With the ones before each 64-bit word as a directory, a value is found by
its place (a select of ones), and the values that share a high part by two selects of zeros.
"""

from __future__ import annotations

import json
import mmap
import os
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np

_NTH = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    for _i, _bit in enumerate(k for k in range(8) if _b >> k & 1):
        _NTH[_b, _i] = _bit

U = np.uint64
_EACH, _TOP = U(0x0101010101010101), U(0x8080808080808080)


def pack_low(low: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after another in 64-bit words, with one word to spare."""
    out = np.zeros((len(low) * width >> 6) + 2, dtype=np.uint64)
    if not width or not len(low):
        return out
    bit = np.arange(len(low), dtype=np.int64) * width
    word, off = bit >> 6, (bit & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(low << off, first)
    over = (bit & 63) + width > 64
    out[word[over] + 1] |= low[over] >> (U(64) - off[over])
    return out


def packed_at(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The values at places i of what pack_low made."""
    if not width:
        return np.zeros(len(i), dtype=np.uint64)
    bit = i * width
    if width <= 57:  # eight bytes from any byte on hold it
        octets = np.ndarray(shape=(words.nbytes - 7,), dtype="<u8", buffer=words, strides=(1,))
        return (octets[bit >> 3] >> (bit & 7).astype(np.uint64)) & U((1 << width) - 1)
    word, off = bit >> 6, (bit & 63).astype(np.uint64)
    v = words[word] >> off
    v |= np.where(off > 0, words[word + 1] << ((U(64) - off) & U(63)), U(0))
    return v & U((1 << width) - 1)


def nth_one(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place, in each 64-bit word, of its n-th one: sums of ones byte by byte within the word, then a table for the byte."""
    s = words - ((words >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    sums = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH  # of each byte and all lower ones
    n = n.astype(np.uint64)
    shift = np.bitwise_count((((n * _EACH) | _TOP) - sums) & _TOP).astype(np.uint64) * U(8)  # bytes that end before it
    rest = n - (((sums << U(8)) >> shift) & U(0xFF))
    return (shift + _NTH[((words >> shift) & U(0xFF)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of the sequence of sorted unsigned values below universe."""
    n = len(values)
    width = max(0, int(universe // max(n, 1)).bit_length() - 1)
    high = (values >> U(width)).astype(np.int64)
    last = (universe >> width) + 1
    bits = np.zeros(-(-(n + last + 1) // 64) * 64, dtype=bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.bitwise_count(words), out=ones[1:])
    return {"meta": np.array([n, width], dtype=np.int64), "high": words, "ones": ones.astype(np.uint32), "low": pack_low(values & U((1 << width) - 1), width)}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = "") -> None:
        self.n, self.width = (int(x) for x in arrays[prefix + "meta"][:2])
        self.high, self.ones, self.low = (arrays[prefix + k] for k in ("high", "ones", "low"))

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = word * 64 + nth_one(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << U(self.width)) | packed_at(self.low, self.width, i)

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th zeros."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        return word * 64 + nth_one(~self.high[word], k - zeros[word])

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1 where its successor is another one."""
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        h = (values >> U(self.width)).astype(np.int64)
        b = self.select_zero(h) - h
        a = np.where(h > 0, self.select_zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        return successor(self.low, self.width, a, b, values & U((1 << self.width) - 1))

    def values(self) -> np.ndarray:
        """All values, decoded."""
        bits = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits)[: self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << U(self.width)) | packed_at(self.low, self.width, np.arange(self.n))


def successor(words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, want: np.ndarray, universe: int = 0) -> np.ndarray:
    """The place of each wanted value in its own sorted range [a, b) of packed values, or -1 where its successor is another one.

    With a universe, over which values are taken to spread evenly, long ranges are first narrowed to where the value should be.
    """
    low, top = a.copy(), b.copy()
    if universe and len(long := np.flatnonzero(b - a >= 32)):
        n = b[long] - a[long]
        guess = a[long] + (want[long].astype(np.float64) * n / universe).astype(np.int64)
        reach = (1.5 * np.sqrt(n)).astype(np.int64) + 2
        for probe in (np.maximum(guess - reach, a[long]), np.minimum(guess + reach, b[long] - 1)):
            own = long[(low[long] <= probe) & (probe < top[long])]
            at = probe[(low[long] <= probe) & (probe < top[long])]
            less = packed_at(words, width, at) < want[own]
            low[own[less]] = at[less] + 1
            top[own[~less]] = at[~less]
    todo = np.flatnonzero(low < top)
    while len(todo):
        x, y = low[todo], top[todo]
        mid = (x + y) >> 1
        less = packed_at(words, width, mid) < want[todo]
        x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
        low[todo], top[todo] = x, y
        todo = todo[x < y]
    out = np.full(len(want), -1, dtype=np.int64)
    inside = np.flatnonzero(low < b)
    hit = inside[packed_at(words, width, low[inside]) == want[inside]]
    out[hit] = low[hit]
    return out


class Store:
    """Named sets of arrays in a shared folder, one file a set, each put in place whole, so that a task that runs again does no harm.

    In a folder that can be opened as a path the arrays are mapped into memory; in any other store that Arrow's file systems know, a set
    is read whole. The sets used last stay open, at most ``most`` of them, each without a file descriptor of its own where Python allows.
    """

    def __init__(self, uri: str, most: int = 512) -> None:
        url = urlparse(uri)
        self.path = url.path if url.scheme in ("", "file") else None
        self.uri, self.most, self.open = uri.rstrip("/"), most, OrderedDict()
        if self.path:
            os.makedirs(self.path, exist_ok=True)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": OrderedDict()}

    def _elsewhere(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def save(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        at, listed = 0, []
        for k, v in arrays.items():
            listed.append([k, v.dtype.str, len(v), at])
            at += -(-v.nbytes // 64) * 64
        head = json.dumps(listed).encode()
        head += b" " * (-(8 + len(head)) % 64)
        parts = [len(head).to_bytes(8, "little"), head]
        for v in arrays.values():
            data = np.ascontiguousarray(v).tobytes()
            parts += [data, b"\0" * (-len(data) % 64)]
        if self.path:
            part = f"{self.path}/.{name}.{os.getpid()}"
            with open(part, "wb") as f:
                f.writelines(parts)
            os.replace(part, f"{self.path}/{name}")
        else:
            system, base = self._elsewhere()
            with system.open_output_stream(f"{base}/{name}") as f:
                for p in parts:
                    f.write(p)

    def load(self, name: str) -> dict[str, np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        if self.path:
            with open(f"{self.path}/{name}", "rb") as f:
                try:
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
                except TypeError:  # before Python 3.13
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            system, base = self._elsewhere()
            with system.open_input_file(f"{base}/{name}") as f:
                data = f.read_buffer()
        size = int.from_bytes(bytes(memoryview(data)[:8]), "little")
        listed = json.loads(bytes(memoryview(data)[8 : 8 + size]))
        out = {k: np.frombuffer(data, dtype=t, count=n, offset=8 + size + at) if n else np.zeros(0, dtype=t) for k, t, n, at in listed}
        self.open[name] = out
        if len(self.open) > self.most:
            self.open.popitem(last=False)
        return out

    def remove(self, name: str) -> None:
        self.open.pop(name, None)
        if self.path:
            os.remove(f"{self.path}/{name}")
        else:
            system, base = self._elsewhere()
            system.delete_file(f"{base}/{name}")
