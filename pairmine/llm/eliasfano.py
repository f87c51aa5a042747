"""Elias-Fano coded sequences and packed levels of an n-gram trie, as arrays that can be memory-mapped.

A sequence of n ascending numbers below u keeps the low l = log2(u / n) bits of each number packed, and the high bits in unary:
number i with high part h sets bit h + i. A ``base`` is taken off all numbers first: of numbers that lie together far from 0 the high
bits would else be nearly the same, so that each search among the low bits would go through many. Zeros before each 64-bit word are counted, so that the place of
the k-th zero or one is a search among the counts and one inside a word. All look-ups are over arrays of queries.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterable

import numpy as np
from pyarrow import fs

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


#: The place of the k-th set bit of a byte, at byte * 8 + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], dtype=np.uint8)
_EACH = np.uint64(0x0101010101010101)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word, from 0: the byte by running sums of the bytes' bits, then a table."""
    k = k.astype(np.uint64)
    two = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
    four = (two & np.uint64(0x3333333333333333)) + ((two >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((four + (four >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte i: set bits of the bytes up to i
    top = np.uint64(0x8080808080808080)
    shift = np.minimum(np.bitwise_count((k * _EACH | top) - sums & top), 7).astype(np.uint64) << np.uint64(3)
    before = (sums << np.uint64(8)) >> shift & np.uint64(255)
    byte = word >> shift & np.uint64(255)
    return (shift + _IN_BYTE[byte << np.uint64(3) | (k - before) & np.uint64(7)]).astype(np.int64)


class Ascending:
    """An ascending sequence (repeats allowed) over arrays that may lie in a mapped file."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, base: int = 0) -> None:
        self.n, self.low_bits, self.low, self.high, self.zeros, self.base = n, low_bits, low, high, zeros, base
        self.ones = np.arange(len(zeros), dtype=np.int64) * 64 - zeros

    @classmethod
    def build(cls, values: np.ndarray, bound: int, base: int = 0) -> Ascending:
        """``values``: ascending, from ``base`` up to, not including, ``bound``."""
        n = len(values)
        values, bound = values - base, bound - base
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.zeros(n * low_bits, dtype=np.uint8)
        for k in range(low_bits):
            bits[k::low_bits] = (values >> np.uint64(k)) & _ONE
        low = _words(bits)
        tops = (values >> np.uint64(low_bits)).astype(np.int64)
        length = n + (bound >> low_bits) + 2
        ones = np.zeros(length, dtype=np.uint8)
        ones[tops + np.arange(n)] = 1
        high = _words(ones)
        counts = np.bitwise_count(~high).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        return cls(n, low_bits, low, high, zeros, base)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> shift
        rest = (self.low[word + 1] << _ONE) << (np.uint64(63) - shift)
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        at = np.asarray(at, dtype=np.int64)
        word = np.searchsorted(self.ones, at, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], at - self.ones[word])
        return (((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)).astype(np.int64) + self.base

    def values(self) -> np.ndarray:
        """All the numbers."""
        places = np.flatnonzero(np.unpackbits(self.high.astype("<u8").view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return (((places - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)).astype(np.int64) + self.base

    def _next_zero(self, place: np.ndarray) -> np.ndarray:
        """The place of the first zero after each place; the sequence ends in zeros."""
        place = place + 1
        word = place >> 6
        rest = ~self.high[word] >> (place & 63).astype(np.uint64)
        found = place + np.bitwise_count((rest & -rest) - _ONE)
        far = np.flatnonzero(rest == 0)
        if len(far):  # none left in the word: the first one counted after it
            found[far] = self._select_zero(self.zeros[word[far] + 1])
        return found

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per value, the place of the first number not below it, the end of the numbers that share its high
        bits, and its low bits."""
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) + int(np.bitwise_count(~self.high[-1:])[0]) - 1
        beyond = top > last
        top = np.minimum(top, last)
        before = np.where(top > 0, self._select_zero(np.maximum(top - 1, 0)), -1)
        end = np.minimum(self._next_zero(before) - top, self.n)
        lo = np.minimum(before - top + 1, end)
        hi = end
        want = values & np.uint64((1 << self.low_bits) - 1)
        active = np.flatnonzero(lo < hi)
        a, b, own = lo[active], hi[active], want[active]
        while len(active):
            mid = (a + b) >> 1
            less = self._low(mid) < own
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            left = a < b
            if not left.all():
                lo[active[~left]] = a[~left]
                active, a, b, own = active[left], a[left], b[left], own[left]
        return np.where(beyond, self.n, lo), np.where(beyond, 0, end), want

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The place of the first number that is not below each value; n if there is none."""
        return self._search((np.maximum(values, self.base) - self.base).astype(np.uint64))[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        found = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return found
        at, end, want = self._search((np.maximum(values, self.base) - self.base).astype(np.uint64))
        inside = np.flatnonzero((at < end) & (np.asarray(values) >= self.base))
        inside = inside[self._low(at[inside]) == want[inside]]
        found[inside] = at[inside]
        return found

    def parts(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.low_bits, self.base]), "low": self.low, "high": self.high, "zeros": self.zeros}

    @classmethod
    def of_parts(cls, parts: dict[str, np.ndarray]) -> Ascending:
        n, low_bits, base = parts["shape"].tolist()
        return cls(n, low_bits, parts["low"], parts["high"], parts["zeros"], base)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with one spare word."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view("<u8").astype(np.uint64)


def coded(values: np.ndarray, codes: int | None = None, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A table of values and the place of each value in it.

    Without ``codes`` the table has every value there is; with it, that many values at most, each the mean of an equally
    large group (quantisation). With ``mass`` groups are equally heavy instead: rare values that weigh much stay apart.
    """
    table, at = np.unique(values, return_inverse=True)
    if codes is not None and len(table) > codes:
        if mass is None:
            mass = np.ones(len(values))
            edges = np.quantile(values, np.linspace(0, 1, codes + 1)[1:-1])
        else:
            below = np.cumsum(np.bincount(at, weights=mass))
            edges = table[np.searchsorted(below, below[-1] * np.linspace(0, 1, codes + 1)[1:-1])]
        at = np.searchsorted(edges, values, side="right")
        sums, n = np.bincount(at, weights=values * mass, minlength=codes), np.bincount(at, weights=mass, minlength=codes)
        table = sums / np.maximum(n, 1e-300)
    kind = np.uint8 if len(table) <= 256 else np.uint16 if len(table) <= 65536 else np.uint32
    return table, at.astype(kind)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """A file with a short head and the arrays one after the other, each at a multiple of 8 bytes."""
    where, path = _file_system(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    entries, at = [], 0
    for name, array in arrays.items():
        entries.append((name, array.dtype.str, len(array), at))
        at += (array.nbytes + 7) // 8 * 8
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with where.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            raw = np.ascontiguousarray(array).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))


#: Files that a process keeps mapped, and of these local copies; the one that was asked for longest ago goes first.
#: A mapping holds no file descriptor, and the system takes its memory back when it is short.
OPEN_FILES, OPEN_COPIES = 4096, 128
_OPEN: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; the last ``OPEN_FILES`` (``OPEN_COPIES`` where files are copied) stay open.

    A shared folder that is a file system is mapped as it is. From any other store the file is copied to an unnamed local
    file first, which goes when the file is closed.
    """
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    where, path = _file_system(uri)
    as_it_is = isinstance(where, fs.LocalFileSystem)
    while len(_OPEN) >= (OPEN_FILES if as_it_is else OPEN_COPIES):
        _OPEN.popitem(last=False)  # unmapped as soon as no array of it is in use
    if as_it_is:
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    else:
        with tempfile.TemporaryFile() as file, where.open_input_stream(path) as source:
            while piece := source.read(1 << 24):
                file.write(piece)
            file.flush()
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    _OPEN[uri] = _arrays(data)
    return _OPEN[uri]


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, read into memory: for a file that is looked at once and then deleted."""
    where, path = _file_system(uri)
    with where.open_input_stream(path) as source:
        return _arrays(source.read())


def _arrays(data: bytes | mmap.mmap) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    return {
        name: np.frombuffer(data, dtype=kind, count=n, offset=8 + size + at)
        for name, kind, n, at in json.loads(data[8 : 8 + size])
    }


def group(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}


def named(prefix: str, arrays: dict[str, np.ndarray]) -> Iterable[tuple[str, np.ndarray]]:
    return ((prefix + k, v) for k, v in arrays.items())
