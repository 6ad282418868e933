"""Elias-Fano sequences and files of arrays that are memory-mapped, not read."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

ALIGN = 64
#: Numbers that are looked up together: what is made on the way stays in the processor's cache.
PIECE = 1 << 14


def write_arrays(base_uri: str, name: str, arrays: dict[str, np.ndarray], meta: dict | None = None) -> str:
    """Write arrays into one file below base_uri, under a name that no other attempt of a task uses."""
    system, root = filesystem(base_uri)
    head, at = {"meta": meta or {}, "arrays": {}}, 0
    for key, a in arrays.items():
        head["arrays"][key] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // ALIGN) * ALIGN
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGN)
    system.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}.lvl"
    with system.open_output_stream(path) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % ALIGN))
    return path


def filesystem(uri: str):
    """The pyarrow file system of a shared folder's address, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def map_arrays(base_uri: str, path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays of a file as memory maps. A folder that the machine does not mount is copied to an unlinked file."""
    from pyarrow import fs

    system, _ = filesystem(base_uri)
    if isinstance(system, fs.LocalFileSystem):
        local, drop = path, False
    else:
        fd, local = tempfile.mkstemp()
        os.close(fd)
        fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        drop = True
    raw = np.asarray(np.memmap(local, np.uint8, "r"))
    if drop:
        os.unlink(local)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    arrays = {}
    for key, (kind, count, at) in head["arrays"].items():
        size = np.dtype(kind).itemsize * count
        arrays[key] = raw[8 + n + at : 8 + n + at + size].view(kind)
    return arrays, head["meta"]


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each 64-bit word, which has that many."""
    k = k.astype(np.uint64)
    # Set bits of each byte, then of it and those below it; fewer than k + 1 there: the bit is further up.
    s = word - ((word >> np.uint64(1)) & _FIVES)
    s = (s & _THREES) + ((s >> np.uint64(2)) & _THREES)
    s = ((s + (s >> np.uint64(4))) & _FIFTEENS) * _EACH
    byte = np.bitwise_count((((k * _EACH) | _TOPS) - s) & _TOPS).astype(np.uint64) << np.uint64(3)
    k -= ((s << np.uint64(8)) >> byte) & np.uint64(255)
    return byte.astype(np.int64) + _IN_BYTE[(((word >> byte) & np.uint64(255)) << np.uint64(3) | k).astype(np.int64)]


_FIVES, _THREES, _FIFTEENS, _EACH, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 1, 0x80))
#: For each byte and k, the place of its k-th set bit.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def _by_pieces(look, *columns: np.ndarray | None) -> list[np.ndarray]:
    """The arrays that `look` gives for columns of numbers, a PIECE of them at a time."""
    n = len(columns[0])
    if n <= PIECE:
        return look(*columns)
    parts = [look(*(c if c is None else c[i : i + PIECE] for c in columns)) for i in range(0, n, PIECE)]
    return [np.concatenate(p) for p in zip(*parts)]


class EliasFano:
    """A non-decreasing sequence of unsigned numbers: low bits packed, high bits in unary, with running
    counts of ones so that any entry, and the first entry not below a value, are found in a few steps."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.bits = (int(x) for x in arrays[prefix + "shape"])
        self.low, self.high, self.ones = arrays[prefix + "low"], arrays[prefix + "high"], arrays[prefix + "ones"]
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        where = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = int(where[-1]) // 64 + 2 if n else 1
        high = np.packbits(np.bincount(where, minlength=64 * words)[: 64 * words].astype(np.uint8), bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))[:-1]
        at = np.arange(n, dtype=np.int64) * bits
        packed = np.zeros((n * bits) // 64 + 2, np.uint64)
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(packed, at >> 6, low << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(packed, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        return {prefix + "shape": np.array([n, bits], np.int64), prefix + "low": packed, prefix + "high": high, prefix + "ones": ones}

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word = at >> 6
        at &= 63
        shift = at.view(np.uint64)
        out = self.low[word] >> shift
        over = np.flatnonzero(at > 64 - self.bits)
        if len(over):
            out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        out &= np.uint64((1 << self.bits) - 1)
        return out

    def _place(self, i: np.ndarray) -> np.ndarray:
        """Where the i-th one stands in the high bits."""
        word = np.searchsorted(self.ones, i, "right") - 1
        # Words without ones repeat the running count; the last of them is followed by the one sought.
        return 64 * word + _select_in_word(self.high[word], i - self.ones[word])

    def _value(self, i: np.ndarray, where: np.ndarray) -> np.ndarray:
        return ((where - i).astype(np.uint64) << np.uint64(self.bits)) | self.low_bits(i)

    def at(self, i: np.ndarray) -> np.ndarray:
        return _by_pieces(lambda i: [self._value(i, self._place(i))], i)[0]

    def both(self, i: np.ndarray) -> list[np.ndarray]:
        """at(i) and at(i + 1), which is the next one behind it."""

        def look(i: np.ndarray) -> list[np.ndarray]:
            where = self._place(i)
            word, up = where >> 6, np.uint64(1) + (where & 63).astype(np.uint64)
            rest = self.high[word] & np.where(up < 64, ~np.uint64(0) << np.minimum(up, np.uint64(63)), np.uint64(0))
            open_ = np.flatnonzero(rest == 0)
            while len(open_):
                word[open_] += 1
                rest[open_] = self.high[word[open_]]
                open_ = open_[rest[open_] == 0]
            following = 64 * word + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            return [self._value(i, where), self._value(i + 1, following)]

        return _by_pieces(look, i)

    def bucket(self, high: np.ndarray) -> np.ndarray:
        """How many entries have high bits below each value, up to all of them."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        bits = ~self.high[word]
        left = k - self.zeros[word]
        inside = left < np.bitwise_count(bits)
        if not inside.all():
            left[~inside] = 0
        out = 64 * word + _select_in_word(bits, left) - k
        out[~inside] = self.n
        out[high <= 0] = 0
        return np.minimum(out, self.n)

    def run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries [a, b) that have these high bits: a run of ones behind the zero that ends the bucket before."""
        a = self.bucket(high)
        at = a + high
        last = 64 * len(self.high)
        if (at >= last).any():
            at = np.minimum(at, last - 1)
        # The last bits are zeros, so a run ends before them.
        shift = at & 63
        rest = ~(self.high[at >> 6] >> shift.astype(np.uint64))
        length = np.minimum(np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)), 64 - shift)
        open_ = np.flatnonzero(length == 64 - shift)
        at += length
        open_ = open_[at[open_] < last]
        while len(open_):
            rest = ~self.high[at[open_] >> 6]
            ones = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            length[open_] += ones
            at[open_] += ones
            open_ = open_[(ones == 64) & (at[open_] < last)]
        return a, np.minimum(a + length, self.n)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of the first entry not below x, kept inside [lo, hi)."""
        return _by_pieces(self._successor, x, lo, hi)[0]

    def _successor(self, x: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> list[np.ndarray]:
        """The successor, and the end of those entries in [lo, hi) that have the high bits of x."""
        h = np.minimum(x >> np.uint64(self.bits), np.uint64(64 * len(self.high))).astype(np.int64)
        a, b = self.run(h)
        if lo is not None:
            a, b = np.minimum(np.maximum(a, lo), hi), np.minimum(np.maximum(b, lo), hi)
        low, end = x & np.uint64((1 << self.bits) - 1), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.low_bits(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        return [a, end]

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of x, or -1."""

        def look(x: np.ndarray, lo: np.ndarray | None, hi: np.ndarray | None) -> list[np.ndarray]:
            at, end = self._successor(x, lo, hi)
            # Entries before `end` have the high bits of x, so the low bits decide.
            some = np.flatnonzero(at < end)
            hit = some[self.low_bits(at[some]) == x[some] & np.uint64((1 << self.bits) - 1)]
            out = np.full(len(x), -1, np.int64)
            out[hit] = at[hit]
            return [out]

        return _by_pieces(look, x, lo, hi)[0]


def lists_build(sizes: np.ndarray, values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Sorted lists end to end: monotone pointers, and values made monotone by adding to each list what the
    lists before it reach."""
    ends = np.cumsum(sizes)
    tops = values[ends - 1].astype(np.uint64) + np.uint64(1) if len(sizes) else np.empty(0, np.uint64)
    base = np.concatenate(([0], np.cumsum(tops)[:-1])).astype(np.uint64) if len(sizes) else tops
    return EliasFano.build(np.concatenate(([0], ends)), prefix + "ptr_") | EliasFano.build(values.astype(np.uint64) + np.repeat(base, sizes), prefix + "val_") | EliasFano.build(np.concatenate((base, [base[-1] + tops[-1] if len(sizes) else 0])).astype(np.uint64), prefix + "base_")


class SortedLists:
    """Search for a value among the successors of one list, relative to that list."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.pointer, self.value, self.base = (EliasFano(arrays, prefix + x) for x in ("ptr_", "val_", "base_"))

    def bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.pointer.both(k)
        return lo.astype(np.int64), hi.astype(np.int64)

    def find(self, k: np.ndarray, x: np.ndarray, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of x counted over all lists or -1, position of the list's first entry) for list k of each x;
        back: which k each x belongs to, where many ask the same lists."""
        lo, hi = self.bounds(k)
        base, top = self.base.both(k)
        if back is not None:
            lo, hi, base, top = lo[back], hi[back], base[back], top[back]
        out, some = np.full(len(x), -1, np.int64), np.flatnonzero(base + x < top)
        out[some] = self.value.find(base[some] + x[some], lo[some], hi[some])
        return out, lo
