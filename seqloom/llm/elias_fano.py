"""Elias-Fano sequences over memory-mapped arrays, queried for many values at once."""

from __future__ import annotations

import json
import mmap
import tempfile

import numpy as np


def _packed(upper: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit vector with the given ones, and the zeros before each of its words."""
    bits = np.zeros((length + 63) // 64 * 64, dtype=np.uint8)
    bits[upper] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    zeros = 64 - np.bitwise_count(words).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype("<u4" if length < 1 << 32 else "<u8")


class Pointers:
    """Monotone pointers in unary: where the children of each node begin."""

    def __init__(self, a: dict[str, np.ndarray], name: str):
        self.words, self.zeros = a[name + ".words"], a[name + ".zeros"]

    @staticmethod
    def build(name: str, sizes: np.ndarray) -> dict[str, np.ndarray]:
        n = int(sizes.sum())
        upper = np.repeat(np.arange(len(sizes)), sizes) + np.arange(n)
        words, zeros = _packed(upper, n + len(sizes) + 1)
        return {name + ".words": words, name + ".zeros": zeros}

    def _zero(self, j: np.ndarray) -> np.ndarray:
        """Position of the zero number ``j``."""
        at = np.searchsorted(self.zeros, j, side="right") - 1
        left = (j - self.zeros[at].astype(np.int64)).astype(np.int64)
        word, pos = ~self.words[at], np.zeros(len(j), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= count
            left -= count * over
            word = word >> (over * width).astype(np.uint64)
            pos += over * width
        return at * 64 + pos

    def span(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node, and the one after its last."""
        end = self._zero(node) - node
        before = np.maximum(node - 1, 0)
        return np.where(node > 0, self._zero(before) - before, 0), end


def successor(low: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Index of ``value`` among the ascending values of ``lo`` to ``hi``, -1 if it is not there.

    ``low`` holds the values in planes, the lowest bits first.
    """
    def read(i):
        out = low[0][i].astype(np.uint64)
        shift = 8 * low[0].itemsize
        for plane in low[1:]:
            out |= plane[i].astype(np.uint64) << np.uint64(shift)
            shift += 8 * plane.itemsize
        return out

    lo, end = lo.copy(), hi
    hi = hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = read(mid) < value[live]
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    out = np.full(len(value), -1, dtype=np.int64)
    inside = np.flatnonzero(lo < end)
    hit = inside[read(lo[inside]) == value[inside]]
    out[hit] = lo[hit]
    return out


class Sequence:
    """Ascending distinct 64-bit values: upper parts in unary, lower parts in whole bytes."""

    def __init__(self, a: dict[str, np.ndarray], name: str):
        self.pointers = Pointers(a, name)
        self.base, self.shift, self.buckets = (int(x) for x in a[name + ".head"])
        self.low = [a[f"{name}.low{i}"] for i in range(self.shift // 8)]

    @staticmethod
    def build(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
        n = max(1, len(values))
        base = int(values[0]) if len(values) else 0
        span = int(values[-1]) - base + 1 if len(values) else 1
        shift = 8
        while shift < 56 and span >> shift > 2 * n:
            shift += 8
        rest = values - np.uint64(base)
        buckets = (span >> shift) + 1
        sizes = np.bincount((rest >> np.uint64(shift)).astype(np.int64), minlength=buckets)
        out = {name + ".head": np.array([base, shift, buckets], dtype="<u8")} | Pointers.build(name, sizes)
        for i in range(shift // 8):
            out[f"{name}.low{i}"] = (rest >> np.uint64(8 * i)).astype(np.uint8)
        return out

    def index(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 for one that is not in the sequence."""
        out = np.full(len(values), -1, dtype=np.int64)
        rest = values - np.uint64(self.base)  # smaller values wrap around to large ones
        bucket = rest >> np.uint64(self.shift)
        fits = np.flatnonzero((values >= np.uint64(self.base)) & (bucket < np.uint64(self.buckets)))
        if len(fits):
            lo, hi = self.pointers.span(bucket[fits].astype(np.int64))
            mask = np.uint64((1 << self.shift) - 1)
            out[fits] = successor(self.low, lo, hi, rest[fits] & mask)
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the length of a header, the header, and the arrays at multiples of eight bytes."""
    head, at, parts = {}, 0, []
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = [np.asarray(x).dtype.str, at, len(x)]
        parts += [data, bytes(-len(data) % 8)]
        at += len(data) + -len(data) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def load(uri: str) -> dict[str, np.ndarray]:
    """Map a file of the shared folder; a store that cannot be mapped is first read into an unnamed file."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, path = FileSystem.from_uri(uri)
    if isinstance(fs, LocalFileSystem):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as source:
            while chunk := source.read(1 << 24):
                f.write(chunk)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8: 8 + size])
    return {name: np.frombuffer(data, dtype=kind, count=n, offset=8 + size + at) for name, (kind, at, n) in head.items()}


def save(uri: str, arrays: dict[str, np.ndarray], attempt: str) -> None:
    """Write beside the file and rename, so that a repeated task replaces a whole file by an equal one."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.{attempt}") as f:
        f.write(dump(arrays))
    fs.move(f"{path}.{attempt}", path)
