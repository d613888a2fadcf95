"""Bounded slices of Arrow batches, and packed columns that travel to a bucket as one binary value."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Stands for a null doc_id: after every id.
NO_ID = np.iinfo(np.int64).max


def slices(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``limit`` bytes of ``column`` (a longer text is a table of its own end)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = size + np.cumsum(lengths, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        size = int(ends[-1] % limit)
    if held:
        yield pa.Table.from_batches(held)


def pack(*parts: bytes | np.ndarray) -> bytes:
    """The parts, in order, as one compressed value."""
    raw = [p.tobytes() if isinstance(p, np.ndarray) else bytes(p) for p in parts]
    return zstandard.ZstdCompressor(level=5).compress(struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw)) + b"".join(raw))


def unpack(value: bytes) -> list[memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(value))
    n = struct.unpack_from("<q", data)[0]
    ends = 8 * (n + 1) + np.cumsum((0, *struct.unpack_from(f"<{n}q", data, 8)))
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


def covered(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in any of the ranges."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    step, low = 1, values
    while 2 * step <= width:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    return np.minimum(low[: len(low) - (width - step)], low[width - step :]) if width > step else low


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, for hashes of ranges from prefix sums.

    The power of a place is the product of one of its low ``BITS`` and one of the rest, so tables stay small.
    """

    BASE, BITS = 0x2545F4914F6CDD1D, 16

    def __init__(self):
        self.low = [self.table(self.BASE), self.table(pow(self.BASE, -1, 1 << 64))]
        self.high = [self.table(pow(int(t[-1]) * int(t[1]), 1, 1 << 64)) for t in self.low]

    def table(self, base: int) -> np.ndarray:
        steps = np.full(1 << self.BITS, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def down(self, places: np.ndarray) -> np.ndarray:
        """The inverse's power of each place."""
        return self.low[1][places & ((1 << self.BITS) - 1)] * self.high[1][places >> self.BITS]

    def downs(self, n: int) -> np.ndarray:
        """The inverse's powers of 0..n - 1."""
        return (self.high[1][: -(-n >> self.BITS), None] * self.low[1]).ravel()[:n]

    def parts(self, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, powers of a..b - 1) of the parts of 0..n - 1."""
        for a in range(0, n, 1 << self.BITS):
            b = min(a + (1 << self.BITS), n)
            yield a, b, self.low[0][: b - a] * self.high[0][a >> self.BITS]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out, total = np.zeros(len(values) + 1, np.uint64), np.uint64(0)
        for a, b, powers in self.parts(len(values)):
            out[a + 1 : b + 1] = np.cumsum(values[a:b] * powers, dtype=np.uint64) + total
            total = out[b]
        return out

    def prefix_at(self, table: np.ndarray, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The prefix sums of ``table[codes]`` at the places (ascending) alone."""
        out, total, done = np.zeros(len(places), np.uint64), np.uint64(0), int(np.searchsorted(places, 1))
        for a, b, powers in self.parts(len(codes)):
            sums = np.cumsum(table[codes[a:b]] * powers, dtype=np.uint64) + total
            upto = int(np.searchsorted(places, b, side="right"))
            out[done:upto], done, total = sums[places[done:upto] - a - 1], upto, sums[-1]
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each range start..end - 1; equal ranges of values have equal hashes."""
        out = prefix[ends]
        out -= prefix[starts]
        out *= self.down(starts)
        return out


POWERS = Powers()
