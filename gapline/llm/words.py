"""Words of whole texts as numpy arrays, inside tasks.

A word is a run of bytes of one class. Its hash is a polynomial of its bytes modulo
2^64, mixed; a window of words has a polynomial of its words' hashes. Both come from
running sums over slices of bounded size, so a long text costs memory in proportion to
its words only. Hashes are the same in every task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
LONG_WORD = 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def not_space() -> np.ndarray:
    """Byte classes of words cut at the space and the bytes 9 to 13."""
    keep = np.ones(256, bool)
    keep[[32, 9, 10, 11, 12, 13]] = False
    return keep


def letters() -> np.ndarray:
    """Byte classes of words made of ASCII letters, digits and all bytes of other scripts."""
    keep = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        keep[a:b] = True
    return keep


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words and windows; made once per task."""

    def __init__(self, keep: np.ndarray | None = None, lower: bool = False):
        self.keep = not_space() if keep is None else keep
        self.lower = lower
        self.size = SLICE + 2 * LONG_WORD
        self.table = [powers(b, self.size + 1) for b in BASES]

    def split(self, texts: pa.Array) -> "Words":
        """Words of a string array, null texts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        inside = self.keep[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[ends] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(self, raw, ends, start, stop, np.searchsorted(start, ends))

    def words(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out, table, at = np.empty(len(start), np.uint64), self.table[0], 0
        if self.lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(stop, start[at] + SLICE, "right")))
            a, b = int(start[at]), int(stop[to - 1])
            if b - a <= self.size:
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * table[: b - a], out=total[1:])
                s, e = start[at:to] - a, stop[at:to] - a
                out[at:to] = (total[e] - total[s]) * table[self.size - s]
            at = to
        for i in np.flatnonzero(stop - start > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(out)

    def windows(self, hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each word on, for all but the last width - 1."""
        n, table = len(hashes) - width + 1, self.table[which]
        out = np.empty(max(0, n), np.uint64)
        salted = hashes if which == 0 else mix(hashes + np.uint64(BASES[which]))
        for at in range(0, n, SLICE):
            part = salted[at : at + SLICE + width - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * table[: len(part)], out=total[1:])
            k = len(part) - width + 1
            out[at : at + k] = (total[width:] - total[:k]) * table[self.size - np.arange(k)]
        return mix(out)


class Words:
    """Words of a batch of texts: byte spans, and the first word of each text."""

    def __init__(self, hasher: Hasher, raw, ends, start, stop, first):
        self.hasher, self.raw, self.ends, self.start, self.stop, self.first = hasher, raw, ends, start, stop, first

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return self.hasher.words(self.raw, self.start, self.stop)

    def window_starts(self, width: int) -> np.ndarray:
        """Words from which ``width`` words follow within their text."""
        if len(self) < width:
            return np.zeros(0, np.int64)
        doc = self.doc()
        return np.flatnonzero(doc[: len(self) - width + 1] == doc[width - 1 :])


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Runs of rows of a batch whose texts have about ``most`` bytes; a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
