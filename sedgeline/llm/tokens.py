"""Vectorised tokenisation and hashing of Arrow text columns.

Texts of a record batch are handled in blocks of about ``BLOCK`` bytes. Within a
block all words are found and hashed with a handful of numpy passes: a word's hash
is a polynomial over its bytes, taken from prefix sums, then mixed. A text longer
than a block is hashed in segments cut between words, so memory per text is its
bytes plus a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_SEGMENT = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that holds for the bytes in the given inclusive ranges."""
    mask = np.zeros(256, bool)
    for lo, hi in ranges:
        mask[lo : hi + 1] = True
    return mask


#: Words as runs without ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII letters and digits and of every non-ASCII character.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("p", ())) < n:
        n = max(n, _SEGMENT + 1)
        for key, b in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _powers[key] = np.cumprod(step, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _SEGMENT, "right"))
        j = max(j, i + 1)
        top = int(ends[j - 1])
        p, q = _power_tables(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:top]] * p[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64) * _ODD[0]
        i = j
    return mix(out)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    if len(mask) and mask[-1]:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[0::2], edge[1::2]


@dataclass
class Block:
    """Some consecutive texts, joined with a newline after each."""

    first: int  # row of the batch
    data: np.ndarray  # bytes
    begin: np.ndarray  # offset of each text in data
    length: np.ndarray  # bytes of each text

    @property
    def rows(self) -> int:
        return len(self.begin)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """Index, within the block, of the text that holds each byte position."""
        return np.searchsorted(self.begin, positions, "right") - 1


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a column in blocks of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        part = texts.slice(lo, hi - lo).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), part), "\n")
        _, offsets, data = joined.buffers()
        n = int(total[hi] - total[lo]) + hi - lo - 1
        raw = np.frombuffer(data, np.uint8, n) if n else np.zeros(0, np.uint8)
        yield Block(lo, raw, total[lo:hi] - total[lo] + np.arange(hi - lo), sizes[lo:hi])
        lo = hi


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of the text within the block
    hash: np.ndarray  # uint64
    data: np.ndarray  # folded bytes

    def slice_of(self, rows: int) -> np.ndarray:
        """Bounds of each text's words: text i has words [bounds[i], bounds[i + 1])."""
        return np.searchsorted(self.text, np.arange(rows + 1))


def words(block: Block, classes: np.ndarray, fold: bool = True) -> Words:
    """The words of a block's texts; ``fold`` lower-cases A-Z first."""
    data = LOWER[block.data] if fold else block.data
    mask = classes[block.data]
    if block.rows > 1:
        mask[block.begin[1:] - 1] = False  # the newline between two texts is in no word
    start, end = spans_of(mask)
    return Words(start, end, block.text_of(start), span_hashes(data, start, end), data)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes (also across texts: the caller masks those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out += h[i : i + m] * _ODD[i + 1]
    return mix(out)


def shingle_sets(w: Words, rows: int, n: int) -> list[np.ndarray]:
    """Per text the ascending distinct hashes (int64) of its n-word shingles.

    A text of fewer words has one shingle, its whole sequence; without words it has none.
    """
    bounds = w.slice_of(rows)
    every = windows(w.hash, n).view(np.int64)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            s = every[lo : hi - n + 1]
        elif hi > lo:
            s = windows(w.hash[lo:hi], hi - lo).view(np.int64)
        else:
            s = every[:0]
        s = np.sort(s)
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return out
