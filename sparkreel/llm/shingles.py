"""Word shingles of a batch of texts as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
with np.errstate(over="ignore"):
    BYTE_VALUES = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
FACTOR, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each text in them; NULL as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if len(part) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _piece(raw: np.ndarray, first: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and stops of the words in ``raw``; ``first`` marks bytes that begin a text."""
    solid = ~separators[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(LOWER[raw], starts, stops), starts, stops


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * _powers(FACTOR, len(raw)), dtype=np.uint64)])
    return mixed((sums[stops] - sums[starts]) * _powers(INVERSE, len(raw) + 1)[starts] + (stops - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of each word (A-Z lower-cased) and the number of words before each text."""
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    parts, at = [], 0
    while at < len(raw):
        stop = at + PIECE
        while stop < len(raw) and not separators[raw[stop]] and not first[stop]:
            stop += 1
        h, a, b = _piece(raw[at:stop], first[at:min(stop, len(raw))], separators)
        parts.append((h, a + at, b + at))
        at = stop
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    hashes, starts, stops = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, stops, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and the number of them before each text.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    raw, offsets = text_buffer(column)
    hashes, _, _, before = word_spans(raw, offsets)
    counts = np.diff(before)
    whole = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        ahead = np.zeros(len(hashes), np.uint64)
        ahead[:len(hashes) - k] = hashes[k:]
        short = np.repeat(before[1:], counts) - np.arange(len(hashes)) <= k
        ahead[short] = 0
        whole = mixed(whole * FACTOR + ahead)
    sets, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        if n:
            own = np.unique(whole[before[i]:before[i] + max(1, n - words + 1)])
            sets.append(own)
            sizes[i + 1] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)
