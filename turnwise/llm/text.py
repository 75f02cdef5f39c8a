"""Vectorised word and shingle hashing over Arrow string arrays; whole texts, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed constants of the 64-bit mixer.
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(max(n, 1 << 20), base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about `most` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same for the same bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the end) of the runs between the six ASCII white-space characters."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each document, ascending.

    words are word hashes, first[d]:first[d+1] those of document d. A document of fewer words gives its whole sequence as one
    shingle, one without words none.
    """
    count = np.diff(first)
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= size:
        for k in range(size):
            full[: n - size + 1] += words[k : n - size + 1 + k] * _PLACES[k]
    full = mix(full)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        whole[has] += words[first[short[has]] + k] * _PLACES[k]
    whole = mix(whole + count[short].astype(np.uint64))
    of_short = dict(zip(short.tolist(), whole, strict=True))
    out, sizes = [], np.zeros(len(count), np.int64)
    for d in np.flatnonzero(count).tolist():
        own = np.unique(full[first[d] : first[d + 1] - size + 1]) if count[d] >= size else np.array([of_short[d]], np.uint64)
        out.append(own)
        sizes[d] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the set of word shingles of each text, letters A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return shingles(span_hashes(data, starts, ends), first, size)


def segment_reduce(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """op over values[offsets[d]:offsets[d+1]]; `empty` where there are none."""
    sizes = np.diff(offsets)
    out = np.full(len(sizes), empty, values.dtype)
    has = sizes > 0
    if has.any():
        out[has] = op.reduceat(values, offsets[:-1][has])
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An array<long> column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), signed(values))
