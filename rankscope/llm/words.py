"""Words of many logs at once, as byte spans and 64-bit fingerprints in numpy arrays.

An Arrow string column is one buffer of bytes with offsets. Everything here works on that buffer, so a
task never holds one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text whose temporaries are held at once; a longer log is a block of its own.
BLOCK = 4 << 20
# Bytes hashed at once inside a block.
STRETCH = 1 << 20


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# Bytes between words. Words of calls end at white space only, words of prose at all ASCII but letters and digits.
SPACES = _table((0x20, 0x20), (0x09, 0x0D))
PUNCTUATION = _table((0x00, 0x2F), (0x3A, 0x40), (0x41, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint64(step)
        done, step = done + k, step * step % (1 << 64)
    return out


_POWERS: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, 2 * STRETCH), _powers(_INVERSE, 2 * STRETCH)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look random."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``size`` bytes of ``column`` or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of the first word of every row (one more at the end)."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.logical_not(between[data], out=word[:n])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut))
    ends = np.flatnonzero(before & (~word | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of every span; equal spans have equal ones."""
    up, down = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + STRETCH, "right"))
        if j <= i:  # one word longer than a stretch
            out[i] = _long(data[base:ends[i]])
            i += 1
            continue
        sums = np.zeros(ends[j - 1] - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:ends[j - 1]]] * up[:len(sums) - 1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def _long(word: np.ndarray) -> np.uint64:
    up, _ = _tables()
    total, lift = 0, 1
    for at in range(0, len(word), STRETCH):
        part = word[at:at + STRETCH]
        total += lift * int((_BYTE[part] * up[:len(part)]).sum(dtype=np.uint64))
        lift = lift * pow(_BASE, STRETCH, 1 << 64) % (1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of every ``n`` consecutive words, whatever the row; the last ``n - 1`` places have none."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + words[k:len(words) - n + 1 + k]
    return mix(total)
