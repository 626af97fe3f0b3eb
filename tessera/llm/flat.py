"""Whole Arrow string columns as flat byte arrays: words, hashes and windows without a Python object per word.

Everything here works on one chunk of rows at a time (see ``chunks``), holds a few arrays as long as the chunk and
never looks at a prefix or a sample of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that end at ASCII white space only.
NOT_WHITE = ~WHITE
#: Bytes of words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

CHUNK_BYTES = 1 << 20
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        got = np.multiply.accumulate(out)
        if n <= CHUNK_BYTES * 2:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` bytes of text, one row at least; no bytes are copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = strings(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and each row's offsets (n + 1, from 0). Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each row's words begin in these (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[buf]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    first[cut] = is_in[cut]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    last[cut - 1] = is_in[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over prefix sums, scrambled. Blocks bound the memory."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + limit, "right")), i + 1)
        block = buf[lo : ends[j - 1]].astype(np.uint64)
        total = np.zeros(len(block) + 1, np.uint64)
        block += np.uint64(1)
        block *= powers(_BYTE_BASE, len(block))
        np.cumsum(block, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        h = total[e]
        h -= total[s]
        h *= powers(pow(_BYTE_BASE, -1, 1 << 64), len(block) + 1)[s]
        h += (e - s).astype(np.uint64) * np.uint64(_WORD_BASE)
        out[i:j] = mix(h)
        i = j
    return out


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0]+count[0]-1, begin[1] .., joined."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = begin - np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.repeat(shift, count) + np.arange(total)


def window_starts(word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of k words fits its row, and how many each row has."""
    count = np.maximum(np.diff(word_off) - k + 1, 0)
    return ranges(word_off[:-1], count), count


def hash_windows(h: np.ndarray, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of the k word hashes from each position of ``at``, order kept."""
    if not len(at):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=total[1:])
    out = total[at + k]
    out -= total[at]
    out *= powers(pow(_WORD_BASE, -1, 1 << 64), len(h) + 1)[at]
    return mix(out)


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; 0 for empty rows."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(n: int, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in at[i] .. at[i]+length-1 for some i."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    return np.cumsum(mark[:-1]) > 0
