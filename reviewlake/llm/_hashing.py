"""Vectorised hashing of the words of Arrow text columns, a bounded chunk of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; longer texts are taken in pieces that end at white space.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SEED = np.uint64(0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian lane of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on as an integer; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = LONG) -> np.ndarray:
    """The hash of the bytes between each start and end, eight at a time, each step a bijection of what came before.

    Up to eight bytes, spans of one length have different hashes. Those of more than `long` bytes are hashed one by one.
    """
    wide, left = lanes(data), ends - starts
    single = np.flatnonzero(left > long)
    at, left = starts.astype(np.int64), np.where(left > long, 0, left)
    with np.errstate(over="ignore"):
        out = mix(left.astype(np.uint64) * np.uint64(_BASE) + _SEED)
        live = np.arange(len(starts))
        while len(live):
            n = left[live]
            out[live] = mix(out[live] ^ (wide[at[live]] & MASKS[np.minimum(n, 8)]))
            live = live[n > 8]
            at[live] += 8
            left[live] -= 8
    for k in single:
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the edges of its rows; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), edges


def _hash_words(data: np.ndarray, cuts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in data; a word ends at each of cuts too."""
    word = ~space[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, spans(LOWER[data], starts, ends)


def words(column: pa.Array, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each word counted from the first, hash of each word), for chunks of rows.

    Words are the runs of bytes between those of `space`, with A-Z in lower case.
    """
    data, edges = buffers(column)
    row, rows = 0, len(edges) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(edges, edges[row] + CHUNK, "right")) - 1)
        at, hashes = [], []
        a, z = int(edges[row]), int(edges[end])
        while a < z:
            stop = z
            if z - a > 2 * CHUNK:  # one long text: on to a space
                stop = a + CHUNK
                while stop < z and not space[data[stop]]:
                    stop += 1
            starts, found = _hash_words(data[a:stop], edges[row : end + 1] - a, space)
            at.append(np.searchsorted(edges[row : end + 1], starts + a, "right") - 1)
            hashes.append(found)
            a = stop
        yield row, end, np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        row = end


def windows(of: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of rows that have size words at least, in the order of the words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = of[:n] == of[size - 1 :]
    total = hashes[:n][whole]
    for k in range(1, size):
        total = mix(total) ^ hashes[k : n + k][whole]
    return of[:n][whole], mix(total ^ np.uint64(size))


def shingles(of: np.ndarray, hashes: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted; fewer words than size are one shingle whole."""
    counts = np.bincount(of, minlength=rows)
    at, found = windows(of, hashes, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if short.size:
        firsts = (np.cumsum(counts) - counts)[short]
        one = hashes[firsts]
        for k in range(1, size):
            more = np.flatnonzero(counts[short] > k)
            one[more] = mix(one[more]) ^ hashes[firsts[more] + k]
        found, at = np.concatenate([found, mix(one ^ counts[short].astype(np.uint64))]), np.concatenate([at, short])
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
    return at[fresh], found[fresh]
