"""Words and n-grams of whole Arrow columns as numpy arrays, without a Python step per row.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  All separators are
ASCII, so UTF-8 bytes are scanned directly.  A word's id is a 64-bit polynomial
hash of its bytes, finished by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E6C63D0876A9A47 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone, and whole.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        steps = np.full(size, base, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if size <= CHUNK_BYTES * 8:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, of one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words(NamedTuple):
    start: np.ndarray  # byte offsets within the chunk
    end: np.ndarray
    ids: np.ndarray  # uint64
    first: np.ndarray  # of each row: index of its first word; one more at the end


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words of the rows; ``offs`` starts at 0 and ends at ``len(data)``."""
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(0, U), np.zeros(len(offs), np.int64))
    text = _LOWER[data]
    solid = ~_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | begins[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((text.astype(U) + U(1)) * _power(_P, n, "p"), out=sums[1:])
    ids = mix((sums[e] - sums[s]) * _power(_PINV, n, "inv")[s])
    return Words(s, e, ids, np.searchsorted(s, offs))


def grams(w: Words, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles and their rows, in text order.

    A row with fewer words gives its whole sequence as one, if asked.
    """
    n, counts = len(w.ids), np.diff(w.first)
    row = np.repeat(np.arange(len(counts)), counts)
    if n >= width:
        h = np.zeros(n - width + 1, U)
        for k in range(width):
            h = mix(h * U(0x9FB21C651E98DF25) + w.ids[k : n - width + 1 + k])
        ok = row[: n - width + 1] == row[width - 1 :]
        h, rows = h[ok], row[: n - width + 1][ok]
    else:
        h, rows = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width)) if whole_if_short else []
    if len(short):
        extra = np.empty(len(short), U)
        for i, r in enumerate(short):
            x = np.array([counts[r]], U) * U(0xD6E8FEB86659FD93)
            for v in w.ids[w.first[r] : w.first[r + 1]]:
                x = mix(x * U(0x9FB21C651E98DF25) + v)
            extra[i] = x[0]
        h, rows = np.concatenate([h, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
    return h, rows


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending within the row."""
    if not len(h):
        return h, rows
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]
