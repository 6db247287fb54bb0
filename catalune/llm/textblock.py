"""Vectorised views of Arrow text columns, shared by the Arrow operators.

A *block* is a run of rows whose UTF-8 bytes lie in one numpy array.  Rows are
grouped into blocks of bounded size, so memory does not follow the size of an
Arrow batch; a single row longer than the bound forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column, nulls as empty strings, as 64-bit-offset strings."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        return pa.array([""] * len(col), pa.large_string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets start at 0."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes (or one longer row)."""
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII and every byte of a longer code point.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = byte_table(b" \t\n\v\f\r")


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of ``mask``; runs are cut at row starts."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[:-1]
    cut = cut[(cut > 0) & (cut < n)]
    edge = np.zeros(n, bool)
    edge[1:] = mask[:-1]
    edge[cut] = False
    starts = np.flatnonzero(mask & ~edge)
    edge[:-1] = mask[1:]
    edge[-1] = False
    edge[cut - 1] = False
    return starts, np.flatnonzero(mask & ~edge) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) <= n:
        size = max(n + 1, BLOCK_BYTES + 64)
        inv = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for key, m in (("p", _MULT), ("i", inv)):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"], _powers["i"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they lie."""
    p, inv = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= p[: len(data)]
    np.cumsum(terms, out=total[1:])
    h = total[ends]
    h -= total[starts]
    h *= inv[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def sums_by_row(values: np.ndarray, row_of: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row_of, weights=values, minlength=rows)[:rows]


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row each position belongs to."""
    return np.searchsorted(offsets, starts, side="right") - 1
