"""Numpy helpers that work on an Arrow column of texts as one run of bytes.

Batches are cut into pieces of about ``PIECE`` bytes, so that the arrays made of
a piece stay small whatever the batch holds; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15
U64 = np.uint64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that isn't a letter or digit.
NON_WORD = np.zeros(256, bool)
NON_WORD[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of each piece; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.binary()) if not pa.types.is_large_binary(column.type) else column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        yield first, whole[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, MULTIPLIER, U64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), U64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of MULTIPLIER and of its inverse."""
    return _powers(1 << max(20, int(n).bit_length()))


#: A second value of each byte: hashes over these collide independently of those over the bytes themselves.
SECOND = mix(np.arange(256, dtype=U64) + U64(0x632BE59BD9B4E019))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """s with (s[j] - s[i]) * inverse power i = the polynomial hash of values[i:j]."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (and of all)."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-2]
    starts = np.flatnonzero(~gap[:-1] & (before | edge[:-1]))
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
