"""Words of whole texts as 64-bit hashes, worked out on the bytes of an Arrow batch.

Letters A-Z are lower-cased and a word is a longest run of bytes of a class, so
bytes of UTF-8 sequences are always word bytes. A batch is walked in pieces of
at most `PIECE` bytes, cut between rows or, in a long row, between words: memory
stays bounded by the piece and eight bytes per word of the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

Kind = Callable[[np.ndarray], np.ndarray]

def spaced(low: np.ndarray) -> np.ndarray:
    """Which bytes belong to words that white space ends: [^\\x20\\x09-\\x0D]+"""
    return (low != 0x20) & (low - np.uint8(9) > 4)


def alnum(low: np.ndarray) -> np.ndarray:
    """Which lower-cased bytes belong to words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"""
    return (low - np.uint8(0x30) < 10) | (low - np.uint8(0x61) < 26) | (low >= 0x80)


def lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 4: swapped bytes stay apart
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[name] = np.cumprod(run, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which all output bits depend on all input bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts, with the end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def _hash(data: np.ndarray, starts: np.ndarray, word: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data`, and the byte at which each starts; rows begin at `starts`."""
    n = len(data)
    low = lowered(data)
    inside = word(low)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cuts = starts[(starts > 0) & (starts < n)]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up[:n], out=total[1:])
    return mixed((total[last] - total[first]) * down[first]), first


def cut(data: np.ndarray, word: Kind) -> Iterator[np.ndarray]:
    """One long row in pieces that end after a byte that is no word byte."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            breaks = np.flatnonzero(~word(lowered(data[at:end])))
            if len(breaks):
                end = at + int(breaks[-1]) + 1
                break
            end = min(len(data), end + PIECE)
        yield data[at:end]
        at = end


@dataclass
class Words:
    """Rows `row` to `row + len(counts)` of a batch; `hashes` holds their words in order."""

    row: int
    counts: np.ndarray
    hashes: np.ndarray


def words(column: pa.Array, word: Kind) -> Iterator[Words]:
    data, starts = buffers(column)
    rows = len(starts) - 1
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, "right")) - 1)
        own = data[starts[row] : starts[end]]
        if len(own) > PIECE:
            parts = [_hash(x, np.zeros(0, np.int64), word)[0] for x in cut(own, word)]
            hashes = np.concatenate(parts)
            counts = np.array([len(hashes)])
        else:
            begin = starts[row : end + 1] - starts[row]
            hashes, first = _hash(own, begin[:-1], word)
            counts = np.diff(np.searchsorted(first, begin))
        yield Words(row, counts, hashes)
        row = end


def word_hash(text: str, word: Kind) -> list[int]:
    """The word hashes of one short text."""
    return [int(h) for part in words(pa.array([text]), word) for h in part.hashes]


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows take `counts` of the values in turn."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
