"""Word shingles of Arrow string batches as sorted arrays of 64-bit hashes, with numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; one longer text is hashed alone.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_WORD = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _bytes(plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: its random value, A-Z like a-z; whether it parts words: white space (space, 09 to 0D), or if plain all ASCII but letters and digits."""
    value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    if plain:
        space[:128] = True
        space[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    else:
        space[[0x20, *range(0x09, 0x0E)]] = True
    return value, space


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, _INVERSE))


def word_hashes(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in data, and each text's first word (with the end).

    Words are parted by white space; plain ones by all ASCII characters but letters and digits.
    """
    value, space = _bytes(plain)
    gap = space[data]
    word = ~gap
    starts, ends = word.copy(), word.copy()
    starts[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    starts[first] = word[first]
    ends[last] = word[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(max(CHUNK, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _WORD[9]
    return mixed(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _WORD[i]
    return mixed(total)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, of about CHUNK bytes each; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; a text of fewer words has its whole sequence as one."""
    for _, data, offsets in chunks(texts):
        words, first = word_hashes(data, offsets)
        runs = shingle_hashes(words, size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                s = np.sort(runs[a : b - size + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                yield mixed((words[a:b] * _WORD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _WORD[10 : 11] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
