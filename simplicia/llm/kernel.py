"""Word boundaries and word hashes of Arrow string columns, with numpy.

Inside a task the texts of a record batch lie in one byte buffer.  The
functions here find the words of all texts at once and give every word a
64-bit hash from prefix sums, without making a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# A random weight for every byte value, for sums modulo 2**64 and modulo a prime; fixed seeds, so all tasks agree.
_WEIGHT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_103_515_249
_PRIME_WEIGHT = np.random.default_rng(20240301).integers(1, _PRIME, 256, dtype=np.uint64)


def _lower(weight: np.ndarray) -> np.ndarray:
    out = weight.copy()
    out[65:91] = weight[97:123]
    return out


_WEIGHTS = {False: (_WEIGHT, _PRIME_WEIGHT), True: (_lower(_WEIGHT), _lower(_PRIME_WEIGHT))}

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)
# remainders by the prime fit into half the room
_prime_powers = np.ones(1, np.uint32)
_prime_inverses = np.ones(1, np.uint32)

#: Tables grow by steps of so many entries; a worker keeps them from task to task.
_STEP = 1 << 16
#: Text whose words are looked at together, in bytes; a longer text is looked at alone, as a whole.
SLICE = 1 << 19


def _room(n: int) -> int:
    return -(-n // _STEP) * _STEP


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    global _powers, _inverses
    if len(_powers) < n:
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            table = np.full(_room(n), base, U64)
            table[0] = 1
            np.cumprod(table, out=table)
            globals()[name] = table
    return _powers[:n], _inverses[:n]


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the other base and of its inverse modulo the prime, n of each at least; doubled until they are enough."""
    for name, base in (("_prime_powers", _PRIME_BASE), ("_prime_inverses", pow(_PRIME_BASE, -1, _PRIME))):
        table = globals()[name]
        size = _room(n) if len(table) < n else len(table)
        while len(table) < size:
            more = table[: size - len(table)] * U64(pow(base, len(table), _PRIME)) % U64(_PRIME)
            table = np.concatenate([table, more.astype(np.uint32)])
        globals()[name] = table
    return _prime_powers[:n], _prime_inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a one-to-one mapping."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binary values) and the offsets of each; a null text counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Prefix(NamedTuple):
    """Prefix sums of the weights of bytes, modulo 2**64 and of remainders by the prime."""

    wide: np.ndarray
    prime: np.ndarray


def byte_prefix(data: np.ndarray, *, lower: bool = False) -> Prefix:
    """Prefix sums from which span_hashes takes the hash of any span."""
    n = len(data)
    power, prime_power = power_tables(n + 1)[0][:n], _prime_tables(n + 1)[0][:n]
    weight, prime_weight = _WEIGHTS[lower]
    prefix = Prefix(np.zeros(n + 1, U64), np.zeros(n + 1, U64))
    each = weight[data]
    each *= power
    np.cumsum(each, out=prefix.wide[1:])
    # fewer than 2**33 summands below 2**31: no overflow
    np.take(prime_weight, data, out=each, mode="clip")  # a byte is always in range; this mode needs no copy
    each *= prime_power
    each %= U64(_PRIME)
    np.cumsum(each, out=prefix.prime[1:])
    return prefix


def span_hashes(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans have equal hashes.

    Sums modulo a power of two alone agree on some different spans of regular
    structure whatever the weights; the sums modulo a prime tell these apart.
    """
    inverse, prime_inverse = power_tables(len(prefix.wide) + 1)[1], _prime_tables(len(prefix.wide) + 1)[1]
    prime = (prefix.prime[end] - prefix.prime[start]) % U64(_PRIME) * prime_inverse[start] % U64(_PRIME)
    return mix(mix((prefix.wide[end] - prefix.wide[start]) * inverse[start]) + prime * U64(0xC2B2AE3D27D4EB4F))


@dataclass
class Words:
    """Words of the texts of rows first..last of a batch."""

    first: int
    last: int
    data: np.ndarray
    text_at: np.ndarray  # byte offset of each text, and the end
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray  # index of each text's first word, and the end
    hash: np.ndarray
    prefix: Prefix

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hashes(self.prefix, start, end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slices(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of(column: pa.Array, *, lower: bool, max_bytes: int = SLICE) -> Iterator[Words]:
    """Words of whole texts, some megabytes of text at a time."""
    data, offsets = text_buffers(column)
    for first, last in slices(offsets, max_bytes):
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        n = len(part)
        word = ~_SPACE[part]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:n]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        prefix = byte_prefix(part, lower=lower)
        words = Words(first, last, part, at, start, end, np.searchsorted(start, at), np.zeros(0, U64), prefix)
        words.hash = words.span_hash(start, end)
        yield words


def windows(words: Words, width: int, base: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and each run's first word."""
    n = len(words.hash)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for k in range(1, width):
        cut = words.word_at[1:] - k
        inside[cut[(cut >= 0) & (cut >= words.word_at[:-1])]] = False
    # texts shorter than the window have no run; the loop above marks each of their words
    at = np.flatnonzero(inside[: n - width + 1])
    total = words.hash[at].copy()
    for k in range(1, width):
        total *= U64(base)
        total += words.hash[at + k]
    return mix(total), at
