"""Words and shingles of Arrow text columns as numpy arrays.

Words are runs of bytes outside space and U+0009-U+000D (UTF-8 keeps those
bytes for themselves).  A word's hash is polynomial, cut from one prefix sum
over the bytes; all arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ONE = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text that are looked at together.
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: For text compared without punctuation: every ASCII byte but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ONE)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, dtype=U64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null texts are empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64  # also longer than 2 GB together
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about chunk bytes."""
    data, at = buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + chunk, side="right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of each word, in order; start and end are bytes."""
    n = len(data)
    if n == 0:
        return np.empty(0, U64), *[np.empty(0, np.int64)] * 3
    letters = LOWER[data]
    solid = ~space[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    starts_text = np.zeros(n + 1, dtype=bool)
    starts_text[at] = True  # a text starts here, or the end
    opens |= solid & starts_text[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes |= solid & starts_text[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[letters] * powers(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_INVERSE, n)[start]
    return mix(h), np.searchsorted(at, start, side="right") - 1, start, end


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds): text i has hash[bounds[i]:bounds[i + 1]], repeats included.

    A text with fewer than k words gives its whole sequence as one; one
    without words gives none.
    """
    step = U64(0xA24BAED4963EE407)
    per = np.bincount(text, minlength=n_texts)
    if len(word) >= k:
        h = word[: len(word) - k + 1].copy()
        for i in range(1, k):
            h *= step
            h += word[i : len(word) - k + 1 + i]
        whole = text[: len(word) - k + 1] == text[k - 1 :]
        h = mix(h[whole])
    else:
        h = np.empty(0, U64)
    count = np.maximum(per - k + 1, 0)
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])
        own = []
        for i in short:
            x = U64(per[i])
            with np.errstate(over="ignore"):
                for w in word[first[i] : first[i + 1]]:
                    x = x * step + w
            own.append(x)
        where = np.concatenate([[0], np.cumsum(count)])[short]
        h = np.insert(h, where, mix(np.array(own, dtype=U64) ^ U64(_ONE)))
        count[short] = 1
    return h, np.concatenate([[0], np.cumsum(count)])


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    if len(x) < 2:
        return x
    keep = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


class Lookup:
    """Place of 64-bit keys in an array of distinct ones, by hash tables.

    What collides in one table goes to the next, so a lookup is exact.
    """

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([np.zeros(1, U64), keys.astype(U64)])
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        rows = np.arange(1, len(self.keys), dtype=np.int32)
        while len(rows):
            i = len(self.tables)
            multiplier = U64((self.MULTIPLIERS[i % 5] + 2 * i) % 2**64)
            bits = max(10, int(8 * len(rows)).bit_length())
            shift = U64(64 - bits)
            slot = (self.keys[rows] * multiplier) >> shift
            table = np.zeros(1 << bits, np.int32)
            table[slot] = rows
            self.tables.append((multiplier, shift, table))
            rows = rows[table[slot] != rows]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """1 + place of each key, or 0."""
        keys = keys.astype(U64, copy=False)
        row, open_ = np.zeros(len(keys), np.int32), None
        for multiplier, shift, table in self.tables:
            rest = keys if open_ is None else keys[open_]
            got = table[(rest * multiplier) >> shift]
            got[self.keys[got] != rest] = 0
            if open_ is None:
                row, open_ = got, np.flatnonzero(got == 0)
            else:
                row[open_] = got
                open_ = open_[got == 0]
        return row
