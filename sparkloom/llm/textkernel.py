"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw Arrow buffers of a batch of texts: one flat
``uint8`` array and the row offsets into it. A batch is cut into slices of a few
megabytes (``slices``), so the temporary arrays stay small whatever the batch
size is; a text longer than a slice forms a slice of its own and is processed
whole.

Null texts count as empty texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))


def _byte_values() -> np.ndarray:
    """256 fixed pseudo-random 64-bit values (splitmix64)."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_VALUES = _byte_values()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES_LOWER = _VALUES[_LOWER]

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) array and its row offsets (int64, from 0)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row ranges of about ``limit`` bytes."""
    raw, offs = buffers(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class RangeHasher:
    """64-bit hashes of byte ranges of one buffer, by polynomial prefix sums."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        power, self._inverse = _power_tables(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_VALUES_LOWER if lower else _VALUES)[raw] * power[:-1], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inner = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(inner + (ends - starts).astype(np.uint64) * _U64(0xA24BAED4963EE407))


def words(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and each row's first word (offsets).

    Words are ``[^\\x20\\x09-\\x0D]+``, unless another table of separating bytes is given.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(separator[raw], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[1:-1][edges]
    finish[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offs)


#: ASCII but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each row, and the row offsets into them."""
    starts, ends, first = words(raw, offs)
    return RangeHasher(raw, lower=True)(starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row and their row offsets.

    A row with fewer words (but at least one) has one shingle: all its words.
    """
    counts = np.diff(first)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, n)):
        factor = _U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        rolled[: n - k] += hashes[k:] * factor
    rolled = mix(rolled)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(made, out=out_first[1:])
    index = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    out = rolled[index]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        h = _U64(counts[row])
        with np.errstate(over="ignore"):
            for x in hashes[first[row] : first[row + 1]]:
                h = h * _U64(0xC2B2AE3D27D4EB4F) + x
        out[out_first[row]] = mix(np.array([h], np.uint64))[0]
    return out, out_first


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the row offsets."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(len(first)))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every range, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class HashIndex:
    """An open-addressing map from 64-bit keys to int64 values, looked up in batches."""

    def __init__(self, capacity: int = 1 << 12):
        self._reset(capacity)

    def _reset(self, capacity: int) -> None:
        size = 1 << max(4, int(2 * capacity - 1).bit_length())
        self._mask = _U64(size - 1)
        self._keys = np.zeros(size, dtype=np.uint64)
        self._vals = np.full(size, -1, dtype=np.int64)
        self._full = np.zeros(size, dtype=bool)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where absent."""
        at = (keys * _U64(0x9FB21C651E98DF25)) >> _U64(20) & self._mask
        found = np.where(self._keys[at] == keys, self._vals[at], -1)
        # an empty slot holds key 0 and value -1, so key 0 absent also yields -1
        todo = np.flatnonzero((self._keys[at] != keys) & self._full[at])
        at = at[todo]
        while len(todo):
            at = (at + _U64(1)) & self._mask
            same = self._keys[at] == keys[todo]
            found[todo[same]] = self._vals[at[same]]
            more = ~same & self._full[at]
            todo, at = todo[more], at[more]
        return found

    def insert(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds distinct keys that are not yet in the map."""
        if 2 * (self.count + len(keys)) > len(self._keys):
            old_keys, old_vals = self._keys[self._full], self._vals[self._full]
            self._reset(2 * (self.count + len(keys)))
            self._put(old_keys, old_vals)
        self._put(keys, vals)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.count += len(keys)
        at = (keys * _U64(0x9FB21C651E98DF25)) >> _U64(20) & self._mask
        todo = np.arange(len(keys))
        while len(todo):
            free = ~self._full[at]
            slot, one = np.unique(at[free], return_index=True)
            who = todo[free][one]
            self._keys[slot], self._vals[slot], self._full[slot] = keys[who], vals[who], True
            left = np.ones(len(todo), dtype=bool)
            left[np.flatnonzero(free)[one]] = False
            todo, at = todo[left], (at[left] + _U64(1)) & self._mask


#: Code points with the White_Space property; fixed values.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point: white space, letter (L*), number (N*) or other."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[_SPACES] = SPACE
        _classes.append(table)
    return _classes[0]


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8 bytes and the byte at which each begins (with the end)."""
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return chars, begins


def pretokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the matches of the byte-level pattern, and each row's first match.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    Its matches follow from runs of one character class: the last character of a
    white-space run before other text is split off, and joins what follows if it
    is a blank; a lone apostrophe takes a suffix from the letters after it.
    """
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    chars, begins = code_points(raw)
    n = len(chars)
    kind = char_classes()[chars]
    cut = np.zeros(n + 4, dtype=bool)  # a row begins here
    cut[np.searchsorted(begins, offs[:-1])] = True
    cut[n:] = True
    run = np.empty(n + 1, dtype=bool)
    run[1:n] = kind[1:] != kind[:-1]
    run[0] = run[n] = True
    run |= cut[: n + 1]
    token = run.copy()
    # white space before other text of the same row
    after = np.flatnonzero(run[1:n] & ~cut[1:n] & (kind[:-1] == SPACE)) + 1
    token[after - 1] = True
    token[after[chars[after - 1] == 0x20]] = False
    # suffixes after a lone apostrophe
    lone = np.flatnonzero((chars[: n - 1] == 0x27) & token[: n - 1] & run[1:n] & ~cut[1:n])
    lone = lone[kind[lone + 1] == LETTER]
    lone = lone[run[lone]]
    if len(lone):
        one = chars[lone + 1]
        two = np.zeros(len(lone), dtype=np.uint32)
        has = (lone + 2 < n) & ~cut[lone + 2]
        two[has] = chars[lone[has] + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        token[lone[short] + 1] = False
        token[lone[short] + 2] = True
        token[lone[long] + 1] = False
        token[lone[long] + 3] = True
    token[n] = False
    starts = begins[:-1][np.flatnonzero(token[:n])]
    ends = np.append(starts[1:], len(raw))
    return starts, ends, np.searchsorted(starts, offs)
