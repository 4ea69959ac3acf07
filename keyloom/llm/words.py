"""Vectorised word and line scanning over the bytes of many texts at once.

Where an index stands for equality, distinct_spans and grouped compare the bytes (or exact numbers made from
them). Hashes alone are used where no comparison can follow, as for shingles of different tasks: 8 bytes after
8 go through a mixing step that loses nothing of the state before, so equal-length spans of up to 8 bytes
never collide and other different spans do with a chance of about 2**-64 a pair, however they repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: UTF-8 continuation bytes.
INNER = (np.arange(256) & 0xC0) == 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, wrapping."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
_KEY = b"keyloom spans"
_TAILS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, as numbers; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span."""
    eight, lengths = eights(data), ends - starts
    out = mix(lengths.astype(U))
    for k in range(0, LONG_SPAN, 8):
        at = np.flatnonzero((lengths > k) & (lengths <= LONG_SPAN))
        if not len(at):
            break
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & _TAILS[np.minimum(lengths[at] - k, 8)]))
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=_KEY).digest(), "little")
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span has the bytes of the span numbered other[i]."""
    at = np.flatnonzero(other != np.arange(len(other)))
    to = other[at]
    lengths = ends[at] - starts[at]
    if not np.array_equal(lengths, ends[to] - starts[to]):
        return False
    for i in np.flatnonzero(lengths > LONG_SPAN).tolist():
        if not np.array_equal(data[starts[at[i]] : ends[at[i]]], data[starts[to[i]] : ends[to[i]]]):
            return False
    eight = eights(data)
    for k in range(0, LONG_SPAN, 8):
        some = (lengths > k) & (lengths <= LONG_SPAN)
        at, to, lengths = at[some], to[some], lengths[some]
        if not len(at):
            break
        if ((eight[starts[at] + k] ^ eight[starts[to] + k]) & _TAILS[np.minimum(lengths - k, 8)]).any():
            return False
    return True


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one span of every kind, and for each span its kind's number. Equal means equal bytes."""
    _, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if equal_spans(data, starts, ends, index[inverse]):
        return index, inverse
    # Two different spans share a hash: number them by their bytes.
    raw, numbers, firsts = data.tobytes(), {}, []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if numbers.setdefault(raw[a:b], len(numbers)) == len(firsts):
            firsts.append(i)
    return np.array(firsts), np.array([numbers[raw[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where inside holds, cut at the texts' offsets."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    first = inside & (~before[:-1] | cut[:-1])
    after = np.append(inside[1:], False)
    last = inside & (~after | cut[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_text(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds (one more than texts) of each text's share of the sorted positions."""
    return np.searchsorted(positions, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags hold within each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive word hashes (also across texts: the caller masks those)."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, U)
    for k in range(size):
        out = mix(out ^ hashes[k : k + n])
    return out


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal rows of the columns of numbers together, earlier first, and a flag: equal to the one before."""
    key = np.zeros(len(columns[0]), U)
    for c in columns:
        key = mix(key ^ c.astype(U))
    order = np.argsort(key, kind="stable")
    alike = key[order][1:] == key[order][:-1]
    equal = lambda: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    same = equal()
    if (alike != same).any():  # two different rows share a key
        order = np.lexsort(columns)
        same = equal()
    return order, np.append(np.zeros(min(len(key), 1), bool), same)


def tables_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace-separated words: starts, ends and each text's bounds among them."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, per_text(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, with the texts' bounds.

    Words are lower-cased in A-Z. A text of 1 to size-1 words has one shingle, of all its words.
    """
    data = LOWER[data]
    starts, ends, bounds = tables_of_words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    owner, number = owners(bounds), np.diff(bounds)
    if len(hashes) >= size:
        whole = windows(hashes, size)
        inside = owner[: len(whole)] == owner[size - 1 :]
        whole, who = whole[inside], owner[: len(inside)][inside]
    else:
        whole, who = np.zeros(0, U), np.zeros(0, np.int64)
    few = np.flatnonzero((number > 0) & (number < size))
    if len(few):
        short = number[few].astype(U)
        for k in range(size - 1):
            has = number[few] > k
            short[has] = mix(short[has] ^ hashes[bounds[few[has]] + k])
        whole = np.concatenate([whole, short])
        who = np.concatenate([who, few])
    order = np.lexsort((whole, who))
    whole, who = whole[order], who[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (who[1:] != who[:-1])
    whole, who = whole[new], who[new]
    return whole, np.searchsorted(who, np.arange(len(offsets)))
