"""Hashed word features of whole texts, for a batch of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)
_Q = np.uint64(0x2545F4914F6CDD1D)
#: Words longer than LONG bytes that hold bytes above ASCII (scripts without spaces) also give each window of WINDOW bytes that begins a character.
LONG, WINDOW = 24, 6


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M
    return h ^ (h >> np.uint64(31))


def words_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts, and start, length and text number of each word (runs of letters, digits and bytes above ASCII)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return _LOWER[raw], starts, ends - starts, np.searchsorted(firsts, starts, "right") - 1


def word_features(texts: Sequence[bytes], prefixes: Sequence[int] = (4, 5, 6, 7, 8)) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word, of its prefixes of the given byte lengths, and of the windows of long words above ASCII; repeats included.

    A hash covers every byte: it sums values that depend on a byte and its place in the word.
    """
    low, starts, sizes, owner = words_of(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = (low.astype(np.uint64) + np.uint64(1)) * _P
    place = np.arange(len(low), dtype=np.uint64) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(low)])).astype(np.uint64)
    spread = mixed(value + place * _Q)
    spread[~_IN_WORD[low]] = 0
    found_owner, found = [owner], [mixed(np.add.reduceat(spread, starts) + np.uint64(1 << 32))]
    h, at, left, of = np.zeros(len(starts), np.uint64), starts, sizes, owner
    for j in range(max(prefixes, default=0)):
        longer = left > j + 1
        h, at, left, of = h[longer] + spread[at[longer] + j], at[longer], left[longer], of[longer]
        if j + 1 in prefixes:
            found_owner.append(of)
            found.append(mixed(h + np.uint64(j + 1)))
    high = np.add.reduceat(low >= 128, starts, dtype=np.int64) > 0
    for word in np.flatnonzero((sizes > LONG) & high):
        at = np.arange(starts[word], starts[word] + sizes[word] - WINDOW + 1)
        at = at[low[at] & 0xC0 != 0x80]
        h = sum(mixed(value[at + j] + np.uint64(j) * _Q) for j in range(WINDOW))
        found_owner.append(np.full(len(at), owner[word]))
        found.append(mixed(h + np.uint64(1 << 33)))
    return np.concatenate(found_owner), np.concatenate(found)
