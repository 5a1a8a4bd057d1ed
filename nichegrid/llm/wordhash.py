"""Words of many texts as 64-bit hashes, in numpy and a bounded lot of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACES = b" \t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, with A-Z as a-z, and which bytes are space."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[list(_SPACES)] = True
    values[space] = 0
    return values, space


_VALUES, _SPACE = _tables()
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1024)
        _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _MULTIPLIER, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _of_bytes(raw: np.ndarray) -> np.ndarray:
    """The hashes of the words in ``raw``, in order."""
    blank = _SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts = edge[~blank[edge]]
    if len(raw) and not blank[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = int(starts[0])
    raw, starts = raw[first:], starts - first
    inside = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return mixed(np.add.reduceat(_VALUES[raw] * _power(int(inside.max()) + 1)[inside], starts))


def words(text: bytes | None, lot: int = 1 << 18) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    if not text:
        return np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(text):
        end = min(at + lot, len(text))
        while end < len(text) and not _SPACE[text[end]]:  # a lot ends at a space
            end += 1
        out.append(_of_bytes(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words in ``raw`` begin and end."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def words_of_all(texts: Sequence[bytes | None], lot: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lots of texts as (first, past the last, word hashes, start of each text's words and the end).

    A lot has about ``lot`` bytes, or one longer text.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= lot):
            size += len(texts[last] or b"")
            last += 1
        if last == first + 1:
            hashes = words(texts[first], lot)
            yield first, last, hashes, np.array([0, len(hashes)])
        else:
            joined = np.frombuffer(b"\n".join(t or b"" for t in texts[first:last]) + b"\n", np.uint8)
            blank = _SPACE[joined]
            begins = ~blank
            begins[1:] &= blank[:-1]
            ends = np.array([len(t or b"") + 1 for t in texts[first:last]]).cumsum()
            counts = np.concatenate([[0], begins.cumsum()])
            yield first, last, _of_bytes(joined), np.concatenate([[0], counts[ends]])
        first = last


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words; a shorter text, if not empty, is one run."""
    counts = np.diff(bounds)
    runs = np.maximum(counts - size + 1, 0)
    starts = np.repeat(bounds[:-1] - np.concatenate([[0], runs.cumsum()[:-1]]), runs) + np.arange(runs.sum())
    combined = np.zeros(len(starts), np.uint64)
    for i in range(size):
        combined = combined * _MULTIPLIER + hashes[starts + i]
    text = np.repeat(np.arange(len(counts)), runs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = []
    for t in short:
        value = np.uint64(counts[t])
        with np.errstate(over="ignore"):
            for h in hashes[bounds[t] : bounds[t + 1]]:
                value = value * _MULTIPLIER + h
        whole.append(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.concatenate([text, short]), mixed(np.concatenate([combined, np.array(whole, np.uint64)]))
