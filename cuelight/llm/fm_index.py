"""An FM-index over the words of a shard of texts.

The words of a shard, numbered by its own vocabulary, stand in one row with a separator after each text. Its suffixes are
sorted; the words before them (the Burrows-Wheeler transform) go into a wavelet matrix, whose ranks answer a backward search
for many phrases at once. Every ``SAMPLE``-th place is kept, so that an occurrence is found by stepping back to one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Places between two that are kept; occurrences located at a time; numbers of the end and of a separator, before the words.
SAMPLE, LOCATED, END, SEPARATOR, WORDS = 16, 1 << 18, 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order. Its last number is 0 and occurs nowhere else.

    Sorts by some numbers, then by twice as many each round; a suffix that is told from all others rests.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, dtype=np.int64)])
    key = padded[:n].copy()
    for k in range(1, width):
        key = key << bits | padded[k:n + k]
    order = np.argsort(key)
    rank = np.zeros(n, dtype=np.int64)
    active = np.arange(n)
    key = key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begins = np.flatnonzero(new)
        rank[order[active]] = active[begins[np.cumsum(new) - 1]]
        alone = new & np.concatenate([new[1:], [True]])
        active = active[~alone]
        if not len(active):
            return order
        places = order[active]
        key = rank[places] * n + rank[places + width]
        by = np.argsort(key)
        order[active], key = places[by], key[by]
        width *= 2


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with one spare word behind them."""
    out = np.zeros(len(bits) // 64 + 1, dtype="<u8")
    raw = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[:len(raw)] = raw
    return out


class Ranks:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


@dataclass
class Stored:
    """What is written of an index: occurrences of each number, the wavelet matrix level by level, marks of the suffixes whose places are
    kept, and these places."""

    counts: bytes
    levels: bytes
    marks: bytes
    places: bytes


STORED = [f.name for f in fields(Stored)]


def build(text: np.ndarray) -> Stored:
    """The index of a row of numbers that ends in ``END``."""
    order = suffix_array(text)
    counts = np.bincount(text)
    kept = order % SAMPLE == 0
    column, levels = text[order - 1].astype(np.int32), []
    for level in reversed(range(max(1, (len(counts) - 1).bit_length()))):
        bit = (column >> level & 1).astype(bool)
        levels.append(_packed(bit).tobytes())
        column = np.concatenate([column[~bit], column[bit]])
    return Stored(counts.astype("<i4").tobytes(), b"".join(levels), _packed(kept).tobytes(), (order[kept] // SAMPLE).astype("<i4").tobytes())


class Index:
    def __init__(self, stored: Stored):
        self.counts = np.frombuffer(stored.counts, dtype="<i4").astype(np.int64)
        self.size, depth = int(self.counts.sum()), max(1, (len(self.counts) - 1).bit_length())
        self.levels = [Ranks(w) for w in np.frombuffer(stored.levels, dtype="<u8").reshape(depth, -1)]
        self.zeros = [self.size - int(r.ones(np.array([self.size]))[0]) for r in self.levels]
        self.marks, self.places = Ranks(np.frombuffer(stored.marks, dtype="<u8")), np.frombuffer(stored.places, dtype="<i4")
        self.begins = np.cumsum(self.counts) - self.counts
        # at the bottom of the matrix numbers stand in the order of their bits reversed
        numbers = np.arange(len(self.counts))
        turned = sum((numbers >> k & 1) << (depth - 1 - k) for k in range(depth))
        bottom = np.argsort(turned)
        self.shift = self.begins.copy()
        self.shift[bottom] -= np.cumsum(self.counts[bottom]) - self.counts[bottom]

    def _before(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first suffix of ``number`` and what stands before place ``at`` of the column, for each pair."""
        for k, (ranks, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = ranks.ones(at)
            at = np.where(number >> len(self.levels) - 1 - k & 1, zeros + ones, at - ones)
        return self.shift[number] + at

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase. Phrases are rows of numbers that end at the last column; no
        number is negative within their lengths."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            alive = alive[(lengths[alive] > k) & (low[alive] < high[alive])]
            if not len(alive):
                break
            number = phrases[alive, phrases.shape[1] - 1 - k]
            low[alive], high[alive] = self._before(number, low[alive]), self._before(number, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places at which suffixes begin, by their rows in the order."""
        found, steps, left = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(left):
            kept = self.marks.get(rows)
            found[left[kept]] = self.places[self.marks.ones(rows[kept])].astype(np.int64) * SAMPLE + steps
            left, rows = left[~kept], rows[~kept]
            number, at = np.zeros(len(rows), dtype=np.int64), rows
            for ranks, zeros in zip(self.levels, self.zeros):
                one, ones = ranks.get(at), ranks.ones(at)
                number, at = number << 1 | one, np.where(one, zeros + ones, at - ones)
            rows, steps = self.shift[number] + at, steps + 1
        return found
