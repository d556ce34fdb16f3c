"""Suffix order, wavelet ranks and backward search over a sequence of small integers.

The sequence is one shard of text as word codes.  Code 0 stands for "no word of
the searched phrases"; each 0 is a symbol of its own, smaller than every code
and ordered by place, so no phrase reaches over one and every suffix is unique.
"""

from __future__ import annotations

import numpy as np

#: Places are kept in this many bits of a sort key, which bounds a shard.
PLACE_BITS = 20
MAX_PLACES = 1 << PLACE_BITS
_PLACES = np.uint64(MAX_PLACES - 1)


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order, by doubling the compared length.

    Rank of the first part, rank of what follows and place share one 60-bit key,
    so a round is one plain sort; only suffixes that still tie take part in it.
    ``codes`` ends with 0.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n > MAX_PLACES or codes[-1] != 0:
        raise ValueError("a shard ends with 0 and holds at most 2**20 codes")
    bits = max(1, int(codes.max()).bit_length())
    compared = max(1, (64 - PLACE_BITS) // bits)
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for ahead in range(compared):
        symbol = np.zeros(n, np.uint64)
        symbol[: max(0, n - ahead)] = codes[ahead:]
        open_ &= symbol > 0
        key = (key << np.uint64(bits)) | np.where(open_, symbol, np.uint64(0))
    key = np.sort((key << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64))
    order = (key & _PLACES).astype(np.int64)
    head = key >> np.uint64(PLACE_BITS)
    fresh = np.ones(n, bool)
    # A key whose last symbol is 0 reached a 0: its place decides.
    fresh[1:] = (head[1:] != head[:-1]) | ((head[1:] & np.uint64((1 << bits) - 1)) == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        place = order[slots]
        pair = (rank[place].astype(np.uint64) << np.uint64(PLACE_BITS)) | rank[place + compared].astype(np.uint64)
        key = np.sort((pair << np.uint64(PLACE_BITS)) | place.astype(np.uint64))
        place = (key & _PLACES).astype(np.int64)
        order[slots] = place
        pair = key >> np.uint64(PLACE_BITS)
        fresh = np.ones(len(slots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[place] = np.maximum.accumulate(np.where(fresh, slots, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = slots[tied]
        compared *= 2
    return order


class WaveletRanks:
    """Bit levels of a sequence, highest first, each split stably into its zeros and ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[int] = []
        self._words: list[np.ndarray] = []
        self._before: list[np.ndarray] = []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self._words.append(words)
            self._before.append(before)
            self.zeros.append(len(current) - int(bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[level][word] + np.bitwise_count(self._words[level][word] & low)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place ``at``."""
        start = np.zeros(len(at), np.int64)
        end = at.astype(np.int64)
        for level in range(self.bits):
            is_one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones_start, ones_end = self._ones(level, start), self._ones(level, end)
            start = np.where(is_one, self.zeros[level] + ones_start, start - ones_start)
            end = np.where(is_one, self.zeros[level] + ones_end, end - ones_end)
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        start = np.zeros(len(at), np.int64)
        place = at.astype(np.int64)
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            word = self._words[level][place >> 6]
            is_one = ((word >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones_start, ones_place = self._ones(level, start), self._ones(level, place)
            start = np.where(is_one, self.zeros[level] + ones_start, start - ones_start)
            place = np.where(is_one, self.zeros[level] + ones_place, place - ones_place)
            symbol = (symbol << 1) | is_one
        return symbol, place - start


class PhraseIndex:
    """FM-index of one shard: count phrases by backward search, locate them by sampled suffix places."""

    def __init__(self, codes: np.ndarray, top: int, sample: int = 16):
        order = suffix_order(codes)
        n = len(codes)
        last = codes[order - 1]  # the symbol before each suffix; before the first stands the closing 0
        self._ranks = WaveletRanks(last, max(1, int(top).bit_length()))
        self._first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(codes, minlength=top + 1), out=self._first[1:])
        # Sampled are the places at every ``sample``-th step after a 0, so walking back never has to cross one.
        place = np.arange(n)
        after_zero = np.zeros(n, np.int64)
        after_zero[1:] = np.where(codes[:-1] == 0, place[1:], 0)
        step = place - np.maximum.accumulate(after_zero)
        self._kept = (step % sample == 0)[order]
        self._kept_before = np.cumsum(self._kept) - self._kept
        self._places = order[self._kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; ``phrases`` is right-aligned, one phrase a row, codes above 0."""
        width = phrases.shape[1]
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self._first[-1])
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                continue
            symbol = phrases[live, width - back]
            low[live] = self._first[symbol] + self._ranks.rank(symbol, low[live])
            high[live] = self._first[symbol] + self._ranks.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text place of each row: step back to a sampled one and add the steps."""
        found = np.zeros(len(rows), np.int64)
        which = np.arange(len(rows))
        at = rows.astype(np.int64)
        steps = 0
        while len(which):
            kept = self._kept[at]
            found[which[kept]] = self._places[self._kept_before[at[kept]]] + steps
            which, at = which[~kept], at[~kept]
            if len(which):
                symbol, before = self._ranks.symbol_and_rank(at)
                at = self._first[symbol] + before
            steps += 1
        return found
