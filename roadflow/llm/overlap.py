"""T-occurrence search over one inverted index: which sets share enough elements with a query set."""

from __future__ import annotations

import heapq

import numpy as np


class Groups:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return int(k)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        root = self.parent
        while True:
            up = root[root]
            if (up == root).all():
                self.parent = root
                return root
            root = up


class OccurrenceIndex:
    """Inverted lists of sets.

    A query needs ``t`` common elements with a match.  Its longest lists are set
    aside, fewer than ``t`` of them, so a match must occur on the short ones too
    (DivideSkip).  The short lists are merged by a heap that skips records which
    can't reach their share; what comes out is looked up in the long lists by
    binary search.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(elements, kind="stable")
        sorted_ = elements[order]
        fresh = np.ones(len(sorted_), bool)
        fresh[1:] = sorted_[1:] != sorted_[:-1]
        number = np.cumsum(fresh) - 1
        self.posting = owner[order]
        self.start = np.append(np.flatnonzero(fresh), len(sorted_))
        mine = np.empty(len(order), np.int64)
        mine[order] = number
        bounds = np.cumsum([0, *(len(s) for s in sets)])
        self.lists = [mine[bounds[k] : bounds[k + 1]] for k in range(len(sets))]

    def lengths(self, query: int) -> np.ndarray:
        lists = self.lists[query]
        return self.start[lists + 1] - self.start[lists]

    def matches(self, query: int, allowed: np.ndarray, least: int, needed: np.ndarray) -> np.ndarray:
        """Positions among ``allowed`` that share at least ``needed[position]`` elements with the query.

        ``least`` is a lower bound of ``needed`` over all allowed positions.
        """
        lists = self.lists[query]
        length = self.lengths(query)
        lists = lists[np.argsort(length, kind="stable")]
        if len(lists) < least:
            return np.zeros(0, np.int64)
        longest = int(self.start[lists[-1] + 1] - self.start[lists[-1]]) if len(lists) else 0
        # Fewer lists are set aside where they are long, as each candidate costs a probe in each of them.
        aside = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        runs = []
        for k in short.tolist():
            run = self.posting[self.start[k] : self.start[k + 1]]
            run = run[allowed[run]]
            if len(run):
                runs.append(run.tolist())
        share = least - aside
        candidates, counts = _merge_skip(runs, share)
        if not len(candidates):
            return candidates
        reached = counts >= needed[candidates] - len(long_)
        candidates, counts = candidates[reached], counts[reached]
        out = []
        step = max(1, (1 << 20) // max(1, len(long_)))
        for at in range(0, len(candidates), step):
            some = candidates[at : at + step]
            total = counts[at : at + step] + self._probe(long_, some)
            out.append(some[total >= needed[some]])
        return np.concatenate(out) if out else candidates

    def _probe(self, lists: np.ndarray, records: np.ndarray) -> np.ndarray:
        """On how many of ``lists`` each record is found, by binary search in all of them side by side."""
        if not len(lists) or not len(records):
            return np.zeros(len(records), np.int64)
        low = np.broadcast_to(self.start[lists], (len(records), len(lists))).copy()
        high = np.broadcast_to(self.start[lists + 1], low.shape).copy()
        end = high.copy()
        wanted = records[:, None]
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            below = open_ & (self.posting[np.minimum(middle, len(self.posting) - 1)] < wanted)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        found = (low < end) & (self.posting[np.minimum(low, len(self.posting) - 1)] == wanted)
        return found.sum(1)


def _merge_skip(runs: list[list[int]], share: int) -> tuple[np.ndarray, np.ndarray]:
    """Records on at least ``share`` of the sorted runs, and on how many they are."""
    from bisect import bisect_left

    if len(runs) < share:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heap = [(run[0], k) for k, run in enumerate(runs)]
    heapq.heapify(heap)
    at = [0] * len(runs)
    records, counts = [], []
    while len(heap) >= share:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= share:
            records.append(top)
            counts.append(len(popped))
            target = top + 1
        else:
            # Fewer than ``share`` runs stand before the next top, so nothing below it can get there.
            while heap and len(popped) < share - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = max(heap[0][0], top + 1)
        for k in popped:
            run, place = runs[k], at[k]
            if run[place] < target:
                place = place + 1 if place + 1 < len(run) and run[place + 1] >= target else bisect_left(run, target, place + 1)
                at[k] = place
            if place < len(run):
                heapq.heappush(heap, (run[place], k))
    return np.array(records, np.int64), np.array(counts, np.int64)
