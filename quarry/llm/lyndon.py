"""Suffix arrays by linear grouping, of many short texts side by side.

Suffixes are grouped by their first symbol and the groups taken from the highest down. The suffixes of a group point to
the nearest suffix before them that is in a lower group; each suffix so pointed to begins with its own symbols followed
by as many copies of the group's prefix as point to it, so it moves up within its group, the more copies the further.
When all groups are done, each holds the suffixes of one Lyndon prefix, and the groups are in order. Then suffixes are
read from the least up, and each puts those before it, along the same pointers, at the next free place of their group.
No text is renamed or sorted again. Every text is one lane: a step takes one group, or one suffix, of each lane.
"""

from __future__ import annotations

import numpy as np


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for each i."""
    if not len(n):
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Lanes:
    """symbols: those of all lanes, one lane after another, each lane ending with a 0; 0 elsewhere separates the parts
    of a lane. A separator is smaller than all symbols and than the separators before it. ends: where lanes end."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        # a separator before the first lane, at which pointers stop
        self.symbol = np.concatenate([[0], symbols]).astype(np.int64)
        self.base = np.concatenate([[1], ends[:-1] + 1]).astype(np.int64)
        self.size = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        n = len(self.symbol)
        lane = np.repeat(np.arange(len(ends)), self.size)
        at = np.arange(1, n)
        rank = np.where(self.symbol[1:] == 0, -at, self.symbol[1:])  # separators: the later the smaller
        order = np.lexsort((rank, lane)) + 1
        self.order = np.concatenate([[0], order])  # suffixes by place
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        ranks = np.concatenate([[-n], rank[order - 1]])
        new = np.ones(n, bool)
        new[2:] = (ranks[2:] != ranks[1:-1]) | (lane[order[1:] - 1] != lane[order[:-1] - 1])
        first = np.flatnonzero(new)
        self.group = np.empty(n, np.int64)  # of each suffix: the first place of its group
        self.group[self.order] = np.repeat(first, np.diff(np.append(first, n)))
        self.many = np.zeros(n, np.int64)  # of each group, at its first place: its suffixes
        self.many[first] = np.diff(np.append(first, n))
        self.before = np.zeros(n, np.int64)
        self.parts = np.bincount(lane, self.symbol[1:] == 0, len(ends)).astype(np.int64)

    def _point(self, s: np.ndarray, low: np.ndarray) -> None:
        """Lets each suffix s point to the nearest before it in a group below the place low."""
        self.before[s] = s - 1
        while len(s):
            p = self.before[s]
            up = self.group[p] >= low
            s, low, p = s[up], low[up], p[up]
            self.before[s] = self.before[p]

    def _raise(self, p: np.ndarray) -> None:
        """Moves suffixes up within their groups, each by how often it is in p."""
        p = np.sort(p)
        first = np.ones(len(p), bool)
        first[1:] = p[1:] != p[:-1]
        at = np.flatnonzero(first)
        p, times = p[at], np.diff(np.append(at, len(p)))
        group = self.group[p]
        order = np.lexsort((times, group))
        p, times, group = p[order], times[order], group[order]
        head = np.ones(len(p), bool)
        head[1:] = group[1:] != group[:-1]
        start = np.flatnonzero(head)
        own = group[start]
        moved = np.diff(np.append(start, len(p)))
        tail = own + self.many[own] - moved  # the moved ones take the last places of their group
        to = spread(tail, moved)
        # those that lie there and aren't moved change places with moved ones from elsewhere
        limit = np.repeat(tail, moved)
        vacant = self.place[p]
        outside = vacant < limit
        there = self.order[to]
        self.place[p] = -1
        out = there[self.place[there] >= 0]
        vacant = vacant[outside]
        self.order[vacant], self.place[out] = out, vacant
        self.order[to], self.place[p] = p, to
        cut = head.copy()
        cut[1:] |= times[1:] != times[:-1]
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, len(p)))
        self.many[own] -= moved
        self.many[to[at]] = length
        self.group[p] = np.repeat(to[at], length)

    def grouped(self) -> None:
        """The first phase: groups of equal Lyndon prefixes, in order."""
        lowest = self.base + self.parts
        last = self.base + self.size - 1
        live = np.flatnonzero(last >= lowest)
        last, lowest = last[live], lowest[live]
        while len(last):
            low = self.group[self.order[last]]
            n = last - low + 1
            s = self.order[spread(low, n)]
            self._point(s, np.repeat(low, n))
            p = self.before[s]
            p = p[self.symbol[p] > 0]
            if len(p):
                self._raise(p)
            last = low - 1
            more = last >= lowest
            last, lowest = last[more], lowest[more]

    def ordered(self) -> np.ndarray:
        """The second phase: the suffixes of all lanes, in each lane from the least up. Separators come first."""
        n = len(self.symbol)
        free = np.arange(n)  # of each group, at its first place: the next free one
        out = np.zeros(n, np.int64)
        separators = self.symbol == 0
        out[self.place[separators]] = np.flatnonzero(separators)
        done = separators.copy()
        longest = np.argsort(-self.size, kind="stable")
        base, size = self.base[longest], self.size[longest]
        live = len(base)
        for k in range(int(size[0]) if live else 0):
            live = int(np.searchsorted(-size[:live], -k, side="left"))
            j = out[base[:live] + k] - 1
            while len(j := j[~done[j]]):
                g = self.group[j]
                out[free[g]] = j
                free[g] += 1
                done[j] = True
                j = self.before[j]
        return out[1:] - 1


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each lane its suffixes in order, as places in symbols. See Lanes for symbols and ends."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    lanes = Lanes(symbols, ends)
    lanes.grouped()
    return lanes.ordered()
