"""An index of running moments: the last end of a run of almost constant values from any start, without a rescan.

Values are the leaves of binary trees that hold count, mean and sum of squared deviations of every node.  Moments are
merged, never subtracted, so large values elsewhere in a series cost no digits.  Adding values never lowers the sum of
squared deviations, so a node cannot hold a valid end if what lies before it has too large a sum even for the count at
the node's end; and a node whose own end is valid makes all to the left of it needless.  Few nodes of a level remain.
"""

from __future__ import annotations

import numpy as np

#: Starts searched at once.
_AT_ONCE = 1 << 15


def merge(n1, mean1, m1, n2, mean2, m2):
    n = n1 + n2
    share = n2 / np.maximum(n, 1.0)
    off = mean2 - mean1
    return n, mean1 + off * share, m1 + m2 + off * off * n1 * share


class Moments:
    """Trees over several series of equally many leaves.  A leaf is a value, or the moments of a block of values."""

    def __init__(self, count: np.ndarray, mean: np.ndarray, m2: np.ndarray):
        self.series, self.leaves = mean.shape
        self.top = max(0, int(self.leaves - 1).bit_length())
        self.width = 1 << self.top
        level = []
        for part in (count, mean, m2):
            padded = np.zeros((self.series, self.width))
            padded[:, : self.leaves] = part
            level.append(padded.ravel())
        self.levels = [tuple(level)]
        for _ in range(self.top):
            n, mu, s = self.levels[-1]
            self.levels.append(merge(n[::2], mu[::2], s[::2], n[1::2], mu[1::2], s[1::2]))

    def last_ends(self, bounds: np.ndarray, series: np.ndarray, start: np.ndarray, before=None):
        """Per query the last leaf whose end is valid, or -1, the mean up to there, and leaves left open.

        A run from leaf ``start`` of its series, behind the values with moments ``before`` (count, mean, m2), is valid
        up to an end if it has two values or more and a variance below the series' bound.  Open leaves are given as
        (query, leaf, count, mean, m2 of the run before the leaf): their own values are needed to tell.
        """
        best, mean, open_ = np.full(len(start), -1, np.int64), np.full(len(start), np.nan), []
        for at in range(0, len(start), _AT_ONCE):
            some = slice(at, at + _AT_ONCE)
            own = tuple(np.asarray(x, float)[some] for x in before) if before is not None else tuple(np.zeros((3, len(start[some]))))
            best[some], mean[some], left = self._search(bounds, series[some].astype(np.int64), start[some].astype(np.int64), own)
            open_.append((left[0] + at, *left[1:]))
        if not open_:
            return best, mean, (np.empty(0, np.int64), np.empty(0, np.int64), *np.empty((3, 0)))
        return best, mean, tuple(np.concatenate(x) for x in zip(*open_, strict=True))

    def _search(self, bounds, series, start, acc):
        n, mu, s = (x.copy() for x in acc)
        bound = bounds[series]
        place = series * self.width + start
        taken = []
        # The nodes that cover all leaves from the start on, with what lies before each.
        for level in range(self.top + 1):
            inside = place < (series + 1) << (self.top - level)
            idx = np.flatnonzero(inside & ((place & 1 == 1) | (level == self.top)))
            node = place[idx]
            taken.append((idx, node, n[idx], mu[idx], s[idx]))
            n[idx], mu[idx], s[idx] = merge(n[idx], mu[idx], s[idx], *(x[node] for x in self.levels[level]))
            place[idx] += 1
            place >>= 1
        best, mean = np.full(len(start), -1, np.int64), np.full(len(start), np.nan)
        front = tuple(x[:0] for x in taken[0])
        for level in range(self.top, -1, -1):
            q, node, n, mu, s = (np.concatenate([a, b]) for a, b in zip(front, taken[level], strict=True))
            own = tuple(x[node] for x in self.levels[level])
            first = (node << level) - series[q] * self.width
            end = np.minimum(first + (1 << level), self.leaves) - 1
            able = (own[0] > 0) & (end > best[q]) & (s < bound[q] * (n + own[0]))
            q, node, n, mu, s, end = (x[able] for x in (q, node, n, mu, s, end))
            own = tuple(x[able] for x in own)
            total, middle, spread = merge(n, mu, s, *own)
            valid = (total >= 2) & (spread < bound[q] * total)
            np.maximum.at(best, q[valid], end[valid])
            top = valid & (best[q] == end)
            mean[q[top]] = middle[top]
            left = ~valid & (end > best[q])
            q, node, n, mu, s = (x[left] for x in (q, node, n, mu, s))
            if level:
                low = 2 * node
                past = merge(n, mu, s, *(x[low] for x in self.levels[level - 1]))
                front = tuple(np.concatenate([a, b]) for a, b in zip((q, low, n, mu, s), (q, low + 1, *past), strict=True))
        leaf = node - series[q] * self.width
        block = self.levels[0][0][node] > 1
        return best, mean, tuple(x[block] for x in (q, leaf, n, mu, s))
