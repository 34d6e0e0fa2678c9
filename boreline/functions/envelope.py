"""How far a run of stations follows one arc: every end is tried, few stations are looked at again.

All arcs from a start along its direction form a family with a bend of two dimensions, a vector across the direction.
Positions at length s of two arcs lie no farther apart than half of s squared times the distance of their bends, because
the exponential map of the sphere of directions does not stretch.  A station whose deviation from a reference arc leaves
room so is within the tolerance of every arc whose bend lies in a known radius around the reference.  An end whose bend
lies within the least radius is accepted at once; else only stations of a smaller radius are looked at.
"""

from __future__ import annotations

import numpy as np

from boreline.functions import arcs

_MARGIN = 1e-9
#: The bound is used for arcs of less than half a turn only.
_TURN = 3.0
_MOST = 1 << 13
#: Stations that paths look ahead in step; a longer run is followed alone.
_IN_STEP = 48


class Survey:
    """Stations of one path, as arrays, and arcs from a station to later ones."""

    def __init__(self, md, inc, az, north, east, tvd, tolerance: float):
        self.md, self.t, self.p = md, arcs.tangent(inc, az), np.stack([north, east, tvd], axis=1)
        self.tolerance = tolerance

    def _place(self, start, bend, s):
        k = np.linalg.norm(bend)
        x = (s * k)[:, None]
        if k < 1e-12:
            return self.p[start] + s[:, None] * self.t[start] + 0.5 * (s * s)[:, None] * bend
        return self.p[start] + np.sin(x) / k * self.t[start] + (1.0 - np.cos(x)) / k * (bend / k)


class ByDepth(Survey):
    """The arc between two directions; a station belongs to the place of its own depth."""

    def bends(self, start, first, stop):
        t1, t2, length = self.t[start], self.t[first:stop], self.md[first:stop] - self.md[start]
        angle = 2.0 * np.arcsin(np.minimum(1.0, 0.5 * np.linalg.norm(t2 - t1, axis=1)))
        small = angle < 1e-9
        across = np.where(small[:, None], t2 - t1, (t2 - np.cos(angle)[:, None] * t1) * (angle / np.where(small, 1.0, np.sin(angle)))[:, None])
        sound = (length > 0) & (angle < _TURN)
        return across / np.where(length > 0, length, 1.0)[:, None], length, sound

    def deviations(self, start, bend, inner):
        s = self.md[inner] - self.md[start]
        return np.linalg.norm(self._place(start, bend, s) - self.p[inner], axis=1), s

    def accept_many(self, start, end, own, inner):
        """Which places ``inner`` are near the arcs from ``start[own]`` to ``end[own]``."""
        t1, t2, length = self.t[start], self.t[end], self.md[end] - self.md[start]
        dl = 2.0 * np.arcsin(np.minimum(1.0, 0.5 * np.linalg.norm(t2 - t1, axis=1)))
        flat, whole = (dl < 1e-9)[own], np.where(dl < 1e-9, 1.0, np.sin(dl))[own]
        dl, reach = dl[own], length[own]
        u = (self.md[inner] - self.md[start][own]) / reach
        w1, w2 = np.where(flat, 1.0 - u, np.sin((1.0 - u) * dl) / whole), np.where(flat, u, np.sin(u * dl) / whole)
        t = w1[:, None] * t1[own] + w2[:, None] * t2[own]
        t /= np.linalg.norm(t, axis=1, keepdims=True)
        at = self.p[start][own] + 0.5 * (u * reach * arcs.half_angle_factor(u * dl))[:, None] * (t1[own] + t)
        return (reach > 0) & (np.linalg.norm(at - self.p[inner], axis=1) <= self.tolerance[own])

    def accepts(self, start, end, inner):
        length = self.md[end] - self.md[start]
        if not length > 0:
            return False
        at = arcs.minimum_curvature_points(self.p[start], self.t[start], self.t[end], length, (self.md[inner] - self.md[start]) / length)
        return bool((np.linalg.norm(at - self.p[inner], axis=1) <= self.tolerance).all())


class ByPlace(Survey):
    """The circular arc along the direction of the start through the end; a station belongs to the nearest place."""

    def bends(self, start, first, stop):
        t, chord, length = self.t[start], self.p[first:stop] - self.p[start], self.md[first:stop] - self.md[start]
        size = np.linalg.norm(chord, axis=1)
        side = chord - (chord @ t)[:, None] * t
        bend = np.where((size > 0)[:, None], 2.0 * side / np.where(size > 0, size, 1.0)[:, None] ** 2, 0.0)
        return bend, length, (length > 0) & (np.linalg.norm(bend, axis=1) * length < _TURN)

    def deviations(self, start, bend, inner):
        """From the arc as long as the station's depth; later ends only make it longer."""
        reach, k = self.md[inner] - self.md[start], np.linalg.norm(bend)
        v = self.p[inner] - self.p[start]
        along = v @ self.t[start]
        if k < 1e-12:
            s = np.clip(along, 0.0, np.maximum(reach, 0.0))
        else:
            s = np.arctan2(along * k, 1.0 - (v @ (bend / k)) * k) / k
            far = np.linalg.norm(self._place(start, bend, reach) - self.p[inner], axis=1) < np.linalg.norm(v, axis=1)
            s = np.where((s >= 0.0) & (s <= reach), s, np.where(far, reach, 0.0))
        off = np.linalg.norm(self._place(start, bend, s) - self.p[inner], axis=1)
        return off, np.maximum(s, 0.0)

    def accept_many(self, start, end, own, inner):
        """Which places ``inner`` are near the arcs from ``start[own]`` to ``end[own]``."""
        t, chord, length = self.t[start], self.p[end] - self.p[start], (self.md[end] - self.md[start])[own]
        size = np.linalg.norm(chord, axis=1)
        side = chord - np.einsum("ij,ij->i", chord, t)[:, None] * t
        off = np.linalg.norm(side, axis=1)
        bent = off > 1e-12
        n = np.where(bent[:, None], side / np.where(bent, off, 1.0)[:, None], 0.0)[own]
        k = np.where(bent & (size > 0), 2.0 * off / np.where(size > 0, size, 1.0) ** 2, 0.0)[own]
        t, v = t[own], self.p[inner] - self.p[start][own]
        x, y, flat = np.einsum("ij,ij->i", v, t), np.einsum("ij,ij->i", v, n), np.abs(k) < 1e-12
        bend = np.where(flat, 1.0, k)

        def off_at(s):
            along = np.where(flat, s, np.sin(s * bend) / bend)
            aside = np.where(flat, 0.0, (1.0 - np.cos(s * bend)) / bend)
            return np.linalg.norm(along[:, None] * t + aside[:, None] * n - v, axis=1)

        turned = np.arctan2(x * bend, 1.0 - y * bend) / bend
        ends = np.where(off_at(length) < np.linalg.norm(v, axis=1), length, 0.0)
        turned = np.where((turned >= 0.0) & (turned <= length), turned, ends)
        s = np.where(flat, np.minimum(np.maximum(x, 0.0), length), turned)
        return off_at(s) <= self.tolerance[own]

    def accepts(self, start, end, inner):
        arc = arcs.CircularArc.through(self.p[start], self.t[start], self.p[end])
        return bool((arc.distance(self.md[end] - self.md[start], self.p[inner]) <= self.tolerance).all())


def farthest(path: Survey, start: int, stop: int) -> tuple[int, bool]:
    """The last end before the first one that fails, and whether one failed before ``stop``.

    An end fails if a station between is farther from the arc than the tolerance.
    """
    at = start + 2
    if at >= stop:
        return min(start + 1, stop - 1), False
    bends, _, _ = path.bends(start, at, at + 1)
    reference, radius, width, looked = bends[0], np.empty(0), 16, 0

    def radii(inner):
        off, s = path.deviations(start, reference, inner)
        room = path.tolerance * (1.0 - _MARGIN) - 1e-10 - off
        far = np.abs(path.md[inner] - path.md[start]) * np.linalg.norm(reference)
        with np.errstate(divide="ignore"):
            found = np.where(room >= 0, 2.0 * room / (s * s), -np.inf)
        return np.where(far < _TURN, np.where(np.isnan(found), np.inf, found), -np.inf)

    while at < stop:
        to = min(stop, at + width)
        bends, length, sound = path.bends(start, at, to)
        radius = np.concatenate([radius, radii(np.arange(start + 1 + len(radius), to - 1))])
        inner = np.arange(at, to) - start - 1  # stations between, per end
        least = np.minimum.accumulate(radius)[inner - 1]
        beyond = np.maximum.accumulate(path.md[start + 1 : to - 1])[inner - 1] - path.md[start]
        sound &= (length >= beyond) & (path.md[start + 1 : to - 1].min() >= path.md[start])
        apart = np.linalg.norm(bends - reference, axis=1) * (1.0 + _MARGIN)
        moved = False
        for k in np.flatnonzero(~sound | (apart > least)).tolist():
            end = at + k
            some = np.flatnonzero(radius[: inner[k]] < apart[k]) if sound[k] else np.arange(inner[k])
            if not path.accepts(start, end, some + start + 1):
                return end - 1, True
            looked += len(some)
            if looked > inner[k] + 256 and sound[k]:
                # As much work as a new reference takes, so this end's arc becomes it.
                reference, at, moved, looked = bends[k], end + 1, True, 0
                radius = radii(np.arange(start + 1, end))
                break
        if not moved:
            at, width = to, min(2 * width, _MOST)
    return stop - 1, False


def kept_in_step(kind: type[Survey], fields, begins, tolerance) -> np.ndarray:
    """Which stations the greedy walk along each of many paths keeps: all paths go on by one end at a time.

    ``fields``: md, inc, az, north, east, tvd of all paths; path i has the rows from ``begins[i]`` up to
    ``begins[i + 1]`` and ``tolerance[i]``; without a positive one it keeps all.  Stations ahead are looked at in step
    while a run is short; a longer run goes to ``farthest``, which does not look at all of its stations again.
    """
    every = kind(*fields, tolerance)
    kept = np.zeros(len(every.md), bool)
    keep_all = ~(tolerance > 0)
    kept[np.repeat(keep_all, np.diff(begins))] = True
    path = np.flatnonzero(~keep_all & (np.diff(begins) > 0))
    stop, start = begins[path + 1], begins[path].copy()
    kept[start] = True
    end = start + 2
    while len(path):
        over = end >= stop
        kept[stop[over] - 1] = True
        path, start, end, stop = (x[~over] for x in (path, start, end, stop))
        for i in np.flatnonzero(end - start > _IN_STEP).tolist():
            low = begins[path[i]]
            alone = kind(*(f[low : stop[i]] for f in fields), tolerance[path[i]])
            start[i] = low + farthest(alone, int(start[i] - low), int(stop[i] - low))[0]
            kept[start[i]] = True
            end[i] = start[i] + 2
        go = end < stop
        some = np.flatnonzero(go)
        if not len(some):
            continue
        many = end[some] - start[some] - 1
        own = np.repeat(np.arange(len(some)), many)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + start[some][own] + 1
        every.tolerance = tolerance[path[some]]
        with np.errstate(divide="ignore", invalid="ignore"):
            near = every.accept_many(start[some], end[some], own, inner)
        failed = some[np.bincount(own[~near], minlength=len(some)) > 0]
        end[some] += 1
        start[failed] = end[failed] - 2
        kept[start[failed]] = True
        end[failed] = start[failed] + 2
    return kept
