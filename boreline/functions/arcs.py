"""Numpy helpers of the per-well operators: arcs, tangents, golden-section search.  Arrays are north, east, down."""

from __future__ import annotations

import numpy as np

GOLDEN = (np.sqrt(5.0) - 1.0) / 2.0
GOLDEN_STEPS = 48
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def tangent(inc, az):
    inc, az = np.asarray(inc, dtype=float), np.asarray(az, dtype=float)
    return np.stack([np.sin(inc) * np.cos(az), np.sin(inc) * np.sin(az), np.cos(inc)], axis=-1)


def angles(t):
    """Inclination and azimuth in [0, 2 pi) of unit vectors."""
    return np.arccos(np.clip(t[..., 2], -1.0, 1.0)), np.mod(np.arctan2(t[..., 1], t[..., 0]), 2.0 * np.pi)


def frame(inc, az):
    """High-side and right vectors."""
    high = np.array([np.cos(inc) * np.cos(az), np.cos(inc) * np.sin(az), -np.sin(inc)])
    return high, np.array([-np.sin(az), np.cos(az), np.zeros_like(az)])


def toolface(i1, a1, i2, a2):
    """Direction of the turn from (i1, a1) to (i2, a2), clockwise from high side."""
    turn = a2 - a1
    up = np.cos(i1) * np.sin(i2) * np.cos(turn) - np.sin(i1) * np.cos(i2)
    return np.mod(np.arctan2(np.sin(i2) * np.sin(turn), up), 2.0 * np.pi)


def wrap_signed(a):
    return a - 2.0 * np.pi * np.ceil((a - np.pi) / (2.0 * np.pi))


def _over_sine(x, whole):
    """sin(x) / sin(whole), x / whole for small angles."""
    return np.where(whole < 1e-9, x, np.sin(x * whole) / np.where(whole < 1e-9, 1.0, np.sin(whole)))


def half_angle_factor(dl):
    """2/dl tan(dl/2), its limit for small angles."""
    small = dl < 1e-6
    return np.where(small, 1.0 + dl * dl / 12.0, 2.0 / np.where(small, 1.0, dl) * np.tan(np.where(small, 0.0, dl) / 2.0))


def completed(md, inc, az, starts, opening):
    """Positions of stations by minimum curvature, in steps of whole micrometres as ``survey.complete_survey`` has them.

    Paths follow one another; ``opening`` marks their first stations, whose positions are ``starts``.
    """
    first = np.flatnonzero(opening)
    i1, a1, i2, a2 = inc[:-1], az[:-1], inc[1:], az[1:]
    half_i, half_a = np.sin((i2 - i1) / 2.0), np.sin((a2 - a1) / 2.0)
    dl = 2.0 * np.arcsin(np.minimum(1.0, np.sqrt(half_i * half_i + np.sin(i1) * np.sin(i2) * half_a * half_a)))
    q = dl * dl
    series = 1.0 + q / 12.0 * (1.0 + q / 10.0 * (1.0 + q / 168.0 * (1.0 + 31.0 * q / 18.0)))
    factor = np.where(dl < 0.02, series, 2.0 / np.where(dl < 0.02, 1.0, dl) * np.tan(dl / 2.0))
    t = tangent(inc, az)
    step = np.empty((len(md), 3))
    step[1:] = (0.5 * np.diff(md) * factor)[:, None] * (t[:-1] + t[1:])
    step[first] = starts
    step = np.copysign(np.floor(np.abs(step) * 1e6 + 0.5), step).astype(np.int64)
    total = np.cumsum(step, axis=0)
    before = (total - step)[first]
    return (total - np.repeat(before, np.diff([*first, len(md)]), axis=0)) / 1e6


def minimum_curvature_points(p, t1, t2, length, u):
    """Points at fractions ``u`` of the arc that starts at p along t1 and ends along t2."""
    dl = 2.0 * np.arcsin(min(1.0, 0.5 * np.linalg.norm(t2 - t1)))
    u = np.asarray(u, dtype=float)
    if dl < 1e-9:
        t = (1.0 - u)[:, None] * t1 + u[:, None] * t2
    else:
        t = (np.sin((1.0 - u) * dl)[:, None] * t1 + np.sin(u * dl)[:, None] * t2) / np.sin(dl)
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    return p + 0.5 * (u * length * half_angle_factor(u * dl))[:, None] * (t1 + t)


def arc_to_point(p, t, target):
    """End tangent and length of the circular arc from p along t through each target; nan where there is none."""
    chord = target - p
    size = np.linalg.norm(chord, axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = chord / size[..., None]
    cosine = np.clip(np.sum(t * unit, axis=-1), -1.0, 1.0)
    half = np.arccos(cosine)
    end = 2.0 * cosine[..., None] * unit - t
    with np.errstate(divide="ignore", invalid="ignore"):
        length = size * np.where(half < 1e-9, 1.0, half / np.where(half < 1e-9, 1.0, np.sin(half)))
    bad = (size <= 0) | (half > np.pi - 1e-6)
    length = np.where(bad, np.nan, length)
    return end, length


class CircularArc:
    def __init__(self, p, inc, az, curvature, face):
        self.p, self.t = np.asarray(p, dtype=float), tangent(inc, az)
        high, right = frame(inc, az)
        self.n, self.k = np.cos(face) * high + np.sin(face) * right, curvature

    @classmethod
    def through(cls, p, t, target):
        """The arc from p along t through target."""
        arc = cls.__new__(cls)
        arc.p, arc.t = p, t
        chord = target - p
        size = np.linalg.norm(chord)
        side = chord - np.dot(chord, t) * t
        off = np.linalg.norm(side)
        arc.n = side / off if off > 1e-12 else np.zeros(3)
        arc.k = 2.0 * off / size**2 if size > 0 and off > 1e-12 else 0.0
        return arc

    def at(self, s):
        s = np.asarray(s, dtype=float)[..., None]
        x = s * self.k
        if abs(self.k) < 1e-12:
            return self.p + s * self.t
        return self.p + np.sin(x) / self.k * self.t + (1.0 - np.cos(x)) / self.k * self.n

    def direction(self, s):
        return angles(np.cos(s * self.k) * self.t + np.sin(s * self.k) * self.n)

    def distance(self, length, points):
        """Least distance of each point to the arc of the given length."""
        v = points - self.p
        x = v @ self.t
        if abs(self.k) < 1e-12:
            s = np.clip(x, 0.0, length)
        else:
            s = np.arctan2(x * self.k, 1.0 - (v @ self.n) * self.k) / self.k
            near_end = np.linalg.norm(self.at(np.full(len(points), length)) - points, axis=1) < np.linalg.norm(v, axis=1)
            s = np.where((s >= 0.0) & (s <= length), s, np.where(near_end, length, 0.0))
        return np.linalg.norm(self.at(s) - points, axis=1)


class _Integrated:
    """Position as the integral of the tangent, by 16-point quadrature from the start."""

    def at(self, s):
        s = np.asarray(s, dtype=float)
        half = 0.5 * s[..., None]
        inc, az = self.angle_at(half * (1.0 + _NODES))
        return self.p + np.einsum("...ki,k->...i", tangent(inc, az) * half[..., None], _WEIGHTS)

    def direction(self, s):
        inc, az = self.angle_at(np.asarray(s, dtype=float))
        return angles(tangent(inc, az))


class BuildAndTurn(_Integrated):
    def __init__(self, p, inc, az, build, turn):
        self.p, self.inc, self.az, self.build, self.turn = np.asarray(p, dtype=float), inc, az, build, turn

    def angle_at(self, s):
        return self.inc + self.build * s, self.az + self.turn * s


class CurvatureAndToolface(_Integrated):
    def __init__(self, p, inc, az, curvature, face):
        self.p, self.inc, self.az = np.asarray(p, dtype=float), inc, az
        self.build, self.side = curvature * np.cos(face), curvature * np.sin(face)

    def angle_at(self, s):
        inc = self.inc + self.build * s
        if abs(self.build) < 1e-12:
            sine = np.sin(self.inc)
            rate = self.side / sine if abs(sine) > 1e-9 else 0.0
            return inc, self.az + rate * s
        a, b = np.tan(np.abs(inc) / 2.0), np.tan(abs(self.inc) / 2.0)
        floor = 1e-12
        return inc, self.az + self.side / self.build * np.log(np.maximum(a, floor) / max(b, floor))


SECTION = {"CircularArc": CircularArc, "ConstantBuildAndTurn": BuildAndTurn,
           "ConstantCurvatureAndToolface": CurvatureAndToolface}


class Curves:
    """Sections of mixed types, one in each place of the arrays, with positions and directions of many at once."""

    def __init__(self, kind, pose, inc, az, first, second):
        self.kind = np.asarray(kind, dtype=object)
        self.p = np.asarray(pose, dtype=float).reshape(-1, 3)
        self.inc, self.az, self.first, self.second = (np.asarray(x, dtype=float) for x in (inc, az, first, second))
        high, right = frame(self.inc, self.az)
        self.t = tangent(self.inc, self.az)
        self.n = np.cos(self.second)[:, None] * high.T + np.sin(self.second)[:, None] * right.T if len(self.inc) else self.t

    def _angles(self, i, s):
        """Inclination and azimuth at ``s`` (places x nodes) of sections ``i`` that are no arcs."""
        inc0, az0, a, b = (x[i][:, None] for x in (self.inc, self.az, self.first, self.second))
        plain = (self.kind[i] == "ConstantBuildAndTurn")[:, None]
        build, side = np.where(plain, a, a * np.cos(b)), a * np.sin(b)
        inc = inc0 + build * s
        sine, level, floor = np.sin(inc0), np.abs(build) < 1e-12, 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(np.abs(sine) > 1e-9, side / sine, 0.0)
            curved = side / build * np.log(np.maximum(np.tan(np.abs(inc) / 2.0), floor) / np.maximum(np.tan(np.abs(inc0) / 2.0), floor))
        return inc, az0 + np.where(plain, b * s, np.where(level, rate * s, curved))

    def at(self, i, s):
        """Positions at ``s`` along sections ``i``."""
        s = np.asarray(s, dtype=float)
        out = np.empty((len(s), 3))
        arc = self.kind[i] == "CircularArc"
        j, k, x = i[arc], self.first[i[arc]], s[arc]
        flat = np.abs(k) < 1e-12
        over = np.where(flat, 1.0, k)
        along = np.where(flat, x, np.sin(x * k) / over)
        out[arc] = self.p[j] + along[:, None] * self.t[j] + np.where(flat, 0.0, (1.0 - np.cos(x * k)) / over)[:, None] * self.n[j]
        if not arc.all():
            j, half = i[~arc], 0.5 * s[~arc][:, None]
            inc, az = self._angles(j, half * (1.0 + _NODES))
            out[~arc] = self.p[j] + np.einsum("...ki,k->...i", tangent(inc, az) * half[..., None], _WEIGHTS)
        return out

    def direction(self, i, s):
        s = np.asarray(s, dtype=float)
        t = np.empty((len(s), 3))
        arc = self.kind[i] == "CircularArc"
        x = (s * self.first[i])[arc][:, None]
        t[arc] = np.cos(x) * self.t[i[arc]] + np.sin(x) * self.n[i[arc]]
        if not arc.all():
            inc, az = self._angles(i[~arc], s[~arc][:, None])
            t[~arc] = tangent(inc[:, 0], az[:, 0])
        return angles(t)

    def closest(self, i, length, points):
        """Golden-section search for the place nearest to each point on section ``i``: arc length, distance, position.

        The middle of the section counts where it is nearer than what the search ended at.
        """
        left, right = np.zeros(len(points)), np.array(length, dtype=float)

        def distance(s):
            return np.linalg.norm(self.at(i, s) - points, axis=1)

        c, d = right - GOLDEN * (right - left), left + GOLDEN * (right - left)
        fc, fd = distance(c), distance(d)
        for _ in range(GOLDEN_STEPS):
            go = fc > fd
            left, right = np.where(go, c, left), np.where(go, right, d)
            c, d = right - GOLDEN * (right - left), left + GOLDEN * (right - left)
            fc, fd = distance(c), distance(d)
        s, half = 0.5 * (left + right), 0.5 * np.asarray(length, dtype=float)
        s = np.where(distance(half) < distance(s), half, s)
        at = self.at(i, s)
        return s, np.linalg.norm(at - points, axis=1), at

    def balls(self, length):
        """The middle of each section, and a radius around it that holds all its places.

        Half the length, but for sections whose angles turn more than the quadrature follows.
        """
        own, length = np.arange(len(self.inc)), np.asarray(length, dtype=float)
        inc, az = (x[:, 0] for x in self._angles(own, length[:, None]))
        wild = (np.abs(inc - self.inc) > 4.0) | (np.abs(az - self.az) > 4.0) | (np.floor(inc / np.pi) != np.floor(self.inc / np.pi))
        wild &= self.kind != "CircularArc"
        return self.at(own, 0.5 * length), np.where(wild, 1.5, 0.5 * (1.0 + 1e-9)) * length + 1e-9
