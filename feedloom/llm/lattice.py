"""Nearest points of the E8 lattice, for blocks of eight coordinates at a time.

E8 is the union of D8 (whole coordinates with an even sum) and D8 moved by one half in every
coordinate. Its 240 shortest vectors lead from a point to its neighbours.
"""

from __future__ import annotations

import itertools

import numpy as np


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates and an even sum, per row."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        step = np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        near[odd, worst] += step
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of an (n, 8) array; ties take the whole coordinates."""
    whole = _nearest_d8(x)
    half = _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def shortest_vectors() -> np.ndarray:
    """The 240 neighbours of the origin: (+-1, +-1, 0...) and (+-1/2...) with an even sum."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    for signs in itertools.product((-0.5, 0.5), repeat=8):
        if sum(signs) % 2 == 0:
            found.append(np.array(signs))
    return np.array(found)


NEIGHBOURS = shortest_vectors()


def next_nearest(x: np.ndarray, point: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` neighbouring cells whose points are closest to x, and their added squared distance.

    Returns indexes into `NEIGHBOURS` (n, count) and the gains (n, count), ascending.
    """
    # |x - p - v|^2 - |x - p|^2 = |v|^2 - 2 (x - p).v, and every neighbour has |v|^2 = 2.
    added = 2.0 - 2.0 * ((x - point) @ NEIGHBOURS.T)
    best = np.argpartition(added, count - 1, axis=1)[:, :count]
    gain = np.take_along_axis(added, best, axis=1)
    order = np.argsort(gain, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(gain, order, axis=1)
