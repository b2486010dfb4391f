"""BagMinHash signatures of multisets of word shingles, and their exact overlap.

Every element of a bag owns Poisson processes, one for each dyadic range of weights: (0, 1], (1, 2],
(2, 4], (4, 8] and so on, each with the range's width as its rate. A point of the range (2, 4] also
draws which unit of weight it belongs to and counts only for bags whose weight reaches that unit, so
the points that a bag sees grow with its weights. Each point draws one component of the signature,
and each component keeps its earliest point. All draws come from hashes of element, range and
number, so two bags agree in a component with a chance equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_ODD = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)
_BASE = 0x100000001B3  # odd, so that it has an inverse
_MASK = (1 << 64) - 1
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for slot, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: lower case, parted by blanks. All words are hashed at once by prefix sums."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    cuts = np.concatenate(([0], edge, [len(raw)]))
    first = 1 if blank[0] else 0
    starts, ends = cuts[first:-1:2], cuts[first + 1 :: 2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(text: str, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The bag of word shingles: distinct hashes, ascending, and how often each occurs.

    A text of fewer words is one shingle; a text without words has none.
    """
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    width = min(size, n)
    total = np.full(n - width + 1, _U(width), dtype=np.uint64)
    for i in range(width):
        total = mix(total * _ODD[i % len(_ODD)] + words[i : n - width + 1 + i])
    return np.unique(total, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signature(keys: np.ndarray, weights: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """`m` components for a bag that is not empty; each is the hash of its earliest point."""
    own = _U(seed * int(_GOLDEN) & _MASK)
    element, low, weight = [mix(keys + own)], [np.zeros(len(keys))], [weights]
    floor = 1
    while True:
        more = weights > floor
        if not more.any():
            break
        level = _U(floor * int(_ODD[1]) & _MASK)
        element.append(mix(keys[more] + own + level))
        low.append(np.full(int(more.sum()), float(floor)))
        weight.append(weights[more])
        floor *= 2
    element, low, weight = np.concatenate(element), np.concatenate(low), np.concatenate(weight)
    rate = np.maximum(low, 1.0)
    time = np.zeros(len(element))
    best = np.full(m, np.inf)
    winner = np.zeros(m, dtype=np.uint64)
    enough = m * (np.log(m) + 1)
    step = 0
    while len(element):
        # Points that will do: to meet every component first, then to reach the latest winner.
        end = best.max()
        need = enough / rate.sum() if np.isinf(end) else 1 + 1.2 * (rate * (end - time)).max()
        q = int(min(max(np.ceil(need), 1), 512))
        number = np.arange(step, step + q, dtype=np.uint64) * _GOLDEN
        point = mix(element[:, None] + number[None, :])
        wait = -np.log(((point >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / rate[:, None]
        wait[:, 0] += time
        at = np.cumsum(wait, axis=1)
        time = at[:, -1]
        drawn = mix(point ^ _ODD[2])
        component = (drawn >> _U(32)) % _U(m)
        good = at < best[component]
        if len(low) and low[-1] > 0:
            # The unit of weight that the point belongs to, above `low`.
            width = rate.astype(np.uint64)[:, None]
            unit = low[:, None] + 1 + (mix(drawn ^ _ODD[3]) % width).astype(np.float64)
            good &= (low[:, None] == 0) | (unit <= weight[:, None])
        rows, columns = np.nonzero(good)
        if len(rows):
            t, c, p = at[rows, columns], component[rows, columns], point[rows, columns]
            order = np.argsort(-t, kind="stable")  # the earliest is written last
            best[c[order]] = t[order]
            winner[c[order]] = p[order]
        alive = time < best.max()
        element, low, weight, rate, time = (x[alive] for x in (element, low, weight, rate, time))
        step += q
    return winner


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key per band of `rows` components; keys of different bands differ."""
    cut = sig[: len(sig) // rows * rows].reshape(-1, rows)
    total = mix(np.arange(1, len(cut) + 1, dtype=np.uint64) * _GOLDEN)
    for i in range(rows):
        total = mix(total * _ODD[i % len(_ODD)] + cut[:, i])
    return total.astype(np.int64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of equal components for all pairs of rows of two signature tables."""
    return np.array([(row == b).mean(axis=1) for row in a]).reshape(len(a), len(b))


def bins(keys: np.ndarray, weights: np.ndarray, n: int = 256) -> np.ndarray:
    """How many shingles of a bag fall into each bin of hashes."""
    return np.bincount((keys % _U(n)).astype(np.int64), weights, minlength=n).astype(np.int32)


def most_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that bags can have in common by their bins, for all pairs of rows of two tables."""
    return np.array([np.minimum(row, b).sum(axis=1, dtype=np.int64) for row in a]).reshape(len(a), len(b))


def bag_keys(keys: np.ndarray, weights: np.ndarray) -> tuple[int, int]:
    """128 bits that equal bags share."""
    w = weights.astype(np.uint64)
    a = mix(keys + w * _ODD[0]).sum(dtype=np.uint64)
    b = mix(mix(keys ^ _ODD[4]) + w * _ODD[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
