"""DartMinHash signatures of weighted sets, vectorised over many sets.

Every element owns a strip of the plane of weight x rank, cut by weight into cells [0, 1),
[1, 2), [2, 4), [4, 8) and so on. Hashes throw darts into each cell as a Poisson process
along rank, at a rate of the cell's width, so where darts fall depends on the element alone.
A set of an element with weight w is hit by the darts that fall below w. Each dart also
names one of k coordinates; a coordinate keeps the hit of least rank. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.

Ranks are followed up to k ln k + 2 k expected hits, which fills all coordinates of most
sets; a set with one left empty is thrown again to twice the rank. So a set costs
darts of the order of k ln k, whatever its weights.
"""

from __future__ import annotations

import math

import numpy as np

from gridlens.llm.textkit import U, mix

_GAP, _STEP, _HEIGHT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hash to (0, 1]."""
    return ((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """n x k dart values of n sets; set d has elements first[d] .. first[d + 1] - 1 (distinct) with weights above 0. Rows of empty sets are 0."""
    n = len(first) - 1
    total = np.add.reduceat(np.concatenate([weights, [0.0]]), np.minimum(first[:-1], len(weights))) if n else np.zeros(0)
    total = np.where(np.diff(first) > 0, total, 0.0)
    out = np.zeros((n, k), U)
    todo = np.flatnonzero(total > 0)
    reach = (k * math.log(max(k, 2)) + 2 * k) / np.maximum(total, 1e-300)
    while len(todo):
        best, sig = _throw(elements, weights, first, todo, reach[todo], k)
        whole = np.isfinite(best).all(axis=1)
        out[todo[whole]] = sig[whole]
        todo = todo[~whole]
        reach[todo] *= 2
    return out


def _throw(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, sets: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    size = first[sets + 1] - first[sets]
    owner = np.repeat(np.arange(len(sets)), size)
    at = np.arange(len(owner)) + np.repeat(first[sets] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    best = np.full(len(sets) * k, np.inf)
    sig = np.zeros(len(sets) * k, U)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cell, low, wide = 0, 0.0, 1.0
    while len(at):
        with np.errstate(over="ignore"):
            name = mix(elements[at] + U(cell) * _HEIGHT + U(1))
        who, top, rank, step = owner, weights[at], np.zeros(len(at)), 0
        while len(name):
            with np.errstate(over="ignore"):
                dart = mix(name + U(step + 1) * _STEP)
                rank = rank - np.log(_unit(mix(dart ^ _GAP))) / wide
            near = rank <= reach[who]
            name, who, top, rank, dart = name[near], who[near], top[near], rank[near], dart[near]
            if low + wide > 1.0:
                with np.errstate(over="ignore"):
                    hit = low + wide * (1.0 - _unit(mix(dart + _HEIGHT))) < top
            else:
                hit = top >= 1.0 if (top < 1.0).any() else slice(None)
                if not isinstance(hit, slice):
                    with np.errstate(over="ignore"):
                        hit = hit | (1.0 - _unit(mix(dart + _HEIGHT)) < top)
            slot = who[hit] * k + (dart[hit] % U(k)).astype(np.int64)
            np.minimum.at(best, slot, rank[hit])
            hits.append((slot, rank[hit], dart[hit]))
            step += 1
        low, wide, cell = low + wide, (1.0 if cell == 0 else wide * 2), cell + 1
        deep = weights[at] > low
        owner, at = owner[deep], at[deep]
    for slot, rank, dart in hits:
        first_one = best[slot] == rank
        sig[slot[first_one]] = dart[first_one]
    return best.reshape(-1, k), sig.reshape(-1, k)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """n x (k / rows) hashes of neighbouring coordinates, each with its band's number."""
    n, k = sig.shape
    out = np.empty((n, k // rows), U)
    with np.errstate(over="ignore"):
        for b in range(k // rows):
            h = np.full(n, U(b + 1) * _STEP, U)
            for r in range(rows):
                h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
            out[:, b] = h
    return out
