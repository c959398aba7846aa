"""Approximate nearest neighbours by collision counting.

Every block of vectors is projected on ``PROJECTIONS`` random lines, and each line keeps the
block's rows in sorted order.  A query opens a window around its own place on every line and
widens all windows together along one grid of radii (virtual rehashing: no table is built for
a radius).  A vector that lies in the windows of at least ``THRESHOLD`` of the lines is
verified by its exact distance.  The search of a block ends when ``k`` verified vectors, of
this block or of earlier ones, are within the radius.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .vectors import Best, clean, places, search

PROJECTIONS = 192
#: Window width at radius 1; a vector at the radius is in a window with probability 0.73.
WIDTH = 2.2
#: Part of the lines on which a vector must collide.
THRESHOLD = 0.70
#: Ratio of one radius of the grid to the one before.
GROWTH = 1.04
#: Windows begin at this part of the distance to the nearest of the block's first rows.
START, START_ROWS = 0.75, 64
SEED = 9


def lines(dim: int) -> np.ndarray:
    """The fixed random directions for vectors of this length."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


@dataclass
class Block:
    """Rows in id order; for each line the sorted places, and every row's rank among them."""

    ids: np.ndarray
    points: np.ndarray
    place: np.ndarray
    rank: np.ndarray


@dataclass
class Queries:
    ids: np.ndarray
    points: np.ndarray
    own: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, own: np.ndarray) -> Block:
    at = (points @ lines(points.shape[1])).T
    order = np.argsort(at, axis=1, kind="stable")
    rank = np.empty(order.shape, np.uint16)
    np.put_along_axis(rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
    return Block(ids, points, np.take_along_axis(at, order, axis=1), rank)


class Search:
    """The nearest ``k`` found for each query of one part."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k, self.best = queries, k, Best(len(queries.ids), k)
        self.at = queries.points @ lines(queries.points.shape[1])
        self.need = math.ceil(THRESHOLD * PROJECTIONS)
        #: Vectors verified by their distance, of all there are.
        self.spent = {"verified": 0, "all": 0}

    def meet(self, block: Block, number: int) -> None:
        own = places(number, len(block.ids))
        self.spent["all"] += len(self.q.ids) * len(block.ids)
        kth = self.best.key[:, -1]
        # Where earlier blocks gave k, one window does: up to the kth of them.
        known = np.flatnonzero(np.isfinite(kth))
        step = np.ceil(np.log(np.maximum(kth[known], 1e-300)) / math.log(GROWTH))
        half = WIDTH / 2 * GROWTH**step
        for at in range(0, len(known), 1024):
            part = known[at : at + 1024]
            left, right = self._windows(block, part, half[at : at + 1024])
            for i, q in enumerate(part):
                hit = np.flatnonzero(self._hits(block, left[:, i], right[:, i]) >= self.need)
                self._verify(int(q), block, hit, own)
        new = np.flatnonzero(~np.isfinite(kth))
        for at in range(0, len(new), 1024):
            self._grow(new[at : at + 1024], block, own)

    def _windows(self, block: Block, queries: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin and end in every line's sorted places (lines x queries)."""
        at = self.at[queries].T
        left = np.stack([p.searchsorted(x, "left") for p, x in zip(block.place, at - half)])
        return left, np.stack([p.searchsorted(x, "right") for p, x in zip(block.place, at + half)])

    def _hits(self, block: Block, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """On how many lines every row stands inside the window."""
        inside = block.rank - left.astype(np.uint16)[:, None] < (right - left).astype(np.uint16)[:, None]
        return inside.sum(axis=0, dtype=np.uint16)

    def _grow(self, queries: np.ndarray, block: Block, own: np.ndarray) -> None:
        """Widen the windows of queries from a small radius until ``k`` are near enough.

        They begin below the nearest of the block's first rows: about one row in ``START_ROWS``
        is nearer, so little is verified in vain.
        """
        n = len(block.ids)
        few = block.points[:START_ROWS]
        step = np.empty(len(queries), np.int64)
        for i, q in enumerate(queries):
            apart = np.linalg.norm(few - self.q.points[q], axis=1)
            apart = apart[apart > 0]
            step[i] = math.floor(math.log(START * apart.min() if len(apart) else 1e-300, GROWTH))
        seen = np.zeros((len(queries), n), bool)
        active = np.arange(len(queries))
        while len(active):
            radius = GROWTH ** step[active].astype(np.float64)
            left, right = self._windows(block, queries[active], WIDTH / 2 * radius)
            for i, at in enumerate(active):
                hits = self._hits(block, left[:, i], right[:, i])
                found = np.flatnonzero((hits >= self.need) & ~seen[at])
                seen[at, found] = True
                self._verify(int(queries[at]), block, found, own)
                # Far from any collision the grid is crossed faster.
                step[at] += 1 if seen[at].any() or hits.max() * 2 > self.need else 8
            done = (self.best.key[queries[active], -1] <= radius) | ((right - left).min(axis=0) == n)
            active = active[~done]

    def _verify(self, q: int, block: Block, at: np.ndarray, own: np.ndarray) -> None:
        at = at[own[at] != self.q.own[q]]
        self.spent["verified"] += len(at)
        if len(at):
            away = block.points[at] - self.q.points[q]
            self.best.offer(np.array([q]), np.sqrt((away * away).sum(axis=1))[None, :], block.ids[at])

    def found(self) -> tuple[np.ndarray, ...]:
        return self.best.found(self.q.own, self.q.ids)


def nearest(table: DataFrame, every: int, k: int, spent: bool = False) -> DataFrame:
    """The ``k`` nearest rows found for every query, by exact Euclidean distance.

    Queries are the ids divisible by ``every``; every other row of the same length is
    indexed and may be found.  Ties go to the smaller id and fewer candidates give fewer rows:
    then all are found.  Rows that repeat an id are rows and queries of their own; see
    ``vectors.clean`` for rows that take no part (zero vectors among them).
    """
    return search(clean(table, zero=False), every, build, Queries, lambda part: Search(part, k), "double", True, k, spent=spent)
