"""Exact inner-product search with two cover trees walked together.

Data blocks and query parts are each indexed by a cover tree.  A node's points lie within its
radius of its centre; the centres of its children are chosen farthest first, so they cover the
node within a smaller radius and are at least that radius apart.  Nodes are divided until they
hold ``LEAF`` points, or points that coincide.  The walk drops a pair of nodes when the bound
on its inner products, by both covering radii, is below the worst kth score of the query
group.  Rows are dealt into blocks by their nearest pivot, so blocks are compact where the
data are.  Scores are whole numbers and exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, clean, places, search

#: Children of a node, at most.
FAN = 16
#: A node of at most this many points is not divided further.
LEAF = 32
#: Points whose scores are worked out at once for a query group: few at first, then twice as many each time.
SLAB, WIDEST_SLAB = 64, 1024
QUANTA = 64
_EXACT = 2.0**53


@dataclass
class Tree:
    """Points in tree order; node i covers points ``lo[i]:hi[i]`` and has the children
    ``first[i]:first[i] + fan[i]``, nodes being numbered level by level."""

    ids: np.ndarray
    points: np.ndarray
    own: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    fan: np.ndarray

    @property
    def longest(self) -> np.ndarray:
        """The longest point of every node, at most: its centre and its radius."""
        return np.linalg.norm(self.centre, axis=1) + self.radius


def cover(points: np.ndarray, centre: int, fan: int) -> np.ndarray:
    """The covering centre of every point: farthest first from ``centre``, until ``fan``
    centres or all points coincide with one."""
    apart = np.linalg.norm(points - points[centre], axis=1)
    owner = np.full(len(points), centre)
    for _ in range(fan - 1):
        far = int(np.argmax(apart))
        if apart[far] <= 0:
            break
        d = np.linalg.norm(points - points[far], axis=1)
        closer = d < apart
        owner[closer], apart[closer] = far, d[closer]
    return owner


def build(ids: np.ndarray, points: np.ndarray, own: np.ndarray) -> Tree:
    """The cover tree of a block, level by level."""
    order = np.arange(len(ids))
    mean = points.mean(axis=0)
    level = [(0, len(ids), int(np.argmin(((points - mean) ** 2).sum(axis=1))))]
    lo, hi, centre, radius, first, fan = [], [], [], [], [], []
    while level:
        below: list[tuple[int, int, int]] = []
        start = len(lo) + len(level)  # the number of the next level's first node
        for a, b, c in level:
            at = order[a:b].copy()
            reach = float(np.linalg.norm(points[at] - points[c], axis=1).max())
            lo.append(a), hi.append(b), centre.append(c), radius.append(reach * (1 + 1e-12))
            first.append(start + len(below))
            if b - a <= LEAF or reach == 0:
                fan.append(0)
                continue
            owner = cover(points[at], int(np.flatnonzero(at == c)[0]), FAN)
            groups = np.argsort(owner, kind="stable")
            order[a:b] = at[groups]
            heads, cuts = np.unique(owner[groups], return_index=True)
            fan.append(len(heads))
            for head, x, y in zip(heads, cuts, [*cuts[1:], b - a]):
                below.append((a + int(x), a + int(y), int(at[head])))
        level = below
    centres = points[centre]
    return Tree(ids[order], points[order], own[order], np.array(lo), np.array(hi), centres, np.array(radius), np.array(first), np.array(fan))


class Search:
    """The best ``k`` inner products of one query tree's points."""

    def __init__(self, queries: Tree, k: int):
        self.q, self.k, self.best = queries, k, Best(len(queries.ids), k, np.int64)
        self.leaf_of = np.zeros(len(queries.ids), np.int64)
        #: Node pairs looked at and dropped, and inner products worked out, of all there are.
        self.spent = {"pairs": 0, "pruned": 0, "products": 0, "all": 0, "nodes": 0}

    def worst(self) -> np.ndarray:
        """The worst kth score of every query node's points; minus infinity where one lacks k."""
        kth = self.best.key[:, -1]
        kth = np.where(kth == self.best.none, -np.inf, -kth.astype(np.float64))
        tops = np.full(len(self.q.lo), -np.inf)
        leaves = np.flatnonzero(self.q.fan == 0)
        for a in leaves:
            tops[a] = kth[self.q.lo[a] : self.q.hi[a]].min()
        for a in np.flatnonzero(self.q.fan)[::-1]:  # children have larger numbers
            tops[a] = tops[self.q.first[a] : self.q.first[a] + self.q.fan[a]].min()
        return tops

    def bound(self, data: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No inner product of points of the nodes is above this (rounding allowed for)."""
        x, y, rx, ry = self.q.centre[a], data.centre[b], self.q.radius[a], data.radius[b]
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        top = (x * y).sum(axis=1) + rx * ny + ry * nx + rx * ry
        # x.y is half of |x|^2 + |y|^2 - |x - y|^2, and the balls are so far apart at least.
        gap = np.maximum(0, np.linalg.norm(x - y, axis=1) - rx - ry)
        top = np.minimum(top, ((nx + rx) ** 2 + (ny + ry) ** 2 - gap**2) / 2)
        return top + 1e-9 * ((nx + rx) * (ny + ry) + np.abs(top)) + 1e-6

    def meet(self, data: Tree, block: int) -> None:
        """Fold one data tree in, both trees walked together, level by level."""
        q, worst = self.q, self.worst()
        self.spent["all"] += len(q.ids) * len(data.ids)
        self.spent["nodes"] += len(data.lo)
        a = b = np.zeros(1, np.int64)
        leaf_a, leaf_b, leaf_top = [], [], []
        while len(a):
            top = self.bound(data, a, b)
            keep = top >= worst[a]
            self.spent["pairs"] += len(a)
            self.spent["pruned"] += int((~keep).sum())
            a, b, top = a[keep], b[keep], top[keep]
            done = (q.fan[a] == 0) & (data.fan[b] == 0)
            leaf_a.append(a[done]), leaf_b.append(b[done]), leaf_top.append(top[done])
            a, b = a[~done], b[~done]
            # The wider node of a pair is opened, if it can be.
            right = (data.fan[b] > 0) & ((q.fan[a] == 0) | (data.radius[b] >= q.radius[a]))
            opened = np.where(right, data.fan[b], q.fan[a])
            at = np.repeat(np.arange(len(a)), opened)
            child = np.where(right, data.first[b], q.first[a])[at] + np.arange(opened.sum()) - np.repeat(np.cumsum(opened) - opened, opened)
            a, b = np.where(right[at], a[at], child), np.where(right[at], child, b[at])
        a, b, top = np.concatenate(leaf_a), np.concatenate(leaf_b), np.concatenate(leaf_top)
        order = np.lexsort((-top, a))
        a, b, top = a[order], b[order], top[order]
        place = places(block, len(data.ids))
        exact = len(q.ids) == 0 or np.abs(q.points).max() * np.abs(data.points).max() * q.points.shape[1] < _EXACT
        cuts = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(a)]):
            if hi > lo:
                self._leaves(data, int(a[lo]), b[lo:hi], top[lo:hi], place, exact)

    def _leaves(self, data: Tree, a: int, b: np.ndarray, top: np.ndarray, place: np.ndarray, exact: bool) -> None:
        """The data leaves ``b`` against query leaf ``a``, best bound first, until the rest cannot count."""
        rows = np.arange(self.q.lo[a], self.q.hi[a])
        sizes, at, slab = data.hi[b] - data.lo[b], 0, SLAB
        while at < len(b):
            kth = self.best.key[rows, -1]
            worst = -np.inf if (kth == self.best.none).any() else -float(kth.max())
            if top[at] < worst:
                self.spent["pruned"] += len(b) - at
                return
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), slab, "right")))
            end = max(at + 1, min(end, at + int(np.searchsorted(-top[at:], -worst, "right"))))
            cols = np.concatenate([np.arange(data.lo[x], data.hi[x]) for x in b[at:end]])
            self.spent["products"] += len(rows) * len(cols)
            if exact:
                keys = -np.rint(self.q.points[rows] @ data.points[cols].T).astype(np.int64)
            else:
                keys = -_whole(self.q.points[rows], data.points[cols])
            keys[self.q.own[rows][:, None] == place[cols][None, :]] = self.best.none
            self.best.offer(rows, keys, data.ids[cols])
            at, slab = end, min(2 * slab, WIDEST_SLAB)

    def found(self) -> tuple[np.ndarray, ...]:
        own, q, v, key = self.best.found(self.q.own, self.q.ids)
        return own, q, v, -key


def _whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size; those beyond 63 bits stop the job."""
    ints = [np.array([[int(c) for c in row] for row in part], dtype=object) for part in (x, y)]
    out = ints[0] @ ints[1].T
    if any(abs(s) >= 2**63 - 1 for s in out.ravel()):
        raise OverflowError("a score does not fit 64 bits")
    return out.astype(np.int64)


def quantised(table: DataFrame, quanta: int = QUANTA) -> DataFrame:
    """``id, dim, v`` with every component as ``floor(quanta * x)``, whole numbers as doubles."""
    return clean(table, zero=True).select("id", "dim", F.transform("v", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * quanta).cast("double")).otherwise(x * quanta)).alias("v"))


def top_k(table: DataFrame, every: int, k: int, quanta: int = QUANTA, spent: bool = False) -> DataFrame:
    """The ``k`` highest integer inner products of every query against all other rows.

    Components become ``floor(quanta * x)``; queries are the ids divisible by ``every``.  Ties
    go to the smaller id; fewer candidates give fewer rows; vectors meet only vectors of
    their own length; see ``vectors.clean`` for rows that take no part.  Rows that repeat an id
    are rows and queries of their own, and each is a candidate of the other.  An empty table
    gives no rows.  Scores are exact; one beyond 63 bits stops the job.
    """
    return search(quantised(table, quanta), every, build, build, lambda tree: Search(tree, k), "long", False, k, near=True, spent=spent)
