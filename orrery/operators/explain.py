"""Attributions of a score to its columns: seeded background, antithetic walks, exact tree values."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .uncertainty import uniform

#: Rows of a batch that are walked together; bounds a task's memory.
WALKED = 64


def seeded_sample(rows: DataFrame, cell: list[str], size: int, seed: int, key: str = "id") -> DataFrame:
    """At most ``size`` rows a cell, uniform and without replacement.

    The draw is the order of a hash of ``key`` and ``seed``: no other column takes part, and it does
    not depend on how rows are spread.  The filter on the position becomes a limit before the
    shuffle, so a task sends at most ``size`` rows a cell.  A smaller cell is taken whole.
    """
    if size <= 0:
        raise ValueError(f"sample size must be positive, got {size}")
    order = Window.partitionBy(*cell).orderBy(uniform(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def walk_values(predict: Callable[[np.ndarray], np.ndarray], matrix: np.ndarray, background: np.ndarray, orders: list[np.ndarray]) -> np.ndarray:
    """Mean change of ``predict`` as columns move, in each order and its reverse, from every
    background row to the explained row: one value a row and column."""
    n, m = matrix.shape
    b = len(background)
    out = np.zeros((n, m))
    for order in (o for forward in orders for o in (forward, forward[::-1])):
        at = np.broadcast_to(background, (n, b, m)).copy()
        last = predict(at.reshape(-1, m)).reshape(n, b).mean(axis=1)
        for j in order:
            at[:, :, j] = matrix[:, j, None]
            now = predict(at.reshape(-1, m)).reshape(n, b).mean(axis=1)
            out[:, j] += now - last
            last = now
    return out / (2 * len(orders))


def permutation_attributions(rows: DataFrame, cell: str, columns: list[str], background: DataFrame, predict: Callable[[np.ndarray], np.ndarray], rounds: int = 1, seed: int = 1) -> DataFrame:
    """``cell, id, feature, value`` of every row: antithetic permutation values of any model.

    ``background`` is a seeded sample of the cell's training rows, a bounded number a cell.  The
    values of a row add up to its score less the mean score of the background whatever the number
    of rounds, so that sum proves nothing about the shares.  Orders are drawn once, for all rows.
    One round is exact where no more than two columns act together.  Rows of a cell without background have no values, and
    nulls count as 0.
    """
    if rounds <= 0:
        raise ValueError(f"rounds must be positive, got {rounds}")
    made: dict[object, list] = {}
    for r in background.select(cell, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)).collect():
        made.setdefault(r[0], []).append([float(v) for v in r[1:]])
    grounds = {k: np.array(v) for k, v in made.items()}
    draw = np.random.default_rng(seed)
    orders = [draw.permutation(len(columns)) for _ in range(rounds)]
    kinds = dict(rows.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby(cell, sort=False):
                if name not in grounds:
                    continue
                for i in range(0, len(part), WALKED):
                    some = part.iloc[i : i + WALKED]
                    v = walk_values(predict, some[columns].to_numpy(dtype=float), grounds[name], orders)
                    yield pd.DataFrame({cell: np.repeat(some[cell].to_numpy(), len(columns)), "id": np.repeat(some["id"].to_numpy(), len(columns)), "feature": np.tile(columns, len(some)), "value": v.ravel()})

    needed = rows.select(cell, "id", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    return needed.mapInPandas(walk, f"{cell} {kinds[cell]}, id {kinds['id']}, feature string, value double")


Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def leaves(tree) -> list[Leaf]:
    """The leaves of one of Spark's regression trees: the value, and by feature on the path the
    half-open interval ``(above, up to]`` and the share of training weight that went along."""
    found: list[Leaf] = []

    def down(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            found.append((node.prediction(), path))
            return
        split, whole = node.split(), node.impurityStats().count()
        j, at = split.featureIndex(), split.threshold()
        low, high, share = path.get(j, (-math.inf, math.inf, 1.0))
        for child, ends in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            down(child, {**path, j: (*ends, share * child.impurityStats().count() / whole)})

    down(tree._call_java("rootNode"), {})
    return found


def tree_values(ensemble: list[tuple[float, list[Leaf]]], matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values of a weighted sum of trees, and the base value.

    A leaf pays its value times, for each feature on its path, whether the row fits (if the feature
    is known) or the share of training rows that do (if not).  Such a product has as many players
    as its path has features, so its subsets are few, and the leaves simply add up.
    """
    out, base = np.zeros(matrix.shape), 0.0
    for weight, tree in ensemble:
        for value, path in tree:
            fits = {j: ((matrix[:, j] > low) & (matrix[:, j] <= high)).astype(float) for j, (low, high, _) in path.items()}
            shares = {j: p[2] for j, p in path.items()}
            base += weight * value * math.prod(shares.values())
            m = len(path)
            for j in path:
                others = [i for i in path if i != j]
                total = np.zeros(len(matrix))
                for size in range(m):
                    for known in itertools.combinations(others, size):
                        price = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                        product = np.full(len(matrix), price)
                        for i in others:
                            product = product * (fits[i] if i in known else shares[i])
                        total += product
                out[:, j] += weight * value * total * (fits[j] - shares[j])
    return out, base


def tree_attributions(model, rows: DataFrame, cell: str, columns: list[str]) -> DataFrame:
    """``cell, id, feature, value, base, margin`` of every row under Spark's boosted trees.

    The values and the base add up to the margin (half the log odds).  The ensemble is a few
    hundred numbers and travels with the task; rows are taken batch by batch.
    """
    ensemble = [(float(w), leaves(t)) for w, t in zip(model.treeWeights, model.trees)]
    kinds = dict(rows.dtypes)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, base = tree_values(ensemble, pdf[columns].to_numpy(dtype=float))
            n, m = v.shape
            yield pd.DataFrame({cell: np.repeat(pdf[cell].to_numpy(), m), "id": np.repeat(pdf["id"].to_numpy(), m), "feature": np.tile(columns, n), "value": v.ravel(), "base": base, "margin": np.repeat(base + v.sum(axis=1), m)})

    needed = rows.select(cell, "id", *(F.col(c).cast("double").alias(c) for c in columns))
    return needed.mapInPandas(explain, f"{cell} {kinds[cell]}, id {kinds['id']}, feature string, value double, base double, margin double")
