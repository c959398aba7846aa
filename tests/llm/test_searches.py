"""The two vector searches: results that come through their method, and awkward vectors."""

import numpy as np
import pandas as pd
import pytest

from orrery.llm import covertree, qalsh, vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string, own string").repartition(3)


def rows_of(ids, x):
    return [(int(i), [float(c) for c in v], 0, "s", "o") for i, v in zip(ids, x)]


def brute_top(ids, x, k, every):
    want = []
    if len(ids) > 100:  # whole numbers within doubles
        x = np.asarray(x)
        for i in np.flatnonzero(np.asarray(ids) % every == 0):
            s = x @ x[i]
            s[i] = -np.inf
            top = np.lexsort((ids, -s))[:k]
            want += [(int(ids[i]), r, int(ids[j]), int(s[j])) for r, j in enumerate(top, 1)]
        return sorted(want)
    for i, q in enumerate(ids):
        if q % every == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[j])), int(ids[j])) for j in range(len(ids)) if j != i and len(x[j]) == len(x[i]))[:k]
            want += [(int(q), r, v, -t) for r, (t, v) in enumerate(s, 1)]
    return sorted(want)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def spent(df):
    return {r["name"]: r["n"] for r in df.groupBy("name").sum("n").toDF("name", "n").collect()}


def clustered(n, dim=16, centres=40, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 4
    return np.round(c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.05, 6)


@pytest.mark.parametrize("block", [600, 4096])
def test_clustered_vectors_are_pruned(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    x, ids = clustered(2400), np.arange(2400)
    df = frame(spark, rows_of(ids, x))
    assert found(covertree.top_k(df, 4, 5)) == brute_top(ids, np.floor(64 * x), 5, 4)
    n = spent(covertree.top_k(df, 4, 5, spent=True))
    assert n["products"] < 0.35 * n["all"] and n["nodes"] > 100, n


def test_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(900, 64)), np.repeat(rng.normal(size=(1, 64)), 200, axis=0)])
    t = covertree.build(np.arange(len(x)), x, np.arange(len(x)))
    assert len(t.lo) > 60 and sorted(t.ids) == list(range(len(x)))
    for i in range(len(t.lo)):
        own = t.points[t.lo[i] : t.hi[i]]
        assert np.linalg.norm(own - t.centre[i], axis=1).max() <= t.radius[i] + 1e-9
        if t.fan[i]:
            kids = range(t.first[i], t.first[i] + t.fan[i])
            assert [t.lo[k] for k in kids][0] == t.lo[i] and [t.hi[k] for k in kids][-1] == t.hi[i]
            far = max(np.linalg.norm(t.points[t.lo[k] : t.hi[k]] - t.centre[k], axis=1).max() for k in kids)
            apart = min(np.linalg.norm(t.centre[a] - t.centre[b]) for a in kids for b in kids if a < b)
            assert apart >= far - 1e-9
        else:
            assert t.hi[i] - t.lo[i] <= covertree.LEAF or t.radius[i] == 0


def test_repeated_ids_lengths_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 2)
    rows = [(20, [3, 1]), (20, [5, 9]), (1, [3, 1]), (1, [5, 9]), (2, [3, 1]), (40, [1, 1, 1]), (3, [2, 2, 2]), (60, [7]), (5, [0, 0])]
    odd = [(80, None), (100, []), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = frame(spark, [(i, v if v is None else [c if c is None else float(c) for c in v], 0, "s", "o") for i, v in rows + odd])
    got, want = found(covertree.top_k(df, 20, 3)), brute_top([i for i, _ in rows], [[64 * c for c in v] for _, v in rows], 3, 20)
    assert got == want
    near = found(qalsh.nearest(df, 20, 3))
    at = {r[:2] + (round(r[3], 9),): r[2] for r in near if r[0] == 20}
    assert sorted(r[3] for r in near if r[0] == 20 and r[1] == 1) == [0.0, 0.0] and len(at) and not any(r[2] == 5 for r in near)
    assert [r[2] for r in near if r[0] == 40] == [3] and not any(r[0] == 60 for r in near)
    empty = df.limit(0)
    assert covertree.top_k(empty, 20, 3).count() == 0 and qalsh.nearest(empty, 20, 3).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = [(20, [2.0**24 + 1 / 64]), (1, [2.0**26 + 1 / 64]), (2, [2.0**26]), (3, [-(2.0**26)])]
    df = frame(spark, [(i, v, 0, "s", "o") for i, v in big])
    got = [(r[2], r[3]) for r in found(covertree.top_k(df, 20, 3))]
    assert got == [(1, (2**30 + 1) * (2**32 + 1)), (2, (2**30 + 1) * 2**32), (3, -(2**30 + 1) * 2**32)]
    over = frame(spark, [(20, [2.0**40], 0, "s", "o"), (1, [2.0**40], 0, "s", "o")])
    with pytest.raises(Exception, match="64 bits"):
        covertree.top_k(over, 20, 1).collect()


@pytest.mark.parametrize("sf,most", [("sf0.1", 0.2), ("check_s", 0.2)])
def test_collision_counting_verifies_few(spark, sf, most):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    raw = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x, ids = np.array(raw.embedding.tolist(), dtype=float), raw.vec_id.to_numpy()
    hit = total = 0
    for q, part in qalsh.nearest(table, 100, 10).toPandas().groupby("query_id"):
        i = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert np.allclose(part.sort_values("rank").score, d[[int(np.flatnonzero(ids == v)[0]) for v in part.sort_values("rank").vec_id]], rtol=0, atol=1e-12)
        d[i] = np.inf
        hit, total = hit + len(set(ids[np.argsort(d)[:10]]) & set(part.vec_id)), total + 10
    n = spent(qalsh.nearest(table, 100, 10, spent=True))
    assert hit / total >= 0.9 and n["verified"] < most * n["all"], (hit / total, n)


def test_clustered_neighbours(spark):
    x, ids = clustered(2000, seed=8), np.arange(2000)
    df = frame(spark, rows_of(ids, x))
    hit = 0
    for q, part in qalsh.nearest(df, 100, 10).toPandas().groupby("query_id"):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(part.vec_id))
    n = spent(qalsh.nearest(df, 100, 10, spent=True))
    assert hit / 200 >= 0.9 and n["verified"] < 0.1 * n["all"], (hit, n)
