"""Vectors in blocks: what the two searches share.

Data rows are dealt into blocks, each block is indexed once by a task of its own, and the
index is written to the shared folder.  The queries are taken from the stored blocks, so a
query knows its own row by block and place: rows that repeat an id stay rows of their own.
Queries form parts of up to ``QUERY_ROWS``.  A work unit holds one query part while a slice of
the data blocks streams past it; a data block is sent once for each query part, a query part
once for each slice, and nothing else is paired.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Rows of a data block and of a query part, at most; fewer where vectors are long.
BLOCK_ROWS, QUERY_ROWS = 4096, 16_384  # below 65,536: ranks are kept in 16 bits
BLOCK_BYTES = 32_000_000
#: Slices of the data that every query part meets in separate tasks: one for so many blocks,
#: but so many at least (while there are blocks).
SLICE_BLOCKS, LEAST_SLICES = 4096, 8
#: Centres that rows may be dealt by, at most.
PIVOTS = 256


def clean(table: DataFrame, zero: bool) -> DataFrame:
    """``id, dim, v`` (doubles) of the rows that take part.

    Left out: null ids, null or empty vectors, null or non-finite components, and zero
    vectors unless ``zero``.  Rows that repeat an id stay.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = table.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    if not zero:
        rows = rows.where("exists(v, x -> x <> 0)")
    return rows.select("id", F.size("v").alias("dim"), "v")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim)


def _near_pivot(rows: DataFrame, parts: int) -> DataFrame:
    """``cell``: the nearest of a bounded sample of rows, so that blocks are compact."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(min(PIVOTS, parts)).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample}:
        pivots[dim] = np.array([r.v for r in sample if r.dim == dim])
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                centre = sent.value.get(int(dim))
                if centre is not None:
                    own = _matrix(batch.take(pa.array(at)), int(dim))
                    cell[at] = np.argmin((centre * centre).sum(axis=1)[None, :] - 2 * (own @ centre.T), axis=1)
            yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in rows.dtypes), "cell int"]))


def _blocks(rows: DataFrame, size: int, build: Callable, near: bool = False) -> DataFrame:
    """``dim, block, n, data``: rows (with ``own``, or it is null) dealt into blocks of about
    ``size``, each built once.  With ``near`` rows are dealt by their nearest pivot first."""
    count, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = max(1, min(size, BLOCK_BYTES // (8 * dim)))
    parts = max(1, -(-count // size))
    if near and parts > 1:
        dealt = stored(_near_pivot(rows, parts), "cells")
        # A row a cell and length; a full cell is split by a hash.
        cells = dealt.groupBy("dim", "cell").count().withColumn("split", F.ceil(F.col("count") / size).cast("int"))
        first = F.sum("split").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.select("dim", "cell", "split", F.coalesce(first, F.lit(0)).alias("first"))
        dealt = dealt.join(F.broadcast(cells), ["dim", "cell"])
        dealt = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("split"))).cast("int")).drop("cell", "split", "first")
    else:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(min(parts, 4096), "dim", "block").sortWithinPartitions("dim", "block", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vs, owns = None, [], [], []

        def done() -> pa.RecordBatch:
            data = pickle.dumps(build(np.concatenate(ids), np.concatenate(vs), np.concatenate(owns)), protocol=5)
            out = pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([sum(map(len, ids))], pa.int32()), pa.array([data], pa.binary())], names=["dim", "block", "n", "data"])
            ids.clear(), vs.clear(), owns.clear()
            return out

        for batch in batches:
            dims, blocks = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi <= lo:
                    continue
                if at and at != (dims[lo], blocks[lo]) and ids:
                    yield done()
                at = (dims[lo], blocks[lo])
                part = batch.slice(lo, hi - lo)
                ids.append(part.column("id").to_numpy())
                owns.append(part.column("own").to_numpy())
                vs.append(_matrix(part, int(dims[lo])))
        if ids:
            yield done()

    return dealt.select("dim", "block", "id", "own", "v").mapInArrow(run, "dim int, block int, n int, data binary")


def places(block: int, n: int) -> np.ndarray:
    """The row numbers of a block's rows: its number and the place in it."""
    return (np.int64(block) << 32) + np.arange(n)


def _queries(data: DataFrame, every: int) -> DataFrame:
    """The rows of the stored blocks whose id is divisible by ``every``; ``own`` is their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                item = pickle.loads(batch.column("data")[i].as_buffer())
                at = np.flatnonzero(item.ids % every == 0)
                own = places(batch.column("block")[i].as_py(), len(item.ids))[at]
                v = pa.FixedSizeListArray.from_arrays(pa.array(item.points[at].ravel()), item.points.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(item.ids[at]), pa.array(np.full(len(at), item.points.shape[1], np.int32)), v, pa.array(own)], names=["id", "dim", "v", "own"])

    return data.select("block", "data").mapInArrow(run, "id long, dim int, v array<double>, own long")


def search(
    rows: DataFrame,
    every: int,
    build_data: Callable[[np.ndarray, np.ndarray, np.ndarray], object],
    build_queries: Callable[[np.ndarray, np.ndarray, np.ndarray], object],
    state: Callable[[object], object],
    score: str,
    ascending: bool,
    k: int,
    near: bool = False,
    spent: bool = False,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the best ``k`` for each query, over all blocks.

    ``state`` makes a search of a query part; its ``meet(block, place)`` folds a data block in,
    and ``found()`` gives query numbers, their ids, found ids and scores.  The last step ranks
    at most ``k`` rows a query and slice.  With ``spent`` the result is instead what the
    searches counted: ``name, n`` in one row a unit.
    """
    data = stored(_blocks(rows.withColumn("own", F.lit(-1).cast("long")), BLOCK_ROWS, build_data, near), "data-blocks")
    asked = stored(_blocks(_queries(data, every), QUERY_ROWS, build_queries), "query-blocks")
    n_data, n_asked = data.count(), max(1, asked.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0])
    slices = max(1, min(n_data, LEAST_SLICES), -(-n_data // SLICE_BLOCKS))
    left = asked.select("dim", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), F.lit(0).alias("role"), F.lit(0).alias("block"), "data")
    right = data.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("q"), F.pmod("block", F.lit(slices)).alias("s"), F.lit(1).alias("role"), "block", "data")
    # More parts than units, so that few units share a task.
    dealt = left.unionByName(right).repartition(min(4 * n_asked * slices, 65_536), "dim", "q", "s").sortWithinPartitions("dim", "q", "s", "role", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held) -> pa.RecordBatch:
            if spent:
                return pa.RecordBatch.from_arrays([pa.array(list(held.spent)), pa.array(list(held.spent.values()), pa.int64())], names=["name", "n"])
            own, q, v, s = held.found()
            kind = pa.int64() if score == "long" else pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)], names=["own", "query_id", "vec_id", "score"])

        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                unit = tuple(batch.column(c)[i].as_py() for c in ("dim", "q", "s"))
                role, block = batch.column("role")[i].as_py(), batch.column("block")[i].as_py()
                if unit != at:
                    if held is not None:
                        yield out(held)
                    at, held = unit, None
                if role == 0:
                    held = state(pickle.loads(batch.column("data")[i].as_buffer()))
                elif held is not None:  # a part may hold no query of this length
                    held.meet(pickle.loads(batch.column("data")[i].as_buffer()), block)
        if held is not None:
            yield out(held)

    if spent:
        return dealt.mapInArrow(run, "name string, n long")
    got = dealt.mapInArrow(run, f"own long, query_id long, vec_id long, score {score}")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The best ``k`` of every query so far: smaller keys first, then smaller ids."""

    def __init__(self, n: int, k: int, kind: type = np.float64):
        self.none = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        self.key = np.full((n, k), self.none, kind)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def offer(self, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        """Fold a matrix of keys (rows x candidates) in; ``none`` marks what does not count."""
        good = keys <= self.key[rows, -1][:, None]
        rows, keys = rows[good.any(axis=1)], keys[good.any(axis=1)]
        cols = good.any(axis=0)
        if not len(rows):
            return
        keys = np.concatenate([self.key[rows], keys[:, cols]], axis=1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids[cols], (len(rows), int(cols.sum())))], axis=1)
        first = np.lexsort((ids, keys), axis=1)[:, : self.k]
        self.key[rows], self.id[rows] = np.take_along_axis(keys, first, axis=1), np.take_along_axis(ids, first, axis=1)

    def found(self, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        have = self.key != self.none
        n = have.sum(axis=1)
        return np.repeat(own, n), np.repeat(ids, n), self.id[have], self.key[have]
