"""Small shared pieces: streaming Arrow batches in and out, summed tables, row ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Text of about this many characters is worked on at once, so memory does not follow the batch.
CHUNK_CHARS = 1_000_000
#: Tables that are added up in one place before the sums of all places meet.
LANE_TASKS = 256


def binary_to_float(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long float32 blobs as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, width)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores after it until no taken name is like it."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def with_outputs(docs: DataFrame, keep: Iterable[str], outputs: dict[str, str], work: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """``keep`` columns as they are, and the ``outputs`` that ``work`` makes of whole texts.

    An output whose name a kept column has already gets underscores after it.
    """
    keep = list(keep)
    kinds = dict(docs.dtypes)
    inner = [f"k{i}" for i in range(len(keep))]
    # A kept text is sent once.
    read = inner[keep.index("text")] if "text" in keep else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, read):
            made = work(batch.column(read).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), *made], names=[*inner, *(f"o{i}" for i in range(len(outputs)))])

    rows = docs.select(*(column(c).alias(k) for c, k in zip(keep, inner)), *([F.col("text")] if read == "text" else []))
    schema = [*(f"{k} {kinds[c]}" for c, k in zip(keep, inner)), *(f"o{i} {kind}" for i, kind in enumerate(outputs.values()))]
    return rows.mapInArrow(run, ", ".join(schema)).toDF(*keep, *(fresh_name(n, keep) for n in outputs))


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batches holding about ``CHUNK_CHARS`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).nbytes
        step = max(1, int(batch.num_rows * CHUNK_CHARS / max(size, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def summed(
    df: DataFrame,
    count: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]],
    block: int,
) -> dict[str, np.ndarray]:
    """Sum the fixed-size integer tables that ``count`` makes of every partition.

    ``count`` maps a partition to named int64 vectors.  They travel in blocks of ``block``
    numbers and are added up as they stream past, so a task holds one table, however many
    partitions there are.  The driver receives the sum: names x length numbers, a bound set
    by the model's parameters and never by the rows.
    """

    def sparse(name: str, part: int, lane: int, table: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(table)
        arrays = [pa.array([name]), pa.array([part], pa.int32()), pa.array([lane], pa.int32()), pa.array([hit.astype("<i4").tobytes()]), pa.array([table[hit].astype("<i8").tobytes()])]
        return pa.RecordBatch.from_arrays(arrays, names=["name", "part", "lane", "at", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() // LANE_TASKS
        for name, table in count(batches).items():
            for at in range(0, len(table), block):
                if table[at : at + block].any():
                    yield sparse(name, at // block, lane, table[at : at + block])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, part, lane, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                table = sums.setdefault((name, part, lane), np.zeros(block, np.int64))
                table[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i8")
        for key, table in sums.items():
            yield sparse(*key, table)

    schema = "name string, part int, lane int, at binary, n binary"
    # Two levels: a task meets the tables of LANE_TASKS tasks, then those of all lanes.
    lanes = df.mapInArrow(emit, schema).repartition("name", "part", "lane").mapInArrow(add, schema)
    parts = lanes.withColumn("lane", F.lit(0)).repartition("name", "part").mapInArrow(add, schema)
    out: dict[str, np.ndarray] = {}
    for row in parts.collect():
        at = row["part"] * block
        table = out.get(row["name"], np.zeros(0, np.int64))
        if len(table) < at + block:
            table = np.concatenate([table, np.zeros(at + block - len(table), np.int64)])
        table[at + np.frombuffer(row["at"], "<i4")] += np.frombuffer(row["n"], "<i8")
        out[row["name"]] = table
    return out


def held_out(modulus: int, rest: int):
    """True where crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents as ``doc_id, text, y``, the same ones every run.

    Rows with a null id or label are left out; of several labels for one id the smallest
    counts.  The ids chosen are the ``bound`` smallest by a hash, so the table that is
    broadcast has a fixed bound.  The texts are stored once for the passes that follow.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(keep)
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id")
        .limit(bound)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return stored(found, f"{label}-sample", "zstd")


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, stored once, with a unique id that is fixed by the stored copy, and the
    name of that column: ``_rid``, or a longer one where the documents have that name."""
    name = fresh_name("_rid", docs.columns)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows", "zstd"), name
