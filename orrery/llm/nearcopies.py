"""Near copies: SimHash candidates over five-word shingles, then exact Jaccard similarity.

Rows with the same words are one node.  The fingerprint has ``LANES`` times 64 bits, taken over
the distinct shingles, and two nodes are candidates within a radius that a pair of similarity
0.8 keeps with probability 0.9997 (a closer one with more).  Sets of similarity 0.8 have sizes
in that ratio, so tiles go by size class and meet themselves and the next.  The tiled
comparison gives a forest of candidate links, and every link is then decided on the shingle
sets.  A candidate component whose members are one component after that, as with a large
group of copies, is done.  In the others members outside the largest part are held, so many
at a time, and all members stream past them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..shared import stored
from .rows import text_chunks
from .simhash import bits, forest
from .tokens import mixed

WORDS = 5
SIMILARITY = 0.8
LANES = 4
#: Bits of 256 that candidates may differ in: pairs of similarity 0.8 differ in 39 (sd 5.7); sets
#: of a few shingles in up to 48 (sd 6.2).
RADIUS, SMALL_RADIUS, SMALL = 58, 74, 32
TILE_ROWS = 16_384
#: Members of one candidate component that a task holds at a time.
HELD = 512
#: Members that stream past them in one task.
STREAMED = 1024
SEED = 42


def shingles(tokens: list[bytes], words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle."""
    if not tokens:
        return np.zeros(0, np.uint64)
    each = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in each], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """``LANES`` times 64 bits by majority over distinct shingles; zeros for an empty set."""
    return b"".join(bits(mixed(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))).tobytes() if len(hashes) else bytes(8) for lane in range(LANES))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _similar(common, n, m, similarity: float):
    return common >= similarity * (n + m - common) - 1e-9


def _marks(docs: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            tokens = [_words(t) for t in batch.column("text").to_pylist()]
            digests = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() for t in tokens]
            sets = [shingles(t) for t in tokens]
            columns = [batch.column("node"), pa.array(digests, pa.binary()), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "digest", "fp", "n"])

    return docs.select(F.col(key).alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, digest binary, fp binary, n long")


def _sets(docs: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """The shingle hashes of the rows in ``nodes``, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            blobs = [shingles(_words(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary())], names=["node", "s"])

    rows = docs.select(F.col(key).alias("node"), F.col("text").cast("binary").alias("text")).join(nodes, "node", "left_semi")
    return rows.mapInArrow(run, "node long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``src``, ``dst`` whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                keep.append(bool(_similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnRenamed("node", "src"), "src").join(sets.select(F.col("node").alias("dst"), F.col("s").alias("t")), "dst")
    return both.select("src", "dst", "s", "t").mapInArrow(run, "src long, dst long")


class _Held:
    """Held members of one bucket, found by shingle, and what hangs together there."""

    def __init__(self, node: list[int], part: list[int], sets: list[np.ndarray]):
        self.node, self.size = np.array(node), np.array([len(s) for s in sets])
        order = np.argsort(np.concatenate(sets), kind="stable")
        self.hashes, self.owner = np.concatenate(sets)[order], np.repeat(np.arange(len(sets)), self.size)[order]
        self.part, self.root = np.array(part), {}

    def find(self, part: int) -> int:
        while part in self.root:
            part = self.root[part]
        return part

    def links(self, node: int, part: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        lo, hi = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.node))
        for i in np.flatnonzero(_similar(common, self.size, len(own), SIMILARITY) & (self.part != part)):
            a, b = self.find(part), self.find(int(self.part[i]))
            if a != b:
                self.root[max(a, b)] = min(a, b)
                yield node, int(self.node[i])


def _across(members: DataFrame) -> DataFrame:
    """Links between parts inside ``bucket``; members ``outside`` its largest part are held,
    ``HELD`` at a time by a hash, and all members stream past each lot, ``STREAMED`` in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held, out = None, [], None, []
        for batch in batches:
            for bucket, lot, share, role, node, part, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lot", "share", "role", "node", "part", "s"))):
                if (bucket, lot, share) != at:
                    at, rows, held = (bucket, lot, share), [], None
                own = np.frombuffer(s, np.uint64)
                if role == 0:
                    rows.append((node, part, own))
                    continue
                if rows:
                    held = held or _Held(*map(list, zip(*rows)))
                    out.extend(held.links(node, part, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["src", "dst"])
                out = []

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n))
    held = members.where("outside").withColumn("lot", one("lots")).withColumn("share", every("shares")).withColumn("role", F.lit(0))
    past = members.withColumn("share", one("shares")).withColumn("lot", every("lots")).withColumn("role", F.lit(1))
    unit = ["bucket", "lot", "share"]
    dealt = held.unionByName(past.select(held.columns)).select(*unit, "role", "node", "part", "s").repartition(*unit).sortWithinPartitions(*unit, "role", "node")
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def candidates(nodes: DataFrame) -> DataFrame:
    """A forest of links between ``least`` of nodes whose ``fp`` are near and sizes ``n`` alike."""
    base = 1 / SIMILARITY
    # A little above the ratio, so that rounding never parts a pair at exactly the similarity.
    tile = F.floor(F.log(F.col("n").cast("double")) / math.log(base * 1.0001)).cast("int")
    small = math.ceil(math.log(SMALL, base))
    rows = nodes.where("n > 0").select(F.col("least").alias("node"), "fp", tile.alias("tile"))
    return forest(rows, [1], LANES, [(small, SMALL_RADIUS), (1 << 31, RADIUS)], TILE_ROWS)


def near_copies(docs: DataFrame, key: str) -> DataFrame:
    """Every row's ``key`` (a unique long) and ``component_id``, the smallest key reachable over
    pairs of similarity ``SIMILARITY`` or more.

    Null texts and texts without words are alike, and like no other.  Texts of fewer than
    ``WORDS`` words are one shingle.  Repeated rows are copies; an empty table gives no rows.
    """
    marks = stored(_marks(docs, key), "marks")
    nodes = stored(marks.groupBy("digest").agg(F.min("node").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n")), "distinct-texts")
    found = stored(candidates(nodes), "candidates")
    ends = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sets = stored(_sets(docs, key, ends), "sets")
    links = stored(_verified(found, sets, SIMILARITY), "links")
    parts = connected_components(links).withColumnRenamed("label", "part")

    members = connected_components(found).select("node", F.col("label").alias("bucket"))
    members = stored(members.join(parts, "node", "left").select("bucket", "node", F.coalesce("part", "node").alias("part")), "members")
    count = members.groupBy("bucket", "part").count()
    mixed_up = count.groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("major"), F.count("*").alias("k"), F.sum("count").alias("all"), F.max("count").alias("most")).where("k > 1")
    lots, shares = F.ceil((F.col("all") - F.col("most")) / HELD).alias("lots"), F.ceil(F.col("all") / STREAMED).alias("shares")
    open_ = members.join(mixed_up.select("bucket", "major", lots, shares), "bucket").select("bucket", "lots", "shares", "node", "part", (F.col("part") != F.col("major")).alias("outside"))
    more = _across(open_.join(sets, "node"))
    labels = connected_components(links.unionByName(more))
    named = nodes.join(labels, F.col("least") == F.col("node"), "left").select("digest", F.coalesce("label", "least").alias("component_id"))
    return marks.select(F.col("node").alias(key), "digest").join(named, "digest").select(key, "component_id")
