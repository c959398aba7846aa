"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

For short radii a tile holds the fingerprints that have the same four population counts, one
for each quarter of the 64 bits.  Two fingerprints that differ in at most r bits have counts
that differ by at most r in total, so all other tile pairs are skipped without loss.  For
long radii tiles go by size class, and what a tile's sorted population counts put beyond the
radius is skipped.  A tile travels as one blob of fingerprints; one with more than
``TILE_ROWS`` is split by a hash.  Every tile reports a spanning forest of its links, never all
pairs, and a distributed components operator joins the forests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, with_least
from ..shared import stored
from .rows import text_chunks

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints that one task holds while others stream past.
TILE_ROWS = 4096
#: Fingerprints in one blob of a large tile.
PACK_ROWS = 1024
QUARTERS = 4
QUARTER_BITS = 16
#: Where a fingerprint has several lanes, pairs further apart than this on the first are dropped.
LANE_RADIUS = 23


def bits(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits (as one number) that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text; zero for a null text or one without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return int(bits(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """``key`` and the signed 64-bit fingerprint ``fp`` of every row's whole text."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps.view("<i8"))], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Tile offsets with at most ``radius`` in total, one of each opposite pair."""
    reach = range(-radius, radius + 1)
    ball = (d for d in itertools.product(reach, repeat=QUARTERS) if sum(map(abs, d)) <= radius)
    return [d for d in ball if d > (0,) * QUARTERS]


class _Tile:
    """The fingerprints of one tile (rows x lanes), and which are known to hang together."""

    def __init__(self, nodes: np.ndarray, fps: np.ndarray, radius: int, lane_radius: int):
        count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
        order = np.argsort(count, kind="stable")
        self.nodes, self.fps, self.count = nodes[order], fps[order], count[order]
        self.radius, self.lane_radius, self.label = radius, lane_radius, np.arange(len(fps))

    def near(self, others: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (other, own) within the radius, a slab at a time; ``count`` ascends."""
        step = max(1, (1 << 20) // max(1, len(self.fps)))
        for at in range(0, len(others), step):
            part = others[at : at + step]
            first, last = self.count.searchsorted(count[at] - self.radius, "left"), self.count.searchsorted(count[at : at + step][-1] + self.radius, "right")
            own = self.fps[first:last]
            apart = np.bitwise_count(part[:, None, 0] ^ own[None, :, 0])
            if own.shape[1] == 1:
                i, j = np.nonzero(apart <= self.radius)
            else:  # a few get past the first lane, and all lanes decide on those
                i, j = np.nonzero(apart <= self.lane_radius)
                near = np.bitwise_count(part[i] ^ own[j]).sum(axis=1, dtype=np.int64) <= self.radius
                i, j = i[near], j[near]
            if len(i):
                yield i + at, j + first

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Join own fingerprints pairwise; the links that were news."""
        links = []
        while True:
            a, b = self.label[i], self.label[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return links
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            tops, first = np.unique(high, return_index=True)
            for top, x in zip(tops, first):
                links.append((int(i[apart[x]]), int(j[apart[x]])))
            root = np.arange(len(self.label))
            root[tops] = low[first]
            while not np.array_equal(root, root[root]):
                root = root[root]
            self.label = root[self.label]

    def own_links(self) -> Iterator[tuple[int, int]]:
        for i, j in self.near(self.fps, self.count):
            for a, b in self.join(i, j):
                yield self.nodes[a], self.nodes[b]

    def links_to(self, nodes: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
        """One link for each other fingerprint that is near, plus what it joins here."""
        count = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
        order = np.argsort(count, kind="stable")
        nodes, fps = nodes[order], fps[order]
        for i, j in self.near(fps, count[order]):
            _, first, of = np.unique(i, return_index=True, return_inverse=True)
            for a, b in zip(i[first], j[first]):
                yield nodes[a], self.nodes[b]
            for a, b in self.join(j, j[first][of]):
                yield self.nodes[a], self.nodes[b]


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[int, int]]:
    """Stretches of equal values in sorted columns."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in columns:
        change |= np.diff(batch.column(c).to_numpy()) != 0
    cuts = np.flatnonzero(change) + 1
    yield from ((lo, hi) for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]) if hi > lo)


def forest(rows: DataFrame, near: list[int] | Column, lanes: int, radius: list[tuple[int, int]] | int, tile_rows: int) -> DataFrame:
    """A spanning forest (``src``, ``dst``) of all pairs of ``node`` whose ``fp`` are within the radius.

    ``rows``: node long, fp binary (``lanes`` times 8 bytes), tile int.  A tile is compared with
    itself and with the tiles in ``near``, offsets or an array column.  The number of tiles is
    bounded by the caller's key, so their sizes may be broadcast.
    """
    size = rows.groupBy("tile").count().select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("salts"), (F.col("count") > PACK_ROWS).alias("many"))
    size = stored(size, "tile-sizes")
    # A part of a tile is packed in pieces, so that no task gathers all its rows.
    piece = F.pmod(F.xxhash64("node", F.lit("piece")), F.lit(max(1, tile_rows // PACK_ROWS))).cast("int")
    dealt = rows.join(F.broadcast(size), "tile").select("tile", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.when(F.col("many"), piece).otherwise(0).alias("piece"), "node", "fp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> pa.RecordBatch:
            nodes, fps = (b"".join(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([nodes]), pa.array([fps])], names=["tile", "salt", "nodes", "fps"])

        for batch in batches:
            tile, salt, piece, nodes = (batch.column(c).to_numpy() for c in ("tile", "salt", "piece", "node"))
            for lo, hi in _runs(batch, "tile", "salt", "piece"):
                if held and at != (tile[lo], salt[lo], piece[lo]):
                    yield flush()
                at = (tile[lo], salt[lo], piece[lo])
                held.append((nodes[lo:hi].astype("<i8").tobytes(), b"".join(batch.column("fp").slice(lo, hi - lo).to_pylist())))
        if held:
            yield flush()

    packed = dealt.repartition("tile", "salt", "piece").sortWithinPartitions("tile", "salt", "piece").mapInArrow(pack, "tile int, salt int, nodes binary, fps binary")
    packed = stored(packed, "tiles")
    home = packed.withColumn("role", F.lit(0))
    # Within one split tile every part also meets the later ones.
    split = packed.join(F.broadcast(size.where("salts > 1").drop("many")), "tile").where("salt + 1 < salts")
    split = split.withColumn("salt", F.explode(F.sequence(F.col("salt") + 1, F.col("salts") - 1))).withColumn("role", F.lit(1)).drop("salts")
    others = F.array(*(F.col("tile") + d for d in near)) if isinstance(near, list) else near
    away = packed.withColumn("tile", F.explode(others)).drop("salt").join(F.broadcast(size.drop("many")), "tile")
    away = away.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("role", F.lit(1)).drop("salts")
    units = home.unionByName(split).unionByName(away).repartition("tile", "salt").sortWithinPartitions("tile", "salt", "role")
    # Upper ends of tile numbers, each with the radius below it.
    limits = [(1 << 31, radius)] if isinstance(radius, int) else radius

    def radius_of(tile: int) -> int:
        return next(r for below, r in limits if tile < below)

    def unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        nodes, fps = (b"".join(part.column(c).to_pylist()) for c in ("nodes", "fps"))
        return np.frombuffer(nodes, "<i8"), np.frombuffer(fps, "<u8").reshape(-1, lanes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, home = None, None, []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            pair = np.array(out, dtype="<i8").reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["src", "dst"])

        def close() -> None:
            """The tile is whole: compare it with itself."""
            nonlocal own
            if home:
                nodes, fps = (np.concatenate(x) for x in zip(*home))
                home.clear()
                r = radius_of(at[0])
                own = _Tile(nodes, fps, r, min(r, LANE_RADIUS))
                out.extend(own.own_links())

        for batch in batches:
            tile, salt, role = (batch.column(c).to_numpy() for c in ("tile", "salt", "role"))
            for lo, hi in _runs(batch, "tile", "salt", "role"):
                if at != (int(tile[lo]), int(salt[lo])):
                    close()
                    at, own = (int(tile[lo]), int(salt[lo])), None
                if role[lo] == 0:
                    home.append(unpacked(batch.slice(lo, hi - lo)))
                    continue
                close()
                for x in range(lo, hi if own is not None else lo, 64):
                    out.extend(own.links_to(*unpacked(batch.slice(x, min(64, hi - x)))))
                    if len(out) > 50_000:
                        yield flush()
        close()
        if out:
            yield flush()

    return units.select("tile", "salt", "role", "nodes", "fps").mapInArrow(compare, "src long, dst long").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (``src``, ``dst``) of all pairs of distinct ``fp`` within ``radius``."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", q * QUARTER_BITS).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1))) for q in range(QUARTERS)]
    base = QUARTER_BITS + 1  # 17 ** 4 tiles at most, whatever the input
    power = [base ** (QUARTERS - 1 - q) for q in range(QUARTERS)]
    key = sum((c.cast("int") * power[q] for q, c in enumerate(counts)), F.lit(0))
    # to_binary of the number's hex digits, bytes turned round: the blob's little-endian order.
    blob = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    blob = F.concat(*(F.substring(blob, 8 - i, 1) for i in range(8)))
    rows = fps.select(F.col("fp").alias("node"), blob.alias("fp"), key.cast("int").alias("tile"))
    digit = [F.pmod(F.floor(F.col("tile") / power[q]), F.lit(base)) for q in range(QUARTERS)]
    steps = []
    for d in _neighbours(radius):
        inside = F.lit(True)
        for q, x in enumerate(d):
            if x:
                inside = inside & (digit[q] + x).between(0, QUARTER_BITS)
        steps.append(F.when(inside, F.col("tile") + sum(x * power[q] for q, x in enumerate(d))))
    return forest(rows, F.array_compact(F.array(*steps)), 1, radius, TILE_ROWS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Every row's ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest key that is reachable over links of at most ``radius``
    bits; fingerprint zero (null or empty texts) links like any other.  A null key takes
    part but never names a component, unless the component has no other key; then the
    component is null.  Repeated rows each get a row; an empty table gives an empty one.
    """
    marks = stored(fingerprints(docs, key, words), "fingerprints")
    each = stored(marks.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    parts = connected_components(links(each, radius))
    joined = each.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"), F.col("label").isNotNull().alias("linked"))
    joined = stored(joined, "labelled")
    linked = with_least(joined.where("linked"), "label", "least", "fp", "component").select("fp", "component")
    groups = linked.unionByName(joined.where("not linked and n > 1").select("fp", F.col("least").alias("component")))
    groups = groups.withColumn("grouped", F.lit(True))
    return marks.join(groups, "fp", "left").select(
        key,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("grouped"), F.col("component")).otherwise(F.col(key)).alias("component_id"),
    )
