"""Mixing sources to target weights, in DataFrame operations only.

The documents of a source, in a pseudorandom order, are one stream of words cut into blocks
of ``BLOCK_WORDS``.  Output shards draw how many slots each source gets (multinomially, by
the targets); the slots of a source are numbered through the shards, a pseudorandom
permutation of its block indices maps them to blocks, and a join on the index fetches them.
A second pass over a source uses a second permutation, so no block is taken more often than
the target needs.  The last slot is cut so that the words taken meet the target to the word.

Sums along a source are taken in three levels: in runs of about ``RUN_ROWS`` rows, over the
runs of a range, and over the ranges, so no task holds all rows of one source.  Rows that are
equal are numbered and spread like any others.  The only table in one place has one row for
each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .rows import column

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
RUN_ROWS = 256
#: Runs of one range.
RANGE_RUNS = 4096
#: Slots that one task expands.
TASK_SLOTS = 16_384
ROUNDS = 16
SEED = 2
#: Rows of a source table that may be broadcast; larger ones are joined by shuffling.
BROADCAST_SOURCES = 10_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2

WORD = r"[^ \t-\r]+"


def words(text: Column) -> Column:
    """Number of words in a text; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, *keys: Column, back: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1 (swap-or-not rounds), or its inverse."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *keys, r), n) + n - at, n)
        coin = F.pmod(F.xxhash64(F.lit(SEED + 1), *keys, r, F.greatest(at, partner)), F.lit(2))
        return F.when(coin == 1, partner).otherwise(at)

    return F.aggregate(rounds, index.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Targets by weight for ``source, source_size``: ``nth, target`` and how to meet them.

    Sources in code point order, null last, get the weights in turn; together they get
    ``share`` of all words, and none gets more than ``limit`` times its own: what is over is
    dealt again by weight.  Sorting by the cap in units of weight finds the level at once.
    """
    everything = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("nth", nth.cast("long")).withColumn("weight", weight)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * share).withColumn("cap", (F.col("source_size") * limit).cast("double"))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("budget") - before) / left)
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    s = s.withColumn("take", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * limit))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS)).withColumn("deficit", F.col("blocks") * BLOCK_WORDS - F.col("source_size"))
    s = s.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(F.lit(0)))
    s = s.withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
    last = F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.ceil((F.col("rest") + F.col("deficit")) / BLOCK_WORDS))).otherwise(F.lit(0))
    s = s.withColumn("slots", F.col("full") * F.col("blocks") + last)
    short = F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.col("nth"), F.col("full"), back=True))
    s = s.withColumn("short_at", short)  # where the last, shorter block comes in the last pass
    first = F.coalesce(F.sum("slots").over(everything.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("first", first).drop("weight", "budget", "cap", "level", "capped")


def _running(rows: DataFrame, key: str, run: str, order: list, value: str, name: str, ranges: bool = True) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of ``key`` that come earlier by run, then
    order.  The totals of the runs are summed the same way, range by range."""
    totals = rows.groupBy(key, run).agg(F.sum(value).alias("_total"))
    if ranges:
        totals = totals.withColumn("_range", F.floor(F.col(run) / RANGE_RUNS))
        starts = _running(totals, key, "_range", [F.col(run)], "_total", "_begin", False).select(key, run, F.col("_begin").alias("_start"))
    else:
        earlier = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(key, run, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(starts, [key, run]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def _numbered(rows: DataFrame) -> DataFrame:
    """``copy``: rows that are equal in ``nth, doc_id, size, tie`` numbered from 0.

    They are numbered inside each input part (``_rid`` holds it), after the sum of the parts
    before, so equal rows are never gathered.
    """
    same = ["nth", "doc_id", "size", "tie"]
    part = rows.withColumn("_part", F.shiftright("_rid", 33))
    inside = Window.partitionBy(*same, "_part")
    part = part.withColumn("_at", F.row_number().over(inside.orderBy("_rid"))).withColumn("_n", F.count("*").over(inside))
    # Only the heads of parts count here, and of those only the ones with company elsewhere.
    heads = part.where("_at = 1").select(*same, "_part", "_n", F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    heads = heads.where("_before > 0").select(*(F.col(c).alias(f"_{c}") for c in same), F.col("_part").alias("_p"), "_before")
    on = F.col("_part") == F.col("_p")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return part.join(heads, on, "left").withColumn("copy", F.coalesce("_before", F.lit(0)) + F.col("_at") - 1).drop("_part", "_at", "_n", "_p", "_before", *(f"_{c}" for c in same))


def _draw(sources: DataFrame, slots: int, n_sources: int, few: bool) -> DataFrame:
    """``shard, slot, nth, pass, block, words`` of every slot of the mix."""
    spark = sources.sparkSession
    # A draw meets the few sources of its part; at most 1024 parts are broadcast.
    width = max(1, -(-slots // max(1024, n_sources)))
    spread = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width)))
    ranges = sources.where("slots > 0").select("nth", "first", "slots", spread.alias("part"))
    ticket = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, slots)))
    draws = spark.range(slots).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), ticket.alias("ticket")).withColumn("part", F.floor(F.col("ticket") / width))
    hit = draws.join(F.broadcast(ranges) if few else ranges, "part").where("ticket >= first and ticket < first + slots")
    counts = hit.groupBy("shard", "nth").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN_ROWS))
    counts = stored(counts, "shard-counts")
    small = sources.select("nth", "blocks", "deficit", "full", "rest", "slots", "short_at")
    small = F.broadcast(small) if few else small
    dealt = _running(counts, "nth", "run", ["shard"], "n", "start").join(small, "nth")
    dealt = dealt.withColumn("n", F.least(F.col("n"), F.col("slots") - F.col("start"))).where("n > 0")
    # What the draws fell short of a source's slots goes to shards after the last.
    drawn = counts.groupBy("nth").agg(F.sum("n").alias("drawn"))
    lack = small.join(drawn, "nth", "left").withColumn("start", F.least(F.coalesce("drawn", F.lit(0)), F.col("slots"))).where("start < slots")
    lack = lack.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("start") - 1) / SHARD_SLOTS))))
    lack = lack.withColumn("start", F.col("start") + F.col("piece") * SHARD_SLOTS).withColumn("n", F.least(F.lit(SHARD_SLOTS), F.col("slots") - F.col("start")))
    cols = ["nth", "shard", "start", "n", "blocks", "deficit", "full", "rest", "short_at"]
    both = dealt.select(cols).unionByName(lack.withColumn("shard", F.col("piece") + -(-slots // SHARD_SLOTS)).select(cols))
    # The counts are few bytes and expand to many rows, so they are dealt out first.
    both = both.repartition(min(65_536, max(1, -(-slots // TASK_SLOTS))), "nth", "start")
    s = both.withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("at", F.pmod("slot", F.col("blocks")))
    s = s.withColumn("block", permuted(F.col("at"), F.col("blocks"), F.col("nth"), F.col("pass")))
    size = F.lit(BLOCK_WORDS) - F.when(F.col("block") == F.col("blocks") - 1, F.col("deficit")).otherwise(F.lit(0))
    before = F.col("at") * BLOCK_WORDS - F.when(F.col("short_at") < F.col("at"), F.col("deficit")).otherwise(F.lit(0))
    cut = F.greatest(F.lit(0), F.least(size, F.col("rest") - before))
    s = s.withColumn("size", size).withColumn("words", F.when(F.col("pass") < F.col("full"), size).otherwise(cut))
    return s.select("shard", "slot", "nth", "pass", "block", "size", "words")


def mix(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan the mix of stored ``_rid, doc_id, source, size, tie`` rows.

    Returns the sources, the slots, and the pieces: for every row and block that it reaches
    into, the part of the row in words (``lo`` to ``hi``), how often the block is taken
    whole (``whole``), and up to where it is taken once more (``cut``).  A row of size zero
    has one piece without a block.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = stored(targets(sizes), "sources")
    n_sources, n_rows, slots = sources.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    few = n_sources <= BROADCAST_SOURCES
    named = sources.select(F.col("source").alias("_s"), "nth")
    own = rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    runs = max(1, -(-n_rows // RUN_ROWS))
    own = _numbered(own).withColumn("run", F.pmod(F.xxhash64("doc_id", "tie", "copy", F.lit(SEED)), F.lit(runs)))
    placed = _running(own, "nth", "run", [F.xxhash64("doc_id", "tie", "copy"), F.col("doc_id"), F.col("size"), F.col("copy")], "size", "at")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / BLOCK_WORDS), F.floor((F.col("at") + F.col("size") - 1) / BLOCK_WORDS)))
    cover = placed.withColumn("block", F.explode_outer(reach))
    drawn = _draw(sources, slots, n_sources, few)
    taken = drawn.groupBy("nth", "block").agg(F.count_if(F.col("words") == F.col("size")).alias("whole"), F.max(F.when(F.col("words") < F.col("size"), F.col("words"))).alias("cut"))
    pieces = cover.join(taken, ["nth", "block"], "left")
    start = F.col("block") * BLOCK_WORDS
    lo, hi = F.greatest("at", start) - F.col("at"), F.least(F.col("at") + F.col("size"), start + BLOCK_WORDS) - F.col("at")
    pieces = pieces.select("_rid", "doc_id", "size", "nth", lo.alias("lo"), hi.alias("hi"), F.coalesce("whole", F.lit(0)).alias("whole"), F.least(hi, F.greatest(lo, start + F.coalesce("cut", F.lit(0)) - F.col("at"))).alias("cut"))
    return sources, drawn, pieces


def _taken() -> Column:
    return F.coalesce((F.col("hi") - F.col("lo")) * F.col("whole") + F.col("cut") - F.col("lo"), F.lit(0))


def stored_sizes(docs: DataFrame) -> DataFrame:
    """``_rid, doc_id, source, size, tie`` of every document, read from its text once."""
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    return stored(rows, "sizes")


def mixed(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken``.

    Null texts have size zero and are never taken; a null source is a source of its own;
    repeated rows are rows of their own.  An empty table, or one without words, takes
    nothing.  The same rows give the same result in any order and partitioning.
    """
    sources, _, pieces = mix(stored_sizes(docs))
    per = pieces.groupBy("_rid", "doc_id", "size", "nth").agg(F.sum(_taken()).cast("long").alias("taken"))
    known = sources.select("nth", "source", F.col("source_size").cast("long").alias("source_size"), "target")
    few = sources.count() <= BROADCAST_SOURCES
    return per.join(F.broadcast(known) if few else known, "nth").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(rows: DataFrame, rid: str) -> DataFrame:
    """The mix itself: ``rows`` (stored, with the unique long ``rid``) as often as they are taken.

    A document taken whole keeps its text to the byte; of one taken in part the words of the
    taken blocks remain, joined by single spaces; words taken twice come in a second row.
    ``n_chars`` follows the text, all other columns stay.  Null and empty texts are never
    taken; repeated rows are rows of their own; an empty table gives an empty one.
    """
    inner = rows.select(column(rid).alias("_rid"), F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(rows.columns))).alias("_row"), F.col("text").alias("_text"), "doc_id", "source")
    sizes = inner.select("_rid", "doc_id", "source", words(F.col("_text")).alias("size"), F.xxhash64("_text").alias("tie"))
    _, _, pieces = mix(stored(sizes, "sizes"))
    once = F.struct(F.col("lo").alias("a"), F.col("cut").alias("b"), (F.col("whole") + 1).alias("times"))
    rest = F.struct(F.col("cut").alias("a"), F.col("hi").alias("b"), F.col("whole").alias("times"))
    parts = pieces.where("hi > lo").groupBy("_rid").agg(F.array_sort(F.flatten(F.collect_list(F.array(once, rest)))).alias("parts"), F.first("size").alias("size"))
    # The two nested parts of one piece are at most block + 1; a row has size / block pieces.
    have = F.explode(F.array(*(F.lit(c) for c in range(1, LIMIT + 1))))
    parts = parts.withColumn("copy", have).withColumn("parts", F.filter("parts", lambda p: (p["times"] >= F.col("copy")) & (p["b"] > p["a"])))
    parts = parts.withColumn("got", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"])).where("got > 0")
    out = inner.select("_rid", "_row", "_text").join(parts, "_rid")
    every = F.filter(F.split("_text", r"[ \t-\r]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("_words"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))), " ")
    whole = F.col("got") == F.col("size")
    out = out.withColumn("_words", F.when(~whole, every)).withColumn("_text", F.when(whole, F.col("_text")).otherwise(cut))
    kinds = dict(rows.dtypes)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(kinds.get("n_chars", "long"))}
    return out.select([new.get(c, F.col("_row").getField(f"c{i}")).alias(c) for i, c in enumerate(rows.columns) if c != rid])
