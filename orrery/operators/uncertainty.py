"""How sure a metric is: rank agreement, calibration slope, bootstrap intervals, readiness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import logit, sigmoid
from ..shared import stored
from .running import by_risk, day_run, running

MODULUS = 2**31 - 1
#: Chances that a Poisson(1) count is at most 0, 1, 2, ...
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(7)]


def uniform(key: Column, rep: Column) -> Column:
    """A repeatable number in [0, 1) for a whole key and a replication, in whole arithmetic."""
    m = F.lit(MODULUS)
    h = F.pmod(F.pmod(key.cast("long"), m) * 48271 + rep.cast("long") * 69621 + 11, m)
    return F.pmod(F.pmod(h * h + 7, m) * 16807, m) / m


def inversions(rows: DataFrame, cell: list[str], a: str, b: str) -> DataFrame:
    """Pairs of a cell that ``a`` and ``b`` order in opposite ways, without forming pairs.

    Two rows differ first at one bit of the rank of ``b``; among rows that agree above that
    bit, each zero counts the ones before it in the order of ``a``.  That is one row for
    each row and bit, and one window.
    """
    r = rows.select(*cell, F.col(a).alias("_a"), F.dense_rank().over(Window.partitionBy(*cell).orderBy(b)).cast("long").alias("_b"))
    r = r.withColumn("_bits", F.length(F.bin(F.max("_b").over(Window.partitionBy(*cell)))))
    r = r.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    r = r.withColumn("_above", F.expr("shiftright(_b, _level + 1)")).withColumn("_one", F.expr("shiftright(_b, _level) & 1"))
    before = Window.partitionBy(*cell, "_level", "_above").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_ones", F.coalesce(F.sum("_one").over(before), F.lit(0)))
    return r.groupBy(*cell).agg(F.sum(F.when(F.col("_one") == 0, F.col("_ones")).otherwise(0)).alias("inversions"))


def rank_agreement(rows: DataFrame, cell: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b, inversions and new ties between two scores; rows with a null go.

    Tau is null where either score is constant.
    """
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = lambda n: n * (n - 1) / 2
    tied = lambda name, *by: rows.groupBy(*cell, *by).count().groupBy(*cell).agg(F.sum(pairs(F.col("count"))).alias(name), F.count("*").alias(f"d_{name}"))
    g = rows.groupBy(*cell).agg(pairs(F.count("*")).alias("n0"))
    for other in (tied("n1", a), tied("n2", b), tied("n3", a, b), inversions(rows, cell, a, b)):
        g = g.join(other, cell)
    tau = (F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("inversions")) / F.sqrt(F.nullif((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")), F.lit(0.0)))
    return g.select(*cell, tau.alias("tau_b"), "inversions", F.greatest(F.lit(0), F.col("d_n1") - F.col("d_n2")).alias("new_ties"))


def calibration_slope(rows: DataFrame, cell: list[str], steps: int = 8) -> DataFrame:
    """Intercept and slope of the label on the logit of the score, by Newton steps.

    All cells step together: a step is one map-side combined aggregate over the stored rows.
    Null where the Hessian is singular.
    """
    data = stored(rows.select(*cell, logit(F.col("score")).alias("z"), F.col("label").cast("double").alias("y")), "logits")
    at = data.select(*cell).distinct().withColumns({"intercept": F.lit(0.0), "slope": F.lit(0.0)})
    for _ in range(steps):
        p = data.join(at, cell).withColumn("p", sigmoid(F.col("intercept") + F.col("slope") * F.col("z"))).withColumn("w", F.expr("p * (1 - p)"))
        s = p.groupBy(*cell).agg(
            *(F.first(c).alias(c) for c in ("intercept", "slope")),
            F.sum("w").alias("a"), F.sum(F.expr("w * z")).alias("b"), F.sum(F.expr("w * z * z")).alias("c"), F.sum(F.expr("y - p")).alias("g"), F.sum(F.expr("(y - p) * z")).alias("h"),
        )
        at = s.select(*cell, F.expr("intercept + (c * g - b * h) / nullif(a * c - b * b, 0)").alias("intercept"), F.expr("slope + (a * h - b * g) / nullif(a * c - b * b, 0)").alias("slope"))
    return at


def bootstrap_brier(rows: DataFrame, cell: list[str], schemes: dict[str, str], replications: int = 1000, level: float = 0.95, most_degenerate: float = 0.05) -> DataFrame:
    """Percentile intervals of the Brier score; each scheme names the column it resamples by.

    A key enters a replication Poisson(1) times, so replications need no gathering: they are
    counts of a map-side combined aggregate.  Draws without both classes are left out; above
    ``most_degenerate`` of them the interval is null.
    """
    drawn = F.explode(F.sequence(F.lit(1), F.lit(replications)))
    scheme = F.explode(F.array(*(F.struct(F.lit(n).alias("scheme"), F.col(c).cast("long").alias("key")) for n, c in schemes.items())))
    r = rows.select(*cell, "label", F.expr("(score - label) * (score - label)").alias("loss"), scheme.alias("s")).select("*", "s.*", drawn.alias("rep"))
    u = uniform(F.col("key"), F.col("rep"))
    r = r.withColumn("u", u).withColumn("w", sum((F.when(F.col("u") >= t, 1).otherwise(0) for t in POISSON), F.lit(0)))
    d = r.groupBy(*cell, "scheme", "rep").agg(F.sum("w").alias("n"), F.sum(F.expr("w * label")).alias("pos"), F.sum(F.expr("w * loss")).alias("loss"))
    d = d.withColumn("brier", F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("loss") / F.col("n")))
    g = d.groupBy(*cell, "scheme").agg(F.count_if(F.col("brier").isNull()).alias("degenerate"), *(F.percentile("brier", q).alias(n) for n, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))))
    known = F.col("degenerate") <= most_degenerate * replications
    return g.withColumns({c: F.when(known, F.col(c)) for c in ("low", "high")})


def approval_checks(plan: DataFrame, cell: list[str]) -> DataFrame:
    """Violations of the checks that block an approval, and the status, of every plan.

    ``plan`` has ``id, final_rank, mechanism, area, decision, reason``, one row a place.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    g = plan.groupBy(*cell).agg(
        F.count("*").alias("n_rows"),
        F.count("decision").alias("n_decided"),
        (F.count("*") - F.countDistinct("id")).alias("n_repeated"),
        F.count_if(F.col("final_rank").isNull() | F.col("mechanism").isNull()).alias("n_unranked"),
        F.count_if(F.col("area").isNull()).alias("n_unplaced"),
        F.count_if(F.col("decision").isNotNull() & empty("reason")).alias("n_unexplained"),
    )
    status = F.when(F.col("n_decided") == 0, "draft").when(F.col("n_decided") >= F.col("n_rows"), "adjusted").otherwise("under_supervisor_review")
    return g.withColumn("ready", F.expr("n_repeated + n_unranked + n_unplaced + n_unexplained = 0")).withColumn("status", status)


def month_effects(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell and month: the mean log odds over the year's, weighted by rows."""
    r = rows.withColumn("_y", F.year("d")).withColumn("month", F.month("d"))
    m = r.groupBy(*cell, "_y", "month").agg(F.count("*").alias("n"), logit(F.avg("label")).alias("lm"))
    y = r.groupBy(*cell, "_y").agg(logit(F.avg("label")).alias("ly"))
    return m.join(y, [*cell, "_y"]).groupBy(*cell, "month").agg((F.sum(F.col("n") * (F.col("lm") - F.col("ly"))) / F.sum("n")).alias("effect"))


def label_redraw(rows: DataFrame, effects: DataFrame, cell: list[str], reps: int) -> DataFrame:
    """``p05, p50, p95`` of the discovery efficiency of the risk order, and the rate of labels that
    change, when every label is drawn anew for the date that the order gives its row.

    A row's own number keeps its label at its real date: below the real probability for a
    positive, above it otherwise; the label at the new date compares that number with the new
    probability.  Numbers are a repeatable hash of id and replication.
    """
    ranked = by_risk(rows.select(*cell, "id", "d", "label", "score"), cell)
    slots = running(rows.select(*cell, "d", "id"), cell, day_run("d"), [F.asc("d"), F.asc("id")], {}).select(*cell, "pos", F.col("d").alias("slot"))
    base = rows.groupBy(*cell).agg(logit(F.avg("label")).alias("_z"))
    at = lambda name, day: effects.select(*cell, F.col("month").alias(f"_{name}"), F.col("effect").alias(name)).withColumnRenamed(f"_{name}", f"_m_{day}")
    p = ranked.join(slots, [*cell, "pos"]).join(base, cell).withColumn("_m_d", F.month("d")).withColumn("_m_slot", F.month("slot"))
    p = p.join(at("_real", "d"), [*cell, "_m_d"], "left").join(at("_sim", "slot"), [*cell, "_m_slot"], "left")
    real, sim = (1 / (1 + F.exp(-(F.col("_z") + F.coalesce(c, F.lit(0.0))))) for c in ("_real", "_sim"))
    p = stored(p.select(*cell, "id", "label", "pos", real.alias("p_real"), sim.alias("p_sim")), "redraw")
    u = uniform(F.col("id"), F.col("rep"))
    d = p.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_u", u)
    drawn = F.when(F.col("label") == 1, F.col("_u") * F.col("p_real")).otherwise(F.col("p_real") + F.col("_u") * (1 - F.col("p_real"))) < F.col("p_sim")
    d = d.withColumn("drawn", drawn.cast("int"))
    # Positions are the same in every replication, so their grid deals the rows.
    each = [*cell, "rep"]
    cum = running(d, each, F.floor(F.col("pos") / 4096), [F.asc("pos")], {"cum": F.col("drawn")}, "_at")
    g = cum.groupBy(*each).agg(F.count("*").alias("n"), F.sum("drawn").alias("p"), F.sum(2 * F.col("cum") - F.col("drawn")).alias("t"), F.count_if(F.col("drawn") != F.col("label")).alias("flips"))
    nde = F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("t") / (2.0 * F.col("n") * F.col("p")) - 0.5) / (0.5 - F.col("p") / (2.0 * F.col("n"))))
    g = g.withColumn("nde", nde)
    return g.groupBy(*cell).agg(F.percentile("nde", F.lit(0.05)).alias("p05"), F.percentile("nde", F.lit(0.5)).alias("p50"), F.percentile("nde", F.lit(0.95)).alias("p95"), (F.sum("flips") / F.sum("n")).alias("flip_rate"))
