"""Models and calibration fitted fold by fold: train, then the calibration quarter, then test.

A fit reads only rows of its own split, and all folds are fitted together: a Newton step is one
map-side combined aggregate over the stored rows, which sends the driver a small matrix a fold.
Rows of the test quarter are scored and never read by a fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import interpolate, logit, sigmoid
from ..shared import stored
from .ranking import pr_auc
from .running import score_run

#: Clamp of the probabilities that are calibrated.
CLAMP = 1e-15
#: Newton steps, and the change below which a fit counts as converged.
STEPS, CONVERGED = 25, 1e-8
MARGIN = 0.005
#: Runs of the grid over scores that are pooled in one call of Python.
RUNS_POOLED = 16


class NotConverged(RuntimeError):
    """A fit whose last step still moved."""


def newton(rows: DataFrame, cell: str, columns: list[str], ridge: float = 0.0, steps: int = STEPS) -> dict[object, np.ndarray]:
    """Intercept and coefficients of a logistic regression for every cell, by Newton steps.

    ``rows``: cell, label, columns.  ``ridge`` is the L2 price of the coefficients (1 / C), not of
    the intercept.  A cell with one label only, or a singular step, has nulls.  Raises
    ``NotConverged`` if a cell still moves at the last step.
    """
    rows = stored(rows.select(cell, F.col("label").cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)), "fit")
    width = len(columns) + 1
    x = [F.lit(1.0), *(F.col(c) for c in columns)]
    spread = {r[0]: r[1] for r in rows.groupBy(cell).agg(F.countDistinct("_y")).collect()}
    beta = {k: np.zeros(width) for k, n in spread.items() if n == 2}
    moved = dict.fromkeys(beta, np.inf)
    spark = rows.sparkSession
    for _ in range(steps):
        if not any(m > CONVERGED for m in moved.values()):
            break
        now = spark.createDataFrame([(k, [float(v) for v in b]) for k, b in beta.items()], f"{cell} {dict(rows.dtypes)[cell]}, _b array<double>")
        z = sum((F.col("_b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
        r = rows.join(F.broadcast(now), cell).withColumn("_p", sigmoid(z))  # a row a fold
        w = F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum((F.col("_y") - F.col("_p")) * c).alias(f"g{i}") for i, c in enumerate(x)]
        sums += [F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(width) for j in range(i, width)]
        for row in r.groupBy(cell).agg(*sums).collect():
            k = row[cell]
            g, h = np.array([row[f"g{i}"] for i in range(width)]), np.zeros((width, width))
            for i in range(width):
                for j in range(i, width):
                    h[i, j] = h[j, i] = row[f"h{i}_{j}"]
            price = np.full(width, ridge)
            price[0] = 0.0
            try:
                step = np.linalg.solve(h + np.diag(price), g - price * beta[k])
            except np.linalg.LinAlgError:
                step = np.full(width, np.nan)
            beta[k] = beta[k] + step
            moved[k] = float(np.abs(step).max())
        for k in [k for k, b in beta.items() if not np.isfinite(b).all()]:
            del beta[k], moved[k]
    if any(m > CONVERGED for m in moved.values()):
        raise NotConverged(f"{[k for k, m in moved.items() if m > CONVERGED]}")
    return {k: beta.get(k, np.full(width, np.nan)) for k in spread}


def _table(spark, cell: str, kind: str, beta: dict, names: list[str]) -> DataFrame:
    rows = [(k, *(None if np.isnan(v) else float(v) for v in b)) for k, b in beta.items()]
    return spark.createDataFrame(rows, f"{cell} {kind}, " + ", ".join(f"{n} double" for n in names))


def platt(calibration: DataFrame, rows: DataFrame, cell: str) -> DataFrame:
    """``rows`` with ``calibrated``: a logistic on the log odds of the score, unpenalised, fitted on
    the calibration rows of the same cell; the score itself where that has one label only."""
    z = lambda df: df.withColumn("_z", logit(F.col("score"), CLAMP))
    beta = newton(z(calibration), cell, ["_z"])
    fits = _table(rows.sparkSession, cell, dict(rows.dtypes)[cell], beta, ["_i", "_s"])
    out = z(rows).join(F.broadcast(fits), cell, "left")
    return out.withColumn("calibrated", F.coalesce(sigmoid(F.col("_i") + F.col("_s") * F.col("_z")), F.col("score"))).drop("_z", "_i", "_s")


def _pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators: blocks of [first x, last x, mean, weight] with rising means."""
    out: list[list[float]] = []
    for a, b, m, n in zip(x[:, 0], x[:, 1], y, w):
        out.append([a, b, m, n])
        while len(out) > 1 and out[-2][2] >= out[-1][2]:
            a2, b2, m2, n2 = out.pop()
            top = out[-1]
            out[-1] = [top[0], b2, (top[2] * top[3] + m2 * n2) / (top[3] + n2), top[3] + n2]
    return out


def isotonic_fit(calibration: DataFrame, cell: str) -> DataFrame:
    """Break points ``cell, px, py`` of the monotone fit: both ends of every pooled block.

    Equal scores are one point.  Violators are pooled run by run, and the blocks of all runs are
    pooled once more, which gives the fit of the whole: a cell is spread over its runs, and what
    meets at last are blocks, not rows.
    """
    kind = dict(calibration.dtypes)[cell]
    points = calibration.where("score is not null").groupBy(cell, "score").agg(F.avg("label").alias("y"), F.count("*").cast("double").alias("w"))
    points = points.select(cell, F.floor(score_run("score", falling=False) / RUNS_POOLED).alias("run"), F.col("score").alias("a"), F.col("score").alias("b"), "y", "w")
    schema = f"{cell} {kind}, a double, b double, y double, w double"

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        blocks = _pooled(pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        out = pd.DataFrame(blocks, columns=["a", "b", "y", "w"])
        out.insert(0, cell, pdf[cell].iloc[0])
        return out

    blocks = points.groupBy(cell, "run").applyInPandas(pool, schema).groupBy(cell).applyInPandas(pool, schema)
    ends = F.explode(F.array_distinct(F.array(F.col("a"), F.col("b"))))
    return blocks.select(cell, ends.alias("px"), F.col("y").alias("py"))


def isotonic(calibration: DataFrame, rows: DataFrame, cell: str) -> DataFrame:
    """``rows`` with ``calibrated``: the monotone fit of the calibration rows of the same cell,
    linear between break points and level outside; null where the cell has no calibration rows."""
    fit = isotonic_fit(calibration, cell).withColumnRenamed(cell, "cell")
    return interpolate(rows.withColumn("cell", F.col(cell)), fit, "score").withColumnRenamed("value", "calibrated").drop("cell")


def log_loss(rows: DataFrame, cell: str, p: str, name: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(CLAMP)), F.lit(1 - CLAMP))
    return rows.groupBy(cell).agg(F.avg(-(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))).alias(name))


def method_choice(losses: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Per fold, isotonic only if its mean log loss over earlier folds is lower by the margin."""
    w = Window.orderBy("fold_id").partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    out = losses.withColumn("mp", F.avg("platt_loss").over(w)).withColumn("mi", F.avg("isotonic_loss").over(w))
    return out.select("fold_id", F.when(F.col("mp") - F.col("mi") > margin, "isotonic").otherwise("platt").alias("method"))


def preprocessed(rows: DataFrame, cell: str, columns: list[str], families: dict[str, str], flags: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns ready for a fit, by what the training rows of each cell say.

    ``rows`` carry ``split``.  A family's indicator is 1 where its column is null; null numbers
    become the training median, null flags false, and numbers are centred and scaled by the
    population sd of training (1 where that is zero).
    """
    train = rows.where("split = 'train'")
    medians = train.groupBy(cell).agg(*(F.median(c).alias(f"_med_{c}") for c in columns))
    full = rows.join(F.broadcast(medians), cell)
    full = full.withColumns({f"is_null_{n}": F.col(c).isNull().cast("double") for n, c in families.items()})
    full = full.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), F.lit(0.0)) for c in columns}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags})
    stats = full.where("split = 'train'").groupBy(cell).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    full = full.join(F.broadcast(stats), cell)
    full = full.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    used = [*columns, *flags, *(f"is_null_{n}" for n in families)]
    return full.drop(*(c for c in full.columns if c.startswith(("_med_", "_m_", "_s_")))), used


def logistic(rows: DataFrame, cell: str, columns: list[str], families: dict[str, str], flags: list[str], c: float = 1.0) -> DataFrame:
    """``cell, id, label, score`` of the test rows: L2 logistic of strength ``c``, fitted on the
    training rows of each cell."""
    data, used = preprocessed(rows, cell, columns, families, flags)
    data = stored(data.select(cell, "id", "label", "split", *used), "preprocessed")
    beta = newton(data.where("split = 'train'"), cell, used, 1.0 / c)
    fits = _table(rows.sparkSession, cell, dict(rows.dtypes)[cell], beta, ["_i", *(f"_b_{u}" for u in used)])
    test = data.where("split = 'test'").join(F.broadcast(fits), cell)
    return test.select(cell, "id", "label", sigmoid(sum((F.col(f"_b_{u}") * F.col(u) for u in used), F.col("_i"))).alias("score"))


def boosted_model(train: DataFrame, used: list[str], rounds: int = 10):
    """Gradient-boosted trees of Spark's own, both labels weighted so that they count the same."""
    n, p = train.agg(F.count("*"), F.sum("label")).first()
    weighted = train.withColumn("_w", F.when(F.col("label") == 1, n / (2.0 * max(p or 0, 1))).otherwise(n / (2.0 * max(n - (p or 0), 1))))
    data = VectorAssembler(inputCols=used, outputCol="_x").transform(weighted)
    return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=rounds, maxDepth=3, seed=1).fit(data)


def boosted(rows: DataFrame, cell: str, columns: list[str], families: dict[str, str], flags: list[str], rounds: int = 10) -> DataFrame:
    """``cell, id, label, score`` of the test rows of one cell: gradient-boosted trees fitted on its
    training rows, weighted so that both labels count the same; the algorithm is Spark's own."""
    data, used = preprocessed(rows, cell, columns, families, flags)
    data = data.select(cell, "id", "label", "split", *used)
    model = boosted_model(data.where("split = 'train'"), used, rounds)
    test = VectorAssembler(inputCols=used, outputCol="_x").transform(data.where("split = 'test'"))
    return model.transform(test).withColumn("score", vector_to_array("probability")[1]).select(cell, "id", "label", "score")


#: Mean scores this near count as equal.
TIED = 1e-6


def choose_rate(scores: DataFrame, baseline: float) -> DataFrame:
    """``rate, mean_score, n_tied`` of the best rate of ``scores`` (rate, fold, score).

    Rates whose mean is within ``TIED`` of the best are equal; the one nearest to the baseline wins,
    then the smaller one.  Rates are a grid of a few.
    """
    m = scores.groupBy("rate").agg(F.avg("score").alias("mean_score")).withColumn("_best", F.max("mean_score").over(Window.partitionBy(F.lit(0))))
    tied = m.where(F.col("_best") - F.col("mean_score") <= TIED).withColumn("_off", F.abs(F.col("rate") - baseline))
    return tied.agg(F.min_by(F.struct("rate", "mean_score"), F.struct("_off", "rate")).alias("r"), F.count("*").alias("n_tied")).where("r is not null").select("r.*", "n_tied")


def penalty_sweep(rows: DataFrame, columns: list[str], families: dict[str, str], flags: list[str], grid: list[float]) -> DataFrame:
    """``rate, fold_id, score``: PR-AUC on each inner fold's held-out rows of a logistic model of
    every strength of the grid.  ``rows`` carry fold_id and split, train or test, of inner folds."""
    out = None
    for rate in grid:
        s = pr_auc(logistic(rows, "fold_id", columns, families, flags, rate), ["fold_id"]).select(F.lit(rate).alias("rate"), "fold_id", F.col("pr_auc").alias("score"))
        out = s if out is None else out.unionByName(s)
    return out
