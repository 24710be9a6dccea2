"""Scores of detected change points and choice of parameters.

truth: (sample_id, bkp); found: (keys..., sample_id, pred), keys being a detector's parameters;
runs: (keys..., sample_id) of everything evaluated, since a run may find nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(points: DataFrame, others: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Distance of each point x to the nearest y with equal ``by``; null if there is none.

    One running pass over both sides in each direction, so many points in a group cost no
    product of them.
    """
    from pyspark.sql import Window

    both = points.select(*by, F.col(x).alias("_p"), F.lit(1).alias("_q")).unionByName(others.select(*by, F.col(y).alias("_p"), F.lit(0).alias("_q")))
    running = lambda *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    other = F.when(F.col("_q") == 0, F.col("_p"))
    down = F.last(other, ignorenulls=True).over(running("_p", "_q"))
    up = F.last(other, ignorenulls=True).over(running(F.desc("_p"), "_q"))
    gap = F.least(F.col("_p") - F.col("_down"), F.col("_up") - F.col("_p"))
    return both.withColumns({"_down": down, "_up": up}).where("_q = 1").select(*by, F.col("_p").alias(x), gap.alias("distance"))


def evaluate(runs: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str], margin: float, max_error: float | None = None) -> DataFrame:
    """tp, precision, recall, f1 and Hausdorff distance of each run.

    A true point counts if a found one is nearer than margin; precision is over found points, so
    it may exceed 1.  Points are sets: of equal ones (events at one time, times in one bin) one
    counts.  Hausdorff: both empty 0, one empty max_error or infinity; at most max_error.
    """
    if max_error is not None and max_error < 0:
        raise ValueError("max_error is negative")
    by = [*keys, "sample_id"]
    true_side = runs.select(*by).join(truth.select("sample_id", "bkp").distinct(), "sample_id")
    found = found.select(*by, "pred").distinct()
    to_found = nearest(true_side, found, by, "bkp", "pred")
    to_true = nearest(found, true_side, by, "pred", "bkp")
    a = to_found.groupBy(*by).agg(F.count("*").alias("n_true"), F.sum(F.when(F.col("distance") < margin, 1).otherwise(0)).alias("tp"), F.max("distance").alias("_a"))
    b = to_true.groupBy(*by).agg(F.count("*").alias("n_found"), F.max("distance").alias("_b"))
    joined = runs.select(*by).join(a, by, "left").join(b, by, "left").fillna(0, ["n_true", "n_found", "tp"])
    p = F.when(F.col("n_found") > 0, F.col("tp") / F.col("n_found")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    far = F.lit(float("inf") if max_error is None else float(max_error))
    hausdorff = F.when((F.col("n_true") == 0) & (F.col("n_found") == 0), 0.0).when((F.col("n_true") == 0) | (F.col("n_found") == 0), far).otherwise(F.least(F.greatest("_a", "_b"), far))
    scored = joined.withColumns({"precision": p, "recall": r, "hausdorff": hausdorff})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return scored.select(*by, "n_true", "n_found", "tp", "precision", "recall", f1.alias("f1"), "hausdorff")


def mean_scores(scores: DataFrame, keys: list[str], cap: float | None = None) -> DataFrame:
    """Mean F1 and Hausdorff over samples; capped where a scale is wanted."""
    h = F.col("hausdorff") if cap is None else F.least("hausdorff", F.lit(float(cap)))
    return scores.groupBy(*keys).agg(F.avg("f1").alias("mean_f1"), F.avg(h).alias("mean_hausdorff"))


def best(means: DataFrame, order: list[str], by: str = "mean_f1", greatest: bool = True) -> DataFrame:
    """The row of the best score; NaN never wins; ties go to the first by ``order``."""
    return means.where(~F.isnan(by)).orderBy(F.desc(by) if greatest else F.asc(by), *order).limit(1)


def select_rate(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rate of least finite mean variation, else of best stability, ties to the least rate.

    results: (keys..., lamda, avg_nvi, best_stability).
    """
    finite = F.col("avg_nvi").isNotNull() & ~F.isnan("avg_nvi") & (F.abs("avg_nvi") < float("inf"))
    by_variation = F.min_by("lamda", F.when(finite, F.struct("avg_nvi", "lamda")))
    by_stability = F.min_by("lamda", F.struct((-F.col("best_stability")).alias("s"), "lamda"))
    return results.groupBy(*keys).agg(F.coalesce(by_variation, by_stability).alias("lamda"))


def best_result(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rate of greatest stability; ties to the least rate."""
    return results.groupBy(*keys).agg(F.min_by("lamda", F.struct((-F.col("best_stability")).alias("s"), "lamda")).alias("lamda"), F.max("best_stability").alias("best_stability"))


def nearest_rate(rates: DataFrame, wanted: float, tolerance: float = 1e-2) -> DataFrame:
    """The rate nearest to the wanted one, if it is within the relative tolerance."""
    return rates.where(F.abs(F.col("lamda") - wanted) <= tolerance * abs(wanted)).orderBy(F.abs(F.col("lamda") - wanted), "lamda").limit(1)


def same_rate(rates: DataFrame, wanted: float) -> DataFrame:
    """Rates equal to the wanted one up to rounding."""
    return rates.where(F.abs(F.col("lamda") - wanted) <= 1e-8 + 1e-5 * abs(wanted))


def hausdorff_cap(scores: DataFrame) -> DataFrame:
    """1.1 times the greatest finite distance, and whether there are infinite ones."""
    infinite = F.col("hausdorff") == float("inf")
    return scores.agg((F.max(F.when(~infinite & ~F.isnan("hausdorff"), F.col("hausdorff"))) * 1.1).alias("cap"), F.bool_or(infinite).alias("any_infinite"))


def clipped(scores: DataFrame, cap: float, value: str = "hausdorff") -> DataFrame:
    """NaN out, infinities to cap or 0, negatives to 0."""
    x = F.col(value)
    return scores.where(~F.isnan(value)).withColumn(value, F.when(x == float("inf"), cap).when(x < 0, 0.0).otherwise(x))
