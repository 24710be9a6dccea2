"""Window functions on series: (keys..., order column, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_order(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def first_difference(series: DataFrame, keys: list[str], order: str = "k", value: str = "value") -> DataFrame:
    """x - previous x; the first is 0."""
    return series.withColumn(value, F.coalesce(F.col(value) - F.lag(value).over(_in_order(keys, order)), F.lit(0.0)))


def running_mean(series: DataFrame, n: int, keys: list[str], order: str = "k", value: str = "value") -> DataFrame:
    """Means of n consecutive values, where there are as many."""
    w = _in_order(keys, order)
    return series.withColumns({value: F.avg(value).over(w.rowsBetween(1 - n, 0)), "_n": F.row_number().over(w)}).where(F.col("_n") >= n).drop("_n")


def derivative(series: DataFrame, keys: list[str], x: str = "t", value: str = "value") -> DataFrame:
    """Central differences at interior points."""
    w = _in_order(keys, x)
    slope = (F.lead(value).over(w) - F.lag(value).over(w)) / (F.lead(x).over(w) - F.lag(x).over(w))
    return series.withColumn("slope", slope).where("slope is not null")


def integral(series: DataFrame, keys: list[str], x: str = "t", value: str = "value") -> DataFrame:
    """Trapezoid integral of each series; pass a segment key to integrate by segment, boundaries unshared."""
    w = _in_order(keys, x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return series.withColumn("_part", part).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("integral"))


def min_max_scaled(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return series.withColumn(value, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def percentile_mask(series: DataFrame, q: float, keys: list[str], value: str = "value") -> DataFrame:
    """1 where a value is at or above the exact q-th percentile (0-100) of its series."""
    cut = series.groupBy(*keys).agg(F.expr(f"percentile({value}, {q / 100!r})").alias("_cut"))
    return series.join(cut, keys).withColumn("mask", (F.col(value) >= F.col("_cut")).cast("int")).drop("_cut")


def label_changes(labels: DataFrame, keys: list[str], order: str = "k", label: str = "label") -> DataFrame:
    """1 where a label differs from the one before; the first is 0."""
    before = F.lag(label).over(_in_order(keys, order))
    return labels.withColumn("change", F.when(before.isNotNull() & (F.col(label) != before), 1).otherwise(0))


def dilated_changes(changes: DataFrame, tolerance: int, keys: list[str], order: str = "k", reach: int | None = None) -> DataFrame:
    """Changes spread to both sides by ``reach``, by default tolerance (tolerance + 1) / 2."""
    reach = tolerance * (tolerance + 1) // 2 if reach is None else reach
    near = F.max("change").over(_in_order(keys, order).rowsBetween(-reach, reach))
    return changes.withColumn("change", near)


def top_positions(series: DataFrame, n: int | str, keys: list[str], order: str = "k", value: str = "value") -> DataFrame:
    """The n greatest values of each series (n: number or column); of equal ones the later."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.desc(order)))
    return series.withColumn("_rank", rank).where(F.col("_rank") <= (F.col(n) if isinstance(n, str) else F.lit(n))).drop("_rank")


def pairs_within(items: DataFrame, reach: int, keys: list[str], order: str = "k") -> DataFrame:
    """(keys..., k, k_before): each index with the ``reach`` ones before it, by exploding offsets."""
    after = items.select(*keys, F.col(order).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d")).withColumn("k_before", F.col("k") - F.col("_d"))
    return after.join(items.select(*keys, F.col(order).alias("k_before")), [*keys, "k_before"]).select(*keys, "k", "k_before")


def mean_distance_before(cells: DataFrame, indices: DataFrame, reach: int, keys: list[str], difference: bool = False) -> DataFrame:
    """Mean Frobenius distance |A - B|^2 / (|A| |B|) of each matrix to the ``reach`` before it.

    cells: (keys..., k, i, j, v); indices: (keys..., k) of all matrices, empty ones too.  A pair's
    distance comes from both norms and the inner product, so the join is on shared cells only.
    """
    norms = indices.join(cells.groupBy(*keys, "k").agg(F.sum(F.col("v") * F.col("v")).alias("s")), [*keys, "k"], "left").select(*keys, "k", F.coalesce("s", F.lit(0.0)).alias("s"))
    pairs = pairs_within(indices, reach, keys)
    later = cells.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"), F.col("k"), "i", "j", F.col("v").alias("_a")).withColumn("k_before", F.col("k") - F.col("_d"))
    inner = later.join(cells.select(*keys, F.col("k").alias("k_before"), "i", "j", F.col("v").alias("_b")), [*keys, "k_before", "i", "j"]).groupBy(*keys, "k", "k_before").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))
    joined = (
        pairs.join(inner, [*keys, "k", "k_before"], "left")
        .join(norms.withColumnRenamed("s", "_x"), [*keys, "k"])
        .join(norms.select(*keys, F.col("k").alias("k_before"), F.col("s").alias("_y")), [*keys, "k_before"])
    )
    square = F.col("_x") + F.col("_y") - 2 * F.coalesce("dot", F.lit(0.0))
    below = F.sqrt(F.col("_x") * F.col("_y"))
    distance = F.when(below > 0, square / below).when(square > 0, float("inf")).otherwise(float("nan"))
    means = joined.groupBy(*keys, "k").agg(F.avg(distance).alias("value"), F.count("*").alias("_n")).where(F.col("_n") == reach).drop("_n")
    if not difference:
        return means
    before = F.lag("value").over(_in_order(keys, "k"))
    return means.withColumn("value", F.abs(F.col("value") - before)).where("value is not null")
