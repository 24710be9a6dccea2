"""Whole workflows: signals, parameter search, test evaluation, interval clustering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, detection, graph, intervals, scores, series, transitions
from ..sources.events import node_counts
from ..sources.storage import kept as _kept
from . import windows


def prepare(events: DataFrame, n_nodes: DataFrame | None = None, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(grid, intervals): the time grid and one packed row an interval."""
    events = intervals.merge_overlaps(events) if merge else events
    grid = intervals.time_grid(events)
    return grid, transitions.packed(intervals.interval_edges(events, merged=merge), grid, node_counts(events) if n_nodes is None else n_nodes)


def window_plans(grid: DataFrame, widths: Sequence[float], fraction: float = 1.0) -> DataFrame:
    """Centred plans of several widths, sampled if fraction is below 1."""
    parts = []
    for w in widths:
        plan = windows.centered(grid, w)
        plan = windows.sampled(plan, fraction) if fraction < 1 else plan
        parts.append(plan.withColumn("window", F.lit(float(w))))
    return reduce(DataFrame.unionByName, parts)


def entropy_signals(events: DataFrame, rates: Sequence[float], widths: Sequence[float], fraction: float = 1.0, backend: str = "sliding", reverse: bool = False) -> DataFrame:
    grid, packed = prepare(events)
    return transitions.window_entropy(packed, window_plans(grid, widths, fraction), rates, backend, reverse=reverse)


def grid_search(signals: DataFrame, truth: DataFrame, n_bkps: DataFrame, keys: list[str], margin: float, by: str = "mean_hausdorff", cap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(means, best): scores of each parameter combination and the best one.

    signals: (sample_id, keys..., k, t, value).
    """
    series_keys = ["sample_id", *keys]
    # read several times and dear to make; kept tables have short plans, which the driver holds for each mention
    signals = _kept(signals)
    found = _kept(detection.detect(signals, n_bkps, series_keys))
    means = scores.mean_scores(scores.evaluate(signals.select(*series_keys).distinct(), truth, found, keys, margin), keys, cap)
    return means, scores.best(means, keys, by, greatest=by == "mean_f1")


def penalty_search(signals: DataFrame, truth: DataFrame, penalties: Sequence[float], keys: list[str], margin: float, by: str = "mean_hausdorff") -> tuple[DataFrame, DataFrame]:
    """The same with a penalty as a further parameter."""
    spark, signals = signals.sparkSession, _kept(signals)
    found = _kept(detection.detect_penalized(signals, penalties, ["sample_id", *keys]))
    runs = signals.select("sample_id", *keys).distinct().join(F.broadcast(spark.createDataFrame([(float(p),) for p in penalties], "penalty double")))
    all_keys = [*keys, "penalty"]
    means = scores.mean_scores(scores.evaluate(runs, truth, found, all_keys, margin), all_keys)
    return means, scores.best(means, all_keys, by, greatest=by == "mean_f1")


def test_evaluation(signals: DataFrame, best: DataFrame, truth: DataFrame, n_bkps: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """Per-sample scores of the best parameters on other samples."""
    best = _kept(best.select(*keys))  # one row, and the whole search as its plan
    chosen = _kept(signals.join(F.broadcast(best), keys))
    found = _kept(detection.detect(chosen, n_bkps, ["sample_id", *keys]))
    return scores.evaluate(chosen.select("sample_id", *keys).distinct(), truth, found, keys, margin)


def frobenius_signals(cells: DataFrame, bins: DataFrame, widths: Sequence[int], difference: bool = False) -> DataFrame:
    """(sample_id, window_length, k, t, value) of the Frobenius baseline; cells of snapshots with i < j."""
    weighted = cells if "v" in cells.columns else cells.withColumn("v", F.lit(1.0))
    named, index = weighted.withColumnRenamed("bin", "k"), bins.withColumnRenamed("bin", "k")
    parts = [series.mean_distance_before(named, index, w, ["sample_id"], difference).withColumn("window_length", F.lit(w)) for w in widths]
    return reduce(DataFrame.unionByName, parts).select("sample_id", "window_length", "k", F.col("k").cast("double").alias("t"), "value")


def spectrum_signals(snapshots: DataFrame, n_eigens: Sequence[int], widths: Sequence[int], scale: float | None = None) -> DataFrame:
    """(sample_id, n_eigen, window_length, k, t, value) of the Laplacian spectrum baseline."""
    parts = []
    for n in n_eigens:
        signatures = detection.laplacian_signatures(snapshots, n)
        for w in widths:
            signal = detection.spectrum_signal(signatures, w, detection.second_window(w, scale))
            parts.append(signal.select("sample_id", F.lit(n).alias("n_eigen"), F.lit(w).alias("window_length"), F.col("bin").alias("k"), F.col("bin").cast("double").alias("t"), "value"))
    return reduce(DataFrame.unionByName, parts)


def interval_clusters(events: DataFrame, change_points: DataFrame, rates: Sequence[float], seeds: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, selected, partitions): clustering of the intervals between change points.

    selected is the chosen rate of each interval; partitions are its best ones.
    """
    grid, packed = prepare(events)
    ranges = clustering.intervals_between(change_points, grid)
    keys = ["sample_id", "interval", "lamda"]
    cells = clustering.interval_autocovariance(packed, ranges, rates)
    runs = clustering.communities(cells, node_counts(events), seeds, keys)
    summary = clustering.summarize(runs, keys)
    selected = scores.select_rate(summary, ["sample_id", "interval"])
    return summary, selected, clustering.best_partition(runs.join(selected, keys), keys)


def bound_curves(events: DataFrame, width: float, n_nodes: DataFrame | None = None) -> DataFrame:
    """(sample_id, k, t_center, upper_bound, lower_bound) of the window from each grid time on.

    Windows without a contact have no row; both their bounds are 0.
    """
    plan = windows.bound_windows(intervals.time_grid(events), width)
    key, n = ["sample_id", "k"], node_counts(events) if n_nodes is None else n_nodes
    sizes = graph.component_sizes_of_runs(windows.runs_of_windows(events, plan)).join(n, "sample_id")
    bounds = sizes.groupBy(*key).agg(F.sum(F.expr(graph.UPPER)).alias("upper_bound"), F.sum(F.expr(graph.LOWER)).alias("lower_bound"))
    return plan.select(*key, "t_center").join(bounds, key)


def rate_blocks(rates: Sequence[float], n: int) -> list[list[float]]:
    """Rates in at most n contiguous blocks of nearly equal length, for runs that are split by hand."""
    size, rest = divmod(len(rates), n)
    cuts = [0]
    for i in range(n):
        cuts.append(cuts[-1] + size + (i < rest))
    return [list(rates[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
