"""Flow-based communities of intervals: integrals of autocovariances and repeated Louvain runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.storage import kept
from .transitions import _kernels, _with_rates


def intervals_between(change_points: DataFrame, grid: DataFrame, least: int = 2, with_whole: bool = False) -> DataFrame:
    """(sample_id, interval, start, stop): ranges of grid indices between change points.

    change_points: (sample_id, k).  Ranges shorter than ``least`` are left out; interval 0 is the
    whole range if asked for.
    """
    from pyspark.sql import Window

    ends = grid.groupBy("sample_id").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    bounds = change_points.select("sample_id", "k").union(ends.select("sample_id", F.explode(F.array("a", "b")))).distinct()
    order = Window.partitionBy("sample_id").orderBy("start")
    pairs = bounds.select("sample_id", F.col("k").alias("start")).withColumn("stop", F.lead("start").over(order)).where(F.col("stop") - F.col("start") >= least)
    numbered = pairs.withColumn("interval", F.row_number().over(order).cast("long")).select("sample_id", "interval", "start", "stop")
    if with_whole:
        numbered = numbered.union(ends.select("sample_id", F.lit(0).cast("long"), "a", "b"))
    return numbered


def uncovered(intervals: DataFrame, grid: DataFrame) -> DataFrame:
    """Intervals that end after the last matrix of their sample."""
    last = grid.groupBy("sample_id").agg(F.max("k").alias("n_intervals"))
    return intervals.join(last, "sample_id").where("stop > n_intervals")


def unfinished(intervals: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return intervals.join(done.select(*keys).distinct(), keys, "left_anti")


def interval_autocovariance(packed: DataFrame, intervals: DataFrame, rates: Sequence[float], walk: bool = False, tol: float = 0.0) -> DataFrame:
    """Cells (sample_id, interval, lamda, i, j, v) of the flow integral minus p p^T, uniform p.

    Each interval starts its own products.  What is below tol times the greatest value is left out;
    with a tol of 0 every cell is there, zeros too.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = _integral(group, walk)
        i, j = np.nonzero(np.abs(s) >= tol * np.abs(s).max()) if s.size else (np.zeros(0, int),) * 2
        one = group.iloc[0]
        return pd.DataFrame({"sample_id": one["sample_id"], "interval": one["interval"], "lamda": one["lamda"], "i": i, "j": j, "v": s[i, j]})

    return _cut(packed, intervals, rates).groupBy("sample_id", "interval", "lamda").applyInPandas(run, "sample_id long, interval long, lamda double, i long, j long, v double")


def within(rows: DataFrame, intervals: DataFrame, bucket: int = 256) -> DataFrame:
    """Rows (sample_id, k, ...) of each interval (sample_id, interval, start, stop) with start <= k < stop.

    Intervals are listed under the buckets of k that they reach, so a sample's rows meet the
    intervals near them only, and one long sample is many keys.  Rows may be long, and those of an
    explode are more than any estimate knows: both sides are shuffled, none is sent to the driver.
    """
    listed = intervals.where("stop > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    return rows.withColumn("_b", F.floor(F.col("k") / bucket)).join(listed.hint("merge"), ["sample_id", "_b"]).where("k >= start and k < stop").drop("start", "stop", "_b")


def _cut(packed: DataFrame, intervals: DataFrame, rates: Sequence[float]) -> DataFrame:
    return _with_rates(within(packed, intervals), rates)


def _integral(group: pd.DataFrame, walk: bool) -> np.ndarray:
    group = group.sort_values("k")
    n, rate = int(group["n_nodes"].iloc[0]), float(group["lamda"].iloc[0])
    total, product, size = np.zeros((n, n)), np.eye(n), 0.0
    p1 = np.full(n, 1 / n)
    for at in range(0, len(group), 256):
        part = group.iloc[at : at + 256]
        for m, tau in zip(_kernels(part, n, rate, walk), part["tau"].to_numpy(), strict=True):
            product = K.normalize_rows(product @ m)
            p2 = p1 @ product
            half = p1[:, None] * product / np.sqrt(np.where(p2 > 0, p2, 1.0))
            total += tau * (half @ half.T)
            size += tau
    return (total / size if size > 0 else total) - np.outer(p1, p1)


def interval_products(packed: DataFrame, intervals: DataFrame, rates: Sequence[float], walk: bool = True, tol: float = 1e-12) -> DataFrame:
    """Cells (sample_id, interval, lamda, k, i, j, v) of the product over each interval; k is its last with a contact.

    Kernels are made and multiplied in one task an interval and rate, so cells of single kernels
    are never shuffled.  Intervals without a contact have no cells.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        group = group[group["ii"].map(len) > 0].sort_values("k")
        n, total = int(one["n_nodes"]), np.eye(int(one["n_nodes"]))
        for at in range(0, len(group), 256):
            for m in _kernels(group.iloc[at : at + 256], n, float(one["lamda"]), walk):
                total = K.normalize_rows(total @ m)
        i, j = np.nonzero(np.abs(total) > tol) if len(group) else (np.zeros(0, int),) * 2
        return pd.DataFrame({"sample_id": one["sample_id"], "interval": one["interval"], "lamda": one["lamda"], "k": group["k"].max(), "i": i, "j": j, "v": total[i, j]})

    return _cut(packed, intervals, rates).groupBy("sample_id", "interval", "lamda").applyInPandas(run, "sample_id long, interval long, lamda double, k long, i long, j long, v double")


def communities(autocovariance: DataFrame, n_nodes: DataFrame, seeds: Sequence[int], keys: list[str]) -> DataFrame:
    """(keys..., run, node, cluster, stability): one Louvain run a seed, each its own task."""
    table = autocovariance.sparkSession.createDataFrame([(int(s),) for s in seeds], "run long")
    each = autocovariance.select(*keys, "i", "j", "v").join(n_nodes, "sample_id").join(F.broadcast(table))  # a short list of seeds

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, seed = int(group["n_nodes"].iloc[0]), int(group["run"].iloc[0])
        s = K.dense(group["i"], group["j"], group["v"], n)
        label = K.louvain(s, seed)
        part = pd.DataFrame({"run": seed, "node": np.arange(n), "cluster": label, "stability": K.stability(s, label)})
        for k in keys:
            part[k] = group[k].iloc[0]
        return part[[*keys, "run", "node", "cluster", "stability"]]

    kinds = dict(autocovariance.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", run long, node long, cluster long, stability double"
    return each.groupBy(*keys, "run").applyInPandas(run, schema)


def summarize(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: best and mean stability, mean number of clusters, mean variation between runs."""
    from .partitions import average_variation

    runs = kept(runs)  # read five times, dear to make, and their plan would be in this one as often
    each = runs.groupBy(*keys, "run").agg(F.first("stability").alias("s"), F.countDistinct("cluster").alias("c"))
    sums = each.groupBy(*keys).agg(F.max("s").alias("best_stability"), F.avg("s").alias("avg_stability"), F.avg("c").alias("avg_clusters"))
    return sums.join(average_variation(runs, keys), keys, "left")


def best_partition(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The partition of the most stable run; ties to the least run."""
    top = runs.groupBy(*keys).agg(F.min_by("run", F.struct((-F.col("stability")).alias("s"), "run")).alias("run"))
    return runs.join(top, [*keys, "run"]).select(*keys, "node", "cluster")


def static_communities(adjacency: DataFrame, n_nodes: DataFrame, time: float = 1.0, kind: str = "continuous", directed: bool = False, seed: int = 0) -> DataFrame:
    """(sample_id, node, cluster, stability) of a static weighted graph by Markov stability."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n_nodes"].iloc[0])
        s = K.markov_stability_matrix(K.dense(group["i"], group["j"], group["v"], n), time, kind, directed)
        s = (s + s.T) / 2
        label = K.louvain(s, seed)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "node": np.arange(n), "cluster": label, "stability": K.stability(s, label)})

    return adjacency.join(n_nodes, "sample_id").groupBy("sample_id").applyInPandas(run, "sample_id long, node long, cluster long, stability double")


def match_clusters(similarity: DataFrame, keys: list[str]) -> DataFrame:
    """Best one-to-one pairs (keys..., a, b) of clusters by similarity (keys..., a, b, v)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index="a", columns="b", values="v", aggfunc="sum", fill_value=0.0)
        pairs = K.assignment(1 - table.to_numpy())
        out = pd.DataFrame({"a": [table.index[i] for i, _ in pairs], "b": [table.columns[j] for _, j in pairs]})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "a", "b"]]

    kinds = dict(similarity.dtypes)
    return similarity.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "a", "b"]))


def order_like(table: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """Order clusters b after the model clusters a they resemble: (keys..., b, place).

    table: contingency (keys..., a, b, n).  Model clusters in turn take the unplaced clusters whose
    Jaccard index with them is at least threshold, best first; the rest follow by number.
    """
    from pyspark.sql import Window

    w = lambda c: Window.partitionBy(*keys, c)
    index = F.col("n") / (F.sum("n").over(w("a")) + F.sum("n").over(w("b")) - F.col("n"))
    scored = table.select(*keys, "a", "b", index.alias("jaccard"))
    # the first model cluster that accepts a cluster is the one that takes it
    taken = scored.groupBy(*keys, "b").agg(F.min_by(F.struct("a", "jaccard"), F.when(F.col("jaccard") >= threshold, F.col("a"))).alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("m.a"), F.desc("m.jaccard"), "b")
    return taken.select(*keys, "b", F.row_number().over(order).cast("long").alias("place"))


def prepared_integral(autocovariance: DataFrame, keys: list[str], scale: float = 1.0, threshold: float = 0.0, largest_component: bool = False) -> DataFrame:
    """An integral scaled, symmetrized and thresholded (as a share of its greatest value); optionally its largest component."""
    from . import cells, graph

    kept = cells.symmetrized(cells.scale(autocovariance, scale), keys)
    if threshold > 0:
        kept = cells.drop_small(kept, keys, threshold, absolute=True)
    if not largest_component:
        return kept
    labels = graph.components(kept.where("i != j"), keys)
    sizes = labels.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy(*keys).agg(F.min_by("component", F.struct((-F.col("n")).alias("n"), "component")).alias("component"))
    inside = labels.join(top, [*keys, "component"], "left_semi").select(*keys, "node")
    return kept.join(inside.withColumnRenamed("node", "i"), [*keys, "i"], "left_semi").join(inside.withColumnRenamed("node", "j"), [*keys, "j"], "left_semi")
