"""Graph operators on edge and cell tables.

Edges: (keys..., i, j) with i < j, undirected.  Cells: (keys..., i, j, v), sparse matrices.
``keys`` name the matrix a row belongs to, for example sample_id and k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric adjacency cells of an undirected edge table; a weight column ``v`` defaults to 1."""
    v = F.col("v") if "v" in edges.columns else F.lit(1.0)
    ends = F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select(*keys, v.alias("v"), F.explode(ends).alias("e")).select(*keys, "e.i", "e.j", "v")


def static_adjacency(events: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Symmetric (sample_id, i, j, v): time that pairs spend in contact in [start, end); self-loops count twice."""
    if start is not None:
        events = events.where(F.col("t_end") > start)
    if end is not None:
        events = events.where(F.col("t_start") < end)
    low = F.greatest("t_start", F.lit(start)) if start is not None else F.col("t_start")
    high = F.least("t_end", F.lit(end)) if end is not None else F.col("t_end")
    one_way = events.groupBy("sample_id", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum(high - low).alias("v"))
    return both_ways(one_way, ["sample_id"]).groupBy("sample_id", "i", "j").agg(F.sum("v").alias("v"))


def adjacency_of_windows(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Static adjacency of many windows at once, from a range join that gives w_start and w_end."""
    length = F.least("t_end", "w_end") - F.greatest("t_start", "w_start")
    one_way = joined.groupBy(*keys, F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum(length).alias("v"))
    return both_ways(one_way, keys).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def degrees(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    return adjacency.groupBy(*keys, "i").agg(F.sum(F.abs("v")).alias("degree"))


def laplacian(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """D - A of cells without repeats; nodes without an edge have no cells.

    Degrees are the only aggregate: cells off the diagonal pass through.
    """
    inner = F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0))
    diagonal = adjacency.groupBy(*keys, "i").agg((F.sum(F.abs("v")) - inner).alias("v")).select(*keys, "i", F.col("i").alias("j"), "v").where("v != 0")
    return diagonal.unionByName(adjacency.where("i != j").select(*keys, "i", "j", (-F.col("v")).alias("v")))


def random_walk_matrix(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """D^-1 A on the nodes with edges; the others stand for themselves (a cell of 1 that is not stored)."""
    total = F.sum("v").over(Window.partitionBy(*keys, "i"))
    return adjacency.select(*keys, "i", "j", (F.col("v") / total).alias("v"))


def random_walk_laplacian(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """I - D^-1 A of cells without repeats; an isolated node walks to itself, so its row is 0.

    One pass over the rows: the first cell of a row also brings its diagonal cell.
    """
    row = Window.partitionBy(*keys, "i")
    inner = F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).over(row)
    seen = adjacency.withColumns({"_all": F.sum("v").over(row), "_own": inner, "_n": F.row_number().over(row.orderBy("j"))})
    off = F.when(F.col("i") != F.col("j"), F.struct(F.col("j"), (-F.col("v") / F.col("_all")).alias("v")))
    diagonal = F.when(F.col("_n") == 1, F.struct(F.col("i").alias("j"), (1 - F.col("_own") / F.col("_all")).alias("v")))
    return seen.select(*keys, "i", F.explode(F.array_compact(F.array(off, diagonal))).alias("c")).select(*keys, "i", "c.j", "c.v").where("v != 0")


def normalized_laplacian(adjacency: DataFrame, keys: list[str]) -> DataFrame:
    """I - D^-1/2 A D^-1/2; each isolated node has no cells (its degree is no divisor)."""
    d = degrees(adjacency, keys)
    a = d.select(*keys, "i", F.col("degree").alias("_a"))
    b = d.select(*keys, F.col("i").alias("j"), F.col("degree").alias("_b"))
    scaled = adjacency.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", (-F.col("v") / F.sqrt(F.col("_a") * F.col("_b"))).alias("v"))
    ones = d.select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return ones.unionByName(scaled).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def identity(nodes: DataFrame, keys: list[str], value: float = 1.0) -> DataFrame:
    return nodes.select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(value).alias("v"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, written below the shared folder of checkpoints."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/chronoloom-checkpoints")
    return df.checkpoint()


def components(edges: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """(keys..., node, component) of every node with an edge; component is the least node reachable.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the
    logarithm of a component's diameter.  Each round's table is checkpointed; the driver sees
    one count a round.
    """
    links = checkpointed(both_ways(edges.select(*keys, "i", "j").where("i != j").distinct(), keys).select(*keys, "i", "j"))
    labels = links.groupBy(*keys, F.col("i").alias("node")).agg(F.least(F.first("i"), F.min("j")).alias("component")).checkpoint()
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("node", "j"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(F.min("component").alias("_near"))
        spread = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = spread.select(*keys, F.col("node").alias("component"), F.col("component").alias("_jump"))
        moved = spread.join(jump, [*keys, "component"]).select(*keys, "node", "_old", F.least("component", "_jump").alias("component")).checkpoint()
        labels = moved.select(*keys, "node", "component")
        if moved.where("_old != component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def component_sizes(edges: DataFrame, keys: list[str]) -> DataFrame:
    return components(edges, keys).groupBy(*keys, "component").agg(F.count("*").alias("size"))


def component_sizes_of_runs(runs: DataFrame, block: int = 1024) -> DataFrame:
    """(sample_id, k, component, size) of every k from runs (sample_id, i, j, k0, k1) of linked pairs, k1 included.

    For graphs that change little from one k to the next: a run is listed once for each ``block`` of
    k that it reaches, and a task a block spreads the least label over its graphs all at once.
    Components are those of ``components``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group["_b"].to_numpy() * block
        k0, k1 = np.maximum(group["k0"].to_numpy(), first), np.minimum(group["k1"].to_numpy(), first + block - 1)
        nodes, ends = np.unique(group[["i", "j"]].to_numpy(), return_inverse=True)
        ends, length = ends.reshape(-1, 2), k1 - k0 + 1
        at = np.repeat(k0 - first - np.cumsum(length) + length, length) + np.arange(length.sum())
        a, b = (at * len(nodes) + np.repeat(ends[:, side], length) for side in (0, 1))
        label = np.arange(block * len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            moved = label.copy()
            np.minimum.at(moved, a, low)
            np.minimum.at(moved, b, low)
            np.minimum.at(moved, label[a], low)
            np.minimum.at(moved, label[b], low)
            moved = moved[moved]
            if (moved == label).all():
                break
            label = moved
        linked = np.zeros(len(label), dtype=bool)
        linked[a] = linked[b] = True
        root, size = np.unique(label[linked], return_counts=True)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "k": first[0] + root // len(nodes), "component": nodes[root % len(nodes)], "size": size})

    listed = runs.where("k1 >= k0 and i != j").withColumn("_b", F.explode(F.sequence(F.floor(F.col("k0") / block), F.floor(F.col("k1") / block))))
    return listed.groupBy("sample_id", "_b").applyInPandas(run, "sample_id long, k long, component long, size long")


UPPER = "size / n_nodes * ln(size)"
LOWER = "size / n_nodes * (2 - 2 / size) * ln(2.0D)"


def upper_bound(sizes: DataFrame, keys: list[str], n_nodes: DataFrame) -> DataFrame:
    """Sum over components of size / N * ln(size): no entropy of a walk within them is greater."""
    return _bound(sizes, keys, n_nodes, F.expr(UPPER), "upper_bound")


def lower_bound(sizes: DataFrame, keys: list[str], n_nodes: DataFrame) -> DataFrame:
    """Sum over components of size / N * (2 - 2 / size) * ln 2, that of a spanning tree of fleeting contacts."""
    return _bound(sizes, keys, n_nodes, F.expr(LOWER), "lower_bound")


def _bound(sizes: DataFrame, keys: list[str], n_nodes: DataFrame, term, name: str) -> DataFrame:
    return sizes.join(n_nodes, "sample_id").groupBy(*keys).agg(F.sum(term).alias(name))
