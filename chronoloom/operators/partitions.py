"""Partitions of nodes, (keys..., node, cluster), and flows between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compacted(partition: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster numbers without gaps from 0."""
    return partition.withColumn("cluster", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("cluster")) - 1).cast("long"))


def indicator(partition: DataFrame, keys: list[str], clusters: list[int]) -> DataFrame:
    """One row a node, one 0/1 column a cluster."""
    return partition.groupBy(*keys, "node").pivot("cluster", clusters).agg(F.lit(1)).fillna(0)


def integrity(partition: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per partition: nodes in several clusters, nodes in none, nodes unknown."""
    known = nodes.select("node").distinct().withColumn("_known", F.lit(1))
    counted = partition.groupBy(*keys, "node").agg(F.count("*").alias("n")).join(known, "node", "left")
    sums = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("n_repeated"),
        F.sum(F.when(F.col("_known").isNotNull(), 1).otherwise(0)).alias("_found"),
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("n_unknown"),
    )
    # what a partition lacks is what there is less what it has: no product of partitions and nodes
    return sums.join(F.broadcast(known.agg(F.count("*").alias("_all")))).select(*keys, "n_repeated", (F.col("_all") - F.col("_found")).alias("n_missing"), "n_unknown")


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., a, b, n): nodes shared by each pair of clusters."""
    left = a.select(*keys, "node", F.col("cluster").alias("a"))
    return left.join(b.select(*keys, "node", F.col("cluster").alias("b")), [*keys, "node"]).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def _sized(table: DataFrame, keys: list[str]) -> DataFrame:
    w = lambda *c: Window.partitionBy(*keys, *c)
    return table.withColumns({"na": F.sum("n").over(w("a")), "nb": F.sum("n").over(w("b")), "total": F.sum("n").over(w())})


def mutual_information(table: DataFrame, keys: list[str]) -> DataFrame:
    """(H1 + H2 - H12) / max(H1, H2) in bits; 1 where both partitions are trivial."""
    s = _sized(table, keys)
    h = lambda n: -F.col("n") / F.col("total") * F.log2(F.col(n) / F.col("total"))
    sums = s.groupBy(*keys).agg(F.sum(h("na")).alias("h1"), F.sum(h("nb")).alias("h2"), F.sum(h("n")).alias("h12"))
    top = F.greatest("h1", "h2")
    return sums.select(*keys, F.when(top > 0, (F.col("h1") + F.col("h2") - F.col("h12")) / top).otherwise(1.0).alias("nmi"))


def variation(table: DataFrame, keys: list[str]) -> DataFrame:
    """-sum n log2(n^2 / (na nb)) / (N log2 N); 0 for fewer than two nodes."""
    s = _sized(table, keys)
    sums = s.groupBy(*keys).agg(F.sum(-F.col("n") * F.log2(F.col("n") * F.col("n") / (F.col("na") * F.col("nb")))).alias("v"), F.first("total").alias("total"))
    return sums.select(*keys, F.when(F.col("total") > 1, F.abs(F.col("v")) / (F.col("total") * F.log2("total"))).otherwise(0.0).alias("nvi"))


def jaccard_distance(table: DataFrame, keys: list[str]) -> DataFrame:
    """Node pairs that the two partitions judge differently, as a share of those that one of them joins."""
    s = _sized(table, keys).withColumns({c: F.col(n) * (F.col(n) - 1) / 2 for c, n in (("_ab", "n"), ("_a", "na"), ("_b", "nb"))})
    # a cluster's pairs are told once for each of its rows: weigh them by the row's share
    sums = s.groupBy(*keys).agg(F.sum("_ab").alias("ab"), F.sum(F.col("_a") * F.col("n") / F.col("na")).alias("pa"), F.sum(F.col("_b") * F.col("n") / F.col("nb")).alias("pb"))
    union = F.col("pa") + F.col("pb") - F.col("ab")
    return sums.select(*keys, F.when(union > 0, 1 - F.col("ab") / union).otherwise(0.0).alias("jaccard"))


def run_pairs(partitions: DataFrame, keys: list[str], run: str = "run", fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Contingency tables of pairs of runs (run_a < run_b), all or a seeded share of them."""
    runs = partitions.select(*keys, run).distinct()
    pairs = runs.withColumnRenamed(run, "run_a").join(runs.withColumnRenamed(run, "run_b"), keys).where("run_a < run_b")
    if fraction is not None:
        pairs = pairs.where(F.pmod(F.xxhash64("run_a", "run_b", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    a = pairs.join(partitions.select(*keys, F.col(run).alias("run_a"), "node", F.col("cluster").alias("a")), [*keys, "run_a"])
    b = partitions.select(*keys, F.col(run).alias("run_b"), "node", F.col("cluster").alias("b"))
    return a.join(b, [*keys, "run_b", "node"]).groupBy(*keys, "run_a", "run_b", "a", "b").agg(F.count("*").alias("n"))


def average_variation(partitions: DataFrame, keys: list[str], run: str = "run", fraction: float | None = None, seed: int = 0) -> DataFrame:
    each = variation(run_pairs(partitions, keys, run, fraction, seed), [*keys, "run_a", "run_b"])
    return each.groupBy(*keys).agg(F.avg("nvi").alias("avg_nvi"))


def flows(source: DataFrame, target: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., source, target, type, value): nodes that go from a cluster to a cluster, by class.

    Nodes without a class are left out.
    """
    joined = source.select(*keys, "node", F.col("cluster").alias("source")).join(target.select(*keys, "node", F.col("cluster").alias("target")), [*keys, "node"])
    return joined.join(classes.select("node", "type"), "node").groupBy(*keys, "source", "target", "type").agg(F.count("*").alias("value"))


def flow_labels(flow: DataFrame, level: str = "level") -> DataFrame:
    """Names L<level>_C<cluster> of both ends; the target lies one level on."""
    return flow.withColumns({"source_label": F.format_string("L%d_C%d", F.col(level), F.col("source")), "target_label": F.format_string("L%d_C%d", F.col(level) + 1, F.col("target"))})


def offset_flows(flow: DataFrame, level: str = "level") -> DataFrame:
    """Cluster numbers made unique over levels by running offsets."""
    ends = flow.select(F.col(level).alias("_l"), F.col("source").alias("c")).union(flow.select(F.col(level) + 1, "target"))
    sizes = ends.groupBy("_l").agg((F.max("c") + 1).alias("n"))
    offsets = sizes.select("_l", F.coalesce(F.sum("n").over(Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))  # one row a level
    a, b = offsets.select(F.col("_l").alias(level), F.col("o").alias("_a")), offsets.select((F.col("_l") - 1).alias(level), F.col("o").alias("_b"))
    return flow.join(a, level).join(b, level).withColumns({"source": F.col("source") + F.col("_a"), "target": F.col("target") + F.col("_b")}).drop("_a", "_b")


def node_profiles(flow: DataFrame) -> DataFrame:
    """(label, type, value): what flows through each labelled cluster, over both its ends."""
    ends = flow.select(F.col("source_label").alias("label"), "type", "value").union(flow.select("target_label", "type", "value"))
    return ends.groupBy("label", "type").agg(F.sum("value").alias("value"))


def sankey_layers(flow: DataFrame, types: list[str], level: str = "level") -> DataFrame:
    """(level, cluster, total, place): clusters of each layer in order of their counts of the types, greatest first."""
    out = flow.select(F.col(level).alias("level"), F.col("source").alias("cluster"), "type", "value")
    last = flow.agg(F.max(level).alias("_top"))
    final = flow.join(last, F.col(level) == F.col("_top")).select((F.col(level) + 1).alias("level"), F.col("target").alias("cluster"), "type", "value")
    counts = [F.sum(F.when(F.col("type") == t, F.col("value")).otherwise(0)).alias(f"_c{n}") for n, t in enumerate(types)]
    totals = out.union(final).groupBy("level", "cluster").agg(F.sum("value").alias("total"), *counts)
    order = Window.partitionBy("level").orderBy(*[F.desc(f"_c{n}") for n in range(len(types))], "cluster")
    return totals.select("level", "cluster", "total", F.row_number().over(order).cast("long").alias("place"))
