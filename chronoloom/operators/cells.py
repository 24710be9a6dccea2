"""Algebra of sparse matrices as cell tables (keys..., i, j, v).

``keys`` name the matrix.  A stochastic matrix is stored without the rows of nodes that stay
where they are; ``to_full`` adds them.  Shapes are carried by node tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add(a: DataFrame, b: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    return a.select(*keys, "i", "j", "v").unionByName(b.select(*keys, "i", "j", (sign * F.col("v")).alias("v"))).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return add(a, b, keys, -1)


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def transpose(a: DataFrame) -> DataFrame:
    return a.withColumns({"i": F.col("j"), "j": F.col("i")})


def matmul(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A B: join on the inner index, partial sums before the second shuffle."""
    left = a.select(*keys, "i", F.col("j").alias("_m"), F.col("v").alias("_a"))
    right = b.select(*keys, F.col("i").alias("_m"), "j", F.col("v").alias("_b"))
    return left.join(right, [*keys, "_m"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def gram(a: DataFrame, keys: list[str], columns: bool = False) -> DataFrame:
    """A A^T, or A^T A for ``columns``; always both triangles."""
    return matmul(transpose(a), a, keys) if columns else matmul(a, transpose(a), keys)


def upper_triangle(a: DataFrame) -> DataFrame:
    return a.where("i <= j")


def scale_rows(a: DataFrame, vector: DataFrame, keys: list[str]) -> DataFrame:
    """diag(d) A; vector has (keys..., node, d)."""
    return a.join(vector.withColumnRenamed("node", "i"), [*keys, "i"]).select(*keys, "i", "j", (F.col("v") * F.col("d")).alias("v"))


def scale_columns(a: DataFrame, vector: DataFrame, keys: list[str]) -> DataFrame:
    """A diag(d)."""
    return a.join(vector.withColumnRenamed("node", "j"), [*keys, "j"]).select(*keys, "i", "j", (F.col("v") * F.col("d")).alias("v"))


def outer(p: DataFrame, keys: list[str], triangle: bool = False) -> DataFrame:
    """p p^T of (keys..., node, d), matrix by matrix."""
    left = p.select(*keys, F.col("node").alias("i"), F.col("d").alias("_a"))
    right = p.select(*keys, F.col("node").alias("j"), F.col("d").alias("_b"))
    out = left.join(right, keys).select(*keys, "i", "j", (F.col("_a") * F.col("_b")).alias("v"))
    return upper_triangle(out) if triangle else out


def row_normalize(a: DataFrame, keys: list[str], target: float = 1.0) -> DataFrame:
    """Rows that sum to ``target``; rows of sum 0 stay.  For target 0 the mean of a row's cells is taken off."""
    row = Window.partitionBy(*keys, "i")
    if target == 0:
        return a.withColumn("v", F.col("v") - F.avg("v").over(row))
    total = F.sum("v").over(row)
    return a.withColumn("v", F.when(total == 0, F.col("v")).otherwise(F.col("v") * target / total))


def drop_small(a: DataFrame, keys: list[str], tol: float = 1e-8, relative: bool = True, absolute: bool = False) -> DataFrame:
    """Cells above tol (times the greatest absolute value); by value, so negatives go, unless ``absolute``."""
    size = F.abs("v") if absolute else F.col("v")
    if not relative:
        return a.where(size > tol)
    greatest = F.max(F.abs("v")).over(Window.partitionBy(*keys))
    return a.withColumn("_top", greatest).where(size > tol * F.col("_top")).drop("_top")


def snap_to_one(a: DataFrame, tol: float = 1e-8) -> DataFrame:
    return a.withColumn("v", F.when(F.abs(F.col("v") - 1) <= tol, 1.0).otherwise(F.col("v")))


def support(a: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes whose row or column has a cell."""
    return a.select(*keys, F.col("i").alias("node")).union(a.select(*keys, "j")).distinct()


def shared_support(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return support(a, keys).intersect(support(b, keys)).groupBy(*keys).agg(F.count("*").alias("n_shared"))


def to_full(a: DataFrame, nodes: DataFrame, keys: list[str], value: float = 1.0) -> DataFrame:
    """Add ``value`` on the diagonal of nodes (keys..., node) without a cell."""
    missing = nodes.select(*keys, "node").join(support(a, keys), [*keys, "node"], "left_anti")
    return a.select(*keys, "i", "j", "v").unionByName(missing.select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(value).alias("v")))


def to_compact(a: DataFrame, keys: list[str], value: float = 1.0) -> DataFrame:
    """Leave out nodes that have ``value`` on the diagonal and no other cell in row or column."""
    alone = F.max(F.when(F.col("i") != F.col("j"), 1).when(F.col("v") != value, 1).otherwise(0))
    linked = a.withColumn("node", F.explode(F.array("i", "j"))).groupBy(*keys, "node").agg(alone.alias("_linked")).where("_linked = 1").select(*keys, F.col("node").alias("i"))
    return a.join(linked, [*keys, "i"], "left_semi")


def add_diagonal(a: DataFrame, nodes: DataFrame, keys: list[str], value: float) -> DataFrame:
    diagonal = nodes.select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(value).alias("v"))
    return add(a, diagonal, keys)


def compact_matmul(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A B of compactly stored matrices: a node that one of them leaves out stands for itself there."""
    both = support(a, keys).union(support(b, keys)).distinct()
    return to_compact(matmul(to_full(a, both, keys), to_full(b, both, keys), keys), keys)


def deltas(a: DataFrame, keys: list[str], order: str = "k", tol: float = 0.0) -> DataFrame:
    """Changes of each cell between consecutive matrices; the first matrix whole.

    A cell absent in between counts as 0; changes of at most tol are left out.
    """
    every = a.select(*keys, order).distinct()
    pair = Window.partitionBy(*keys, "i", "j").orderBy(order)
    following = every.withColumn("_next", F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))
    # a cell changes where it is stored, and right after it was stored last in a run
    stored = a.join(following, [*keys, order])
    gone = stored.where("_next is not null").select(*keys, F.col("_next").alias(order), "i", "j", F.lit(0.0).alias("v"), F.lit(1).alias("_gone"))
    rows = a.select(*keys, order, "i", "j", "v", F.lit(0).alias("_gone")).unionByName(gone)
    filled = rows.groupBy(*keys, order, "i", "j").agg(F.sum("v").alias("v"))
    changed = filled.withColumn("v", F.col("v") - F.coalesce(F.lag("v").over(pair), F.lit(0.0)))
    return changed.where(F.abs("v") > tol)


def restore(changes: DataFrame, keys: list[str], order: str = "k") -> DataFrame:
    """Running sums of ``deltas`` at the matrices where a cell changes."""
    pair = Window.partitionBy(*keys, "i", "j").orderBy(order)
    return changes.withColumn("v", F.sum("v").over(pair))


def entropy(a: DataFrame, keys: list[str], n_nodes: DataFrame, p0: DataFrame | None = None) -> DataFrame:
    """Conditional entropy -sum_i p_i sum_j v ln v; p uniform over all nodes unless given as (sample_id, node, d)."""
    term = F.when(F.col("v") > 0, -F.col("v") * F.ln("v")).otherwise(0.0)
    if p0 is None:
        return a.join(n_nodes, "sample_id").groupBy(*keys).agg((F.sum(term / F.col("n_nodes"))).alias("entropy"))
    return a.join(p0.withColumnRenamed("node", "i"), ["sample_id", "i"]).groupBy(*keys).agg(F.sum(term * F.col("d")).alias("entropy"))


def stationary(walk: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    """Stationary matrix of each component: columns by structural degree, equal rows.

    walk: cells of a random walk; components: (keys..., node, component).
    """
    degree = walk.groupBy(*keys, F.col("i").alias("node")).agg(F.count("*").alias("degree")).join(components, [*keys, "node"])
    share = degree.withColumn("p", F.col("degree") / F.sum("degree").over(Window.partitionBy(*keys, "component")))
    rows = components.select(*keys, "component", F.col("node").alias("i"))
    return rows.join(share.select(*keys, "component", F.col("node").alias("j"), F.col("p").alias("v")), [*keys, "component"]).select(*keys, "i", "j", "v")


def linear_transition(walk: DataFrame, stationary_cells: DataFrame, keys: list[str], time: Column, settle: float = 10.0) -> DataFrame:
    """Linear stand-in for the heat kernel at ``time`` (an expression over keys).

    Up to 1 from the identity to the walk, then to the stationary matrix at ``settle``.
    Only nodes with edges are stored, as everywhere.
    """
    nodes = support(walk, keys).select(*keys, F.col("node").alias("i"), F.col("node").alias("j"))
    parts = [
        nodes.withColumns({"e": F.lit(1.0), "w": F.lit(0.0), "s": F.lit(0.0)}),
        walk.select(*keys, "i", "j", F.lit(0.0).alias("e"), F.col("v").alias("w"), F.lit(0.0).alias("s")),
        stationary_cells.select(*keys, "i", "j", F.lit(0.0).alias("e"), F.lit(0.0).alias("w"), F.col("v").alias("s")),
    ]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys, "i", "j").agg(F.sum("e").alias("e"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    value = (
        F.when(time < 0, F.raise_error(F.lit("negative time")).cast("double"))
        .when(time <= 1, (1 - time) * F.col("e") + time * F.col("w"))
        .when(time < settle, (F.col("w") * (time - settle) + F.col("s") * (1 - time)) / (1 - settle))
        .otherwise(F.col("s"))
    )
    return summed.select(*keys, "i", "j", value.alias("v")).where("v != 0")


def block_sums(a: DataFrame, partition: DataFrame, keys: list[str]) -> DataFrame:
    """Contract a matrix by clusters: partition has (keys..., node, cluster)."""
    left = partition.select(*keys, F.col("node").alias("i"), F.col("cluster").alias("_a"))
    right = partition.select(*keys, F.col("node").alias("j"), F.col("cluster").alias("_b"))
    return a.join(left, [*keys, "i"]).join(right, [*keys, "j"]).groupBy(*keys, F.col("_a").alias("i"), F.col("_b").alias("j")).agg(F.sum("v").alias("v"))


def trace(a: DataFrame, keys: list[str]) -> DataFrame:
    return a.where("i = j").groupBy(*keys).agg(F.sum("v").alias("trace"))


def frobenius_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """|A - B|^2 / (|A| |B|) with Frobenius norms; NaN or infinite where a matrix is empty."""
    marked = a.select(*keys, "i", "j", F.col("v").alias("_a"), F.lit(0.0).alias("_b")).unionByName(b.select(*keys, "i", "j", F.lit(0.0).alias("_a"), F.col("v").alias("_b")))
    cells = marked.groupBy(*keys, "i", "j").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    norms = cells.groupBy(*keys).agg(F.sum(F.pow(F.col("_a") - F.col("_b"), 2)).alias("d"), F.sqrt(F.sum(F.col("_a") ** 2)).alias("na"), F.sqrt(F.sum(F.col("_b") ** 2)).alias("nb"))
    below = F.col("na") * F.col("nb")
    return norms.select(*keys, F.when(below > 0, F.col("d") / below).when(F.col("d") > 0, float("inf")).otherwise(float("nan")).alias("distance"))


def reindexed(a: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matrix on its support only, and the map (keys..., node, index) from nodes to its rows."""
    index = support(a, keys).withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy("node")) - 1).cast("long"))
    left = index.select(*keys, F.col("node").alias("i"), F.col("index").alias("_i"))
    right = index.select(*keys, F.col("node").alias("j"), F.col("index").alias("_j"))
    return a.join(left, [*keys, "i"]).join(right, [*keys, "j"]).select(*keys, F.col("_i").alias("i"), F.col("_j").alias("j"), "v"), index


def autocovariance(t: DataFrame, p1: DataFrame, keys: list[str], p2: DataFrame | None = None) -> DataFrame:
    """diag(p1) T - p1 p2^T; vectors are (keys..., node, d), p2 is p1 T unless given."""
    weighted = scale_rows(t, p1, keys)
    after = weighted.groupBy(*keys, F.col("j").alias("node")).agg(F.sum("v").alias("d")) if p2 is None else p2
    return subtract(weighted, _product(p1, after, keys), keys)


def forward_autocovariance(t: DataFrame, p1: DataFrame, keys: list[str]) -> DataFrame:
    """diag(p1) T diag(1 / p1 T) T^T diag(p1) - p1 p1^T."""
    weighted = scale_rows(t, p1, keys)
    inverse = weighted.groupBy(*keys, F.col("j").alias("node")).agg(F.sum("v").alias("_p")).where("_p > 0").select(*keys, "node", (1 / F.col("_p")).alias("d"))
    return subtract(matmul(scale_columns(weighted, inverse, keys), transpose(weighted), keys), _product(p1, p1, keys), keys)


def _product(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    left = p.select(*keys, F.col("node").alias("i"), F.col("d").alias("_a"))
    return left.join(q.select(*keys, F.col("node").alias("j"), F.col("d").alias("_b")), keys).select(*keys, "i", "j", (F.col("_a") * F.col("_b")).alias("v"))


def block_sum(a: DataFrame, rows: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the cells in the rows and columns of two node tables (keys..., node), per matrix."""
    inside = a.join(rows.select(*keys, F.col("node").alias("i")), [*keys, "i"], "left_semi").join(columns.select(*keys, F.col("node").alias("j")), [*keys, "j"], "left_semi")
    return inside.groupBy(*keys).agg(F.sum("v").alias("total"))


def all_near_zero(a: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all cells equal those of a reference matrix up to rounding."""
    marked = a.select(*keys, "i", "j", F.col("v").alias("_a"), F.lit(0.0).alias("_b")).unionByName(reference.select(*keys, "i", "j", F.lit(0.0).alias("_a"), F.col("v").alias("_b")))
    both = marked.groupBy(*keys, "i", "j").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return both.groupBy(*keys).agg(F.bool_and(F.abs(F.col("_a") - F.col("_b")) <= 1e-8 + 1e-5 * F.abs("_b")).alias("near_zero"))


def symmetrized(a: DataFrame, keys: list[str]) -> DataFrame:
    return scale(add(a, transpose(a), keys), 0.5)
