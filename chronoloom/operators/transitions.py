"""Transition matrices and entropy signals.

The relational part prepares edges and window plans; grouped functions build heat kernels,
multiply them in order and emit rows.  Running products are scans over blocks of intervals, and
windows of the ``tree`` backend are covered by a stored tree of block products: their groups hold
a block of one sample at one rate.  The other window backends hold a sample's kernels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .graph import checkpointed


def packed(edges: DataFrame, grid: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """One row an interval: (sample_id, n_nodes, k, t, tau, ii, jj), edges as arrays; empty intervals too.

    Grid and edges are grouped together, not joined: edges come out of an explode, whose length no
    estimate knows, so a join would send them to the driver as a broadcast.
    """
    times = grid.where("tau is not null").select("sample_id", "k", "t", "tau", F.lit(None).cast("struct<i:bigint,j:bigint>").alias("e"))
    nothing = F.lit(None).cast("double")
    links = edges.select("sample_id", "k", nothing.alias("t"), nothing.alias("tau"), F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).alias("e"))
    lists = times.unionByName(links).groupBy("sample_id", "k").agg(F.max("t").alias("t"), F.max("tau").alias("tau"), F.collect_list("e").alias("e")).where("tau is not null")
    return lists.join(n_nodes, "sample_id").select("sample_id", "n_nodes", "k", "t", "tau", F.transform("e", lambda x: x["i"]).alias("ii"), F.transform("e", lambda x: x["j"]).alias("jj"))


def _adjacency(part: pd.DataFrame, n: int) -> np.ndarray:
    a = np.zeros((len(part), n, n))
    for x, (i, j) in enumerate(zip(part["ii"], part["jj"], strict=True)):
        i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
        a[x, i, j] = a[x, j, i] = 1.0
    return a


def _kernels(part: pd.DataFrame, n: int, rate: float, walk: bool, unit_time: bool = False) -> np.ndarray:
    a = _adjacency(part, n)
    times = rate * (np.ones(len(part)) if unit_time else part["tau"].to_numpy(dtype=float))
    if walk:
        return K.walk_heat_kernels(a, times)
    return K.heat_kernels(np.eye(n) * a.sum(axis=2)[:, :, None] - a, times)


def _with_rates(intervals: DataFrame, rates: Sequence[float]) -> DataFrame:
    table = intervals.sparkSession.createDataFrame([(float(r),) for r in rates], "lamda double")
    return intervals.join(F.broadcast(table))  # a short list of rates times each interval


def inter_transitions(intervals: DataFrame, rates: Sequence[float], walk: bool = True, unit_time: bool = False, tol: float = 1e-12) -> DataFrame:
    """Cells (sample_id, lamda, k, i, j, v) of each interval's kernel; rows of inactive nodes are not stored."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["ii"].map(len) > 0]
        out, n = [], int(group["n_nodes"].iloc[0]) if len(group) else 0
        for at in range(0, len(group), 256):
            part = group.iloc[at : at + 256]
            mats = _kernels(part, n, float(part["lamda"].iloc[0]), walk, unit_time)
            active = _adjacency(part, n).any(axis=2)
            x, i, j = np.nonzero((np.abs(mats) > tol) & active[:, :, None])
            out.append(pd.DataFrame({"sample_id": part["sample_id"].iloc[0], "lamda": part["lamda"].iloc[0], "k": part["k"].to_numpy()[x], "i": i, "j": j, "v": mats[x, i, j]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["sample_id", "lamda", "k", "i", "j", "v"])

    keyed = _with_rates(intervals, rates).withColumn("_slice", F.floor(F.col("k") / 4096))
    return keyed.groupBy("sample_id", "lamda", "_slice").applyInPandas(run, "sample_id long, lamda double, k long, i long, j long, v double")


BLOCK = 256


def _blocks(intervals: DataFrame, rates: Sequence[float], block: int) -> DataFrame:
    return _with_rates(intervals, rates).withColumn("block", F.floor(F.col("k") / block).cast("long"))


_PRODUCT = "sample_id long, lamda double, block long, n_nodes long, m array<double>"


def _product_row(group: pd.DataFrame, block: int, total: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"sample_id": [group["sample_id"].iloc[0]], "lamda": [float(group["lamda"].iloc[0])], "block": [block], "n_nodes": [len(total)], "m": [total.ravel()]})


def _multiplied(total: np.ndarray, products: pd.DataFrame, reverse: bool) -> np.ndarray:
    for m in products.sort_values("block", ascending=not reverse)["m"]:
        total = K.normalize_rows(total @ np.asarray(m).reshape(total.shape))
    return total


def block_products(intervals: DataFrame, rates: Sequence[float], walk: bool = False, reverse: bool = False, block: int = BLOCK) -> DataFrame:
    """(sample_id, lamda, block, n_nodes, m): the product over each block of intervals, row by row; a task a block."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ascending=not reverse)
        n = int(group["n_nodes"].iloc[0])
        total = np.eye(n)
        for m in _kernels(group, n, float(group["lamda"].iloc[0]), walk):
            total = K.normalize_rows(total @ m)
        return _product_row(group, int(group["block"].iloc[0]), total)

    return _blocks(intervals, rates, block).groupBy("sample_id", "lamda", "block").applyInPandas(run, _PRODUCT)


def joined_blocks(products: DataFrame, fan: int, reverse: bool = False) -> DataFrame:
    """Products of ``fan`` consecutive blocks each."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _product_row(group, int(group["block"].iloc[0]) // fan, _multiplied(np.eye(int(group["n_nodes"].iloc[0])), group, reverse))

    return products.withColumn("_above", F.floor(F.col("block") / fan)).groupBy("sample_id", "lamda", "_above").applyInPandas(run, _PRODUCT)


def carries(products: DataFrame, reverse: bool = False, fan: int = BLOCK) -> DataFrame:
    """(sample_id, lamda, block, n_nodes, m): the product of all blocks before (reversed: after) each one.

    Blocks are joined ``fan`` at a time until one group holds the rest; the products before the
    joined ones come down again as where their blocks begin.
    """
    products = checkpointed(products)
    first, last = products.agg(F.min("block"), F.max("block")).first()
    rest = products.where("false") if last is None or first // fan == last // fan else carries(joined_blocks(products, fan, reverse), reverse, fan)
    above = rest.select(*(F.col(c).alias(f"c_{c}") for c in ("sample_id", "lamda", "block", "m")))

    def run(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=["sample_id", "lamda", "block", "n_nodes", "m"])
        group = group.sort_values("block", ascending=not reverse)
        n = int(group["n_nodes"].iloc[0])
        total, out = np.asarray(before["c_m"].iloc[0]).reshape(n, n) if len(before) else np.eye(n), []
        for block, m in zip(group["block"], group["m"], strict=True):
            out.append(_product_row(group, int(block), total))
            total = K.normalize_rows(total @ np.asarray(m).reshape(n, n))
        return pd.concat(out)

    here = products.withColumn("_above", F.floor(F.col("block") / fan).cast("long"))
    return here.groupBy("sample_id", "lamda", "_above").cogroup(above.groupBy("c_sample_id", "c_lamda", "c_block")).applyInPandas(run, _PRODUCT)


def running_entropy(intervals: DataFrame, rates: Sequence[float], walk: bool = False, reverse: bool = False, block: int = BLOCK) -> DataFrame:
    """Entropy of the running product after (reversed: from) each interval: (sample_id, lamda, k, t, entropy).

    A scan in two passes: blocks of ``block`` intervals are multiplied apart, the products before
    each block are made of those, and each block goes on from there.  So one long sample has as
    many tasks as blocks; kernels are made twice.
    """
    before = carries(block_products(intervals, rates, walk, reverse, block), reverse)
    before = before.select(*(F.col(c).alias(f"c_{c}") for c in ("sample_id", "lamda", "block", "m")))

    def run(group: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=["sample_id", "lamda", "k", "t", "entropy"])
        group = group.sort_values("k", ascending=not reverse)
        n, rate = int(group["n_nodes"].iloc[0]), float(group["lamda"].iloc[0])
        total, values = np.asarray(carry["c_m"].iloc[0]).reshape(n, n), []
        for m in _kernels(group, n, rate, walk):
            total = K.normalize_rows(total @ m)
            values.append(K.entropy(total))
        return pd.DataFrame({"sample_id": group["sample_id"], "lamda": rate, "k": group["k"], "t": group["t"] + group["tau"], "entropy": values})

    here = _blocks(intervals, rates, block).groupBy("sample_id", "lamda", "block")
    return here.cogroup(before.groupBy("c_sample_id", "c_lamda", "c_block")).applyInPandas(run, "sample_id long, lamda double, k long, t double, entropy double")


def running_transition(intervals: DataFrame, rates: Sequence[float], walk: bool = False, reverse: bool = False, tol: float = 1e-12, block: int = BLOCK) -> DataFrame:
    """Cells of the product over all of a sample's intervals: (sample_id, lamda, i, j, v); blocks apart, then joined."""
    products = checkpointed(block_products(intervals, rates, walk, reverse, block))
    while (products.agg(F.max("block")).first()[0] or 0) > 0:
        products = checkpointed(joined_blocks(products, BLOCK, reverse))

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                total = np.asarray(row.m).reshape(row.n_nodes, row.n_nodes)
                i, j = np.nonzero(np.abs(total) > tol)
                yield pd.DataFrame({"sample_id": row.sample_id, "lamda": row.lamda, "i": i, "j": j, "v": total[i, j]})

    return products.mapInPandas(run, "sample_id long, lamda double, i long, j long, v double")


def product_tree(products: DataFrame, reverse: bool = False) -> DataFrame:
    """(level, sample_id, lamda, block, n_nodes, m): block products, and those of 2, 4, 8, ... blocks."""
    here = checkpointed(products)
    levels, level = here.withColumn("level", F.lit(0)), 0
    while (here.agg(F.max("block")).first()[0] or 0) > 0:
        here, level = checkpointed(joined_blocks(here, 2, reverse)), level + 1
        levels = levels.union(here.withColumn("level", F.lit(level)))
    return levels


def _pieces(block: int):
    """Pieces of windows, in their order: ranges within a block (level -1), and tree nodes over the blocks between."""

    def run(batches):
        for plan in batches:
            out = []
            for row in plan.itertuples(index=False):
                left, right = row.left, row.right
                a, b = left // block, right // block
                mine = [(-1, a, left, min(right, a * block + block - 1))]
                if a < b:
                    tail, lo, hi, level = [(-1, b, b * block, right)], a + 1, b, 0
                    while lo < hi:
                        if lo & 1:
                            mine.append((level, lo, 0, 0))
                            lo += 1
                        if hi & 1:
                            hi -= 1
                            tail.insert(0, (level, hi, 0, 0))
                        lo, hi, level = lo // 2, hi // 2, level + 1
                    mine += tail
                out += [(row.sample_id, row.lamda, row.window, row.k, row.t, left // block, place, *piece) for place, piece in enumerate(mine)]
            yield pd.DataFrame(out, columns=["sample_id", "lamda", "window", "k", "t", "head", "place", "level", "block", "a", "b"])

    return run


def _tree_entropy(intervals: DataFrame, plans: DataFrame, rates: Sequence[float], walk: bool, reverse: bool, block: int = 64) -> DataFrame:
    """window_entropy over a stored tree of block products: no group holds more than a block's kernels or its windows' pieces.

    A window is the end of its first block, the tree nodes that cover the blocks between, and the
    start of its last block.  Reversed, all is done over transposed kernels.
    """
    direction = "reverse" if reverse else "forward"
    tree = product_tree(block_products(intervals, rates, walk, reverse, block), reverse)
    nodes = tree.select("level", "block", "m", F.col("sample_id").alias("n_sample"), F.col("lamda").alias("n_lamda"))
    kinds = "sample_id long, lamda double, window double, k long, t double, head long, place int"
    wanted = _with_rates(plans, rates).select("sample_id", "lamda", F.col("window").cast("double").alias("window"), "k", "t", "left", "right")
    wanted = checkpointed(wanted.mapInPandas(_pieces(block), f"{kinds}, level int, block long, a long, b long"))
    names = [k.split()[0] for k in kinds.split(", ")]
    whole = wanted.where("level >= 0").join(nodes, ["level", "block"]).where((F.col("sample_id") == F.col("n_sample")) & (F.col("lamda") == F.col("n_lamda"))).select(*names, "m")

    def within(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(asked):
            return pd.DataFrame(columns=[*names, "m"])
        group = group.sort_values("k")
        mats = _kernels(group, int(group["n_nodes"].iloc[0]), float(group["lamda"].iloc[0]), walk)
        products = K.RangeProducts(mats.transpose(0, 2, 1) if reverse else mats)
        first, last = int(group["k"].iloc[0]), int(group["k"].iloc[-1])
        asked = asked.rename(columns={f"w_{c}": c for c in [*names, "a", "b"]})
        found = [products.query(max(a, first) - first, min(b, last) - first) for a, b in zip(asked["a"], asked["b"], strict=True)]
        asked["m"] = [(m.T if reverse else m).ravel() for m in found]
        return asked[[*names, "m"]]

    asked = wanted.where("level < 0").select(*(F.col(c).alias(f"w_{c}") for c in [*names, "block", "a", "b"]))
    parts = _blocks(intervals, rates, block).groupBy("sample_id", "lamda", "block").cogroup(asked.groupBy("w_sample_id", "w_lamda", "w_block")).applyInPandas(within, f"{kinds}, m array<double>")

    def entropies(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["k", "place"])
        n, out = int(round(len(group["m"].iloc[0]) ** 0.5)), []
        for (k, t), part in group.groupby(["k", "t"], sort=True):
            total = np.eye(n)
            for m in part["m"]:
                m = np.asarray(m).reshape(n, n)
                total = m @ total if reverse else total @ m
            out.append((k, t, K.entropy(total)))
        k, t, values = zip(*out, strict=True)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "lamda": group["lamda"].iloc[0], "window": group["window"].iloc[0], "direction": direction, "k": k, "t": t, "value": values})

    return parts.union(whole).groupBy("sample_id", "lamda", "window", "head").applyInPandas(entropies, "sample_id long, lamda double, window double, direction string, k long, t double, value double")


def window_entropy(intervals: DataFrame, plans: DataFrame, rates: Sequence[float], backend: str = "sliding", walk: bool = False, reverse: bool = False) -> DataFrame:
    """Entropy of the ordered product over each planned window.

    plans: (sample_id, window, k, t, left, right).  Result: (sample_id, lamda, window, direction,
    k, t, value).  backend: sliding (two products a window at most) or direct, which hold a sample's
    kernels at a rate in one task, or tree, which holds a block's.
    """
    if backend not in ("sliding", "tree", "direct"):
        raise ValueError(backend)
    if backend == "tree":
        return _tree_entropy(intervals, plans, rates, walk, reverse)
    direction = "reverse" if reverse else "forward"
    mats_side = _with_rates(intervals, rates)
    # both sides stem from one grid: new names keep them apart
    plan_side = _with_rates(plans, rates).select(F.col("sample_id").alias("p_sample"), F.col("lamda").alias("p_lamda"), *(F.col(c).alias(f"p_{c}") for c in ("window", "k", "t", "left", "right")))

    def run(mats_part: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if not len(mats_part) or not len(plan):
            return pd.DataFrame(columns=["sample_id", "lamda", "window", "direction", "k", "t", "value"])
        plan = plan.rename(columns={"p_sample": "sample_id", "p_lamda": "lamda"} | {f"p_{c}": c for c in ("window", "k", "t", "left", "right")})
        mats_part = mats_part.sort_values("k")
        n, rate = int(mats_part["n_nodes"].iloc[0]), float(mats_part["lamda"].iloc[0])
        mats = np.concatenate([_kernels(mats_part.iloc[at : at + 256], n, rate, walk) for at in range(0, len(mats_part), 256)])
        first, out = int(mats_part["k"].iloc[0]), []
        # a product from right to left is the transpose of one over transposed kernels
        flipped = np.ascontiguousarray(mats.transpose(0, 2, 1)) if reverse else mats
        for window, part in plan.sort_values(["window", "left", "right"]).groupby("window", sort=True):
            left, right = part["left"].to_numpy() - first, part["right"].to_numpy() - first
            if reverse:
                values = [K.entropy(m.T) for m in K.sliding_products(flipped, left, right)()]
            elif backend == "sliding":
                values = [K.entropy(m) for m in K.sliding_products(mats, left, right)()]
            else:
                values = [K.entropy(K.direct_product(mats, a, b)) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            out.append(pd.DataFrame({"sample_id": part["sample_id"], "lamda": rate, "window": window, "direction": direction, "k": part["k"], "t": part["t"], "value": values}))
        return pd.concat(out)

    grouped = mats_side.groupBy("sample_id", "lamda").cogroup(plan_side.groupBy("p_sample", "p_lamda"))
    return grouped.applyInPandas(run, "sample_id long, lamda double, window double, direction string, k long, t double, value double")


def running_products(matrices: DataFrame, n_nodes: DataFrame, keys: list[str], reverse: bool = False, tol: float = 1e-12, only_last: bool = False) -> DataFrame:
    """Ordered products of stored matrices (keys with sample_id..., k, i, j, v): cells after each k.

    Rows that are not stored stand for themselves.  Give an interval among the keys to start anew
    in each.  Every product's rows are normalized and what is at most tol is left out.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, out = int(group["n_nodes"].iloc[0]), []
        total = np.eye(n)
        ordered = sorted(group.groupby("k"), key=lambda g: g[0], reverse=reverse)
        for at, (k, part) in enumerate(ordered):
            i, j = part["i"].to_numpy(), part["j"].to_numpy()
            m = np.eye(n)
            m[np.unique(i)] = 0.0
            m[i, j] = part["v"].to_numpy()
            total = K.normalize_rows(total @ m)
            total[np.abs(total) <= tol] = 0.0
            if not only_last or at == len(ordered) - 1:
                x, y = np.nonzero(total)
                out.append(pd.DataFrame({"k": k, "i": x, "j": y, "v": total[x, y]}))
        made = pd.concat(out)
        for key in keys:
            made[key] = group[key].iloc[0]
        return made[[*keys, "k", "i", "j", "v"]]

    kinds = dict(matrices.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", k long, i long, j long, v double"
    return matrices.join(n_nodes, "sample_id").groupBy(*keys).applyInPandas(run, schema)


def component_exponentials(laplacian: DataFrame, components: DataFrame, keys: list[str], time: float) -> DataFrame:
    """exp(-time L) component by component: blocks of one matrix are independent tasks.

    laplacian: cells; components: (keys..., node, component).  Rows are normalized.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, (i, j) = np.unique(np.concatenate((group["i"], group["j"]))), (group["i"], group["j"])
        m = np.zeros((len(nodes), len(nodes)))
        m[np.searchsorted(nodes, i), np.searchsorted(nodes, j)] = group["v"]
        kernel = K.normalize_rows(K.general_exponential(-time * m))
        x, y = np.nonzero(kernel)
        out = pd.DataFrame({"i": nodes[x], "j": nodes[y], "v": kernel[x, y]})
        for key in keys:
            out[key] = group[key].iloc[0]
        return out[[*keys, "i", "j", "v"]]

    kinds = dict(laplacian.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i long, j long, v double"
    named = components.withColumnRenamed("node", "i")
    return laplacian.join(named, [*keys, "i"]).groupBy(*keys, "component").applyInPandas(run, schema)
