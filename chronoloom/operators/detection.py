"""Change-point detection and snapshot baselines: one grouped kernel a series or sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def _schema(frame: DataFrame, keys: list[str]) -> str:
    kinds = dict(frame.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def detect(signals: DataFrame, n_bkps: DataFrame, keys: list[str], order: str = "k", report: str = "t") -> DataFrame:
    """Kernel change points (linear kernel) of each series, as many as its sample has: (keys..., pred).

    signals: keys with sample_id, an order column, value and ``report``; n_bkps: (sample_id, n_bkps).
    A series too short for them gives none.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        x = group["value"].to_numpy(dtype=float)
        at = K.change_points(x, int(group["n_bkps"].iloc[0])) if np.isfinite(x).all() else []
        out = pd.DataFrame({"pred": group[report].to_numpy(dtype=float)[at]})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "pred"]]

    joined = signals.join(n_bkps, "sample_id").select(*keys, order, "value", *({report} - {order, *keys}), "n_bkps")
    return joined.groupBy(*keys).applyInPandas(run, _schema(signals, keys) + ", pred double")


def detect_penalized(signals: DataFrame, penalties: Sequence[float], keys: list[str], order: str = "k", report: str = "t") -> DataFrame:
    """Change points at the least cost plus a penalty a segment: (keys..., penalty, rank, signal_index, k, pred)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        x, out = group["value"].to_numpy(dtype=float), []
        penalty = float(group["penalty"].iloc[0])
        at = K.penalized_change_points(x, penalty) if np.isfinite(x).all() else []
        out = pd.DataFrame({"penalty": penalty, "rank": np.arange(1, len(at) + 1), "signal_index": at, "k": group[order].to_numpy()[at], "pred": group[report].to_numpy(dtype=float)[at]})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "penalty", "rank", "signal_index", "k", "pred"]]

    table = signals.sparkSession.createDataFrame([(float(p),) for p in penalties], "penalty double")
    each = signals.select(*keys, order, "value", *({report} - {order, *keys})).join(F.broadcast(table))  # a short list times each series
    return each.groupBy(*keys, "penalty").applyInPandas(run, _schema(signals, keys) + ", penalty double, rank long, signal_index long, k long, pred double")


def _matrices(group: pd.DataFrame, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Dense symmetric snapshots of a sample: (index values, stack)."""
    n = int(group["n_nodes"].iloc[0])
    group = group.sort_values("bin")
    mats = np.zeros((len(group), n, n))
    for x, (i, j, v) in enumerate(zip(group["ii"], group["jj"], group["vv"], strict=True)):
        i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
        mats[x, i, j] = mats[x, j, i] = np.asarray(v, dtype=float) if weighted else 1.0
    return group["bin"].to_numpy(), mats


def packed_snapshots(cells: DataFrame, bins: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """One row a snapshot, empty ones too; cells: (sample_id, bin, i, j[, v]) with i < j."""
    v = F.col("v") if "v" in cells.columns else F.lit(1.0)
    lists = cells.groupBy("sample_id", "bin").agg(F.collect_list(F.struct("i", "j", v.alias("v"))).alias("e"))
    none, nothing = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    return (
        bins.join(lists, ["sample_id", "bin"], "left")
        .join(n_nodes, "sample_id")
        .select("sample_id", "n_nodes", "bin", F.coalesce(F.transform("e", lambda x: x["i"]), none).alias("ii"), F.coalesce(F.transform("e", lambda x: x["j"]), none).alias("jj"), F.coalesce(F.transform("e", lambda x: x["v"]), nothing).alias("vv"))
    )


def _laplacians(mats: np.ndarray, normalized: bool) -> np.ndarray:
    if normalized:
        return np.stack([K.normalized_laplacian(m) for m in mats])
    return np.eye(mats.shape[1]) * mats.sum(axis=2)[:, :, None] - mats


def _per_sample(snapshots: DataFrame, compute, extra: str = "value double") -> DataFrame:
    return snapshots.groupBy("sample_id").applyInPandas(compute, f"sample_id long, bin long, {extra}")


def laplacian_signatures(snapshots: DataFrame, n_eigen: int, normalized: bool = False, top: bool = True) -> DataFrame:
    """(sample_id, bin, signature): greatest (least) singular values of each Laplacian, of length 1."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "signature": [K.singular_signature(m, n_eigen, top) for m in _laplacians(mats, normalized)]})

    return _per_sample(snapshots, run, "signature array<double>")


def spectrum_signal(signatures: DataFrame, window: int, second: int | None = None, difference: bool = False) -> DataFrame:
    """1 - |<signature, direction of the ones before>|, of two windows the greater; optionally its first difference."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        s = np.stack(group["signature"].to_numpy())
        value = K.window_scores(s, window)
        if second is not None:
            value = np.maximum(value, K.window_scores(s, second))
        if difference:
            value = np.diff(value, prepend=value[:1])
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": group["bin"], "value": value})

    return _per_sample(signatures, run)


def second_window(window: int, scale: float | None) -> int | None:
    return None if scale is None else max(window + 1, round(scale * window))


def procrustes_signal(snapshots: DataFrame, window: int, n_eigen: int = 2, difference: bool = False, normalized: bool = False, metric: str = "procrustes") -> DataFrame:
    """Mean distance of each snapshot's Laplacian subspace to those of the ``window`` before."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        spaces = [np.linalg.eigh(m)[1][:, :n_eigen] for m in _laplacians(mats, normalized)]
        distance = K.SUBSPACE_DISTANCES[metric]
        value = np.array([np.mean([distance(K.principal_angles(spaces[k], spaces[b])) for b in range(k - window, k)]) for k in range(window, len(spaces))])
        index = index[window:]
        if difference:
            value, index = np.abs(np.diff(value)), index[1:]
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "value": value})

    return _per_sample(snapshots, run)


def cumulative_sum_signal(snapshots: DataFrame, window: int) -> DataFrame:
    """Inner product of the changes of mean adjacency that even and odd snapshots see, normalized."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        out = np.zeros(len(mats))
        for k in range(window, len(mats) - window + 1):
            before, after = mats[k - window : k], mats[k : k + window]
            if window < 2:
                continue
            a, b = after[0::2].mean(axis=0) - before[0::2].mean(axis=0), after[1::2].mean(axis=0) - before[1::2].mean(axis=0)
            below = np.linalg.norm(a) * np.linalg.norm(b)
            out[k] = (a * b).sum() / below if below > 0 else 0.0
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "value": out})

    return _per_sample(snapshots, run)


def spectral_norm_signal(snapshots: DataFrame, window: int) -> DataFrame:
    """Spectral norm of the change of mean adjacency over windows on both sides."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        out = np.zeros(len(mats))
        for k in range(window, len(mats) - window + 1):
            out[k] = np.linalg.norm(mats[k : k + window].mean(axis=0) - mats[k - window : k].mean(axis=0), 2)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "value": out})

    return _per_sample(snapshots, run)


def spectral_clustering_signal(snapshots: DataFrame, window: int, n_eigen: int, normalized: bool = False, seed: int = 0) -> DataFrame:
    """Distance of the cluster centres that spectral clustering finds on both sides of each snapshot."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        out = np.zeros(len(mats))

        def smoothed(part: np.ndarray) -> np.ndarray:
            space = K.embedding(part.mean(axis=0), n_eigen, normalized)
            label = K.k_means(space, n_eigen, seed)
            centres = np.stack([space[label == c].mean(axis=0) if (label == c).any() else np.zeros(n_eigen) for c in range(n_eigen)])
            return centres[label]

        for k in range(window, len(mats) - window + 1):
            angles = np.linalg.svd(smoothed(mats[k - window : k]).T @ smoothed(mats[k : k + window]), compute_uv=False)
            out[k] = float(angles.sum())
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "value": out})

    return _per_sample(snapshots, run)


def subspace_distances(pairs: DataFrame, key: str, metric: str = "grassmann") -> DataFrame:
    """pairs: (key, side 0 or 1, row, vec): distance of the spaces that the columns of both sides span."""
    distance = K.SUBSPACE_DISTANCES[metric]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [np.stack(g.sort_values("row")["vec"].to_numpy()) for _, g in group.groupby("side", sort=True)]
        value = distance(K.principal_angles(*sides)) if len(sides) == 2 and sides[0].shape == sides[1].shape else float("nan")
        return pd.DataFrame({key: [group[key].iloc[0]], "distance": [value]})

    return pairs.groupBy(key).applyInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, distance double")


def graph_spectra(snapshots: DataFrame) -> DataFrame:
    """(sample_id, bin, value): spectral gap of each snapshot."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": index, "value": [K.spectral_gap(m) for m in mats]})

    return _per_sample(snapshots, run)


def node_embeddings(snapshots: DataFrame, k: int, kind: str = "laplacian") -> DataFrame:
    """(sample_id, bin, node, vec): Laplacian eigenvectors or closed-walk profiles of each node."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index, mats = _matrices(group)
        out = []
        for x, m in zip(index, mats, strict=True):
            e = K.embedding(m, k) if kind == "laplacian" else K.return_profile(m, k)
            out.append(pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "bin": x, "node": np.arange(len(e)), "vec": list(e)}))
        return pd.concat(out)

    return snapshots.groupBy("sample_id").applyInPandas(run, "sample_id long, bin long, node long, vec array<double>")


def balanced_pairs(items: DataFrame, per_class: int, seed: int = 0, reach: int | None = None) -> DataFrame:
    """(a, b, same): seeded pairs of (k, label) rows, equally many of both kinds, within ``reach`` if given."""
    from .series import pairs_within

    if reach is None:
        raise ValueError("pairs need a reach: all pairs of a long series are no table to build")
    near = pairs_within(items.withColumn("_g", F.lit(0)), reach, ["_g"]).select(F.col("k_before").alias("a"), F.col("k").alias("b"))
    named = near.join(items.select(F.col("k").alias("a"), F.col("label").alias("_x")), "a").join(items.select(F.col("k").alias("b"), F.col("label").alias("_y")), "b")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "a", "b").cast("binary"))
    marked = named.select("a", "b", (F.col("_x") == F.col("_y")).alias("same"), draw.alias("_d"))
    # the least draws of each kind: every task sends its own least ones only
    kinds = [marked.where(F.col("same") == same).orderBy("_d", "a", "b").limit(per_class) for same in (True, False)]
    return kinds[0].union(kinds[1]).drop("_d")


def pair_losses(pairs: DataFrame, margin: float = 1.0, weight: float = 1.0) -> DataFrame:
    """Mean contrastive loss of distances and hinge loss of similarities, from (y, distance, similarity)."""
    d, s, y = F.col("distance"), F.col("similarity"), F.col("y")
    contrastive = ((1 - y) * F.greatest(F.lit(margin) - d, F.lit(0.0)) + y * d) / 2
    hinge = ((1 - y) * weight * F.greatest(s + margin, F.lit(0.0)) + y * F.greatest(margin - s, F.lit(0.0))) / 2
    return pairs.agg(F.avg(contrastive).alias("contrastive"), F.avg(hinge).alias("hinge"))
