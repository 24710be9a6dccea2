"""Stored relations of networks, transition matrices, signals and result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine without it a folder below /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/chronoloom-checkpoints"


def kept(frame: DataFrame) -> DataFrame:
    """The table, written to a new folder below the shared one and read back with the size it has."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def save_network(folder: str, overwrite: bool = False, **relations: DataFrame) -> None:
    """Write each named relation (events, nodes, grid, cells, ...) as a Parquet table below folder."""
    for name, frame in relations.items():
        frame.write.mode("overwrite" if overwrite else "ignore").parquet(f"{folder}/{name}")


def load_network(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def save_transitions(matrices: DataFrame, path: str, keys: list[str] | None = None, tol: float | None = None, as_deltas: bool = False, replace: bool = False) -> None:
    """Cells partitioned by rate (and the settling time of linear ones, if there).

    as_deltas: the first matrix of each sample, then changes.  Kept as they are if already there.
    """
    keys = keys or [k for k in ("sample_id", "lamda", "settle") if k in matrices.columns]
    if tol is not None:
        matrices = cells.drop_small(matrices, [*keys, "k"] if "k" in matrices.columns else keys, tol, absolute=True)
    if as_deltas:
        matrices = cells.deltas(matrices, keys, tol=0.0)
    by = [k for k in ("lamda", "settle") if k in matrices.columns]
    matrices.write.mode("overwrite" if replace else "ignore").option("compression", "zstd").partitionBy(*by).parquet(path)


def load_transitions(spark: SparkSession, path: str, lamda: float | None = None, as_deltas: bool = False) -> DataFrame:
    """Reads one rate's partition if lamda is given; deltas come back as running sums at their changes."""
    found = spark.read.parquet(path)
    if lamda is not None:
        found = found.where(F.abs(F.col("lamda") - lamda) <= 1e-8 + 1e-5 * abs(lamda))
    return cells.restore(found, [k for k in ("sample_id", "lamda", "settle") if k in found.columns]) if as_deltas else found


def save_signals(signals: DataFrame, path: str, replace: bool = False) -> None:
    signals.write.mode("overwrite" if replace else "ignore").partitionBy("lamda", "window", "direction").parquet(path)


def load_signal(spark: SparkSession, path: str, lamda: float, window: float, reverse: bool = False) -> DataFrame:
    """One signal; only its partition is read."""
    near = lambda c, x: F.abs(F.col(c) - x) <= 1e-8 + 1e-5 * abs(x)
    return spark.read.parquet(path).where(near("lamda", lamda) & near("window", window) & (F.col("direction") == ("reverse" if reverse else "forward")))


def signal_name(lamda: float, window: float, reverse: bool = False) -> str:
    return f"signal_lamda_{lamda:.11f}_window_{window:g}{'_rev' if reverse else ''}"


def penalty_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a penalty, arrays joined by spaces; found: keys, penalty, rank, signal_index, k, pred (seconds)."""
    rows = found.groupBy(*keys, "penalty").agg(F.array_sort(F.collect_list(F.struct("rank", "signal_index", "k", "pred"))).alias("r"))
    joined = lambda f: F.concat_ws(" ", F.transform("r", f))
    return rows.select(
        *keys,
        "penalty",
        F.size("r").alias("num_change_points"),
        joined(lambda x: x["signal_index"].cast("string")).alias("change_point_indices"),
        joined(lambda x: x["k"].cast("string")).alias("change_point_k_samples"),
        joined(lambda x: x["pred"].cast("string")).alias("change_point_t_seconds"),
        joined(lambda x: (x["pred"] / 3600).cast("string")).alias("change_point_t_hours"),
    )


def change_points_long(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, "penalty", F.col("rank").alias("change_point_rank"), "signal_index", F.col("k").alias("k_sample"), F.col("pred").alias("t_seconds"), (F.col("pred") / 3600).alias("t_hours"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)
