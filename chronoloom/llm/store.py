"""Shared-folder storage for intermediate tables.

Lineage is cut by tables written below ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor only repeats the tasks it ran.  Only where that setting is
absent (tests on one machine) a folder below ``/tmp`` takes its place.  Intermediate tables
last as long as the program, since results are read lazily; it removes them when it ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
FALLBACK_DIR = os.path.join(tempfile.gettempdir(), "chronoloom-checkpoints")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; set only where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{FALLBACK_DIR}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for files that tasks write themselves; it goes when the program ends."""
    path = new_path(spark, name)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.append((spark, path))
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_hash(rows: DataFrame, salt: int) -> Column:
    """A 64-bit hash of all columns; nulls count by their place, columns that hold maps by their JSON."""
    columns = [F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in rows.dtypes]
    return F.xxhash64(F.lit(salt), *columns, *[F.col(f"`{c}`").isNull() for c in rows.columns])


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on any Hadoop file system."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(jpath, True)


def forget_last(spark: SparkSession, n: int = 1) -> None:
    """Remove the nth last table of :func:`materialize`, once nothing reads it any more."""
    if len(_made) >= n:
        delete(spark, _made.pop(-n)[1])


def tables_made() -> int:
    return len(_made)


def forget_since(spark: SparkSession, start: int, keep: int = 1) -> None:
    """Remove the tables made since :func:`tables_made` gave ``start``, but for the last ``keep``, once nothing reads them any more."""
    for _, path in _made[start : len(_made) - keep]:
        delete(spark, path)
    del _made[start : len(_made) - keep]


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        with suppress(Exception):  # the gateway may be gone
            delete(spark, path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
