"""Event tables: construction, validation and node dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENTS


def from_lists(
    spark: SparkSession,
    sources: Sequence,
    targets: Sequence,
    starts: Sequence[float],
    ends: Sequence[float],
    sample_id: int = 0,
    extra: dict[str, Sequence] | None = None,
    relabel: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(events, nodes) from parallel lists; labels get dense ids in sorted order.

    Small inputs only: the lists are on the driver to begin with.
    """
    lengths = {len(x) for x in (sources, targets, starts, ends, *(extra or {}).values())}
    if len(lengths) > 1:
        raise ValueError("sources, targets, times and attributes must be equally long")
    if any(a > b for a, b in zip(starts, ends, strict=True)):
        raise ValueError("an event ends before it starts")
    labels = sorted(set(sources) | set(targets))
    ids = {x: i for i, x in enumerate(labels)} if relabel else {x: int(x) for x in labels}
    order = sorted(range(len(sources)), key=lambda e: (starts[e], ends[e]))
    rows = [(sample_id, n, ids[sources[e]], ids[targets[e]], float(starts[e]), float(ends[e])) for n, e in enumerate(order)]
    events = spark.createDataFrame(rows, EVENTS)
    if extra:
        named = spark.createDataFrame([(n, *(str(v[e]) for v in extra.values())) for n, e in enumerate(order)], ["event_id", *extra])
        events = events.join(named, "event_id").select(*EVENTS.names, *extra)
    nodes = spark.createDataFrame([(sample_id, ids[x], str(x)) for x in labels], "sample_id long, node long, label string")
    return events, nodes


def relabel(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense node ids per sample in sorted-label order; columns src and dst are labels of any type."""
    labels = events.select("sample_id", F.col("src").alias("label")).union(events.select("sample_id", "dst")).distinct()
    ranked = labels.withColumn("node", (F.row_number().over(Window.partitionBy("sample_id").orderBy("label")) - 1).cast("long"))
    a = ranked.select("sample_id", F.col("label").alias("src"), F.col("node").alias("_a"))
    b = ranked.select("sample_id", F.col("label").alias("dst"), F.col("node").alias("_b"))
    joined = events.join(a, ["sample_id", "src"]).join(b, ["sample_id", "dst"])
    return joined.withColumns({"src": F.col("_a"), "dst": F.col("_b")}).select(*events.columns), ranked.select("sample_id", "node", "label")


def nodes_of(events: DataFrame) -> DataFrame:
    return events.select("sample_id", F.col("src").alias("node")).union(events.select("sample_id", "dst")).distinct()


def node_counts(events: DataFrame) -> DataFrame:
    return nodes_of(events).groupBy("sample_id").agg(F.count("*").alias("n_nodes"))


def with_durations(events: DataFrame) -> DataFrame:
    return events.withColumn("duration", F.col("t_end") - F.col("t_start"))


def invalid(events: DataFrame) -> DataFrame:
    """Rows that no operator accepts: null ids or times, or an end before the start."""
    return events.where("sample_id is null or src is null or dst is null or t_start is null or t_end is null or t_end < t_start")


def one_sample(events: DataFrame, sample_id: int) -> DataFrame:
    return events.where(F.col("sample_id") == sample_id)


def until_grid_index(events: DataFrame, grid: DataFrame, index: int) -> DataFrame:
    """Events that end by grid time ``index``; the node dimension stays as it was."""
    cut = grid.where(F.col("k") == index).select("sample_id", F.col("t").alias("_cut"))
    return events.join(cut, "sample_id").where("t_end <= _cut").drop("_cut")


def day_and_seconds(column: str) -> tuple[Column, Column]:
    """Days since 1970 and seconds of the day of a timestamp without time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.floor(micros / 86_400_000_000).cast("long"), F.pmod(micros, F.lit(86_400_000_000)) / 1e6


def contacts(spark: SparkSession, sf_dir: str, cohorts: int = 20) -> DataFrame:
    """A temporal network from the table ``events``: one sample a day.

    A user's cohort is in contact with the cohort of the next user of that day, from the event
    on for a time that its value sets; contacts of a cohort with itself are no edges.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    day, seconds = day_and_seconds("ts")
    order = Window.partitionBy("sample_id").orderBy("ts", "event_id")
    return (
        table.select(day.alias("sample_id"), "event_id", "ts", F.pmod("user_id", F.lit(cohorts)).alias("src"), seconds.alias("t_start"), "value")
        .withColumn("dst", F.lead("src").over(order))
        .where("dst is not null and src != dst")
        .select("sample_id", "event_id", "src", "dst", "t_start", (F.col("t_start") + F.col("value") * 10 + 60).alias("t_end"))
    )


CONTACTS_SQL = """
contacts AS (
  SELECT * FROM (
    SELECT sample_id, event_id, src, lead(src) OVER (PARTITION BY sample_id ORDER BY ts, event_id) AS dst, t_start, t_start + value * 10 + 60 AS t_end
    FROM (SELECT epoch_us(ts) // 86400000000 AS sample_id, event_id, ts, user_id % 20 AS src, (epoch_us(ts) % 86400000000) / 1e6 AS t_start, value FROM events)
  ) WHERE dst IS NOT NULL AND src <> dst)
"""
