"""Relational operators on intervals: merging, clipping, grids, as-of and interval joins, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_overlaps(events: DataFrame) -> DataFrame:
    """Unite overlapping events of each undirected pair; touching ones stay apart.

    An island starts where no earlier event of the pair still lasts.
    """
    pair = Window.partitionBy("sample_id", "lo", "hi").orderBy("t_start", "t_end", "event_id")
    before = F.max("t_end").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.select("*", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).withColumn(
        "_new", F.when(before.isNull() | (F.col("t_start") >= before), 1).otherwise(0)
    )
    islands = marked.withColumn("_island", F.sum("_new").over(pair))
    first = F.struct("t_start", "t_end", "event_id")
    return (
        islands.groupBy("sample_id", "lo", "hi", "_island")
        .agg(F.min_by("event_id", first).alias("event_id"), F.min_by("src", first).alias("src"), F.min_by("dst", first).alias("dst"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
        .select("sample_id", "event_id", "src", "dst", "t_start", "t_end")
    )


def overlapping(events: DataFrame, start: float | Column, end: float | Column) -> DataFrame:
    """Events active in [start, end); both bounds reach the scan."""
    return events.where((F.col("t_start") < end) & (F.col("t_end") > start))


def overlap_length(start: float | Column, end: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.least("t_end", lit(end)) - F.greatest("t_start", lit(start))


def trim(events: DataFrame, head: float, tail: float, clip: bool = True, align_first: bool = True) -> DataFrame:
    """Keep what is active in (head, tail), clip to it and shift time to 0.

    align_first: the sample's first kept start becomes 0; otherwise head does.
    """
    kept = events.where((F.col("t_end") > head) & (F.col("t_start") < tail))
    if clip:
        kept = kept.withColumns({"t_start": F.greatest("t_start", F.lit(head)), "t_end": F.least("t_end", F.lit(tail))})
    zero = F.min("t_start").over(Window.partitionBy("sample_id")) if align_first else F.lit(head)
    return kept.withColumn("_zero", zero).withColumns({"t_start": F.col("t_start") - F.col("_zero"), "t_end": F.col("t_end") - F.col("_zero")}).drop("_zero")


def warm_up_time(density: float, inter_tau: float) -> float:
    """Time after which an empty event process has become stationary."""
    import math

    x = density * inter_tau
    return -inter_tau * math.log((-1 + math.sqrt(1 + 4 * x)) / (2 * x))


def active_count(events: DataFrame) -> DataFrame:
    """Step function of the number of active events; times without a net change are left out."""
    deltas = events.select("sample_id", F.explode(F.array(F.struct(F.col("t_start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t_end").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    net = deltas.select("sample_id", "x.t", "x.d").groupBy("sample_id", "t").agg(F.sum("d").alias("d")).where("d != 0")
    return net.select("sample_id", "t", F.sum("d").over(Window.partitionBy("sample_id").orderBy("t")).alias("active"))


def event_edges(events: DataFrame) -> DataFrame:
    """Two rows an event: its start and its end."""
    both = F.array(F.struct(F.col("t_start").alias("t"), F.lit(True).alias("is_start")), F.struct(F.col("t_end").alias("t"), F.lit(False).alias("is_start")))
    return events.select("sample_id", "event_id", F.explode(both).alias("x")).select("sample_id", "x.t", "event_id", "x.is_start")


def time_grid(events: DataFrame) -> DataFrame:
    """Distinct times of each sample as (k, t, tau); tau is null at the last."""
    times = event_edges(events).select("sample_id", "t").distinct()
    order = Window.partitionBy("sample_id").orderBy("t")
    return times.select("sample_id", (F.row_number().over(order) - 1).cast("long").alias("k"), "t", (F.lead("t").over(order) - F.col("t")).alias("tau"))


def default_rate(grid: DataFrame) -> DataFrame:
    """One over the median interval of each sample."""
    return grid.groupBy("sample_id").agg((1 / F.expr("median(tau)")).alias("lamda"))


def as_of(grid: DataFrame, times: DataFrame) -> DataFrame:
    """Last grid time at or before each (sample_id, at); before the grid, its first time.

    One sorted pass over the union of both sides, no join.
    """
    both = grid.select("sample_id", F.col("t").alias("x"), F.col("k"), F.lit(0).alias("side")).union(times.select("sample_id", "at", F.lit(None).cast("long"), F.lit(1)))
    order = Window.partitionBy("sample_id").orderBy("x", "side")
    here = F.struct(F.col("k"), F.col("x").alias("t"))
    last = F.last(F.when(F.col("side") == 0, here), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.when(F.col("side") == 0, here), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = both.select("sample_id", F.col("x").alias("at"), F.coalesce(last, first).alias("m"), "side").where("side = 1")
    return found.select("sample_id", "at", F.col("m.k").alias("k"), F.col("m.t").alias("t"))


def interval_edges(events: DataFrame, merged: bool = False) -> DataFrame:
    """(sample_id, k, i, j), i < j: the pairs in contact in each interval of the time grid, self-loops apart.

    The grid holds all starts and ends, so an event covers the whole intervals from its start's
    rank to before its end's.  One ranking of the times gives both; no join is needed, and what
    explodes is the result itself.  Events of ``merge_overlaps`` name a pair once an interval, so
    with ``merged`` the cells need no further shuffle.
    """
    ends = events.select("sample_id", "event_id", "src", "dst", "t_start", "t_end", F.explode(F.array("t_start", "t_end")).alias("t"))
    ranked = ends.withColumn("k", (F.dense_rank().over(Window.partitionBy("sample_id").orderBy("t")) - 1).cast("long"))
    spans = ranked.groupBy("sample_id", "event_id", "src", "dst", "t_start", "t_end").agg(F.min("k").alias("k0"), F.max("k").alias("k1")).where("src != dst and k1 > k0")
    cells = spans.select("sample_id", F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k"), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    return cells if merged else cells.distinct()


def range_join(events: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Events active in each window (sample_id, w_start, w_end, ...), by time buckets of ``width``.

    Each side is listed under the buckets it covers; a pair is kept in the first bucket they share.
    """
    e = events.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t_start") / width), F.floor(F.col("t_end") / width))))
    w = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("w_start") / width), F.floor(F.col("w_end") / width))))
    joined = e.join(w, ["sample_id", "bucket"]).where("t_start < w_end and t_end > w_start")
    first = F.greatest(F.floor(F.col("t_start") / width), F.floor(F.col("w_start") / width))
    return joined.where(F.col("bucket") == first).drop("bucket")


def snapshots(events: DataFrame, width: float, skip: int = 0) -> DataFrame:
    """(sample_id, bin, i, j), i < j: presence of pairs in tumbling windows.

    Windows are those of range(skip * width, int(t_last - width), width), so the last one may be missing.
    """
    last = F.max("t_end").over(Window.partitionBy("sample_id"))
    top = F.ceil((F.floor(last - width) - skip * width) / width).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("t_start") - skip * width) / width)).cast("long")
    final = F.least(F.col("_top") - 1, F.ceil((F.col("t_end") - skip * width) / width).cast("long") - 1)
    kept = events.where("src != dst").withColumn("_top", top).withColumn("_a", first).withColumn("_b", final).where("_b >= _a")
    return kept.select("sample_id", F.explode(F.sequence("_a", "_b")).alias("bin"), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()


def breakpoint_bins(breakpoints: DataFrame, width: float, skip: int = 0, odd_only: bool = False) -> DataFrame:
    """Snapshot bins of (sample_id, bkp, n_bins): distinct ones, or those that hold an odd number."""
    binned = breakpoints.select("sample_id", (F.floor(F.col("bkp") / width) - skip).cast("long").alias("bin"), "n_bins").where("bin > 0 and bin < n_bins")
    counted = binned.groupBy("sample_id", "bin").agg(F.count("*").alias("n"))
    return (counted.where("n % 2 = 1") if odd_only else counted).select("sample_id", "bin")


def time_slices(events: DataFrame, width: float) -> DataFrame:
    """Events cut at multiples of ``width``: one row for each slice they reach into, clipped to it."""
    first = F.floor(F.col("t_start") / width)
    last = F.greatest(first, F.ceil(F.col("t_end") / width) - 1)
    cut = events.withColumn("slice", F.explode(F.sequence(first, last)))
    return cut.withColumns({"t_start": F.greatest("t_start", F.col("slice") * width), "t_end": F.least("t_end", (F.col("slice") + 1) * width)})
