"""Live views of a contact stream: snapshots of pairs and the number of active events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_snapshots(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Contacts of each unordered pair per tumbling window; stream: ts, src, dst.

    Windows close once the watermark has passed them; later rows are dropped by the watermark.
    """
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
        .agg(F.count("*").alias("contacts"))
        .select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "i", "j", "contacts")
    )


def net_changes(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Starts less ends in each window; their running sum is the active count.  stream: ts, ends_at."""
    both = stream.select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ends_at").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("x.at", "x.d")
    return both.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.sum("d").alias("change")).select(F.col("window.start").alias("w_start"), "change")
