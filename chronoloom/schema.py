"""Relations of a temporal network.

A network is a set of tables that share ``sample_id``: many networks are one table, and every
operator works on all samples at once.
"""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("t_start", T.DoubleType()),
        T.StructField("t_end", T.DoubleType()),
    ]
)
NODES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("label", T.StringType())])
GRID = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("tau", T.DoubleType())])
CELLS = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
SIGNAL = "sample_id long, lamda double, window double, direction string, k long, t double, value double"
