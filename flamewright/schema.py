"""Canonical schemas.

``seq`` is the position in the trace's event array; every order-dependent operator sorts by it.  Ids are DECIMAL(20,0), wide
enough for unsigned 64-bit values.  ``trace_id`` keys every table, so many traces are one DataFrame.
"""

from pyspark.sql import types as T

ID = T.DecimalType(20, 0)

EVENTS = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ph", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("dur", T.DoubleType()),
        T.StructField("tid", ID),
        T.StructField("pid", ID),
        T.StructField("id", ID),
        T.StructField("cat", T.StringType()),
        T.StructField("args", T.StringType()),
    ]
)

CPU_NODES = "trace_id string, node_id decimal(20,0), name string, url string, parent decimal(20,0)"
