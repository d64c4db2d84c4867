"""Exact nearest-rank percentiles without collecting a group.

Rank of p among n values: round(p / 100 * (n - 1)), half away from zero.  Equal values are counted once; a logarithmic histogram finds
the bucket of every wanted rank; only those buckets' distinct values are ordered.  No group and no run of ties meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-6))) * 8).cast("int") + 1000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """keys and one column a percentile; df holds no null values in ``value``."""
    counted = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("b", _bucket(F.col("v")))
    hist = counted.groupBy(*keys, "b").agg(F.sum("c").alias("c"))
    run, whole = Window.partitionBy(*keys).orderBy("b"), Window.partitionBy(*keys)
    hist = hist.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    wanted = F.array(*[F.struct(F.lit(k).alias("p"), F.round(F.lit(q / 100) * (F.col("n") - 1)).cast("long").alias("r")) for k, q in percents.items()])
    at = hist.select(*keys, "b", "c", "upto", F.explode(wanted).alias("w")).where("w.r < upto and w.r >= upto - c")
    at = at.select(*keys, "b", F.col("w.p").alias("p"), (F.col("w.r") - (F.col("upto") - F.col("c"))).alias("r"))
    near = at.groupBy(*keys, "b").agg(F.collect_list(F.struct("p", "r")).alias("ws"))
    inside = counted.join(near, [*keys, "b"])
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v")))
    picked = inside.select(*keys, "v", "c", "upto", F.explode("ws").alias("w")).where("w.r < upto and w.r >= upto - c")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("w.p") == k, F.col("v"))).alias(k) for k in percents])


def duration_stats(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """keys, count, total, least, mean, percentiles, largest of ``value``."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return sums.withColumn("mean", F.col("total") / F.col("count")).join(nearest_ranks(df, keys, value, percents), keys)
