"""Connected components of a link table, distributed; and lineage cuts that survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "columns", "components", "cut", "fields", "release", "small_batches", "written"]


def columns(df: DataFrame) -> list:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fields(df: DataFrame, *but: str) -> list:
    """The columns of df out of a struct ``row``, save those named in ``but``: inner columns beside row cannot clash with them."""
    return [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in but]


def small_batches(spark, rows: int = 1000, size: int = 2 << 20) -> None:
    """Arrow batches of few rows and bytes, so that a worker never holds many texts at once (session settings; smaller ones are kept)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(key, str(most + 1)).removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder (with ``by``: in a folder for each value, more tightly packed): smaller than a checkpoint for rows of numbers."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more.

    What was made of them must be written itself.  The driver is asked to collect garbage, which lets Spark delete the shuffle files of finished jobs.
    """
    jvm, spark = tables[0].sparkSession.sparkContext._jvm, tables[0].sparkSession
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node of its component.

    Alternating star contraction: large-star links each larger neighbour to the least node around, small-star
    links each node's smaller neighbours to the least one; every pass at least squares the reach, and the
    tables never hold more rows than links.  Stops when a pass changes nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
