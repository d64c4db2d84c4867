"""Reading trace files: one JSON object with ``traceEvents``, plain or gzipped, one file or a folder.

Files are read by Spark's own JSON source, so any store and any number of files work; a file is one task, save that ``read_lines`` splits large files
that hold one event a line.  Persist the result with ``save`` (Parquet by trace, ordered by time) and later queries read only the columns and row groups they need.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import EVENTS, ID

_RAW = T.StructType(
    [
        T.StructField(
            "traceEvents",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("ph", T.StringType()),
                        T.StructField("ts", T.DoubleType()),
                        T.StructField("dur", T.VariantType()),
                        T.StructField("tid", T.VariantType()),
                        T.StructField("pid", T.VariantType()),
                        T.StructField("id", T.VariantType()),
                        T.StructField("cat", T.StringType()),
                        T.StructField("args", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("cpuThrottling", T.DoubleType()),
                    T.StructField("source", T.StringType()),
                    T.StructField("startTime", T.StringType()),
                    T.StructField("networkThrottling", T.StringType()),
                    T.StructField("hardwareConcurrency", T.IntegerType()),
                    T.StructField("hostDPR", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def trace_stem(path: str) -> str:
    return re.sub(r"(\.json)?(\.gz)?$", "", path.rsplit("/", 1)[-1])


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.substring_index(path, "/", -1)), r"(\.json)?(\.gz)?$", "")


def file_system(spark: SparkSession, name: str):
    """(path, file system that Spark reads it with)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, name: str) -> bool:
    path, fs = file_system(spark, name)
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def put_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small text through Spark's file system."""
    path, fs = file_system(spark, name)
    fs.setWriteChecksum(False)
    out = fs.create(path, True)
    out.write(text.encode())
    out.close()


def list_traces(spark: SparkSession, folder: str) -> list[str]:
    """Paths of *.json and *.json.gz in the folder, one a stem (the gzipped one wins), by stem; listed through Spark's file system."""
    path, fs = file_system(spark, folder)
    best: dict[str, str] = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isFile() and re.search(r"\.json(\.gz)?$", name):
            stem = trace_stem(name)
            if stem not in best or name.endswith(".gz"):
                best[stem] = status.getPath().toString()
    return [best[s] for s in sorted(best)]


def unsigned(v: Column) -> Column:
    """A VARIANT that holds a non-negative JSON integer below 2**64, else null."""
    kind = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "decimal(20,0)")
    big = whole > F.lit(2**63 - 1).cast(ID)
    return F.when(((kind == "BIGINT") | (kind.startswith("DECIMAL") & big)) & (whole >= 0), whole)


def _raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.schema(_RAW).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    return read.withColumn("trace_id", _stem(F.col("_metadata.file_path")))


def read_traces(spark: SparkSession, paths: list[str] | str, check: bool = True) -> DataFrame:
    """Events of all files, trace_id being the file's stem.  With check a broken file or a wrongly typed field raises at run time."""
    raw = _raw(spark, [paths] if isinstance(paths, str) else list(paths))
    if check:
        bad = F.col("traceEvents").isNull()
        raw = raw.withColumn("traceEvents", F.when(bad, F.raise_error(F.concat(F.lit("not a trace: "), F.col("trace_id")))).otherwise(F.col("traceEvents")))
    return _events(raw.select("trace_id", F.posexplode("traceEvents").alias("seq", "e")), check)


def read_lines(spark: SparkSession, paths: list[str] | str, check: bool = True) -> DataFrame:
    """Events of files that hold one event a line, as tracing tools write them; a plain file is split over as many tasks as its size asks for.

    seq follows the order in the file, with gaps; args lose white space between their parts.  A line is an event if it begins with an object that is not the head of the file (what follows
    "traceEvents": [ in a line counts as its own line); commas and whatever stands behind the event are passed over.  With check a line that begins like an
    event and is none raises at run time, so a file laid out otherwise does not pass unnoticed.
    """
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    line = F.regexp_replace(F.ltrim("value"), r'^\{?\s*(?:"metadata"\s*:\s*\{[^{}]*\}\s*,\s*)?"traceEvents"\s*:\s*\[\s*', "")
    # Rows of one split come in order; a split holds at most 2**23 lines of an event.
    place = F.col("_metadata.file_block_start") * 2**23 + F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    rows = text.select(_stem(F.col("_metadata.file_path")).alias("trace_id"), place.alias("seq"), line.alias("line")).where("line like '{_%'")
    event = T.StructType([*_RAW["traceEvents"].dataType.elementType.fields, T.StructField("_broken", T.StringType())])
    # Inside transform the schema is not pruned to the fields that are asked for; pruned to the broken record alone, every record would count as one.
    parsed = F.transform(F.array("line"), lambda x: F.from_json(x, event, {"columnNameOfCorruptRecord": "_broken"}))
    rows = rows.withColumn("e", F.get(parsed, 0))
    if check:
        broken = F.raise_error(F.concat(F.lit("not one event a line: "), F.col("trace_id"))).cast(event)
        # The test of the line stands here again because Spark may work this out ahead of the filter.
        rows = rows.withColumn("e", F.when(F.col("line").like("{_%") & F.col("e._broken").isNotNull(), broken).otherwise(F.col("e")))
    return _events(rows.where("e.name is not null or e.ph is not null"), check)


def _events(e: DataFrame, check: bool) -> DataFrame:
    """The event table of rows (trace_id, seq, e)."""

    def ident(name: str) -> Column:
        v = F.col(f"e.{name}")
        plain = unsigned(v)
        absent = v.isNull()
        if not check:
            return F.coalesce(plain, F.lit(0).cast(ID))
        wrong = F.raise_error(F.concat(F.lit(f"{name} is not an unsigned integer in "), F.col("trace_id"))).cast(ID)
        return F.when(absent, F.lit(0).cast(ID)).when(plain.isNotNull(), plain).otherwise(wrong)

    out = e.select(
        "trace_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("e.name", F.lit("")).alias("name"),
        F.substring(F.coalesce("e.ph", F.lit("")), 1, 1).alias("ph"),
        F.coalesce("e.ts", F.lit(0.0)).alias("ts"),
        F.try_variant_get("e.dur", "$", "double").alias("dur"),
        ident("tid").alias("tid"),
        ident("pid").alias("pid"),
        unsigned(F.col("e.id")).alias("id"),
        F.col("e.cat").alias("cat"),
        F.col("e.args").alias("args"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS])


def read_folder(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    return read_traces(spark, list_traces(spark, folder), check)


def read_metadata(spark: SparkSession, paths: list[str] | str, events: DataFrame) -> DataFrame:
    """One row a trace: recorded settings (null when absent) and the page's URL."""
    raw = _raw(spark, [paths] if isinstance(paths, str) else list(paths))
    m = raw.select("trace_id", "metadata.*").toDF("trace_id", "cpu_throttling", "source", "start_time", "network_throttling", "hardware_concurrency", "host_dpr")
    return m.join(page_urls(events), "trace_id", "left")


def page_urls(events: DataFrame) -> DataFrame:
    """(trace_id, page_url): of the first TracingStartedInBrowser event the first frame URL that is a page."""
    first = events.where(F.col("name") == "TracingStartedInBrowser").groupBy("trace_id").agg(F.min_by("args", "seq").alias("args"))
    frames = F.from_json("args", "data struct<frames: array<struct<url: string>>>")["data"]["frames"]["url"]
    return first.select("trace_id", F.get(F.filter(frames, lambda u: u.isNotNull() & ~u.isin("", "about:blank")), 0).alias("page_url"))


def save(events: DataFrame, path: str) -> None:
    """Parquet by trace, ordered by time inside, so that windows prune row groups.  A long trace is written in several files."""
    events.repartitionByRange("trace_id", "ts").sortWithinPartitions("trace_id", "ts").write.mode("overwrite").partitionBy("trace_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.parquet(path)
    return got.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS])
