"""Mixing sources to target weights (operator 3): hash-threshold histograms, SQL functions only.

Words are summed by source and hash bucket; the running sum names the bucket in which a source's budget ends;
only that bucket's rows are summed again by the next bits, and so on, until the boundary is one hash value.
The result is one threshold a source, and the mix is a filter: no sort, no ranking of documents.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; rows with the same id and
text share a hash and are taken alike (ties); very long texts are counted whole, and a source's words come within half of what shares the boundary hash of its
target; an empty table gives no rows; extra columns pass through in ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import graph

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BITS, HASH_BITS = 12, 60
#: Sources that may be broadcast; a longer table is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Sources ordered by one task.
RANGE_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - HASH_BITS)


def _dealt(df: DataFrame, *order: Column) -> tuple[DataFrame, Column]:
    """df in ranges of the order, of RANGE_ROWS rows on average, with the range's number as ``_range``; and the order."""
    return graph.cut(df.repartitionByRange(1 + df.count() // RANGE_ROWS, *order).withColumn("_range", F.spark_partition_id())), order


def _before(dealt: DataFrame, order, **values: Column) -> DataFrame:
    """dealt with the sum of each value over all rows before the row: inside its range, and over the ranges before it."""
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    ahead = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{k}").over(ranges), F.lit(0)).alias(f"_ahead_{k}") for k in values])
    out = dealt.join(F.broadcast(ahead), "_range")
    return out.withColumns({k: F.col(f"_ahead_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()}).drop(*[f"_ahead_{k}" for k in values])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sizes has one row a source.

    Resharing the excess by weight ends at one fill level: target = min(most * size, level * weight).  With the
    sources in order of most * size / weight, the level is the largest (budget left) / (weight left).
    """
    dealt, order = _dealt(sizes, F.col("source").asc_nulls_last())
    ranked = _before(dealt, order, _rank=F.lit(1)).drop("_range")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    out = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size")).drop("_rank")
    dealt, order = _dealt(out, F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    total, weight = dealt.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    filled = _before(dealt, order, _caps=F.col("_cap"), _ws=F.col("_w"))
    level = filled.agg(F.max((share * total - F.col("_caps")) / (weight - F.col("_ws")))).first()[0]
    return dealt.select("source", "source_size", F.least("_cap", F.lit(level or 0.0) * F.col("_w")).alias("target"))


def thresholds(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, epochs, threshold): rows of slim(source, size, h) with h < threshold are taken once more than epochs."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = wanted.withColumn("epochs", epochs).withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = graph.cut(state.withColumn("prefix", F.lit(0).cast("long")))
    rows, done = slim, []
    for level in range(1, HASH_BITS // BITS + 1):
        shift = HASH_BITS - BITS * level
        own = F.shiftright("h", shift + BITS)
        rows = rows.join(_bounded(state.select(F.col("source").alias("s"), "prefix")), F.col("source").eqNullSafe(F.col("s")) & (own == F.col("prefix"))).select("source", "size", "h")
        bucket = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = Window.partitionBy("source").orderBy("bucket")
        cum = bucket.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s")
        joined = cum.join(_bounded(state), F.col("source").eqNullSafe(F.col("s"))).where("upto > need and upto - n <= need")
        # The first boundary: later buckets start above the need, buckets of size 0 cannot cross it.
        at = graph.cut(joined.select("source", "epochs", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), F.col("bucket").alias("prefix"), "n", "h0", "h1"))
        one = at.where("h0 = h1" if level < HASH_BITS // BITS else "true")
        done.append(one.select("source", "epochs", F.when(2 * F.col("need") > F.col("n"), F.col("h1") + 1).otherwise(F.col("h0")).alias("threshold")))
        crossed = at.select(F.col("source").alias("s"))
        whole = state.join(crossed, F.col("source").eqNullSafe(F.col("s")), "left_anti")
        done.append(whole.select("source", "epochs", F.when(F.col("need") > 0, F.shiftleft(F.col("prefix") + 1, shift + BITS)).otherwise(F.shiftleft("prefix", shift + BITS)).alias("threshold")))
        state = graph.cut(at.where("h0 < h1").select("source", "epochs", "need", "prefix"))
        if level == HASH_BITS // BITS or state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return graph.cut(out)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(slim, by source): slim has doc_id, source, size, h for every row; by source has size, target, epochs, threshold."""
    text = F.col("text").cast("string")
    slim = graph.cut(docs.select("doc_id", "source", size_of(text).alias("size"), hash_of(F.col("doc_id"), text).alias("h")))
    wanted = graph.cut(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), **options))
    cuts = thresholds(slim, wanted).withColumnRenamed("source", "s")
    return slim, graph.cut(wanted.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _taken() -> Column:
    return F.col("size") * F.col("epochs") + F.when(F.col("h") < F.col("threshold"), F.col("size")).otherwise(0)


def takes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    slim, by = plan(docs, **options)
    by = _bounded(by.withColumnRenamed("source", "s"))
    return slim.join(by, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", _taken().cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them; a filter on each row's own hash, no document is moved."""
    _, by = plan(docs, **options)
    by = _bounded(by.select(F.col("source").alias("of"), "epochs", "threshold"))
    held = docs.select(F.struct(*graph.columns(docs)).alias("row"), F.col("source").alias("source"), hash_of(F.col("doc_id"), F.col("text").cast("string")).alias("h"))
    times = (F.col("epochs") + (F.col("h") < F.col("threshold")).cast("long")).cast("int")
    out = held.join(by, F.col("source").eqNullSafe(F.col("of"))).select("row", times.alias("times"))
    return out.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*graph.fields(docs))
