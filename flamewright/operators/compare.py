"""Two traces side by side: event averages, CPU functions, rule-based findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scope import pct_diff

# Finding, metric, threshold in percent, whether both traces need scroll frames.
RULES = [
    ("Long Tasks count", "long_tasks", 10.0, False),
    ("Scroll Duration", "scroll_dur_us", 5.0, True),
    ("JS in Scroll", "scroll_js_us", 10.0, True),
    ("Style Recalc", "scroll_style_us", 10.0, True),
    ("Layout", "scroll_layout_us", 10.0, True),
    ("Paint", "scroll_paint_us", 10.0, True),
    ("HitTest", "scroll_hit_test_us", 10.0, True),
    ("Composite", "scroll_composite_us", 10.0, True),
    ("Main Thread busy", "busy_us", 10.0, False),
    ("Layout Dirty avg", "avg_dirty", 15.0, False),
    ("Style Elements avg", "avg_elements", 10.0, False),
]


def event_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, count_a, count_b, avg_a_us, avg_b_us, diff_pct) of two breakdowns; a missing side is 0."""
    side = lambda df, p: df.select("name", F.col("count").alias(f"count_{p}"), F.col("avg_us").alias(f"avg_{p}_us"))
    out = side(a, "a").join(side(b, "b"), "name", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("count_a", "count_b", "avg_a_us", "avg_b_us")}
    return out.withColumns(zero).withColumn("diff_pct", pct_diff("avg_a_us", "avg_b_us"))


def cpu_diff(a: DataFrame, b: DataFrame, top: int = 30) -> DataFrame:
    """(rank, name, url, source, time_a_us, time_b_us, pct_a, pct_b, diff_pct) of the functions whose share changed most.

    Functions of one name and URL are represented by their heaviest node.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        total = F.sum("self_us").over(Window.partitionBy("trace_id"))
        rows = df.withColumn("total", total)
        best = rows.groupBy("name", "url", "source").agg(F.max("self_us").alias(f"time_{p}_us"), F.first("total").alias("total"))
        pct = F.when(F.col("total") > 0, F.col(f"time_{p}_us") / F.col("total") * 100).otherwise(0.0)
        return best.withColumn(f"pct_{p}", pct).withColumnRenamed("source", f"source_{p}").drop("total")

    out = side(a, "a").join(side(b, "b"), ["name", "url"], "full")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("time_a_us", "time_b_us", "pct_a", "pct_b")}).where("time_a_us > 0 or time_b_us > 0")
    out = out.withColumn("source", F.coalesce("source_a", "source_b")).withColumn("diff_pct", pct_diff("time_a_us", "time_b_us"))
    order = F.abs(F.col("pct_b") - F.col("pct_a"))
    out = out.orderBy(order.desc(), "name", "url").limit(top)
    rank = F.row_number().over(Window.orderBy(order.desc(), "name", "url"))  # over at most ``top`` rows
    return out.select(rank.alias("rank"), "name", "url", "source", "time_a_us", "time_b_us", "pct_a", "pct_b", "diff_pct")


def metrics(summary: DataFrame, scroll: DataFrame, layout: DataFrame, style: DataFrame) -> DataFrame:
    """One row a trace with every metric of the rules; scroll, layout and style summaries may lack traces."""
    cols = {"dur_us": "scroll_dur_us", "js_us": "scroll_js_us", "style_us": "scroll_style_us", "layout_us": "scroll_layout_us", "paint_us": "scroll_paint_us", "hit_test_us": "scroll_hit_test_us", "composite_us": "scroll_composite_us"}
    s = scroll.select("trace_id", "frames", *[F.col(a).alias(b) for a, b in cols.items()])
    return summary.join(s, "trace_id", "left").join(layout.select("trace_id", "avg_dirty"), "trace_id", "left").join(style.select("trace_id", "avg_elements"), "trace_id", "left")


def findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(finding, ord, severity, value_a, value_b, pct) of the rules whose change exceeds its threshold; a and b are one-row metrics.

    Regressed findings come first.  Scroll rules need frames on both sides, the style rule updates on both sides.
    """
    side = lambda df, p: df.select(F.lit(1).alias("one"), F.col("frames").alias(f"frames_{p}"), *[F.col(m).cast("double").alias(f"{m}_{p}") for _, m, _, _ in RULES])
    pair = side(a, "a").join(side(b, "b"), "one")
    both = F.col("frames_a").isNotNull() & F.col("frames_b").isNotNull()
    rows = []
    for k, (name, m, threshold, scroll) in enumerate(RULES):
        needs = both if scroll else (F.col("avg_elements_a").isNotNull() & F.col("avg_elements_b").isNotNull() if m == "avg_elements" else F.lit(True))
        rows.append(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("finding"), F.lit(threshold).alias("threshold"), needs.alias("applies"), F.coalesce(f"{m}_a", F.lit(0.0)).alias("value_a"), F.coalesce(f"{m}_b", F.lit(0.0)).alias("value_b")))
    out = pair.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("pct", pct_diff("value_a", "value_b"))
    out = out.where(F.col("applies") & (F.abs("pct") > F.col("threshold")))
    return out.select("ord", "finding", F.when(F.col("pct") > 0, "Regressed").otherwise("Improved").alias("severity"), "value_a", "value_b", "pct").orderBy(F.col("severity").desc(), "ord")
