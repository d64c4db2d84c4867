"""The registered queries over the test tables, each with its DuckDB SQL.

``tev`` presents the ``events`` table as a trace (two traces by user): purchases are RunTasks, clicks function calls, views
layouts, signups style updates, errors dropped frames; durations are value * 1e9 µs in whole µs, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scope import Matcher, NameFilter, Scope, short_url, source_type
from ..operators import analysis, compare, cpu, delta, inspect, pairing, timebase

# Event types of the table and the trace events they stand for.
ROLES = {"purchase": "RunTask", "click": "FunctionCall", "view": "Layout", "signup": "UpdateLayoutTree", "error": "DroppedFrame"}
DAY = 86_400e6
#: Thresholds scaled to the table's durations.
LONG, HEAVY, MAIN = 3e10, 3e10, 4.9e11
SCOPE = Scope(tid=2)


def tev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    name = kind
    for k, v in ROLES.items():
        name = F.when(kind == k, v).otherwise(name)
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return e.select(
        F.concat(F.lit("t"), F.col("user_id") % 2).alias("trace_id"), F.col("event_id").alias("seq"), name.alias("name"), F.lit("X").alias("ph"), ts.alias("ts"), (F.round(F.col("value") * 100) * 1e7).alias("dur"),
        (F.col("user_id") % 8).cast("decimal(20,0)").alias("tid"), (F.col("user_id") % 3).cast("decimal(20,0)").alias("pid"), F.lit(None).cast("decimal(20,0)").alias("id"), kind.alias("cat"), F.col("props").alias("args"),
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " ELSE event_type END"
TEV = f"""tev AS (SELECT 't' || (user_id % 2) AS trace_id, event_id AS seq, {_CASE} AS name, 'X' AS ph, epoch_us(ts)::DOUBLE AS ts,
 round(value * 100) * 1e7 AS dur, (user_id % 8)::BIGINT AS tid, (user_id % 3)::BIGINT AS pid, event_type AS cat, props AS args FROM events)"""
CTX = f"""{TEV}, thr AS (SELECT trace_id, tid, min(CASE WHEN name = 'RunTask' AND dur > {MAIN} THEN seq END) AS ls, count(*) FILTER (name = 'RunTask') AS n FROM tev GROUP BY ALL),
 mainthr AS (SELECT trace_id, coalesce(arg_min(tid, ls), arg_max(CASE WHEN n > 0 THEN tid END, CASE WHEN n > 0 THEN n * 1000 - tid END), 0) AS main_tid FROM thr GROUP BY trace_id),
 ctx AS (SELECT trace_id, min(ts) AS min_ts, max(ts + dur) AS end_ts, any_value(main_tid) AS main_tid FROM tev JOIN mainthr USING (trace_id) GROUP BY trace_id),
 e AS (SELECT tev.*, min_ts, end_ts, main_tid FROM tev JOIN ctx USING (trace_id))"""


def _ids(df: DataFrame) -> DataFrame:
    """Ids as BIGINT, for comparison with SQL."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "decimal(20,0)"})


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _ids(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_P = lambda p, v="d": f"list_sort(list({v}))[1 + round({p} / 100.0 * (count(*) - 1))::INT]"


@query(f"WITH {CTX} SELECT * FROM (SELECT trace_id, min_ts, end_ts - min_ts AS duration_us, end_ts, main_tid FROM ctx)")
def trace_bounds(spark, d):
    c = timebase.context(tev(spark, d), main_task_us=MAIN)
    return c.select("trace_id", "min_ts", (F.col("last_ts") - F.col("min_ts")).alias("duration_us"), "end_ts", "main_tid")


@query(f"""WITH {CTX} SELECT trace_id, name, count(*) AS count, sum(dur) AS total_us, sum(dur) / count(*) AS avg_us, sum(dur) / (any_value(end_ts) - any_value(min_ts)) * 100 AS pct
 FROM e WHERE tid = main_tid AND name IN ('RunTask','FunctionCall','UpdateLayoutTree','Layout') GROUP BY trace_id, name""")
def summary_breakdown(spark, d):
    return analysis.breakdown(tev(spark, d), main_task_us=MAIN)


@query(f"""WITH {CTX} SELECT trace_id, any_value(end_ts) - any_value(min_ts) AS duration_us, sum(CASE WHEN name = 'RunTask' AND tid = main_tid THEN dur ELSE 0 END) AS busy_us,
 count(*) FILTER (name = 'RunTask' AND tid = main_tid AND dur > {LONG}) AS long_tasks FROM e GROUP BY trace_id""")
def summary_busy(spark, d):
    return analysis.summary(tev(spark, d), long_us=LONG, main_task_us=MAIN)


@query(f"""WITH {CTX} SELECT trace_id, rank::INT AS rank, ts, dur FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, seq) AS rank FROM e
 WHERE name = 'RunTask' AND tid = main_tid AND dur > {LONG}) WHERE rank <= 10""")
def long_tasks_top(spark, d):
    return analysis.long_tasks(tev(spark, d), long_us=LONG, main_task_us=MAIN)


@query(f"""WITH {TEV}, g AS (SELECT trace_id, name, count(*) AS count, sum(dur) AS total FROM tev GROUP BY ALL)
 SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY total DESC, name)::INT AS rank, name, count, round(total) AS total_us, round(total / count) AS avg_us FROM g""")
def names(spark, d):
    return inspect.names(tev(spark, d))


@query(f"""WITH {TEV}, g AS (SELECT trace_id, name, count(*) AS count, sum(dur) AS total FROM tev GROUP BY ALL)
 SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY count DESC, name)::INT AS rank, name, count, round(total) AS total_us, round(total / count) AS avg_us FROM g""")
def names_by_count(spark, d):
    return inspect.names(tev(spark, d), sort="count")


@query(f"""WITH {TEV}, n AS (SELECT trace_id, tid, name, count(*) AS n, sum(CASE WHEN name = 'RunTask' THEN dur ELSE 0 END) AS run FROM tev GROUP BY ALL),
 b AS (SELECT trace_id, tid, sum(n)::BIGINT AS events, sum(run) AS run FROM n GROUP BY ALL),
 t AS (SELECT trace_id, tid, name AS top_event FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, tid ORDER BY n DESC, name) AS r FROM n) WHERE r = 1)
 SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY run DESC, tid)::INT AS rank, tid, events, round(run) AS runtask_us, top_event FROM b JOIN t USING (trace_id, tid)""")
def threads_top_event(spark, d):
    return inspect.threads(tev(spark, d))


@query(f"""WITH {TEV}, b AS (SELECT trace_id, min(ts) AS min_ts FROM tev GROUP BY 1), r AS (SELECT * FROM tev WHERE name IN ('RunTask', 'Layout') AND dur >= 1e9 AND tid = 2),
 t AS (SELECT trace_id, count(*) AS total FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, seq)::INT AS rank FROM r)
 SELECT trace_id, rank, total, round(ts - min_ts) AS t_us, round(dur) AS dur_us, name, tid, pid, args FROM k JOIN b USING (trace_id) JOIN t USING (trace_id) WHERE rank <= 25""")
def events_scoped_topn(spark, d):
    return inspect.events_list(tev(spark, d), NameFilter(("RunTask", "Layout")), SCOPE, 1e9, "dur", 25)


@query(f"""WITH {TEV}, b AS (SELECT trace_id, min(ts) AS min_ts FROM tev GROUP BY 1), r AS (SELECT * FROM tev WHERE regexp_matches(name, '^Lay|Tree$') AND contains(lower(cat), 'ig')),
 t AS (SELECT trace_id, count(*) AS total FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq)::INT AS rank FROM r)
 SELECT trace_id, rank, total, round(ts - min_ts) AS t_us, round(dur) AS dur_us, name, tid, pid, args FROM k JOIN b USING (trace_id) JOIN t USING (trace_id) WHERE rank <= 30""")
def events_regex(spark, d):
    return inspect.events_list(tev(spark, d), NameFilter(("^Lay", "Tree$"), regex=True), Scope(cat="IG"))


@query(f"""WITH {TEV} SELECT trace_id, name, count(*) AS count, round(sum(dur)) AS total_us, round(min(dur)) AS min_us, round(sum(dur) / count(*)) AS avg_us,
 {_P(50, 'dur')} AS p50_us, {_P(90, 'dur')} AS p90_us, {_P(99, 'dur')} AS p99_us, round(max(dur)) AS max_us FROM tev GROUP BY trace_id, name""")
def duration_stats(spark, d):
    return inspect.stats(tev(spark, d))


@query(f"""WITH r AS (SELECT 'x' AS trace_id, l_returnflag AS name, (l_quantity * 1000) AS d FROM lineitem)
 SELECT trace_id, name, {_P(50)} AS p50, {_P(90)} AS p90, {_P(99)} AS p99 FROM r GROUP BY trace_id, name""")
def nearest_rank_lineitem(spark, d):
    from ..functions.ranks import nearest_ranks

    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("x").alias("trace_id"), F.col("l_returnflag").alias("name"), (F.col("l_quantity") * 1000).alias("d"))
    return nearest_ranks(li, ["trace_id", "name"], "d", {"p50": 50, "p90": 90, "p99": 99})


@query(f"""WITH {CTX}, c AS (SELECT trace_id, min_ts, end_ts, greatest(1, ceil((end_ts - min_ts) / {DAY}))::BIGINT AS n FROM ctx),
 s AS (SELECT trace_id, floor((ts - min_ts) / {DAY})::BIGINT AS bucket, count(*) AS events, sum(CASE WHEN name = 'RunTask' THEN dur ELSE 0 END) AS run FROM e GROUP BY ALL),
 g AS (SELECT trace_id, unnest(range(0, n)) AS bucket FROM c)
 SELECT trace_id, bucket, bucket * {DAY} AS t_us, round(coalesce(run, 0)) AS runtask_us, least(coalesce(run, 0) / {DAY}, 1.0) AS busy, coalesce(events, 0) AS events FROM g LEFT JOIN s USING (trace_id, bucket)""")
def timeline(spark, d):
    return inspect.timeline(tev(spark, d), bucket_ms=DAY / 1000)


_GC = {"RunTask": "MajorGC", "FunctionCall": "MinorGC", "Layout": "V8.GCScavenger", "UpdateLayoutTree": "CppGC.Mark"}


def _gc_events(spark, d):
    name = F.col("name")
    for k, v in _GC.items():
        name = F.when(F.col("name") == k, v).otherwise(name)
    return tev(spark, d).withColumn("name", name)


@query(f"""WITH {TEV}, r AS (SELECT trace_id, CASE name WHEN 'RunTask' THEN 'MajorGC' WHEN 'FunctionCall' THEN 'MinorGC / GCScavenger' WHEN 'Layout' THEN 'MinorGC / GCScavenger' WHEN 'UpdateLayoutTree' THEN 'other V8.GC*/CppGC*' END AS "group", dur FROM tev)
 SELECT trace_id, "group", count(*) AS count, round(sum(dur)) AS total_us, round(max(dur)) AS max_us FROM r WHERE "group" IS NOT NULL GROUP BY ALL""")
def gc_groups(spark, d):
    return inspect.gc(_gc_events(spark, d))


@query(f"""WITH {CTX}, r AS (SELECT trace_id, dur, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, seq) AS k FROM e WHERE name = 'RunTask' AND tid = main_tid AND dur >= {LONG})
 SELECT trace_id, {LONG}::DOUBLE AS threshold_us, count(*) AS count, round(sum(dur)) AS total_us, round(max(dur)) AS max_us, round(max(CASE WHEN k = 3 THEN dur END)) AS third_us FROM r GROUP BY trace_id""")
def gc_long_tasks(spark, d):
    return inspect.gc_long_tasks(tev(spark, d), threshold_us=LONG, main_task_us=MAIN).withColumn("third_us", F.get("top_us", F.lit(2))).drop("top_us")


def _order_events(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit("s").alias("ph"), F.col("o_orderpriority").alias("name"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("ts"), F.col("o_orderkey").alias("seq"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.lit("f").alias("ph"), F.lit("x").alias("name"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double").alias("ts"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return o.unionByName(li).select(F.lit("o").alias("trace_id"), "seq", "name", "ph", "ts", F.lit(None).cast("double").alias("dur"), F.lit(1).cast("decimal(20,0)").alias("tid"), F.lit(1).cast("decimal(20,0)").alias("pid"), F.col("id").cast("decimal(20,0)").alias("id"), F.lit("c").alias("cat"), F.lit(None).cast("string").alias("args"))


@query(f"""WITH p AS (SELECT 'o' AS trace_id, o_orderpriority AS name, greatest(epoch_us(l_shipdate) - epoch_us(o_orderdate), 0)::DOUBLE AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT trace_id, name, count(*) AS count, round(sum(d)) AS total_us, round(sum(d) / count(*)) AS avg_us, {_P(50)} AS p50_us, {_P(99)} AS p99_us, max(d) AS max_us FROM p GROUP BY trace_id, name""")
def async_pairs(spark, d):
    return inspect.async_tasks(_order_events(spark, d))


def _talk_events(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.where("role in ('user', 'assistant')").select(F.lit("c").alias("trace_id"), F.col("conv_id").cast("decimal(20,0)").alias("tid"), F.col("turn").cast("long").alias("seq"), F.when(F.col("role") == "user", "b").otherwise("e").alias("ph"), (F.col("turn") * 1000 + F.length("text")).cast("double").alias("ts"))


@query("""WITH r AS (SELECT 'c' AS trace_id, conv_id AS tid, turn, CASE role WHEN 'user' THEN 'b' ELSE 'e' END AS ph, (turn * 1000 + length(text))::DOUBLE AS ts FROM conversations WHERE role IN ('user', 'assistant')),
 s AS (SELECT *, sum(CASE ph WHEN 'b' THEN 1 ELSE -1 END) OVER (PARTITION BY tid ORDER BY turn) AS s FROM r), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY tid ORDER BY turn)) AS m FROM s),
 b AS (SELECT *, coalesce(lag(s - m) OVER (PARTITION BY tid ORDER BY turn), 0) AS before FROM m), l AS (SELECT *, CASE ph WHEN 'b' THEN s - m ELSE before END AS level FROM b),
 p AS (SELECT *, lag(ts) OVER (PARTITION BY tid, level ORDER BY turn) AS bts FROM l WHERE level > 0)
 SELECT trace_id, tid::BIGINT AS tid, bts AS "begin", ts AS "end" FROM p WHERE ph = 'e' AND ts > bts""")
def frame_pairs(spark, d):
    return pairing.stack_pairs(_talk_events(spark, d), ["trace_id", "tid"])


_KIDS = f"""t AS (SELECT trace_id, tid, seq AS task, ts AS start, ts + dur AS stop FROM e WHERE name = 'RunTask' AND tid = main_tid),
 p AS (SELECT t.trace_id, t.task, t.start, t.stop, k.seq, k.name, k.ts, k.dur FROM t JOIN e k ON k.trace_id = t.trace_id AND k.tid = t.tid AND k.ts BETWEEN t.start AND t.stop AND k.name IN ('FunctionCall', 'Layout', 'UpdateLayoutTree'))"""


@query(f"""WITH {TEV}, t AS (SELECT trace_id, tid, seq AS task, ts AS start, ts + dur AS stop FROM tev WHERE name = 'RunTask'),
 p AS (SELECT t.trace_id, t.tid, t.task, k.name, k.dur FROM t JOIN tev k ON k.trace_id = t.trace_id AND k.tid = t.tid AND k.ts BETWEEN t.start AND t.stop AND k.name <> 'RunTask')
 SELECT trace_id, tid, task, name, count(*) AS count, sum(dur) AS total FROM p GROUP BY ALL""")
def interval_children(spark, d):
    return _children(tev(spark, d))


def _children(e: DataFrame) -> DataFrame:
    task = e.where("name = 'RunTask'").select("trace_id", "tid", F.col("seq").alias("task"), F.col("ts").alias("start"), (F.col("ts") + F.col("dur")).alias("stop"))
    kids = e.where("name <> 'RunTask'").select("trace_id", "tid", "name", "ts", "dur")
    return pairing.interval_join(task, kids, ["trace_id", "tid"]).groupBy("trace_id", "tid", "task", "name").agg(F.count("*").alias("count"), F.sum("dur").alias("total"))


@query(f"""WITH {CTX}, {_KIDS}, f AS (SELECT trace_id, task, any_value(start) AS ts, any_value(stop) - any_value(start) AS dur_us, max(name <> 'Layout' AND dur > {HEAVY}) AS heavy,
 sum(CASE WHEN name = 'FunctionCall' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS js_us, sum(CASE WHEN name = 'UpdateLayoutTree' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS style_us,
 sum(CASE WHEN name = 'Layout' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS layout_us FROM p GROUP BY trace_id, task)
 SELECT trace_id, task, ts, dur_us, js_us, style_us, layout_us, 0.0::DOUBLE AS paint_us, 0.0::DOUBLE AS composite_us, 0.0::DOUBLE AS hit_test_us,
 CASE WHEN greatest(js_us, style_us, layout_us) = 0 THEN 'HitTest' WHEN layout_us >= greatest(js_us, style_us) THEN 'Layout' WHEN style_us >= js_us THEN 'Style' ELSE 'JS' END AS bottleneck FROM f WHERE heavy""")
def scroll_frames(spark, d):
    return analysis.scroll_frames(tev(spark, d), HEAVY, main_task_us=MAIN)


@query(f"""WITH {CTX}, {_KIDS}, f AS (SELECT trace_id, task, any_value(stop) - any_value(start) AS d FROM p GROUP BY trace_id, task HAVING max(name <> 'Layout' AND dur > {HEAVY}))
 SELECT trace_id, count(*) AS frames, {_P(50)} AS p50_us, {_P(90)} AS p90_us, {_P(99)} AS p99_us FROM f GROUP BY trace_id""")
def scroll_percentiles(spark, d):
    return analysis.scroll_summary(analysis.scroll_frames(tev(spark, d), HEAVY, main_task_us=MAIN)).select("trace_id", "frames", "p50_us", "p90_us", "p99_us")


@query(f"""WITH {CTX}, {_KIDS}, c AS (SELECT *, lag(name) OVER (PARTITION BY trace_id, task ORDER BY ts, seq) AS before FROM p WHERE ts + dur <= stop)
 SELECT trace_id, task, any_value(stop) - any_value(start) AS task_dur_us, count(*) FILTER (name <> 'FunctionCall' AND before = 'FunctionCall') AS reflows,
 sum(CASE WHEN name <> 'FunctionCall' AND before = 'FunctionCall' THEN dur ELSE 0 END) AS layout_us FROM c GROUP BY trace_id, task HAVING reflows >= 2""")
def forced_reflow(spark, d):
    return analysis.forced_reflows(tev(spark, d), main_task_us=MAIN)


_SPIKE, _BUSY = 9e10, 9e10


def _jank_sql(window: str = "", edge: str = "") -> str:
    return f"""WITH {CTX}, w AS (SELECT *, greatest(5e4, least(1e6, greatest(end_ts - min_ts, 1) / 2000)) AS width FROM e),
 b AS (SELECT *, least(floor((ts - min_ts) / width), greatest(1, ceil(greatest(end_ts - min_ts, 1) / width)) - 1)::BIGINT AS bucket FROM w),
 h AS (SELECT trace_id, bucket, width, min_ts, sum(CASE WHEN name = 'RunTask' AND tid = main_tid THEN dur ELSE 0 END) AS busy, coalesce(max(CASE WHEN name = 'RunTask' AND tid = main_tid THEN dur END), 0) AS max_run,
 count(*) FILTER (name = 'DroppedFrame') AS dropped FROM b WHERE name IN ('RunTask', 'DroppedFrame') {window} GROUP BY ALL HAVING (dropped > 0 OR max_run >= {_SPIKE} OR busy >= {_BUSY}) {edge}),
 i AS (SELECT *, bucket - row_number() OVER (PARTITION BY trace_id ORDER BY bucket) AS island FROM h),
 r AS (SELECT trace_id, width, min_ts, min(bucket) AS first, max(bucket) AS last, sum(busy) AS busy_us, max(max_run) AS max_run_us, sum(dropped)::BIGINT AS dropped FROM i GROUP BY trace_id, island, width, min_ts),
 k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dropped DESC, max_run_us DESC, busy_us DESC, first)::INT AS rank FROM r)
 SELECT trace_id, rank, first, last, min_ts + first * width AS start_us, min_ts + (last + 1) * width AS end_us, busy_us, max_run_us, 0.0::DOUBLE AS max_faf_us, 0.0::DOUBLE AS max_gpu_us, dropped FROM k WHERE rank <= 8"""


@query(_jank_sql())
def jank_clusters(spark, d):
    return analysis.jank_clusters(tev(spark, d), spike_us=_SPIKE, busy_us=_BUSY, main_task_us=MAIN)


_WIN = (1_705_000_000e6, 1_707_000_000e6)


@query(_jank_sql(f"AND ts BETWEEN {_WIN[0]} AND {_WIN[1]}", f"AND min_ts + bucket * width + width > {_WIN[0]} AND min_ts + bucket * width < {_WIN[1]}"))
def windowed_jank(spark, d):
    return analysis.jank_clusters(tev(spark, d), Scope(_WIN), spike_us=_SPIKE, busy_us=_BUSY, main_task_us=MAIN)


@query(f"""WITH {CTX}, l AS (SELECT trace_id, dur, (args::JSON->>'k')::BIGINT AS k FROM e WHERE name = 'Layout' AND tid = main_tid)
 SELECT trace_id, count(*) AS layouts, avg(k) AS avg_dirty, max(k) AS max_dirty, avg(k / 200 * 100) AS avg_ratio FROM l GROUP BY trace_id""")
def layout_dirty(spark, d):
    k = F.get_json_object("args", "$.k")
    e = tev(spark, d).withColumn("args", F.concat(F.lit('{"beginData": {"dirtyObjects": '), k, F.lit(', "totalObjects": 200}}')))
    return analysis.layout_summary(analysis.layout_dirty(e, main_task_us=MAIN))


@query(f"""WITH {CTX}, l AS (SELECT trace_id, (args::JSON->>'k')::BIGINT AS k FROM e WHERE name = 'UpdateLayoutTree' AND tid = main_tid AND (args::JSON->>'k')::BIGINT > 0)
 SELECT trace_id, count(*) AS recalcs, avg(k) AS avg_elements, max(k) AS max_elements FROM l GROUP BY trace_id""")
def style_recalc(spark, d):
    e = tev(spark, d).withColumn("args", F.concat(F.lit('{"elementCount": '), F.get_json_object("args", "$.k"), F.lit("}")))
    return analysis.style_summary(analysis.style_recalc(e, main_task_us=MAIN))


def _counter_events(spark, d):
    k = F.get_json_object("args", "$.k")
    return tev(spark, d).withColumns({"name": F.lit("UpdateCounters"), "ph": F.lit("I"), "args": F.concat(F.lit('{"data": {"jsHeapSizeUsed": '), k, F.lit(', "nodes": '), F.col("tid").cast("string"), F.lit("}}"))})


@query(f"""WITH {TEV}, s AS (SELECT *, (args::JSON->>'k')::DOUBLE AS heap FROM tev)
 SELECT trace_id, count(*) AS samples, arg_min(heap, ts) AS first_heap, arg_max(heap, ts) AS last_heap, max(heap) AS peak_heap, max(CASE WHEN heap = mx THEN ts END) AS peak_ts, max(tid)::DOUBLE AS peak_nodes, 0.0::DOUBLE AS peak_documents, 0.0::DOUBLE AS peak_listeners,
 arg_max(heap, ts) - arg_min(heap, ts) AS growth FROM (SELECT *, max(heap) OVER (PARTITION BY trace_id) AS mx FROM s) GROUP BY trace_id""")
def memory_series(spark, d):
    return inspect.memory_summary(inspect.memory_samples(_counter_events(spark, d)))


@query(f"""WITH {TEV}, r AS (SELECT trace_id, seq, ts, row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM tev),
 k AS (SELECT DISTINCT trace_id, CASE WHEN n <= 50 THEN i ELSE x * (n - 1) // 49 END AS i FROM r, range(50) t(x))
 SELECT trace_id, seq, ts FROM r JOIN k USING (trace_id, i)""")
def downsample(spark, d):
    return inspect.downsample(tev(spark, d), ["ts", "seq"], 50).select("trace_id", "seq", "ts")


def _input_events(spark, d):
    return tev(spark, d).withColumn("args", F.when(F.col("tid") == 3, F.lit('{"data": {"type": 5}}')).otherwise(F.concat(F.lit('{"data": {"type": "'), F.col("cat"), F.lit('"}}')))).withColumn("name", F.lit("EventDispatch"))


@query(f"""WITH {TEV}, r AS (SELECT trace_id, CASE WHEN tid = 3 THEN '(unknown)' ELSE cat END AS type, dur AS d FROM tev)
 SELECT trace_id, type, count(*) AS count, round(sum(d)) AS total_us, round(sum(d) / count(*)) AS avg_us, {_P(50)} AS p50_us, {_P(99)} AS p99_us, max(d) AS max_us FROM r GROUP BY trace_id, type""")
def input_latency(spark, d):
    return inspect.input_types(_input_events(spark, d))


def _profile_events(spark, d):
    """A profile made of the events: a chunk for each process and day, one sample an event."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("pid", F.col("user_id") % 3).withColumn("day", F.floor(F.col("micros") / int(DAY)))
    rows = e.groupBy("pid", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round((F.col("value") - 20) * 100).cast("long").alias("delta"), (F.col("event_id") % 64).alias("node")))).alias("x"))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(i.alias("id"), F.struct(F.concat(F.lit("f"), (i % 10).cast("string")).alias("functionName"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("http://h/"), F.when(i % 3 == 1, "vendor/").otherwise("src/"), i.cast("string"), F.lit(".js"))).alias("url")).alias("callFrame"), F.when(i > 1, F.floor(i / 2)).alias("parent")))
    args = F.to_json(F.struct(F.struct(F.struct(nodes.alias("nodes"), F.transform("x", lambda v: v["node"]).alias("samples")).alias("cpuProfile"), F.transform("x", lambda v: v["delta"]).alias("timeDeltas")).alias("data")))
    chunk = rows.select((F.col("day") * 10 + F.col("pid")).alias("seq"), F.lit("ProfileChunk").alias("name"), F.col("pid"), args.alias("args"))
    start = e.groupBy("pid").agg(F.lit(1000.0).alias("ts")).select(F.col("pid").alias("seq"), F.lit("Profile").alias("name"), "pid", F.lit(None).cast("string").alias("args"))
    return chunk.unionByName(start).select(F.lit("p").alias("trace_id"), F.col("seq").cast("long").alias("seq"), "name", F.lit("P").alias("ph"), F.lit(1000.0).alias("ts"), F.lit(None).cast("double").alias("dur"), F.lit(1).cast("decimal(20,0)").alias("tid"), F.col("pid").cast("decimal(20,0)").alias("pid"), F.lit(None).cast("decimal(20,0)").alias("id"), F.lit("c").alias("cat"), "args")


_SAMPLES = f"""x AS (SELECT user_id % 3 AS pid, floor(epoch_us(ts) / {int(DAY)})::BIGINT AS day, event_id, round((value - 20) * 100) AS delta, event_id % 64 AS node FROM events),
 c AS (SELECT pid, day, sum(delta) AS total, arg_min(delta, event_id) AS d0 FROM x GROUP BY ALL),
 base AS (SELECT pid, day, 1000 + coalesce(sum(total) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d0 AS base FROM c),
 s AS (SELECT node, greatest(delta, 0) AS weight, base + coalesce(sum(delta) OVER (PARTITION BY x.pid, x.day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM x JOIN base USING (pid, day)),
 nd AS (SELECT i AS node, 'f' || (i % 10) AS name, CASE WHEN i % 3 = 0 THEN '' ELSE 'http://h/' || CASE WHEN i % 3 = 1 THEN 'vendor/' ELSE 'src/' END || i || '.js' END AS url, CASE WHEN i > 1 THEN i // 2 END AS parent FROM range(64) t(i))"""
_CPU_WIN = (0.0, 400_000.0)


@query(f"WITH {_SAMPLES} SELECT 'p' AS trace_id, node::BIGINT AS node_id, sum(weight)::DOUBLE AS self_us FROM s WHERE t BETWEEN {_CPU_WIN[0]} AND {_CPU_WIN[1]} AND weight > 0 GROUP BY node")
def cpu_samples_windowed(spark, d):
    return cpu.self_times(_profile_events(spark, d), Scope(_CPU_WIN))


@query(f"""WITH {_SAMPLES} SELECT 'p' AS trace_id, node::BIGINT AS node_id, name, url, CASE WHEN url = '' THEN 'native' WHEN contains(url, 'vendor') THEN 'runtime' ELSE 'app' END AS source, sum(weight)::DOUBLE AS self_us
 FROM s JOIN nd USING (node) GROUP BY ALL HAVING sum(weight) > 0""")
def cpu_functions(spark, d):
    return cpu.functions(_profile_events(spark, d))


@query(f"""WITH {_SAMPLES}, f AS (SELECT CASE WHEN url = '' THEN 'native' WHEN contains(url, 'vendor') THEN 'runtime' ELSE 'app' END AS source, weight FROM s JOIN nd USING (node))
 SELECT 'p' AS trace_id, sum(CASE WHEN source = 'app' THEN weight ELSE 0 END)::DOUBLE AS app_us, sum(CASE WHEN source = 'runtime' THEN weight ELSE 0 END)::DOUBLE AS runtime_us, sum(CASE WHEN source = 'native' THEN weight ELSE 0 END)::DOUBLE AS native_us, sum(weight)::DOUBLE AS total_us FROM f""")
def source_totals(spark, d):
    return cpu.source_totals(cpu.functions(_profile_events(spark, d)))


@query(f"""WITH {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node), t AS (SELECT sum(self_us) AS total FROM w)
 SELECT 'p' AS trace_id, row_number() OVER (ORDER BY self_us DESC, node)::INT AS rank, name AS function, url, round(self_us) AS self_us, self_us / total * 100 AS pct FROM w JOIN nd USING (node), t WHERE contains(name, 'f3')""")
def cpu_functions_matching(spark, d):
    return cpu.matching_functions(_profile_events(spark, d), Matcher("F3"))


@query(f"""WITH RECURSIVE {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node),
 up AS (SELECT node, node AS anc, name AS line FROM nd UNION ALL SELECT up.node, p.node, p.name || ';' || up.line FROM up JOIN nd c ON c.node = up.anc JOIN nd p ON p.node = c.parent),
 full_line AS (SELECT node, arg_max(line, length(line)) AS line FROM up GROUP BY node)
 SELECT 'p' AS trace_id, row_number() OVER (ORDER BY self_us DESC, node)::INT AS rank, line || ' ' || self_us::BIGINT AS line FROM w JOIN full_line USING (node)""")
def stacks_folded(spark, d):
    return cpu.folded(_profile_events(spark, d))


@query(f"""WITH RECURSIVE {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node), t AS (SELECT sum(self_us) AS total FROM w),
 up AS (SELECT node, node AS anc FROM nd UNION ALL SELECT up.node, c.parent FROM up JOIN nd c ON c.node = up.anc WHERE c.parent IS NOT NULL),
 inc AS (SELECT anc AS node, sum(coalesce(self_us, 0)) AS inclusive FROM up LEFT JOIN w ON w.node = up.node GROUP BY anc),
 pl AS (SELECT nd.*, inclusive, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN parent IS NULL THEN inclusive ELSE -inclusive END, nd.node) AS place FROM nd JOIN inc USING (node)),
 walk AS (SELECT node, [place] AS path, 0 AS depth FROM pl WHERE parent IS NULL UNION ALL SELECT pl.node, list_append(path, place), depth + 1 FROM walk JOIN pl ON pl.parent = walk.node)
 SELECT 'p' AS trace_id, row_number() OVER (ORDER BY path)::INT AS rank, depth, node::BIGINT AS node_id, name AS function, url, round(coalesce(self_us, 0)) AS self_us, round(inclusive) AS inclusive_us, inclusive / total * 100 AS pct
 FROM walk JOIN pl USING (node) LEFT JOIN w USING (node), t""")
def calltree(spark, d):
    e = _profile_events(spark, d)
    return cpu.call_tree(cpu.nodes(e), cpu.self_times(e), top=None)


@query("""SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'native' WHEN regexp_matches(lower(url), 'node_modules|svelte|react|vue|angular|polyfill|vendor|chunk-|\\.min\\.') THEN 'runtime' ELSE 'app' END AS source, list_last(string_split(url, '/')) AS short FROM pages""")
def url_sources(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", source_type("url").alias("source"), short_url("url").alias("short"))


@query(f"""WITH {TEV}, r AS (SELECT trace_id, ts, seq, (args::JSON->>'k') AS v FROM tev WHERE contains((args::JSON->>'k'), '77'))
 SELECT trace_id, min(ts) AS ts, 'args' AS kind, arg_min(v, ts) AS label FROM r GROUP BY trace_id""")
def anchor_first_match(spark, d):
    return timebase.find_anchor(tev(spark, d), Matcher("77"))


_AROUND = timebase.windows_around(1_706_000_000e6, 2 * DAY, 5 * DAY, 5 * DAY)


def _delta_sql() -> str:
    wins = " UNION ALL ".join(f"SELECT '{k}' AS win, {a} AS lo, {b} AS hi" for k, (a, b) in _AROUND.items())
    return f"""WITH {CTX}, win AS ({wins}), x AS (SELECT e.*, win FROM e JOIN win ON ts BETWEEN lo AND hi),
 g AS (SELECT t.trace_id, w.win, count(*) FILTER (name = 'DroppedFrame') AS dropped, count(*) FILTER (name = 'RunTask' AND tid = main_tid AND dur >= 3e10) AS lt_count, sum(CASE WHEN name = 'RunTask' AND tid = main_tid AND dur >= 3e10 THEN dur ELSE 0 END) AS lt_us,
 sum(CASE WHEN name = 'RunTask' AND tid = main_tid THEN dur ELSE 0 END) AS busy_us, sum(CASE WHEN name = 'FunctionCall' AND tid = main_tid THEN dur ELSE 0 END) AS js_us FROM (SELECT DISTINCT trace_id FROM tev) t CROSS JOIN win w LEFT JOIN x ON x.trace_id = t.trace_id AND x.win = w.win GROUP BY ALL),
 m AS (SELECT trace_id, win, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS ord, unnest([0, 0, 0, 0, 0, dropped, lt_count, lt_us, busy_us, js_us, 0, 0, 0]::DOUBLE[]) AS v FROM g),
 p AS (SELECT trace_id, ord::INT AS ord, coalesce(max(CASE WHEN win = 'pre' THEN v END), 0) AS pre, coalesce(max(CASE WHEN win = 'shoot' THEN v END), 0) AS shoot, coalesce(max(CASE WHEN win = 'post' THEN v END), 0) AS post FROM m GROUP BY ALL)
 SELECT trace_id, ord, ['frames', 'frame p50', 'frame p90', 'frame p99', 'frame max', 'dropped frames', 'long tasks ≥30000000ms', 'long task time', 'main busy (RunTask)', 'JS (FunctionCall)', 'GC (Major+Minor)', 'GC count', 'CPU samples'][ord + 1] AS metric,
 ['n', 'ms', 'ms', 'ms', 'ms', 'n', 'n', 'ms', 'ms', 'ms', 'ms', 'n', 'ms'][ord + 1] AS unit, pre, shoot, post, shoot - pre AS delta_pre, post - shoot AS delta_post FROM p"""


@query(_delta_sql())
def delta_windows(spark, d):
    return delta.delta_rows(delta.window_stats(tev(spark, d), _AROUND, lt_ms=3e7, main_task_us=MAIN), lt_ms=3e7)


@query(f"""WITH {_SAMPLES}, win AS (SELECT 'pre' AS win, 0 AS lo, 200000 AS hi UNION ALL SELECT 'shoot', 200000, 300000 UNION ALL SELECT 'post', 300000, 500000),
 g AS (SELECT win, node, sum(weight)::DOUBLE AS self_us FROM s JOIN win ON t BETWEEN lo AND hi WHERE weight > 0 GROUP BY ALL)
 SELECT 'p' AS trace_id, win, rank::INT AS rank, name AS function, round(self_us) AS self_us FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY self_us DESC, node) AS rank FROM g JOIN nd USING (node)) WHERE rank <= 3""")
def delta_top_cpu(spark, d):
    return delta.top_cpu(_profile_events(spark, d), {"pre": (0.0, 2e5), "shoot": (2e5, 3e5), "post": (3e5, 5e5)})


def _sides(spark, d):
    e = tev(spark, d)
    return e.where("trace_id = 't0'"), e.where("trace_id = 't1'")


@query(f"""WITH {CTX}, s AS (SELECT trace_id, name, count(*) AS n, sum(dur) / count(*) AS avg FROM e WHERE tid = main_tid AND name IN ('RunTask','FunctionCall','UpdateLayoutTree','Layout') GROUP BY ALL),
 j AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b, coalesce(a.avg, 0) AS avg_a_us, coalesce(b.avg, 0) AS avg_b_us FROM (SELECT * FROM s WHERE trace_id = 't0') a FULL JOIN (SELECT * FROM s WHERE trace_id = 't1') b ON a.name = b.name)
 SELECT *, CASE WHEN avg_a_us > 0 THEN (avg_b_us - avg_a_us) / avg_a_us * 100 ELSE 0.0 END AS diff_pct FROM j""")
def compare_rows(spark, d):
    a, b = _sides(spark, d)
    return compare.event_rows(analysis.breakdown(a, main_task_us=MAIN), analysis.breakdown(b, main_task_us=MAIN))


@query(f"""WITH f AS (SELECT l_linestatus AS st, l_returnflag AS name, l_suppkey % 5 AS u, sum(round(l_quantity))::DOUBLE AS self_us FROM lineitem GROUP BY ALL), t AS (SELECT st, sum(self_us) AS total FROM f GROUP BY st),
 a AS (SELECT name, u, self_us, self_us / total * 100 AS pct FROM f JOIN t USING (st) WHERE st = 'O'), b AS (SELECT name, u, self_us, self_us / total * 100 AS pct FROM f JOIN t USING (st) WHERE st = 'F'),
 j AS (SELECT coalesce(a.name, b.name) AS name, 'http://h/' || coalesce(a.u, b.u) AS url, 'app' AS source, coalesce(a.self_us, 0) AS time_a_us, coalesce(b.self_us, 0) AS time_b_us, coalesce(a.pct, 0) AS pct_a, coalesce(b.pct, 0) AS pct_b FROM a FULL JOIN b ON a.name = b.name AND a.u = b.u)
 SELECT row_number() OVER (ORDER BY abs(pct_b - pct_a) DESC, name, url)::INT AS rank, *, CASE WHEN time_a_us > 0 THEN (time_b_us - time_a_us) / time_a_us * 100 ELSE 0.0 END AS diff_pct FROM j ORDER BY rank LIMIT 30""")
def cpu_diff(spark, d):
    f = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linestatus").alias("trace_id"), F.col("l_returnflag").alias("name"), F.concat(F.lit("http://h/"), F.col("l_suppkey") % 5).alias("url")).agg(F.sum(F.round("l_quantity")).alias("self_us")).withColumn("source", F.lit("app"))
    return compare.cpu_diff(f.where("trace_id = 'O'"), f.where("trace_id = 'F'"))


@query(f"""WITH {TEV}, b AS (SELECT trace_id, min(ts) AS min_ts FROM tev GROUP BY 1), r AS (SELECT * FROM tev WHERE contains(args::JSON->>'k', '42')), t AS (SELECT trace_id, count(*) AS total FROM r GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq)::INT AS rank FROM r) SELECT trace_id, rank, total, round(ts - min_ts) AS t_us, round(dur) AS dur_us, name, tid, args, args::JSON->>'k' AS hit FROM k JOIN b USING (trace_id) JOIN t USING (trace_id) WHERE rank <= 30""")
def find_text(spark, d):
    return inspect.find(tev(spark, d), Matcher("42"))


@query(f"""WITH {TEV}, g AS (SELECT trace_id, name, sum(dur) AS total FROM tev GROUP BY ALL) SELECT trace_id, name, total, total / sum(total) OVER (PARTITION BY trace_id) * 100 AS pct,
 sum(total) OVER (PARTITION BY trace_id ORDER BY total DESC, name ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY trace_id) * 100 AS cumulative_pct FROM g""")
def cumulative_pct(spark, d):
    g = tev(spark, d).groupBy("trace_id", "name").agg(F.sum("dur").alias("total"))
    return analysis.cumulative_pct(g, "total", [F.col("total").desc(), F.col("name")])


@query(f"""WITH {TEV} SELECT trace_id, arg_max(ts, (dur, seq)) AS ts, max(dur) AS dur FROM tev WHERE name = 'RunTask' GROUP BY trace_id""")
def worst_task(spark, d):
    return timebase.worst_task(tev(spark, d))

