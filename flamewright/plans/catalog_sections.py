"""More registered queries: trace files read back, report sections, anchors, stacks and the rules of a comparison, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import checkpoint_dir
from ..functions.scope import Matcher, NameFilter, Scope
from ..operators import analysis, compare, cpu, delta, inspect, timebase
from ..render import blocks
from ..sources import traces
from .catalog import _AROUND, _KIDS, _P, _SAMPLES, _SPIKE, _BUSY, CTX, HEAVY, LONG, MAIN, TEV, _delta_sql, _jank_sql, _order_events, _profile_events, _sides, query, tev

# Trace files.


def trace_folder(spark: SparkSession, d: str) -> str:
    """The events table as one gzipped and one plain trace file in the shared folder, one event a line; returns the folder."""
    e, page = tev(spark, d), spark.read.parquet(f"{d}/pages.parquet").where("page_id = 0").first().url
    ident = F.when(F.col("seq") % 4 == 0, F.concat(F.lit(', "id": '), F.col("seq").cast("string"))).when(F.col("seq") % 4 == 1, F.lit(', "id": "x"')).when(F.col("seq") % 4 == 2, F.lit(', "id": -5')).otherwise("")
    whole = lambda c: F.col(c).cast("decimal(30,0)").cast("string")
    line = F.concat(F.lit('{"name": "'), "name", F.lit('", "ph": "XY", "ts": '), whole("ts"), F.lit(', "dur": '), whole("dur"), F.lit(', "tid": '), F.col("tid").cast("string"), F.lit(', "pid": '), F.col("pid").cast("string"), ident, F.lit(', "cat": "'), "cat", F.lit('", "args": '), "args", F.lit("},"))
    body = e.select("trace_id", F.lit(1).alias("part"), "seq", line.alias("value"))
    ids = e.select("trace_id").distinct()
    head = ids.select("trace_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit('{"traceEvents": [').alias("value"))
    begun = F.concat(F.lit('{"name": "TracingStartedInBrowser", "ph": "I", "ts": 1e6, "args": {"data": {"frames": [{"url": ""}, {"url": "about:blank"}, {"url": "'), F.lit(page), F.lit('"}]}}}], "metadata": '))
    meta = F.when(F.col("trace_id") == "t0", '{"cpuThrottling": 4, "source": "test", "startTime": "today", "networkThrottling": "Slow", "hardwareConcurrency": 8, "hostDPR": 1.5}}').otherwise("{}}")
    tail = ids.select("trace_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(begun, meta).alias("value"))
    lines = head.unionByName(body).unionByName(tail)
    base = f"{checkpoint_dir(spark).rstrip('/')}/traces-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, codec, end in (("t0", "gzip", ".json.gz"), ("t1", "none", ".json")):
        # One file a trace, as tracing tools write them: its lines in order, by one task that streams.
        own = lines.where(F.col("trace_id") == name).repartition(1).sortWithinPartitions("part", "seq").select("value")
        own.write.option("compression", codec).text(f"{base}/{name}-parts")
        folder = hadoop.Path(f"{base}/{name}-parts")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            if status.getPath().getName().startswith("part-"):
                fs.rename(status.getPath(), hadoop.Path(f"{base}/{name}{end}"))
    return base


@query(f"""WITH {TEV}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS place FROM tev)
 SELECT trace_id, place AS seq, name, 'X' AS ph, ts, dur, tid, pid, CASE WHEN seq % 4 = 0 THEN seq ELSE -1 END AS id, cat, (args::JSON->>'k')::BIGINT AS k FROM n""")
def trace_files(spark, d):
    """A folder of a gzipped and a plain trace, read event by event; ids that are no unsigned integers are null, here -1."""
    e = traces.read_folder(spark, trace_folder(spark, d)).where("name <> 'TracingStartedInBrowser'")
    return e.withColumn("id", F.coalesce("id", F.lit(-1))).withColumn("k", F.get_json_object("args", "$.k").cast("long")).drop("args")


@query("""SELECT 't0' AS trace_id, 4.0::DOUBLE AS cpu_throttling, 'test' AS source, 'today' AS start_time, 'Slow' AS network_throttling, 8::INT AS hardware_concurrency, 1.5::DOUBLE AS host_dpr, url AS page_url FROM pages WHERE page_id = 0
 UNION ALL SELECT 't1', 0, '', '', '', 0, 0, url FROM pages WHERE page_id = 0""")
def trace_metadata(spark, d):
    files = traces.list_traces(spark, trace_folder(spark, d))
    return traces.read_metadata(spark, files, traces.read_traces(spark, files)).na.fill(0).na.fill("")


@query(f"""WITH {TEV}, m AS (SELECT *, cat IN ('error', 'signup') AS meta FROM tev)
 SELECT trace_id, min(ts) FILTER (NOT meta) AS min_ts, max(ts + dur) FILTER (NOT meta) AS last_ts, max(ts + dur) AS end_ts FROM m GROUP BY trace_id""")
def bounds_without_metadata(spark, d):
    """Metadata events (by category and by name) take no part in the time base."""
    e = tev(spark, d).withColumn("name", F.when(F.col("cat") == "signup", "thread_name").otherwise(F.col("name"))).withColumn("cat", F.when(F.col("cat") == "error", "__metadata").otherwise(F.col("cat")))
    return timebase.context(e).drop("main_tid")


# Inspector sections.

_BASE = "b AS (SELECT trace_id, min(ts) AS min_ts FROM tev GROUP BY 1)"


@query(f"""WITH {TEV}, {_BASE}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, seq)::INT AS rank FROM tev WHERE name = 'RunTask') WHERE rank <= 5),
 p AS (SELECT h.trace_id, h.rank, h.ts, h.dur, h.tid, k.name, k.dur AS d, k.seq FROM h LEFT JOIN tev k ON k.trace_id = h.trace_id AND k.tid = h.tid AND k.name <> 'RunTask' AND k.ts BETWEEN h.ts AND h.ts + h.dur)
 SELECT trace_id, rank, round(any_value(p.ts) - any_value(min_ts)) AS t_us, round(any_value(dur)) AS dur_us, any_value(tid) AS tid, p.name, count(p.seq) AS count, round(sum(d)) AS total_us,
 round(max(max(CASE WHEN p.name = 'FunctionCall' THEN d END)) OVER (PARTITION BY trace_id, rank)) AS call_us FROM p JOIN b USING (trace_id) GROUP BY trace_id, rank, p.name""")
def task_sections(spark, d):
    """The longest tasks with what ran inside, by name, and their longest call."""
    t = inspect.tasks(tev(spark, d), top=5).withColumn("call_us", F.col("top_function_call.dur_us"))
    out = t.select("trace_id", "rank", "t_us", "dur_us", "tid", "call_us", F.explode_outer("children").alias("c"))
    return out.select("trace_id", "rank", "t_us", "dur_us", "tid", "c.name", F.coalesce("c.count", F.lit(0)).alias("count"), "c.total_us", "call_us")


@query(f"""WITH {TEV}, r AS (SELECT trace_id, tid, seq, ts, CASE name WHEN 'FunctionCall' THEN 'b' ELSE 'e' END AS ph FROM tev WHERE name IN ('FunctionCall', 'Layout')),
 s AS (SELECT *, sum(CASE ph WHEN 'b' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, tid ORDER BY seq) AS s FROM r), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY trace_id, tid ORDER BY seq)) AS m FROM s),
 l AS (SELECT *, CASE ph WHEN 'b' THEN s - m ELSE coalesce(lag(s - m) OVER (PARTITION BY trace_id, tid ORDER BY seq), 0) END AS level FROM m),
 p AS (SELECT *, lag(ts) OVER (PARTITION BY trace_id, tid, level ORDER BY seq) AS bts FROM l WHERE level > 0), f AS (SELECT trace_id, ts - bts AS d FROM p WHERE ph = 'e' AND ts > bts),
 g AS (SELECT trace_id, count(*) AS count, round(sum(d) / count(*)) AS avg_us, {_P(50)} AS p50_us, {_P(90)} AS p90_us, {_P(99)} AS p99_us, max(d) AS max_us FROM f GROUP BY 1),
 x AS (SELECT trace_id, count(*) FILTER (name = 'DroppedFrame') AS dropped_frames FROM tev GROUP BY 1)
 SELECT trace_id, 'Frame' AS frame_event, count, avg_us, p50_us, p90_us, p99_us, max_us, dropped_frames FROM g JOIN x USING (trace_id)""")
def frames_section(spark, d):
    e = tev(spark, d)
    e = e.withColumn("ph", F.when(F.col("name") == "FunctionCall", "b").when(F.col("name") == "Layout", "e").otherwise("X"))
    return inspect.frames(e.withColumn("name", F.when(F.col("name").isin("FunctionCall", "Layout"), "Frame").otherwise(F.col("name"))), frame_event="Frame")


@query(f"""WITH {TEV}, {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, seq)::INT AS rank FROM tev)
 SELECT trace_id, rank, round(ts - min_ts) AS t_us, round(dur) AS dur_us, cat AS type FROM r JOIN b USING (trace_id) WHERE rank <= 30""")
def input_worst(spark, d):
    e = tev(spark, d).withColumn("args", F.concat(F.lit('{"data": {"type": "'), F.col("cat"), F.lit('"}}'))).withColumn("name", F.lit("EventDispatch"))
    return inspect.input_worst(e)


@query("""WITH p AS (SELECT 'o' AS trace_id, o_orderpriority AS name, epoch_us(o_orderdate)::DOUBLE AS ts, greatest(epoch_us(l_shipdate) - epoch_us(o_orderdate), 0)::DOUBLE AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 b AS (SELECT least((SELECT min(epoch_us(o_orderdate)) FROM orders), (SELECT min(epoch_us(l_shipdate)) FROM lineitem))::DOUBLE AS min_ts), k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY d DESC)::INT AS rank FROM p)
 SELECT trace_id, rank, d AS dur_us FROM k WHERE rank <= 30""")
def async_longest(spark, d):
    return inspect.async_longest(_order_events(spark, d)).select("trace_id", "rank", "dur_us")


@query(f"""WITH {TEV}, {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY name, ts, seq)::INT AS rank, count(*) OVER (PARTITION BY trace_id) AS total FROM tev WHERE dur >= 5e9)
 SELECT trace_id, rank, total, round(ts - min_ts) AS t_us, round(dur) AS dur_us, name, tid, pid, args FROM r JOIN b USING (trace_id) WHERE rank <= 40""")
def events_by_name(spark, d):
    return inspect.events_list(tev(spark, d), min_dur=5e9, sort="name", top=40)


@query(f"""WITH {TEV}, {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq)::INT AS rank, count(*) OVER (PARTITION BY trace_id) AS total FROM tev WHERE name = 'Layout' AND pid = 1)
 SELECT trace_id, rank, total, round(ts - min_ts) AS t_us, round(dur) AS dur_us, name, tid, pid, args FROM r JOIN b USING (trace_id) WHERE rank <= 40""")
def events_in_file_order(spark, d):
    return inspect.events_list(tev(spark, d), NameFilter(("Layout",)), Scope(pid=1), sort="count", top=40)


# Whole-trace analyses.


@query(f"""WITH {CTX}, {_KIDS}, f AS (SELECT trace_id, task, any_value(stop) - any_value(start) AS dur_us, sum(CASE WHEN name = 'FunctionCall' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS js, sum(CASE WHEN name = 'UpdateLayoutTree' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS style,
 sum(CASE WHEN name = 'Layout' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS layout FROM p GROUP BY trace_id, task HAVING max(name <> 'Layout' AND dur > {HEAVY})),
 m AS (SELECT trace_id, count(*) AS frames, sum(dur_us) / count(*) AS dur_us, sum(js) / count(*) AS js_us, sum(style) / count(*) AS style_us, sum(layout) / count(*) AS layout_us FROM f GROUP BY 1),
 c AS (SELECT trace_id, unnest(range(6)) AS i, unnest(['JS', 'Style', 'Layout', 'Paint', 'Composite', 'HitTest']) AS n, unnest([js_us, style_us, layout_us, 0, 0, 0]) AS v FROM m)
 SELECT m.trace_id, frames, dur_us, js_us, style_us, layout_us, string_agg(n, '>' ORDER BY v DESC, i) AS ranked FROM m JOIN c ON c.trace_id = m.trace_id GROUP BY ALL""")
def scroll_averages(spark, d):
    """Mean cost of a scroll frame by kind, and the kinds by falling cost."""
    s = analysis.scroll_summary(analysis.scroll_frames(tev(spark, d), HEAVY, main_task_us=MAIN))
    ranked = F.array_join(F.transform(analysis.ranked_costs(), lambda c: c["name"]), ">")
    return s.select("trace_id", "frames", "dur_us", "js_us", "style_us", "layout_us", ranked.alias("ranked"))


_CLUSTERS = _jank_sql().removeprefix("WITH ")


@query(f"""WITH {_CLUSTERS.rsplit(' SELECT trace_id, rank', 1)[0]},
 x AS (SELECT trace_id, bucket, dur, 'fn' || ((args::JSON->>'k')::BIGINT % 7) AS name FROM b WHERE name = 'FunctionCall'),
 s AS (SELECT k.trace_id, k.rank, x.name, sum(dur) AS dur_us FROM k JOIN x ON x.trace_id = k.trace_id AND x.bucket BETWEEN k.first AND k.last WHERE k.rank <= 8 GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, rank ORDER BY dur_us DESC, name)::INT AS call_rank FROM s) WHERE call_rank <= 5""")
def jank_calls(spark, d):
    """The calls that took most time in each jank cluster."""
    k = F.get_json_object("args", "$.k").cast("long") % 7
    e = tev(spark, d).withColumn("args", F.concat(F.lit('{"data": {"functionName": "fn'), k.cast("string"), F.lit('"}}')))
    return analysis.jank_calls(e, analysis.jank_clusters(e, spike_us=_SPIKE, busy_us=_BUSY, main_task_us=MAIN), main_task_us=MAIN)


# Anchors.


@query(f"""WITH {TEV}, c AS (SELECT trace_id, ts, seq, 'fn' || (args::JSON->>'k') AS label FROM tev WHERE name = 'FunctionCall')
 SELECT trace_id, min(ts) AS ts, 'FunctionCall' AS kind, arg_min(label, (ts, seq)) AS label FROM c WHERE contains(label, 'fn7') GROUP BY trace_id""")
def anchor_call(spark, d):
    """The first call whose function matches comes before any other match."""
    e = tev(spark, d).withColumn("args", F.concat(F.lit('{"data": {"functionName": "fn'), F.get_json_object("args", "$.k"), F.lit('"}}')))
    return timebase.find_anchor(e, Matcher("FN7"))


#: Times after each sample's own delta.
_AFTER = f"""{_SAMPLES}, prev AS (SELECT pid, day, 1000 + coalesce(sum(total) OVER (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM c),
 a AS (SELECT node, clock + sum(delta) OVER (PARTITION BY x.pid, x.day ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ts FROM x JOIN prev USING (pid, day))"""


@query(f"""WITH {_AFTER} SELECT 'p' AS trace_id, min(ts)::DOUBLE AS ts, 'cpu-profile' AS kind, 'f3' AS label FROM a JOIN nd USING (node) WHERE node <> 0 AND contains(name, 'f3')""")
def anchor_sample(spark, d):
    """Without a call, the first sample of a function that matches."""
    return timebase.find_anchor(_profile_events(spark, d), Matcher("F3"))


@query(f"""WITH {_AFTER} SELECT 'p' AS trace_id, min(ts)::DOUBLE AS ts, 'cpu-profile' AS kind, 'http://h/src/5.js' AS label FROM a WHERE node = 5""")
def anchor_sample_url(spark, d):
    """Without such a function, the first sample whose URL matches."""
    return timebase.find_anchor(_profile_events(spark, d), Matcher("SRC/5.js"))


# CPU profile.


@query(f"WITH {_SAMPLES}, y AS (SELECT node, greatest(delta, 0) AS weight FROM x WHERE pid = 1) SELECT 'p' AS trace_id, node::BIGINT AS node_id, sum(weight)::DOUBLE AS self_us FROM y GROUP BY node")
def cpu_self_of_process(spark, d):
    return cpu.self_times(_profile_events(spark, d), Scope(pid=1))


@query(f"""WITH {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node)
 SELECT 'p' AS trace_id, row_number() OVER (ORDER BY self_us DESC, node)::INT AS rank, name AS function, round(self_us) AS self_us, url FROM w JOIN nd USING (node) WHERE contains(name, 'f4') OR contains(url, 'vendor/1')""")
def cpu_find(spark, d):
    """Functions whose name or URL matches either word of a pattern."""
    return cpu.matching_urls(_profile_events(spark, d), Matcher("f4|vendor/1", regex=True), top=None)


_UP = "up AS (SELECT node, node AS anc, name AS line, 1 AS depth FROM nd UNION ALL SELECT up.node, p.node, p.name || '>' || up.line, up.depth + 1 FROM up JOIN nd c ON c.node = up.anc JOIN nd p ON p.node = c.parent)"


@query(f"""WITH RECURSIVE {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node), {_UP}, whole AS (SELECT node, arg_max(line, depth) AS stack, max(depth)::INT AS depth FROM up GROUP BY node),
 m AS (SELECT *, sum(self_us) OVER () AS total, row_number() OVER (ORDER BY self_us DESC, node)::INT AS rank FROM w JOIN nd USING (node) WHERE contains(name, 'f3'))
 SELECT 'p' AS trace_id, rank, round(self_us) AS self_us, self_us / total * 100 AS pct, depth, name AS leaf, list_last(string_split(url, '/')) AS leaf_url, stack FROM m JOIN whole USING (node) WHERE rank <= 5""")
def stack_rows(spark, d):
    """The heaviest stacks whose leaf matches; shares are of what matched."""
    return cpu.stacks(_profile_events(spark, d), Matcher("f3"), top=5).select("trace_id", "rank", "self_us", "pct", "depth", "leaf", "leaf_url", F.array_join("stack", ">").alias("stack"))


@query(f"""WITH RECURSIVE {_SAMPLES}, w AS (SELECT node, sum(weight)::DOUBLE AS self_us FROM s GROUP BY node), t AS (SELECT sum(self_us) AS total FROM w), {_UP},
 inc AS (SELECT anc AS node, sum(coalesce(self_us, 0)) AS inclusive FROM up LEFT JOIN w ON w.node = up.node GROUP BY anc), vis AS (SELECT DISTINCT anc AS node FROM up JOIN nd l ON l.node = up.node WHERE contains(l.name, 'f3') AND contains(l.url, 'src')),
 pl AS (SELECT nd.*, inclusive, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN parent IS NULL THEN inclusive ELSE -inclusive END, nd.node) AS place FROM nd JOIN inc USING (node) JOIN vis USING (node)),
 walk AS (SELECT node, [place] AS path, 0 AS depth FROM pl WHERE parent IS NULL UNION ALL SELECT pl.node, list_append(path, place), depth + 1 FROM walk JOIN pl ON pl.parent = walk.node)
 SELECT 'p' AS trace_id, row_number() OVER (ORDER BY path)::INT AS rank, depth, node::BIGINT AS node_id, name AS function, url, round(coalesce(self_us, 0)) AS self_us, round(inclusive) AS inclusive_us, inclusive / total * 100 AS pct
 FROM walk JOIN pl USING (node) LEFT JOIN w USING (node), t""")
def calltree_pruned(spark, d):
    """Only ways to nodes that match by name and by URL."""
    e = _profile_events(spark, d)
    return cpu.call_tree(cpu.nodes(e), cpu.self_times(e), Matcher("f3"), Matcher("src"), top=None)


# Two traces.


@query(f"""WITH r AS ({_delta_sql()}) SELECT a.ord, a.metric, a.unit, a.shoot AS a_shoot, a.delta_pre AS a_delta, b.shoot AS b_shoot, b.delta_pre AS b_delta, b.shoot - a.shoot AS diff_shoot, b.delta_pre - a.delta_pre AS diff_delta
 FROM r a JOIN r b ON a.ord = b.ord WHERE a.trace_id = 't0' AND b.trace_id = 't1'""")
def delta_compare(spark, d):
    """Windows around the anchor in two traces, side by side."""
    rows = delta.delta_rows(delta.window_stats(tev(spark, d), _AROUND, lt_ms=3e7, main_task_us=MAIN), lt_ms=3e7)
    return delta.compare_windows(rows.where("trace_id = 't0'"), rows.where("trace_id = 't1'"))


def _slower(events: DataFrame) -> DataFrame:
    """The events as they were, but every call, layout and style update of the second trace takes half as long again, and layouts and updates touch 40 more objects."""
    second = F.col("trace_id") == "t1"
    k = F.get_json_object("args", "$.k").cast("long") + F.when(second, 40).otherwise(0)
    args = F.concat(F.lit('{"beginData": {"dirtyObjects": '), k.cast("string"), F.lit(', "totalObjects": 200}, "elementCount": '), k.cast("string"), F.lit("}"))
    return events.withColumn("args", args).withColumn("dur", F.when(second, F.col("dur") * 1.5).otherwise(F.col("dur")))


_SLOW = CTX.replace("round(value * 100) * 1e7 AS dur", "round(value * 100) * 1e7 * (CASE user_id % 2 WHEN 1 THEN 1.5 ELSE 1.0 END) AS dur")


@query(f"""WITH {_SLOW}, {_KIDS}, o AS (SELECT trace_id, name, (args::JSON->>'k')::BIGINT + (CASE trace_id WHEN 't1' THEN 40 ELSE 0 END) AS k FROM e WHERE tid = main_tid),
 f AS (SELECT trace_id, task, any_value(stop) - any_value(start) AS d, sum(CASE WHEN name = 'FunctionCall' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS js, sum(CASE WHEN name = 'UpdateLayoutTree' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS style,
 sum(CASE WHEN name = 'Layout' AND dur > 0 AND ts + dur <= stop THEN dur ELSE 0 END) AS layout FROM p GROUP BY trace_id, task HAVING max(name <> 'Layout' AND dur > {HEAVY})),
 sc AS (SELECT trace_id, sum(d) / count(*) AS d, sum(js) / count(*) AS js, sum(style) / count(*) AS style, sum(layout) / count(*) AS layout FROM f GROUP BY 1),
 s AS (SELECT trace_id, count(*) FILTER (name = 'RunTask' AND tid = main_tid AND dur > {LONG})::DOUBLE AS lt, sum(CASE WHEN name = 'RunTask' AND tid = main_tid THEN dur ELSE 0 END) AS busy FROM e GROUP BY 1),
 dl AS (SELECT trace_id, avg(k) FILTER (name = 'Layout') AS dirty, avg(k) FILTER (name = 'UpdateLayoutTree' AND k > 0) AS elements FROM o GROUP BY 1),
 v AS (SELECT trace_id, unnest(range(11))::INT AS ord, unnest([lt, d, js, style, layout, 0, 0, 0, busy, dirty, elements]) AS v, unnest([10, 5, 10, 10, 10, 10, 10, 10, 10, 15, 10]) AS least,
 unnest(['Long Tasks count', 'Scroll Duration', 'JS in Scroll', 'Style Recalc', 'Layout', 'Paint', 'HitTest', 'Composite', 'Main Thread busy', 'Layout Dirty avg', 'Style Elements avg']) AS finding FROM s JOIN sc USING (trace_id) JOIN dl USING (trace_id)),
 r AS (SELECT a.ord, a.finding, a.least, a.v AS value_a, b.v AS value_b, CASE WHEN a.v > 0 THEN (b.v - a.v) / a.v * 100 ELSE 0 END AS pct FROM v a JOIN v b USING (ord) WHERE a.trace_id = 't0' AND b.trace_id = 't1')
 SELECT ord, finding, CASE WHEN pct > 0 THEN 'Regressed' ELSE 'Improved' END AS severity, value_a, value_b, pct FROM r WHERE abs(pct) > least""")
def findings(spark, d):
    """All rules of the comparison, on two traces of which the second does its work more slowly."""

    def side(e):
        scroll = analysis.scroll_summary(analysis.scroll_frames(e, HEAVY, main_task_us=MAIN))
        return compare.metrics(analysis.summary(e, long_us=LONG, main_task_us=MAIN), scroll, analysis.layout_summary(analysis.layout_dirty(e, main_task_us=MAIN)), analysis.style_summary(analysis.style_recalc(e, main_task_us=MAIN)))

    a, b = (_slower(x) for x in _sides(spark, d))
    return compare.findings(side(a), side(b))


# Output forms.


@query(f"""WITH {TEV}, g AS (SELECT name, count(*) AS n, sum(dur) AS total FROM tev WHERE trace_id = 't0' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, name) AS rank FROM g)
 SELECT 0 AS place, '# names' AS line UNION ALL SELECT 1, 'avg_us,count,name,rank,total_us' UNION ALL
 SELECT rank + 1, concat_ws(',', round(total / n)::BIGINT || '.0', n, name, rank, round(total)::BIGINT || '.0') FROM r""")
def csv_names(spark, d):
    """The names section as a CSV block, line by line."""
    keys = ("rank", "name", "count", "total_us", "avg_us")
    rows = inspect.names(tev(spark, d).where("trace_id = 't0'")).orderBy("rank").select(*keys).collect()  # a row an event name
    lines = blocks.csv_blocks([("names", "", [r.asDict() for r in rows])]).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")
