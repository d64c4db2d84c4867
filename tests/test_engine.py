"""The engine on small traces with known answers."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from flamewright import cli
from flamewright.functions.scope import Matcher, NameFilter, Scope
from flamewright.operators import analysis, cpu, delta, inspect, pairing, succession, timebase
from flamewright.plans.session import Options, TraceSession
from flamewright.render import blocks, html
from flamewright.sources import traces

FRAME = inspect.FRAME_EVENT


def x(name, ts, dur=None, tid=11, pid=40, ph="X", **more):
    e = {"name": name, "ph": ph, "ts": ts, "tid": tid, "pid": pid, "cat": "devtools.timeline", **more}
    return e if dur is None else {**e, "dur": dur}


def chunk(ts, nodes, samples, deltas, pid=40):
    listed = [{"id": i, "callFrame": {"functionName": n, "url": u}, "parent": p} for i, n, u, p in nodes]
    return {"name": "ProfileChunk", "ph": "P", "ts": ts, "pid": pid, "tid": 91, "args": {"data": {"cpuProfile": {"nodes": listed, "samples": samples}, "timeDeltas": deltas}}}


def frame(a, b):
    return [x(FRAME, a, tid=23, ph="b"), x(FRAME, b, tid=23, ph="e")]


PASTRY, ICING = "http://oven.test/js/pastry.js", "http://oven.test/js/icing.js"
#: A bakery's page: two and a bit seconds, main thread 11, one long task, a profile of three functions.
BAKERY = [
    {"name": "process_labels", "cat": "__metadata", "ph": "M", "ts": 0, "pid": 31, "tid": 0},
    x("RunTask", 7_000_000, 30_000), x("FunctionCall", 7_004_000, 9_000, args={"data": {"functionName": "kneadDough"}}), x("MinorGC", 7_015_000, 1_200),
    x("RunTask", 7_050_000, 75_000, tid=12), *frame(7_100_000, 7_116_000), *frame(7_116_500, 7_150_500),
    x("RunTask", 7_200_000, 520_000), x("Layout", 7_230_000, 14_000), x("FunctionCall", 7_260_000, 70_000, args={"data": {"functionName": "bakeLoaf"}}),
    {"name": "Profile", "ph": "P", "ts": 7_290_000, "pid": 40, "tid": 91}, *frame(7_300_000, 7_308_000), x("WebSocketReceive", 7_301_000, 250, args={"data": {"note": "oven_ready"}}),
    chunk(7_310_000, [(10, "(root)", "", None), (11, "proof", PASTRY, 10), (12, "glaze", ICING, 11)], [11, 12, 12, 11, 12], [1000, 2000, 3000, 4000, -500]),
    chunk(7_350_000, [(13, "proof", PASTRY, 12)], [13, 13, 11], [2500, 1500, 6000]),
    x("MajorGC", 7_400_000, 22_000), x("V8.GCScavenger", 7_450_000, 800), x("CppGC.Sweep", 7_460_000, 450), x("DroppedFrame", 7_500_000, tid=23, ph="I"),
    *frame(7_900_000, 7_990_000), x("RunTask", 8_000_000, 55_000), x("DroppedFrame", 8_020_000, tid=23, ph="I"), x("MinorGC", 8_030_000, 3_000), x("RunTask", 9_100_000, 5_000),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("traces")
    (d / "bakery.json").write_text(json.dumps({"traceEvents": BAKERY, "metadata": {"cpuThrottling": 6, "hostDPR": 1.5}}))
    with gzip.open(d / "bakery.json.gz", "wt") as f:
        f.write(json.dumps({"traceEvents": BAKERY}))
    (d / "other.json").write_text(json.dumps({"traceEvents": [e for e in BAKERY if e["name"] != "MajorGC"] + [x("TracingStartedInBrowser", 7_000_001, ph="I", args={"data": {"frames": [{"url": ""}, {"url": "about:blank"}, {"url": "http://page/"}]}})]}))
    (d / "broken.txt").write_text("no trace")
    return str(d)


@pytest.fixture(scope="module")
def bakery(spark, folder):
    return traces.read_traces(spark, f"{folder}/bakery.json").cache()


@pytest.fixture(scope="module")
def session(spark, folder):
    return TraceSession.open(spark, f"{folder}/bakery.json")


def one(df):
    return df.first().asDict()


def make(spark, tmp_path, events, name="t"):
    p = tmp_path / f"{name}.json"
    p.write_text(json.dumps({"traceEvents": events}))
    return traces.read_traces(spark, str(p))


def test_reading(spark, folder, bakery, tmp_path):
    assert bakery.count() == len(BAKERY) and bakery.agg(F.max("seq")).first()[0] == len(BAKERY) - 1
    assert [traces.trace_stem(p) for p in traces.list_traces(spark, folder)] == ["bakery", "other"]
    assert traces.list_traces(spark, folder)[0].endswith(".gz")
    both = traces.read_folder(spark, folder)
    assert {r.trace_id: r["count"] for r in both.groupBy("trace_id").count().collect()} == {"bakery": len(BAKERY), "other": len(BAKERY)}
    meta = one(traces.read_metadata(spark, f"{folder}/bakery.json", bakery))
    assert meta["cpu_throttling"] == 6 and meta["page_url"] is None
    assert traces.page_urls(traces.read_traces(spark, f"{folder}/other.json")).first().page_url == "http://page/"
    traces.save(both, str(tmp_path / "saved"))
    assert traces.load(spark, str(tmp_path / "saved")).count() == both.count()


def test_large_files_are_split_by_line(spark, tmp_path):
    r = random.Random(8)
    events = [x(r.choice(["RunTask", "Layout"]), 1000 + i, i % 7, id=i, args={"data": {"k": "}, {" * (i % 3), "n": [i, {"m": None}]}}) for i in range(4000)]
    body = ",\n".join(map(json.dumps, events))
    (tmp_path / "a.json").write_text('{"traceEvents": [\n' + body + '\n], "metadata": {"cpuThrottling": 2}}\n')
    (tmp_path / "b.json").write_text('{"metadata": {"source": "x"}, "traceEvents": [' + body + "]}")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for name in "ab":
            path = str(tmp_path / f"{name}.json")
            split = traces.read_lines(spark, path)
            assert split.rdd.getNumPartitions() > 8
            rows = lambda df: [(*tuple(v)[:1], *tuple(v)[2:-1], json.loads(v.args)) for v in df.orderBy("seq").collect()]
            assert rows(split) == rows(traces.read_traces(spark, path))
        (tmp_path / "c.json").write_text('{"traceEvents": [\n{"name":\n"a"}\n]}')
        with pytest.raises(Exception, match="not one event a line"):
            traces.read_lines(spark, str(tmp_path / "c.json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lenient_and_strict_fields(spark, tmp_path):
    ids = [42, None, "42", -3, 4.5, 2**64 - 1, 0]
    rows = make(spark, tmp_path, [{"name": 'a"\\b', "ph": "sx", "tid": 2**64 - 1, **({} if i is None else {"id": i}), "args": {"b": 1, "a": [1]}} for i in ids]).orderBy("seq").collect()
    assert [None if r.id is None else int(r.id) for r in rows] == [42, None, None, None, None, 2**64 - 1, 0]
    assert rows[0].ph == "s" and rows[0].name == 'a"\\b' and int(rows[0].tid) == 2**64 - 1 and rows[0].ts == 0.0 and json.loads(rows[0].args) == {"b": 1, "a": [1]}
    with pytest.raises(Exception, match="tid"):
        make(spark, tmp_path, [{"name": "a", "tid": "1"}]).collect()
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="not a trace"):
        traces.read_traces(spark, str(tmp_path / "bad.json")).collect()


def test_time_base_and_main_thread(spark, bakery, tmp_path):
    c = one(timebase.context(bakery))
    assert (c["min_ts"], c["end_ts"], int(c["main_tid"])) == (7_000_000, 9_105_000, 11)
    tie = make(spark, tmp_path, [x("RunTask", 1, 5, tid=9), x("RunTask", 2, 5, tid=4)])
    assert int(one(timebase.context(tie))["main_tid"]) == 4
    assert int(one(timebase.context(make(spark, tmp_path, [x("A", 1)])))["main_tid"]) == 0


def test_anchor_priority(spark, bakery, tmp_path):
    # The profile starts at 7,290,000; proof is seen first after 1,000, glaze after 3,000.
    a = one(timebase.find_anchor(bakery, Matcher("glaze")))
    assert (a["ts"], a["kind"], a["label"]) == (7_293_000, "cpu-profile", "glaze")
    a = one(timebase.find_anchor(bakery, Matcher("PASTRY.")))
    assert (a["ts"], a["kind"], a["label"]) == (7_291_000, "cpu-profile", PASTRY)
    a = one(timebase.find_anchor(bakery, Matcher("loaf")))
    assert (a["ts"], a["kind"], a["label"]) == (7_260_000, "FunctionCall", "bakeLoaf")
    a = one(timebase.find_anchor(bakery, Matcher("oven_")))
    assert (a["ts"], a["kind"], a["label"]) == (7_301_000, "args", "oven_ready")
    assert timebase.find_anchor(bakery, Matcher("absent")).count() == 0
    with pytest.raises(ValueError):
        Matcher("")


def test_cpu_profile(bakery):
    # A sample weighs its delta, falling ones nothing: proof (11) 1,000 + 4,000 + 6,000, glaze 2,000 + 3,000, proof (13) 2,500 + 1,500.
    own = {int(r.node_id): r.self_us for r in cpu.self_times(bakery).collect()}
    assert own == {11: 11_000, 12: 5_000, 13: 4_000}
    # Starts of the samples: 7,291,000 and 1,000, 3,000, 6,000, 10,000 later; the second chunk's clock stands at 7,299,500 + 2,500.
    win = {int(r.node_id): r.self_us for r in cpu.self_times(bakery, Scope((7_291_500, 7_302_000))).collect()}
    assert win == {11: 4_000, 12: 5_000, 13: 2_500}
    rows = cpu.matching_functions(bakery, Matcher("proof")).collect()
    assert [r.self_us for r in rows] == [11_000, 4_000] and sum(r.pct for r in rows) == pytest.approx(75)
    tree = cpu.call_tree(cpu.nodes(bakery), cpu.self_times(bakery), url=Matcher("icing.js")).orderBy("rank").collect()
    assert [(r.depth, r.function, r.inclusive_us) for r in tree] == [(0, "(root)", 20_000), (1, "proof", 20_000), (2, "glaze", 9_000)]
    assert [r.line for r in cpu.folded(bakery).orderBy("rank").collect()] == ["(root);proof 11000", "(root);proof;glaze 5000", "(root);proof;glaze;proof 4000"]


def test_stray_samples(bakery):
    assert one(cpu.stray_samples(bakery)) == {"trace_id": "bakery", "stray": 0, "samples": 8}
    assert one(cpu.stray_samples(bakery, slack_us=-300_000))["stray"] > 0


def test_parent_cycles_and_several_roots(spark):
    known = spark.createDataFrame([("t", 1, "a", "", None), ("t", 2, "b", "", 1), ("t", 3, "c", "", 9), ("t", 5, "x", "", 6), ("t", 6, "y", "", 5)], "trace_id string, node_id int, name string, url string, parent int").selectExpr("trace_id", "cast(node_id as decimal(20,0)) node_id", "name", "url", "cast(parent as decimal(20,0)) parent")
    own = spark.createDataFrame([("t", 2, 5.0), ("t", 3, 2.0), ("t", 5, 1.0)], "trace_id string, node_id int, self_us double").withColumn("node_id", F.col("node_id").cast("decimal(20,0)"))
    paths = {int(r.node_id): ([int(i) for i in r.path], r.cyclic) for r in cpu.ancestor_paths(known).collect()}
    assert paths[2] == ([1, 2], False) and paths[3] == ([9, 3], False) and paths[5][1] and sorted(paths[5][0]) == [5, 6]
    rows = cpu.call_tree(known, own).orderBy("rank").collect()
    assert [(r.function, r.depth) for r in rows] == [("c", 0), ("a", 0), ("b", 1)]


def test_deep_stacks_need_no_recursion_limit(spark):
    n = 1500
    known = spark.range(1, n + 1).selectExpr("'t' trace_id", "cast(id as decimal(20,0)) node_id", "cast(nullif(id - 1, 0) as decimal(20,0)) parent")
    assert cpu.ancestor_paths(known).agg(F.max(F.size("path")), F.sum(F.size("path"))).first()[:] == (n, n * (n + 1) // 2)


def test_frames_gc_and_long_tasks(bakery):
    # Frames of 16,000, 34,000, 8,000 and 90,000: the nearest rank of the half is place 1 + round(1.5) of 4.
    f = one(inspect.frames(bakery))
    assert (f["count"], f["max_us"], f["avg_us"], f["p50_us"], f["p99_us"], f["dropped_frames"]) == (4, 90_000, 37_000, 34_000, 90_000, 2)
    assert {r.group: (r["count"], r.total_us) for r in inspect.gc(bakery).collect()} == {inspect.GC_GROUPS[0]: (1, 22_000), inspect.GC_GROUPS[1]: (3, 5_000), inspect.GC_GROUPS[2]: (1, 450)}
    lt = one(inspect.gc_long_tasks(bakery))
    assert (lt["count"], lt["total_us"], lt["top_us"]) == (2, 575_000, [520_000, 55_000])


def test_delta_windows(bakery):
    w = timebase.windows_around(7_301_000)
    assert w == {"pre": (6_701_000, 7_201_000), "shoot": (7_201_000, 7_401_000), "post": (7_401_000, 7_901_000)}
    rows = {r.metric: r for r in delta.delta_rows(delta.window_stats(bakery, w)).collect()}
    assert len(rows) == 13
    # The long task starts at 7,200,000 and so counts before; only the major collection and the second call start during.
    before = {k: v.pre for k, v in rows.items()}
    assert (before["frames"], before["frame max"], before["long tasks ≥50ms"], before["main busy (RunTask)"], before["JS (FunctionCall)"], before["GC count"], before["CPU samples"]) == (2, 34_000, 1, 550_000, 9_000, 1, 0)
    during = {k: v.shoot for k, v in rows.items()}
    assert (during["frames"], during["dropped frames"], during["main busy (RunTask)"], during["JS (FunctionCall)"], during["GC (Major+Minor)"], during["GC count"], during["CPU samples"]) == (1, 0, 0, 70_000, 22_000, 1, 20_000)
    assert (rows["frames"].post, rows["dropped frames"].post, rows["GC (Major+Minor)"].post, rows["CPU samples"].post) == (0, 1, 0, 0)
    same = delta.compare_windows(*[delta.delta_rows(delta.window_stats(bakery, w))] * 2).collect()
    assert len(same) == 13 and all(r.diff_shoot == 0 and r.diff_delta == 0 for r in same)
    assert one(delta.top_cpu(bakery, w).where("win = 'shoot' and rank = 1"))["function"] == "proof"


def stack_oracle(rows):
    stacks, out = {}, []
    for tid, ph, ts in rows:
        if ph == "b":
            stacks.setdefault(tid, []).append(ts)
        elif stacks.get(tid):
            t = stacks[tid].pop()
            if ts > t:
                out.append((tid, t, ts))
    return sorted(out)


def test_stack_and_interval_joins_match_plain_loops(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 2), r.choice("be"), r.randint(0, 50)) for _ in range(300)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "seq long, tid int, ph string, ts int")
    got = sorted((x.tid, x.begin, x.end) for x in pairing.stack_pairs(df, ["tid"]).collect())
    assert got == stack_oracle(rows)
    tasks = [(i, r.randint(0, 1), a := r.uniform(0, 1000), a + r.choice([-5, 0, 3, 700]) + r.uniform(0, 40)) for i in range(60)]
    events = [(i, r.randint(0, 1), r.uniform(-50, 1900)) for i in range(300)]
    t = spark.createDataFrame(tasks, "task int, tid int, start double, stop double")
    e = spark.createDataFrame(events, "event int, tid int, ts double")
    want = sorted((a, b) for a, k, lo, hi in tasks for b, m, ts in events if k == m and lo <= ts <= hi)
    for width in (None, 7.0):
        assert sorted((x.task, x.event) for x in pairing.interval_join(t, e, ["tid"], width).collect()) == want


def test_async_memory_input(spark, tmp_path):
    a = make(spark, tmp_path, [x("raf", 10, ph="s", id=1), x("raf", 12, ph="s", id=1), x("z", 25, ph="f", id=1), x("z", 5, ph="f", id=1), x("raf", 30, ph="s", id=3), x("q", 31, ph="s"), x("q", 40, ph="f")])
    assert sorted(r.dur for r in pairing.async_pairs(a).collect()) == [0, 15]
    mb = 1_048_576
    m = make(spark, tmp_path, [x("UpdateCounters", 5, ph="I", args={"data": {"jsHeapSizeUsed": mb, "nodes": 3}}), x("UpdateCounters", 9, ph="I", args={"data": {"jsHeapSizeUsed": 2 * mb}}), x("UpdateCounters", 7, ph="I", args={"data": {"jsHeapSizeUsed": "9"}})], "m")
    s = one(inspect.memory_summary(inspect.memory_samples(m)))
    assert (s["samples"], s["growth"], s["peak_ts"], s["peak_nodes"]) == (3, mb, 9, 3)
    i = make(spark, tmp_path, [x("EventDispatch", k, d, args={"data": {"type": t}}) for k, (d, t) in enumerate([(1000, "pointerdown"), (2000, "pointerdown"), (4000, "pointerdown"), (500, "mousemove"), (1, 5)])], "i")
    rows = {r.type: r for r in inspect.input_types(i).collect()}
    assert rows["pointerdown"].p50_us == 2000 and rows["pointerdown"].p99_us == 4000 and set(rows) == {"pointerdown", "mousemove", "(unknown)"}
    assert [r.dur_us for r in inspect.input_worst(i, top=2).orderBy("rank").collect()] == [4000, 2000]


def test_scroll_reflow_layout_style_jank(spark, tmp_path):
    e = make(spark, tmp_path, [
        x("RunTask", 1000, 200_000), x("FunctionCall", 2000, 60_000), x("Layout", 70_000, 10_000, args={"beginData": {"dirtyObjects": 5, "totalObjects": 10}}), x("FunctionCall", 90_000, 10),
        x("UpdateLayoutTree", 90_020, 30, args={"elementCount": 7}), x("Layout", 150_000, 90_000, args={"beginData": {"dirtyObjects": "3"}}), x("RunTask", 900_000, 10_000), x("DroppedFrame", 905_000, ph="I", tid=5), x("RunTask", 5_000_000, 10),
    ])
    s = one(analysis.scroll_frames(e))
    assert (s["js_us"], s["layout_us"], s["style_us"], s["bottleneck"]) == (60_010, 10_000, 30, "JS")
    r = one(analysis.forced_reflows(e))
    assert (r["reflows"], r["layout_us"]) == (2, 10_030)
    lay = one(analysis.layout_summary(analysis.layout_dirty(e)))
    assert (lay["layouts"], lay["avg_dirty"], lay["max_dirty"], lay["avg_ratio"]) == (2, 2.5, 5, 25.0)
    assert one(analysis.style_summary(analysis.style_recalc(e)))["avg_elements"] == 7
    j = analysis.jank_clusters(e).orderBy("rank").collect()
    assert [(c.first, c.last, c.dropped, c.max_run_us) for c in j] == [(18, 18, 1, 0), (0, 0, 0, 200_000)]


@pytest.mark.parametrize("seed", range(3))
def test_follows_by_brute_force(spark, seed, monkeypatch):
    """Overlapping tasks, equal times, negative lengths, several traces, bins of all widths."""
    r = random.Random(seed)
    tasks = [(f"t{r.randrange(2)}", k, float(a), float(a + r.choice([0, 3, 10, 40, -2]))) for k in range(60) for a in [r.randrange(60)]]
    events = [(f"t{r.randrange(3)}", k, float(r.randrange(70)), r.choice([0.0, 1.0, 1.0, 2.5, 30.0, -3.0]), r.random() < 0.5) for k in range(90)]
    want = set()
    for trace, task, a, b in tasks:
        held = sorted((ts, seq, first, d) for t, seq, ts, d, first in events if t == trace and a <= ts <= b and ts + d <= b)
        after = [y[3] for x, y in zip(held, held[1:]) if x[2] and not y[2]]
        if held:
            want.add((trace, task, a, b, len(after), sum(after)))
    assert {w[4] for w in want} > {0, 1, 2, 3}
    t, e = spark.createDataFrame(tasks, "trace_id string, task long, start double, stop double"), spark.createDataFrame(events, "trace_id string, seq long, ts double, dur double, first boolean")
    for width in (None, 0.7, 5.0, 1000.0):
        assert {tuple(x) for x in succession.follows(t, e, width).collect()} == want
    parts = t.where("stop >= start").selectExpr("trace_id", "floor(start / 100) as bin", "false as event", "task as seq", "start as begin", "stop as end", "false as first", "0d as us")
    parts = parts.unionByName(e.selectExpr("trace_id", "floor(ts / 100) as bin", "true as event", "seq", "ts as begin", "greatest(ts, ts + dur) as end", "first", "dur as us"))
    batches = parts.orderBy("trace_id", "bin").toArrow().to_batches(7)
    whole = {tuple(x.values()) for b in succession._summaries(iter(batches)) for x in b.to_pylist()}
    monkeypatch.setattr(succession, "ROWS", 5)
    assert {tuple(x.values()) for b in succession._summaries(iter(batches)) for x in b.to_pylist()} == whole
    assert {(*x[:4], *x[7:]) for x in whole} == want


def _shuffled(plan) -> int:
    """Records that the exchanges of an executed plan wrote."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.metrics().contains("shuffleRecordsWritten") else 0
    return own + sum(_shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_reflows_of_overlapping_tasks_list_no_pairs(spark, tmp_path):
    n = 300
    e = make(spark, tmp_path, [x("RunTask", k, 600_000) for k in range(n)] + [x(("FunctionCall", "Layout")[k % 2], 1000 + k, 10) for k in range(n)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = analysis.forced_reflows(e)
        rows = out.collect()
        assert len(rows) == n and {(r.reflows, r.layout_us) for r in rows} == {(n // 2, n // 2 * 10.0)}
        # collect() and the plan of out share one execution; n * n pairs would be 90,000.
        assert 0 < _shuffled(out._jdf.queryExecution().executedPlan()) < 10 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_inspectors(bakery):
    assert [r.name for r in inspect.names(bakery, top=2).orderBy("rank").collect()] == ["RunTask", "FunctionCall"]
    t = {int(r.tid): r for r in inspect.threads(bakery).collect()}
    assert t[11].runtask_us == 610_000 and t[12].runtask_us == 75_000 and t[23].top_event == FRAME
    listed = inspect.events_list(bakery, NameFilter(("RunTask",)), sort="dur").orderBy("rank").collect()
    assert [r.dur_us for r in listed] == [520_000, 75_000, 55_000, 30_000, 5_000] and listed[0].total == 5
    line = inspect.timeline(bakery, bucket_ms=500).orderBy("bucket").collect()
    assert len(line) == 5 and sum(r.events for r in line) == bakery.where("ts >= 7000000").count() and line[0].busy == 1.0 and line[4].runtask_us == 5_000
    task = inspect.tasks(bakery, top=1).first()
    assert task.dur_us == 520_000 and task.top_function_call.name == "bakeLoaf" and {c.name for c in task.children} >= {"MajorGC", "WebSocketReceive", "Layout"}
    assert inspect.find(bakery, Matcher("oven_ready")).first().hit == "oven_ready"
    assert inspect.find(bakery, Matcher("^note$", regex=True)).count() == 1
    assert inspect.find(bakery, Matcher("glaze")).count() == 1


def test_sections_and_envelopes(session):
    o = Options(events="RunTask", function="proof", find="pastry.js", names=True, threads=True, stacks=True, task=True, timeline=True, jank=True, memory=True, input=True, async_=True, anchor="glaze", delta=True, calltree=True, gc=True, frames=True)
    sections = session.sections(o)
    assert [k for k, _, _ in sections] == ["jank", "memory", "input", "async", "timeline", "task", "names", "threads", "events", "functions", "stacks", "calltree", "gc", "frames", "find", "delta"]
    got = json.loads(blocks.envelope(session.name, sections))["sections"]
    assert set(got["events"][0]) == {"t_us", "dur_us", "name", "tid", "pid", "args"}
    assert set(got["stacks"][0]) == {"rank", "self_us", "pct", "depth", "leaf", "leaf_url", "stack"}
    assert set(got["frames"][0]) == {"frame_event", "count", "avg_us", "p50_us", "p90_us", "p99_us", "max_us", "dropped_frames"}
    assert [len(got["delta"][k]) for k in ("metrics", "windows")] == [13, 3]
    assert "# delta.metrics\n" in blocks.csv_blocks(sections)
    assert blocks.csv_rows([{"b": 'x,"y"', "a": None}, {"b": [1]}]) == 'a,b\n,"x,""y"""\n,[1]\n'


def test_csv_numbers():
    """Whole numbers keep all digits, however large; all else is written as JSON has it."""
    assert [blocks.field(v) for v in (30546167400000000.0, 2.0**60, -3e16, 12.0, 0.25, 7, True, None)] == ["30546167400000000.0", "1152921504606846976.0", "-30000000000000000.0", "12.0", "0.25", "7", "true", ""]


def test_reports(spark, folder, tmp_path):
    path = f"{folder}/bakery.json"
    md = cli.run(spark, [path, "--compare", f"{folder}/other.json"])
    assert "## Overview" in md and "**CPU Throttle**: 6x" in md and "## Comparison: bakery (A) vs other (B)" in md and "### Notes" in md
    page = cli.run(spark, [path, "--html"])
    assert page.startswith("<!doctype html>") and "<svg" in page and "<script" not in page
    assert json.loads(cli.run(spark, [path, "--worst", "--json"]))["sections"]["events"]
    assert cli.run(spark, [path, "--flame"]).splitlines()[0] == "(root);proof 11000"
    merged = json.loads(cli.run(spark, [path, "--compare", f"{folder}/other.json", "--anchor", "oven_ready", "--delta", "--json"]))
    assert len(merged["compare"]) == 13 and {r["metric"]: r["diff_shoot"] for r in merged["compare"]}["GC count"] == -1
    assert cli.run(spark, [folder]) == "bakery\nother\n"


def test_repl(spark, folder):
    r = cli.Repl(spark, f"{folder}/bakery.json")
    assert r.answer("quit") is None and f"{len(BAKERY)} events" in r.answer("status")
    assert "Duration stats" in r.answer("stats RunTask") and "# gc" in r.answer("gc --csv")
    assert r.answer("throttle 3") == "throttle = 3x\n" and r.answer("nonsense").startswith("? unknown")
    assert cli.words("find 'a b' \"c\\\"d\" e\\ f") == ["find", "a b", 'c"d', "e f"]
    assert cli.expand(["stats", "X"]) == ["--events", "X", "--stats"] and cli.expand(["top=5"]) == ["--top=5"]


def test_chart_decimation():
    points = [(float(i), 0.0) for i in range(5000)]
    got = html.decimate(points)
    assert len(got) == 700 and got[0] == points[0] and got[-1] == points[-1]


def test_live_timeline(spark, tmp_path, bakery):
    from flamewright.streaming import live

    bakery.coalesce(1).write.json(str(tmp_path / "in"))
    q = live.live_timeline(live.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    rows = spark.sql("select * from live").collect()
    q.stop()
    assert sum(r.events for r in rows) == bakery.count() and sum(r.dropped for r in rows) == 2 and sum(r.runtask_us for r in rows) == 685_000
