"""Sampled CPU profile: nodes, sample times, self time, stacks, call tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.scope import Matcher, Scope, or_anonymous, source_type
from .timebase import context, into_windows

_NODES = "data struct<cpuProfile: struct<nodes: array<struct<id: bigint, callFrame: struct<functionName: string, url: string>, parent: bigint>>>>"
_CHUNK = "data struct<cpuProfile: struct<samples: array<variant>>, timeDeltas: array<variant>>"


def _chunks(events: DataFrame) -> DataFrame:
    return events.where((F.col("name") == "ProfileChunk") & F.col("args").isNotNull())


def _number(v: Column) -> Column:
    """A JSON number as double; other types null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _id(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when((kind == "BIGINT"), F.try_variant_get(v, "$", "decimal(20,0)"))


def nodes(events: DataFrame) -> DataFrame:
    """(trace_id, node_id, name, url, parent), the first of each id; ids are one space over all processes of a trace."""
    rows = _chunks(events).select("trace_id", "seq", F.posexplode(F.from_json("args", _NODES)["data"]["cpuProfile"]["nodes"]).alias("pos", "n"))
    rows = rows.select("trace_id", "seq", "pos", F.coalesce("n.id", F.lit(0)).cast("decimal(20,0)").alias("node_id"), F.struct(F.coalesce("n.callFrame.functionName", F.lit("(anonymous)")).alias("name"), F.coalesce("n.callFrame.url", F.lit("")).alias("url"), F.col("n.parent").cast("decimal(20,0)").alias("parent")).alias("v"))
    return rows.groupBy("trace_id", "node_id").agg(F.min_by("v", F.struct("seq", "pos")).alias("v")).select("trace_id", "node_id", "v.*")


def _deltas(events: DataFrame) -> DataFrame:
    """Chunks in the event table with ``samples`` (array of ids, null entries kept) and ``deltas`` (array of double, other types null)."""
    parsed = F.from_json("args", _CHUNK)["data"]
    rows = _chunks(events).select("trace_id", "seq", "ts", "pid", "tid", "cat", parsed.alias("p"))
    return rows.select("trace_id", "seq", "ts", "pid", "tid", "cat", F.transform("p.cpuProfile.samples", _id).alias("samples"), F.transform("p.timeDeltas", _number).alias("deltas"))


def _starts(events: DataFrame) -> DataFrame:
    return events.where((F.col("name") == "Profile") & (F.col("ph") == "P")).groupBy("trace_id", "pid").agg(F.min_by("ts", "seq").alias("start"))


def _total(deltas: Column) -> Column:
    return F.aggregate(deltas, F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))


def samples(events: DataFrame, scope: Scope = Scope(), timed: bool = True) -> DataFrame:
    """(trace_id, seq, k, pid, tid, cat, node_id, delta, weight, sample_ts) of the chunks in scope (window aside).

    Chunk times run on from the process's Profile event, chunk by chunk, over all chunks whatever the scope; a chunk's base is
    the time after its first delta, and sample k lies the first k deltas further on.  A delta that is no number counts 0; a
    chunk whose first delta is no number has base 0 and does not move the clock.
    """
    rows = _deltas(events)
    if timed:
        usable = rows.where(F.get("deltas", F.lit(0)).isNotNull()).join(_starts(events), ["trace_id", "pid"], "left")
        before = Window.partitionBy("trace_id", "pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        clock = F.coalesce("start", F.lit(0.0)) + F.coalesce(F.sum(_total(F.col("deltas"))).over(before), F.lit(0.0))
        bases = usable.select("trace_id", "seq", (clock + F.get("deltas", F.lit(0))).alias("base"))
        rows = rows.join(bases, ["trace_id", "seq"], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    else:
        rows = rows.withColumn("base", F.lit(0.0))
    n = F.least(F.size("samples"), F.size("deltas"))
    rows = rows.where(scope.chunks() & F.col("samples").isNotNull() & F.col("deltas").isNotNull())
    zipped = F.arrays_zip(F.slice("samples", F.lit(1), n).alias("node_id"), F.slice("deltas", F.lit(1), n).alias("delta"))
    out = rows.select("trace_id", "seq", "pid", "tid", "cat", "base", F.posexplode(F.when(n > 0, zipped)).alias("k", "x"))
    out = out.select("trace_id", "seq", "k", "pid", "tid", "cat", "base", F.coalesce("x.node_id", F.lit(0)).cast("decimal(20,0)").alias("node_id"), F.coalesce("x.delta", F.lit(0.0)).alias("delta"))
    past = F.coalesce(F.sum("delta").over(Window.partitionBy("trace_id", "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) if timed else F.lit(0.0)
    return out.withColumn("weight", F.greatest("delta", F.lit(0.0))).withColumn("sample_ts", F.col("base") + past).drop("base")


def anchor_times(events: DataFrame) -> DataFrame:
    """(trace_id, node_id, ts): earliest sample of each node.  This clock moves on chunks with both arrays only, over their common length, and a sample lies after its own delta."""
    rows = _deltas(events).where("samples is not null and deltas is not null")
    n = F.least(F.size("samples"), F.size("deltas"))
    cut = F.slice("deltas", F.lit(1), n)
    before = Window.partitionBy("trace_id", "pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(_starts(events), ["trace_id", "pid"], "left").withColumn("base", F.coalesce("start", F.lit(0.0)) + F.coalesce(F.sum(_total(cut)).over(before), F.lit(0.0)))
    x = rows.select("trace_id", "seq", "base", F.posexplode(F.when(n > 0, F.arrays_zip(F.slice("samples", F.lit(1), n).alias("node_id"), cut.alias("delta")))).alias("k", "x"))
    upto = F.sum(F.coalesce("x.delta", F.lit(0.0))).over(Window.partitionBy("trace_id", "seq").orderBy("k"))
    x = x.select("trace_id", "seq", F.col("x.node_id").alias("node_id"), (F.col("base") + upto).alias("ts")).where("node_id <> 0")
    known = _chunks(events).select("trace_id", "seq", F.explode(F.from_json("args", _NODES)["data"]["cpuProfile"]["nodes"]["id"]).alias("node_id")).withColumn("node_id", F.col("node_id").cast("decimal(20,0)")).groupBy("trace_id", "node_id").agg(F.min("seq").alias("since"))
    return x.join(known, ["trace_id", "node_id"]).where("seq >= since").groupBy("trace_id", "node_id").agg(F.min("ts").alias("ts"))


def self_times(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(trace_id, node_id, self_us): without a window the sample times are not worked out."""
    rows = samples(events, scope, timed=scope.window is not None)
    if scope.window:
        rows = rows.where(F.col("sample_ts").between(*map(float, scope.window)) & (F.col("weight") > 0))
    return rows.groupBy("trace_id", "node_id").agg(F.sum("weight").alias("self_us"))


def self_times_in(events: DataFrame, windows: dict[str, tuple[float, float]], scope: Scope = Scope()) -> DataFrame:
    """(trace_id, win, node_id, self_us) for several windows from one pass."""
    rows = into_windows(samples(events, scope).where("weight > 0"), windows, "sample_ts")
    return rows.groupBy("trace_id", "win", "node_id").agg(F.sum("weight").alias("self_us"))


def functions(events: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """(trace_id, node_id, name, url, source, self_us) with positive self time; unknown nodes have empty names."""
    rows = self_times(events, scope).where("self_us > 0").join(nodes(events), ["trace_id", "node_id"], "left")
    return rows.select("trace_id", "node_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("url", F.lit("")).alias("url"), source_type("url").alias("source"), "self_us")


def source_totals(funcs: DataFrame) -> DataFrame:
    of = lambda s: F.sum(F.when(F.col("source") == s, F.col("self_us")).otherwise(0.0)).alias(f"{s}_us")
    return funcs.groupBy("trace_id").agg(of("app"), of("runtime"), of("native"), F.sum("self_us").alias("total_us"))


def matching_functions(events: DataFrame, matcher: Matcher, scope: Scope = Scope(), top: int | None = 30) -> DataFrame:
    """rank, function, url, self_us, pct (of all time in scope, unknown nodes included) of the functions whose name matches."""
    own = self_times(events, scope)
    total = own.groupBy("trace_id").agg(F.sum("self_us").alias("total"))
    rows = own.join(nodes(events), ["trace_id", "node_id"]).where(matcher.test("name")).join(total, "trace_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("self_us").desc(), "node_id")))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("trace_id", "rank", or_anonymous("name").alias("function"), "url", F.round("self_us").alias("self_us"), F.when(F.col("total") > 0, F.col("self_us") / F.col("total") * 100).otherwise(0.0).alias("pct"))


def matching_urls(events: DataFrame, matcher: Matcher, scope: Scope = Scope(), top: int | None = 30) -> DataFrame:
    """rank, function, url, self_us of the functions whose name or URL matches."""
    rows = self_times(events, scope).join(nodes(events), ["trace_id", "node_id"]).where(matcher.test("name") | matcher.test("url"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("self_us").desc(), "node_id")))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("trace_id", "rank", or_anonymous("name").alias("function"), F.round("self_us").alias("self_us"), "url")


def stray_samples(events: DataFrame, slack_us: float = 30e6) -> DataFrame:
    """(trace_id, stray, samples): samples whose time lies outside the trace's bounds by more than the slack, a sign of a broken clock."""
    bounds = context(events).select("trace_id", "min_ts", "end_ts")
    rows = samples(events).join(bounds, "trace_id")
    stray = (F.col("sample_ts") < F.col("min_ts") - slack_us) | (F.col("sample_ts") > F.col("end_ts") + slack_us)
    return rows.groupBy("trace_id").agg(F.count_if(stray).alias("stray"), F.count("*").alias("samples"))


def ancestor_paths(tree: DataFrame) -> DataFrame:
    """(trace_id, node_id, path, cyclic): ids from root to node for tree(trace_id, node_id, parent).

    Pointer doubling: after k rounds a path reaches 2**k ancestors, so depth costs its logarithm in joins and no recursion
    limit applies.  A parent that is no node ends the path as an unknown id; a cycle ends it at the first repeated id.
    """
    known = tree.select("trace_id", "node_id", "parent")
    missing = known.where("parent is not null").select("trace_id", F.col("parent").alias("node_id")).distinct().join(known, ["trace_id", "node_id"], "left_anti").withColumn("parent", F.lit(None).cast("decimal(20,0)"))
    now = known.unionByName(missing).select("trace_id", "node_id", F.array(F.col("node_id")).alias("path"), F.col("parent").alias("up"))
    now = cut(now)
    most = now.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most and not now.where("up is not null").isEmpty():
        above = now.select("trace_id", F.col("node_id").alias("up"), F.col("path").alias("more"), F.col("up").alias("next"))
        step = now.join(above, ["trace_id", "up"], "left")
        step = step.select("trace_id", "node_id", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("more", "path")).alias("path"), F.col("next").alias("up"))
        now, reach = cut(step), reach * 2
    whole = now.select("trace_id", "node_id", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.reverse(F.array_distinct(F.reverse("path")))).alias("path"), F.col("up").isNotNull().alias("cyclic"))
    return whole.join(known.select("trace_id", "node_id"), ["trace_id", "node_id"], "left_semi")


def stacks(events: DataFrame, matcher: Matcher | None = None, scope: Scope = Scope(), top: int | None = 30) -> DataFrame:
    """rank, self_us, pct (of what matched), depth, leaf, leaf_url, stack (names root to leaf) of the heaviest leaves."""
    known = nodes(events)
    own = self_times(events, scope).join(known, ["trace_id", "node_id"], "left")
    if matcher:
        own = own.where(matcher.test("name"))
    by = Window.partitionBy("trace_id")
    own = own.withColumn("total", F.sum("self_us").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.col("self_us").desc(), "node_id")))
    own = own if top is None else own.where(F.col("rank") <= top)
    paths = ancestor_paths(known).select("trace_id", "node_id", F.posexplode("path").alias("pos", "id"))
    label = known.select("trace_id", F.col("node_id").alias("id"), or_anonymous("name").alias("label"))
    named = paths.join(own.select("trace_id", "node_id"), ["trace_id", "node_id"], "left_semi").join(label, ["trace_id", "id"], "left")
    chains = named.groupBy("trace_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", F.lit("(unknown)")).alias("label")))), lambda x: x["label"]).alias("stack"))
    out = own.join(chains, ["trace_id", "node_id"], "left").withColumn("stack", F.coalesce("stack", F.array(F.lit("(unknown)"))))
    leaf = F.when(F.col("name").isNull(), "(unknown)").otherwise(or_anonymous("name"))
    return out.select("trace_id", "rank", "node_id", F.col("self_us").alias("exact_us"), F.round("self_us").alias("self_us"), F.when(F.col("total") > 0, F.col("self_us") / F.col("total") * 100).otherwise(0.0).alias("pct"), F.size("stack").alias("depth"), leaf.alias("leaf"), F.substring_index(F.coalesce("url", F.lit("")), "/", -1).alias("leaf_url"), "stack")


def folded(events: DataFrame, matcher: Matcher | None = None, scope: Scope = Scope()) -> DataFrame:
    """rank, line: "a;b;c weight" for flame graphs, heaviest first."""
    rows = stacks(events, matcher, scope, None)
    return rows.select("trace_id", "rank", F.concat(F.array_join("stack", ";"), F.lit(" "), F.expr("format_number(exact_us, '0')")).alias("line"))


def call_tree(known: DataFrame, own: DataFrame, name: Matcher | None = None, url: Matcher | None = None, top: int | None = 30) -> DataFrame:
    """rank (pre-order), depth, node_id, function, url, self_us, inclusive_us, pct of known(trace_id, node_id, name, url, parent) with own(trace_id, node_id, self_us).

    A node shows when it or a descendant matches every given filter.  Children come by falling inclusive time, roots by rising;
    nodes of a parent cycle have no root and are left out.
    """
    paths = ancestor_paths(known).where("not cyclic").select("trace_id", "node_id", F.col("path"))
    ids = known.select("trace_id", "node_id").withColumn("is_node", F.lit(True))
    test = (name.test("name") if name else F.lit(True)) & (url.test("url") if url else F.lit(True))
    leaf = known.withColumn("hit", test).join(own, ["trace_id", "node_id"], "left").select("trace_id", "node_id", "hit", F.coalesce("self_us", F.lit(0.0)).alias("self_us"))
    up = paths.join(leaf, ["trace_id", "node_id"]).select("trace_id", F.explode("path").alias("node_id"), "hit", F.col("self_us").alias("part"))
    sums = up.groupBy("trace_id", "node_id").agg(F.sum("part").alias("inclusive"), F.max("hit").alias("shown"))
    total = own.groupBy("trace_id").agg(F.sum("self_us").alias("total"))
    flat = known.join(sums, ["trace_id", "node_id"]).join(ids.select("trace_id", F.col("node_id").alias("parent"), "is_node"), ["trace_id", "parent"], "left")
    flat = flat.where("shown").withColumn("parent", F.when(F.col("is_node"), F.col("parent")))
    root = F.col("parent").isNull()
    place = F.row_number().over(Window.partitionBy("trace_id", "parent").orderBy(F.when(root, F.col("inclusive")).otherwise(-F.col("inclusive")), "node_id"))
    flat = flat.withColumn("place", place)
    steps = paths.select("trace_id", "node_id", F.posexplode("path").alias("pos", "id")).join(flat.select("trace_id", F.col("node_id").alias("id"), "place"), ["trace_id", "id"])
    order = steps.groupBy("trace_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"]).alias("at"))
    out = flat.join(order, ["trace_id", "node_id"]).join(leaf.select("trace_id", "node_id", "self_us"), ["trace_id", "node_id"]).join(total, "trace_id", "left")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy("at")))
    out = out if top is None else out.where(F.col("rank") <= max(top, 1))
    pct = F.when(F.col("total") > 0, F.col("inclusive") / F.col("total") * 100).otherwise(0.0)
    return out.select("trace_id", "rank", (F.size("at") - 1).alias("depth"), "node_id", or_anonymous("name").alias("function"), "url", F.round("self_us").alias("self_us"), F.round("inclusive").alias("inclusive_us"), pct.alias("pct"))
