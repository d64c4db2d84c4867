"""MinHash near-dedup with BagMinHash signatures (operator 7).

Method: each shingle with multiplicity w owns the unit intervals of [0, w).  Dyadic blocks
[0,1), [1,2), [2,4), [4,8), ... carry independent Poisson processes of points (time, slot); a block
is split in halves after its first point until unit intervals remain, so texts with different
multiplicities see the same points on the intervals they share.  The signature keeps the
earliest time of each slot; two slots agree with probability sum(min)/sum(max) of the multiplicities.
Points later than a limit that follows from the text's total weight are never made, which is what makes
the signature take about one draw per shingle.

Defined cases: null text counts as empty; texts without words are one class; repeated rows and
equal word sequences share a class; rows with a null doc_id get the class of their words (null when no
row with these words has an id); rows that share a doc_id share its class; ties: a pair at the threshold is linked, a class is named by its
least doc_id; very long texts are signed and compared whole (one text and about 100 bytes a word in memory); extra columns are ignored in
``near_classes`` and kept in ``deduplicate``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import graph
from .shingles import byte_sizes, keys, mix, portions, similarity, weighted

SLOTS, BANDS, THRESHOLD = 64, 16, 0.8


def _u(seed: np.ndarray, stream: int) -> np.ndarray:
    """Uniform numbers in (0, 1] from seeds."""
    with np.errstate(over="ignore"):
        return ((mix(seed + np.uint64(stream)) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def bag_signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs x slots, float64 arrival times; inf for texts without shingles)."""
    sig = np.full(n_docs * slots, np.inf)
    weight = np.bincount(doc, count, n_docs)
    todo, slack = weight > 0, 5.0
    while todo.any():
        limit = np.where(todo, (np.log(slots) + slack) / np.maximum(weight, 1), -1.0)
        sig.reshape(n_docs, slots)[todo] = np.inf
        _points(sig, doc, h, count, limit, slots)
        todo = todo & np.isinf(sig.reshape(n_docs, slots)).any(axis=1)
        slack *= 2
    return sig.reshape(n_docs, slots)


def _points(sig, doc, h, count, limit, slots) -> None:
    size, lo, block = 1, 0, 0
    while len(doc) and lo < count.max():
        own = count > lo if lo else slice(None)
        with np.errstate(over="ignore"):
            seed = mix(h[own] + keys(64, 3)[block])
        _descend(sig, doc[own], seed, count[own], lo, size, limit, slots)
        lo, size, block = lo + size, max(1, lo + size), block + 1


def _descend(sig, doc, seed, count, lo, size, limit, slots) -> None:
    t = -np.log(_u(seed, 1)) / (slots * size)
    lo, size = np.full(len(doc), lo, dtype=np.int64), np.full(len(doc), size, dtype=np.int64)
    while True:
        live = np.flatnonzero((t <= limit[doc]) & (lo < count))
        if not len(live):
            return
        doc, seed, count, t, lo, size = (x[live] for x in (doc, seed, count, t, lo, size))
        unit = size == 1
        with np.errstate(over="ignore"):
            at = (mix(seed + np.uint64(2)) >> np.uint64(32)).astype(np.int64) % slots
            np.minimum.at(sig, doc[unit] * slots + at[unit], t[unit])
            follow = mix(seed + np.uint64(4))
        parts = [(doc[unit], follow[unit], count[unit], t[unit] - np.log(_u(follow[unit], 1)) / slots, lo[unit], size[unit])]
        if not unit.all():
            d, s, c, x, a, half = (v[~unit] for v in (doc, seed, count, t, lo, size // 2))
            right = (mix(s + np.uint64(3)) & np.uint64(1)).astype(bool)
            for side in (False, True):
                with np.errstate(over="ignore"):
                    child = mix(s + np.uint64(6 + side))
                parts.append((d, child, c, np.where(right == side, x, x - np.log(_u(child, 1)) / (slots * half)), a + half * side, half))
        doc, seed, count, t, lo, size = (np.concatenate(v) for v in zip(*parts))


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature (n_docs x bands)."""
    n, slots = sig.shape
    rows = slots // bands
    bits = sig.view(np.uint64).reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        return mix((bits * keys(rows, 5)).sum(axis=2, dtype=np.uint64) + keys(bands, 6)).view(np.int64)


def _sign(slots: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("words", pa.string()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, texts, names = batch.column(0), batch.column(1), batch.column(2)
            for a, b in portions(byte_sizes(texts)):
                own = [(t or "").encode() for t in texts.slice(a, b - a).to_pylist()]
                doc, h, count = weighted(own)
                sig = bag_signatures(doc, h, count, len(own), slots)
                keyed = band_keys(sig, bands)
                some = np.isfinite(sig[:, 0])
                words = [xxhash.xxh3_128_hexdigest(b" ".join(t.split())) for t in own]
                flat = pa.array(keyed[some].ravel())
                offsets = pa.array(np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32))
                yield pa.record_batch([ids.slice(a, b - a), names.slice(a, b - a), pa.array(words), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

    return run


def _verify(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            sizes = [x + y for x, y in zip(byte_sizes(batch.column(2)), byte_sizes(batch.column(3)))]
            for i, j in portions(sizes):
                left, right = ([(t or "").encode() for t in batch.column(c).slice(i, j - i).to_pylist()] for c in (2, 3))
                near = pa.array(similarity(left, right) >= threshold)
                part = batch.slice(i, j - i).select([0, 1]).filter(near)
                yield pa.record_batch([part.column(0), part.column(1)], schema=schema)

    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multiset overlap reaches the threshold."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verify(threshold), "a long, b long")


def _tokens(batches):
    """(node, token) of every text; the j-th occurrence of a shingle is a token of its own, so overlaps of multisets count tokens."""
    schema = pa.schema([("node", pa.int64()), ("token", pa.int64())])
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        for a, b in portions(byte_sizes(texts)):
            doc, h, count = weighted([(t or "").encode() for t in texts.slice(a, b - a).to_pylist()])
            j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                token = mix(np.repeat(h, count) + j.astype(np.uint64) * keys(1, 9))
            yield pa.record_batch([pa.array(ids[a:b][np.repeat(doc, count)]), pa.array(token.view(np.int64))], schema=schema)


def _cross_pairs(roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all nodes of different roots that may reach the threshold; roots has node and root.

    Prefix filter: with tokens ordered from rare to frequent, two texts of sizes m and n that reach the threshold share
    o = t / (1 + t) * (m + n) tokens at least, hence one among the first m - o + 1 of the one and n - o + 1 of the other.  In a
    family of near copies those are the tokens of their edits, so only texts with an edit in common meet.  Exact.
    """
    ids = roots.select(F.col("node").alias("id"))
    tokens = graph.written(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "text").mapInArrow(_tokens, "node long, token long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df"))
    size = tokens.groupBy("node").agg(F.count("*").alias("size"))
    ranked = tokens.join(often, "token").withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("df", "token")))
    head = ranked.join(size, "node").where((F.col("df") > 1) & (F.col("pos") <= F.col("size") - F.ceil(threshold * F.col("size")) + 1))
    head = graph.written(head.join(roots, "node").select("node", "root", "token", "pos", "size"))
    several = head.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
    head = head.join(several, "token")
    side = lambda x: head.select("token", *[F.col(c).alias(c + x) for c in ("node", "root", "pos", "size")])
    room = threshold / (1 + threshold) * (F.col("sizea") + F.col("sizeb")) - 1e-6
    fits = (F.col("posa") - 1 <= F.col("sizea") - room) & (F.col("posb") - 1 <= F.col("sizeb") - room)
    near = (F.least("sizea", "sizeb") >= threshold * F.greatest("sizea", "sizeb")) & fits
    met = side("a").join(side("b"), "token").where((F.col("roota") < F.col("rootb")) & near)
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def _mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(band, key, node, ...) with their component's root, of the buckets that hold several components."""
    held = rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = held.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band", "key")
    return held.join(several, ["band", "key"])


def _classes(docs: DataFrame, threshold: float, slots: int, bands: int) -> DataFrame:
    """(doc_id, key, words, class_id) for every row of docs; key: hash of its text, words: digest of its words.

    Equal word sequences are one node.  In each band bucket every node is verified against two pivots (the least node, and the
    one that meets most nodes over all bands, in a family of near copies its centre).  Nodes of buckets that still hold several
    components are then joined exactly by a prefix filter and verified; no link between candidates is lost, and a large
    family costs a star, not its square.
    """
    graph.small_batches(docs.sparkSession)
    signed = graph.cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(_sign(slots, bands), "doc_id long, key long, words string, bands array<long>"))
    named = signed.groupBy("words").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = named.where("node is not null and size(bands) > 0")
    bucket = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = bucket.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    multi = graph.cut(bucket.join(counts, ["band", "key"]))
    meets = multi.groupBy("node").agg(F.sum("n").alias("meets"))
    pivots = multi.join(meets, "node").groupBy("band", "key").agg(F.min("node").alias("low"), F.max_by("node", F.struct("meets", (-F.col("node")).alias("k"))).alias("centre"))
    starred = multi.join(pivots, ["band", "key"]).select("node", F.explode(F.array_distinct(F.array("low", "centre"))).alias("pivot")).where("node <> pivot")
    pairs = graph.cut(starred.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    links = graph.cut(_links(pairs, texts, threshold))
    classes = graph.components(links)
    mixed = graph.cut(_mixed(multi, classes).select("node", "root").distinct())
    cross = _cross_pairs(mixed, texts, threshold).join(pairs, ["a", "b"], "left_anti")
    more = graph.cut(_links(cross, texts, threshold))
    if not more.isEmpty():
        classes = graph.components(links.unionByName(more))
    roots = named.select("words", "node").join(classes, "node", "left").select("words", F.coalesce("root", "node").alias("class_id"))
    return signed.select("doc_id", "key", "words").join(roots, "words", "left")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id) for every row of docs(doc_id, text, ...); class_id is the least doc_id of its class."""
    return _classes(docs, threshold, slots, bands).select("doc_id", "class_id")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """One row for each class (its least doc_id).  Rows with a null doc_id go when a row with an id has their words, else one of each words stays."""
    classes = _classes(docs, threshold, slots, bands)
    lead = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    held = docs.where("doc_id is null").select(F.struct(*graph.columns(docs)).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    solo = classes.where("doc_id is null and class_id is null").groupBy("words").agg(F.min("key").alias("key")).select("key")
    return kept.unionByName(held.join(solo, "key", "left_semi").dropDuplicates(["key"]).select(*graph.fields(docs)))
