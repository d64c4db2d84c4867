"""Suffix-array dedup (operator 8): difference-cover blockwise suffix sorting.

A window is the first LENGTH symbols of a suffix; it is repeated when another suffix starts with the same symbols.
Difference cover: positions whose residue modulo PERIOD lies in a set D are the sample.  Every difference of residues
occurs in D, so any two suffixes reach sample positions of both after one shared shift below PERIOD.  Hence

* the sample's ranks are precomputed: a sample position is named by its next LENGTH - PERIOD symbols;
* the suffixes that reach one name are a bucket; buckets are sorted apart, one at a time, and a bucket's members carry PERIOD - 1
  symbols before the name and PERIOD after it, never the text: two members' suffixes at shift d tie in LENGTH symbols exactly when
  d symbols ahead of the name and PERIOD - d behind it are equal, and these are compared symbol by symbol;
* a bucket over HOT members is not gathered: its suffixes are counted by shift and symbols with partial aggregation.

Most suffixes never reach a bucket.  Ahead of the sort two passes over content-defined blocks (runs of windows with one least gram)
leave out blocks whose inner string occurs once, which cannot tie, and put copies of one block (windows and what follows them) together, so that one of
them is sorted for all; in long families of copies this is nearly everything.  Names and copies are told by 128-bit digests
of the symbols (a false tie anywhere among 10**14 windows has probability below 10**-10); the 64-bit hashes of the first pass only choose.

Symbols are bytes, or words for ``passages`` (windows of more than 50 words).

Defined cases: null text is empty; texts under LENGTH symbols lose nothing; repeated rows are occurrences of each other; ties:
all occurrences are removed, none is kept as the first; a null doc_id is kept; very long texts go in overlapping stretches (a worker holds one text
and a bounded working set); runs of one byte and short periods make one row for all their equal blocks; extra columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import graph
from .shingles import Words, byte_sizes, keys, mix, portions


class Kind(NamedTuple):
    """What the symbols are and how windows are cut."""

    words: bool
    length: int
    gram: int
    step: int
    period: int  # at most 31: shifts are bits of an int


#: Bytes: strings of 400.  Words: passages of over 50.
BYTES = Kind(False, 400, 64, 200, 21)
WORDS = Kind(True, 51, 5, 26, 7)
#: Windows hashed at once; longer texts go in overlapping stretches.
STRETCH = 1 << 20
#: Rows of documents' keys that may be broadcast to pick rows; a longer list is joined by shuffle.
BROADCAST_KEYS = 500_000
#: Members of a bucket that one task may gather.
HOT = 1 << 18


@functools.cache
def cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo period."""
    for size in itertools.count(1):
        for rest in itertools.combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)


class Hashes:
    """64-bit hashes of any ranges of a buffer, from one running sum."""

    def __init__(self, buf: np.ndarray):
        up, self.down = Words.powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum((keys(256, 8)[buf] if buf.dtype == np.uint8 else mix(buf)) * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def symbols(texts: list[bytes], words: bool) -> list[np.ndarray]:
    """Each text as an array of bytes, or of its words' hashes."""
    if not words:
        return [np.frombuffer(t, dtype=np.uint8) for t in texts]
    w = Words(texts)
    return np.split(w.hash, np.cumsum(w.counts)[:-1])


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of ranges of buf, as rows of two int64."""
    data, size = memoryview(buf.view(np.uint8)), buf.itemsize
    of = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(data[a:b]) for a, b in zip((start * size).tolist(), (end * size).tolist())]), dtype=np.int64).reshape(-1, 2)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours (len(x) - w + 1 of them), by block-wise running minima."""
    n = -(-len(x) // w) * w
    padded = np.concatenate((x, np.full(n - len(x), np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def blocks(texts: list[bytes], kind: Kind = BYTES) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, times, inner name, digest, digest) of every block of every text; equal blocks side by side are one row."""
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2]
    units = symbols(texts, kind.words)
    short = [i for i, t in enumerate(units) if kind.length <= len(t) <= STRETCH]
    if short:
        out.append(_blocks([units[i] for i in short], np.array(short), kind))
    for i, t in enumerate(units):
        if len(t) > STRETCH:
            for a in range(0, len(t) - kind.length + 1, STRETCH):
                text, p, *rest = _blocks([t[a : a + STRETCH + kind.length - 1]], np.array([i]), kind)
                out.append((text, p + a, *rest))
    return tuple(np.concatenate(c) for c in zip(*out))


def _blocks(units, numbers, kind):
    length, gram, step = kind.length, kind.gram, kind.step
    buf = np.concatenate(units)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in units])))
    h = Hashes(buf)
    at = np.arange(len(buf) - gram + 1)
    place = np.uint64((1 << 24) - 1)
    least = _least((h.of(at, at + gram) & ~place) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & place).astype(np.int64)
    p = np.arange(len(anchor))
    text = np.repeat(np.arange(len(units)), np.diff(begins))[: len(p)]
    inside = p + length <= begins[text + 1]
    p, text, anchor = p[inside], text[inside], anchor[inside]
    j = (anchor - p) // step
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (j[1:] != j[:-1]) | (p[1:] != p[:-1] + 1))))
    last = np.append(first[1:], len(p)) - 1
    a, b, k = p[first], p[last], j[first]
    inner = anchor[first] - step * k
    with np.errstate(over="ignore"):
        name = mix(h.of(inner, inner - step + 1 + length) + k.astype(np.uint64))
    whole = digests(buf, a, b + length)
    text, n = text[first], b - a + 1
    new = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]).any(axis=1) | (name[1:] != name[:-1]) | (text[1:] != text[:-1]) | (a[1:] != a[:-1] + n[:-1]))))
    times = np.diff(np.append(new, len(a)))
    return numbers[text[new]], a[new] - begins[text[new]], n[new] * times, times, name[new], whole[new, 0], whole[new, 1]


_BLOCKS = "rk long, id long, p int, n int, t int, name long, w0 long, w1 long"


def _emit_blocks(kind):
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("t", pa.int32()), ("name", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64())])

    def run(batches):
        for batch in batches:
            rk, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2)
            for x, y in portions(byte_sizes(texts)):
                i, p, n, t, name, w0, w1 = blocks([(s or "").encode() for s in texts.slice(x, y - x).to_pylist()], kind)
                cols = (rk[x:y][i], ids[x:y][i], p, n, t, name.view(np.int64), w0, w1)
                yield pa.record_batch([pa.array(c, f.type) if c.dtype == np.int64 and f.type == pa.int64() else pa.array(c.astype(np.int32)) for c, f in zip(cols, schema)], schema=schema)

    return run


def samples(units: list[np.ndarray], parts: list[list], kind: Kind) -> tuple[np.ndarray, ...]:
    """(text, position, shifts, shifts alone, digests, symbols around) of the sample positions that the windows of parts reach.

    parts: for each text its runs (p, n, alone) of windows; shifts: bit d stands for the window d symbols ahead of the position.
    """
    length, v = kind.length, kind.period
    pad = np.zeros(v, dtype=units[0].dtype)
    buf = np.concatenate([pad, *units, pad])
    begins = v + np.concatenate(([0], np.cumsum([len(u) for u in units])))
    wanted, alone = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
    reach = np.zeros(len(buf) + 1, dtype=np.int32)
    for begin, own in zip(begins, parts):
        for p, n, lonely in own:
            wanted[begin + p : begin + p + n] = True
            alone[begin + p : begin + p + n] |= lonely
            reach[begin + p] += 1
            reach[min(begin + p + n - 1 + v, len(buf))] -= 1
    at = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    text = np.searchsorted(begins, at, side="right") - 1
    chosen = np.isin((at - begins[text]) % v, cover(v))
    at, text = at[chosen], text[chosen]
    shifts, lonely = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for d in range(v):
        # A window that starts in the text before is no window of this one.
        own = wanted[at - d] & (at - d >= begins[text])
        shifts |= own.astype(np.int32) << d
        lonely |= (own & alone[at - d]).astype(np.int32) << d
    some = shifts > 0
    at, text, shifts, lonely = at[some], text[some], shifts[some], lonely[some]
    around = np.concatenate((buf[at[:, None] + np.arange(1 - v, 0)], buf[at[:, None] + length - v + np.arange(v)]), axis=1) if len(at) else np.zeros((0, 2 * v - 1), buf.dtype)
    return text, at - begins[text], shifts, lonely, digests(buf, at, at + length - v), around


_SAMPLES = "rk long, id long, p int, shifts int, lonely int, r0 long, r1 long, around binary"


def _emit_samples(kind):
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("p", pa.int32()), ("shifts", pa.int32()), ("lonely", pa.int32()), ("r0", pa.int64()), ("r1", pa.int64()), ("around", pa.binary())])

    def run(batches):
        for batch in batches:
            rk, ids, texts, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            for x, y in portions(byte_sizes(texts)):
                runs = [[(r["p"], r["n"], r["alone"]) for r in own] for own in parts.slice(x, y - x).to_pylist()]
                units = symbols([(s or "").encode() for s in texts.slice(x, y - x).to_pylist()], kind.words)
                i, p, shifts, lonely, rank, around = samples(units, runs, kind)
                yield pa.record_batch([pa.array(rk[x:y][i]), pa.array(ids[x:y][i]), pa.array(p.astype(np.int32)), pa.array(shifts), pa.array(lonely), pa.array(rank[:, 0]), pa.array(rank[:, 1]), binaries(around)], schema=schema)

    return run


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow array of byte strings."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def ties(bucket: np.ndarray, shifts: np.ndarray, lonely: np.ndarray, around: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift) of every lonely suffix that ties with another suffix of its bucket (around: bytes, a row a member)."""
    v, size = kind.period, around.shape[1] // (2 * kind.period - 1)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(v):
        own = np.flatnonzero(shifts >> d & 1)
        if not len(own):
            continue
        text = around[own, (v - 1 - d) * size : (2 * v - 1 - d) * size]
        wide = np.zeros((len(own), -(-v * size // 8) * 8), dtype=np.uint8)
        wide[:, : v * size] = text
        order = np.lexsort((*wide.view(">u8").T[::-1].astype(np.uint64), bucket[own]))
        same = (bucket[own][order][1:] == bucket[own][order][:-1]) & (wide[order][1:] == wide[order][:-1]).all(axis=1)
        tied = np.zeros(len(own), dtype=bool)
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        tied &= (lonely[own] >> d & 1).astype(bool)
        rows.append(own[tied])
        found.append(np.full(int(tied.sum()), d))
    return np.concatenate(rows), np.concatenate(found)


def _sort_buckets(kind, most: int = 1 << 16):
    """Members ordered by rank -> (rk, id, p, n) of tied windows; whole buckets of about ``most`` members at a time."""
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("p", pa.int32()), ("n", pa.int32())])

    def flush(held):
        table = pa.Table.from_batches(held).combine_chunks()
        col = lambda k: table.column(k).to_numpy()
        r0, r1, lonely = col("r0"), col("r1"), col("lonely")
        bucket = np.cumsum(np.concatenate(([False], (r0[1:] != r0[:-1]) | (r1[1:] != r1[:-1]))))
        live = (np.bincount(bucket)[bucket] > 1) & (np.bincount(bucket, lonely != 0)[bucket] > 0)
        rows = np.flatnonzero(live)
        if not len(rows):
            return
        data = table.column("around").combine_chunks()
        if isinstance(data, pa.ChunkedArray):
            data = data.chunk(0)
        width = (2 * kind.period - 1) * (8 if kind.words else 1)
        at = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset]
        around = np.frombuffer(data.buffers()[2], dtype=np.uint8)[at : at + len(data) * width].reshape(-1, width)
        i, d = ties(bucket[rows], col("shifts")[rows], lonely[rows], around[rows], kind)
        i = rows[i]
        yield pa.record_batch([pa.array(col("rk")[i]), pa.array(col("id")[i]), pa.array((col("p")[i] - d).astype(np.int32)), pa.array(np.ones(len(i), np.int32))], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= most:
                r0, r1 = batch.column("r0").to_numpy(), batch.column("r1").to_numpy()
                last = held[-1].num_rows - 1
                before = held[-1].column("r0")[last].as_py(), held[-1].column("r1")[last].as_py()
                new = np.flatnonzero((r0 != before[0]) | (r1 != before[1]))
                if len(new):
                    cut = int(new[0])
                    held.append(batch.slice(0, cut))
                    yield from flush(held)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from flush(held)

    return run


def _hot_ties(members: DataFrame, kind: Kind) -> DataFrame:
    """Tied windows of members whose buckets are too large to gather: suffixes counted by rank, shift and symbols."""
    v, size = kind.period, 8 if kind.words else 1
    bit = lambda d: F.call_function("shiftleft", F.lit(1), d)
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(v - 1)), lambda d: F.col("shifts").bitwiseAND(bit(d)) != 0)).alias("d")
    each = members.select("rk", "id", "p", "lonely", "r0", "r1", "around", at)
    each = each.withColumn("text", F.substring("around", (v - 1 - F.col("d")) * size + 1, F.lit(v * size)))
    each = each.withColumn("alone", F.col("lonely").bitwiseAND(bit(F.col("d"))) != 0)
    twice = graph.written(each.groupBy("r0", "r1", "d", "text").agg(F.count("*").alias("c"), F.max("alone").alias("any")).where("c > 1 and any"))
    tied = each.where("alone").join(twice, ["r0", "r1", "d", "text"], "left_semi")
    return tied.select("rk", "id", (F.col("p") - F.col("d")).cast("int").alias("p"), F.lit(1).alias("n"))


def _picked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows joined with chosen on the document's key; a bounded list of keys is broadcast first so that other texts are not moved."""
    if chosen.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(chosen.select("rk", "id")), ["rk", "id"], "left_semi")
    return rows.join(chosen, ["rk", "id"])


def repeated_windows(keyed: DataFrame, kind: Kind = BYTES, hot: int = HOT) -> DataFrame:
    """(rk, id, parts): for every text of keyed(rk, id, text) with repeated windows, runs (p, n) of window starts."""
    found = graph.written(keyed.select("rk", "id", "text").mapInArrow(_emit_blocks(kind), _BLOCKS))
    names = graph.written(found.groupBy("name").agg(F.sum("t").alias("c")).where("c > 1").select("name"))
    shared = graph.written(found.join(names, "name"))
    graph.release(found, names)
    wholes = graph.written(shared.groupBy("w0", "w1").agg(F.sum("t").alias("c"), F.min(F.struct("rk", "id", "p", F.expr("cast(n / t as int) as n"))).alias("one"), F.first("name").alias("name")))
    several = graph.written(wholes.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"))
    full = graph.written(shared.select("rk", "id", "p", "n", "w0", "w1").join(wholes.where("c > 1").select("w0", "w1"), ["w0", "w1"]).select("rk", "id", "p", "n"))
    edge = graph.written(wholes.join(several, "name").groupBy("one.rk", "one.id").agg(F.collect_list(F.struct("one.p", "one.n", (F.col("c") == 1).alias("alone"))).alias("parts")))
    graph.release(shared, wholes, several)
    members = graph.written(_picked(keyed.select("rk", "id", "text").dropDuplicates(["rk", "id"]), edge).select("rk", "id", "text", "parts").mapInArrow(_emit_samples(kind), _SAMPLES))
    tied = graph.written(_tied(members, kind, hot))
    parts = graph.written(full.unionByName(tied).groupBy("rk", "id").agg(F.collect_set(F.struct("p", "n")).alias("parts")))
    graph.release(edge, members, tied, full)
    return parts


def _tied(members: DataFrame, kind: Kind, hot: int) -> DataFrame:
    """(rk, id, p, n): windows of the members that tie with another."""
    # Buckets are counted first by as many leading bits of their rank as leave 1/64 of ``hot`` members a group on average, then, in large groups, each.
    bits = max(1, min(62, 6 + int(members.count() // hot).bit_length()))
    group = F.shiftrightunsigned("r0", 64 - bits)
    crowded = graph.cut(members.groupBy(group.alias("g")).agg(F.count("*").alias("c")).where(F.col("c") > hot).select("g"))
    own, more = members, None
    if crowded.count():  # at most the members over ``hot``
        large = members.withColumn("g", group).join(crowded, "g").groupBy("r0", "r1").agg(F.count("*").alias("c")).where(F.col("c") > hot)
        large = graph.cut(large.select("r0", "r1"))
        if large.count():
            own, more = members.join(large, ["r0", "r1"], "left_anti"), _hot_ties(members.join(large, ["r0", "r1"]), kind)
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = own.repartition(n, "r0", "r1").sortWithinPartitions("r0", "r1").mapInArrow(_sort_buckets(kind), "rk long, id long, p int, n int")
    return tied.unionByName(more) if more is not None else tied


def merged(parts, length: int) -> list[list[int]]:
    """Maximal runs [begin, end) of symbols covered by the windows of parts."""
    out: list[list[int]] = []
    for p, n in sorted((x["p"], x["n"]) for x in parts or ()):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n - 1 + length)
        else:
            out.append([p, p + n - 1 + length])
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, spans string, kept binary"


def _cut_out(length, passage):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("spans", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            for doc_id, text, parts, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = (text.as_py() or "").encode()
                runs = merged(parts, length)
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                row = [doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(merged(more, passage)), ",".join(f"{a}:{b}" for a, b in runs), kept]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, strings: Kind = BYTES, passages: Kind | None = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans, kept) for every row of docs(doc_id, text).

    n_passages: maximal runs of words covered by passages (over 50 words) that also start elsewhere; they are counted, not removed.
    """
    graph.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("rk", F.xxhash64("doc_id", "text")).withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long")))
    parts = repeated_windows(keyed, strings, hot)
    if passages:
        parts = parts.join(repeated_windows(keyed, passages, hot).withColumnRenamed("parts", "more"), ["rk", "id"], "full")
    else:
        parts = parts.withColumn("more", F.col("parts").cast("array<struct<p:int,n:int>>")).withColumn("more", F.slice("more", 1, 0))
    parts = graph.written(parts)
    cut = _cut_out(strings.length, passages.length if passages else 1)
    if parts.count() > BROADCAST_KEYS:
        return keyed.join(parts, ["rk", "id"], "left").select("doc_id", "text", "parts", "more").mapInArrow(cut, _RESULT)
    some, none = F.broadcast(parts.select("rk", "id")), F.lit(0).cast("long")
    text = F.coalesce("text", F.lit(""))
    whole = keyed.join(some, ["rk", "id"], "left_anti").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), none.alias("n_passages"), F.lit("").alias("spans"), text.cast("binary").alias("kept"))
    return _picked(keyed, parts).select("doc_id", "text", "parts", "more").mapInArrow(cut, _RESULT).unionByName(whole)
