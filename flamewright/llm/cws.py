"""Document fingerprints (operator 1): consistent weighted sampling.

Terms are word shingles with their multiplicities S.  For each sample every term draws r, c ~ Gamma(2,1) and b ~ U(0,1)
from its own hash; with t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1), the sample is the pair (term, t) of the
least a.  Two texts agree in a sample with probability sum(min S)/sum(max S), the generalised Jaccard similarity.
The gamma variates come from a table of 65,536 quantiles; a sample keeps 16 bits of its pair.

Defined cases: null text is empty; texts without words share one fingerprint; equal texts have equal fingerprints;
documents are ordered by descending doc_id, null ids last, ties by text; repeated rows follow one another; of very long texts the terms are
drawn in slices of SLICE, so that the draws never take more than 150 MB (the text and 16 bytes a word are held); extra columns are
ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph
from .shingles import keys, weighted

SAMPLES = 64
#: Terms drawn at once.
SLICE = 1 << 18
_TABLE: dict[str, np.ndarray] = {}


def gamma_table() -> np.ndarray:
    """65,536 quantiles of Gamma(2,1), by inverting 1 - (1 + x) exp(-x)."""
    if "g" not in _TABLE:
        x = np.concatenate((np.geomspace(1e-6, 1, 20000), np.linspace(1, 40, 200000)[1:]))
        _TABLE["g"] = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
    return _TABLE["g"]


def fingerprints(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """uint16 signatures, len(texts) x samples."""
    doc, h, count = weighted(texts)
    out = np.full((len(texts), samples), 0xFFFF, dtype=np.uint16)
    if not len(h):
        return out
    low = np.full((len(texts), samples), np.iinfo(np.uint64).max)
    for a in range(0, len(h), SLICE):
        _gather(low, doc[a : a + SLICE], h[a : a + SLICE], count[a : a + SLICE], samples)
    own = np.unique(doc)
    out[own] = (low[own] & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _gather(low: np.ndarray, doc: np.ndarray, h: np.ndarray, count: np.ndarray, samples: int) -> None:
    """Lower each text's draws to the least ones of its terms; doc is sorted."""
    # Terms that several texts share with one multiplicity are drawn once.
    order = np.lexsort((count, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (count[order][1:] != count[order][:-1])))
    which = np.empty(len(h), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    term, times = h[order][new], count[order][new]
    best = np.empty((len(term), samples), dtype=np.uint64)
    for a in range(0, len(term), 1024):
        best[a : a + 1024] = _draws(term[a : a + 1024], times[a : a + 1024], samples)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.append(starts[1:], len(doc))
    # A few texts at a time, so that the rows gathered stay in the cache; a long text a part at a time.
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + 1024, side="right")))
        for lo in range(starts[a], ends[z - 1], 1 << 15):
            hi = min(lo + (1 << 15), ends[z - 1])
            cut = np.maximum(starts[a:z], lo) - lo if z > a + 1 else np.zeros(1, np.int64)
            least = np.minimum.reduceat(best.take(which[lo:hi], axis=0), cut, axis=0)
            low[doc[starts[a:z]]] = np.minimum(low[doc[starts[a:z]]], least)
        a = z


def _draws(term: np.ndarray, times: np.ndarray, samples: int) -> np.ndarray:
    """Order-preserving 64-bit words: ln a in fixed point in the upper half, a hash of (term, t) in the lower."""
    g = gamma_table()
    if "lg" not in _TABLE:
        _TABLE["lg"] = np.log(g)
    with np.errstate(over="ignore"):
        z = term[:, None] * keys(samples, 7)[None, :]
        z ^= z >> np.uint64(32)
        parts = z.view(np.uint16).reshape(len(term), samples, 4)
        r = g.take(parts[:, :, 0])
        b = parts[:, :, 2].astype(np.float32)
        b *= np.float32(2.0**-16)
        b -= np.float32(1)
        name = (term >> np.uint64(20)).astype(np.uint32)
        many = np.flatnonzero(times > 1)
        if len(many):
            t = np.floor(np.log(times[many]).astype(np.float32)[:, None] / r[many] + (b[many] + np.float32(1)))
            b[many] -= t
        b *= r
        b += _TABLE["lg"].take(parts[:, :, 1])
        # ln a lies between -80 and 48 for any multiplicity below 2**50.
        b += np.float32(80)
        b *= np.float32(2.0**24)
        key = b.astype(np.uint64)
        key <<= np.uint64(32)
        key |= _spread(name).astype(np.uint64)[:, None]
        if len(many):
            key[many] = (key[many] >> np.uint64(32) << np.uint64(32)) | _spread(name[many][:, None] ^ (t.astype(np.uint32) * np.uint32(0x9E3779B1)))
        return key


def _spread(name: np.ndarray) -> np.ndarray:
    name = (name ^ (name >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return name ^ (name >> np.uint32(13))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit(text: str, after: str) -> str:
    """The last floor(n/3) code points replaced by the first as many (or all) of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compare(samples: int, portion: int = 1 << 18):
    def flush(rows):
        """rows: (doc_id, text) in order; the last one only follows the others."""
        texts = [t for _, t in rows]
        edited = [edit(t, n) for t, n in zip(texts, texts[1:])]
        sig = fingerprints([t.encode() for t in texts + edited], samples)
        own, alt = sig[: len(texts)], sig[len(texts) :]
        cols = [[i for i, _ in rows[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [text_of(s) for s in own[:-1]], [text_of(s) for s in alt], likeness(own[:-1], alt), likeness(own[:-1], own[1:])]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    def run(batches):
        held, size, bucket, closed = [], 0, None, False
        for batch in batches:
            for b, ghost, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                if b != bucket:
                    held, size, bucket, closed = [], 0, b, False
                if closed:
                    continue
                held.append((doc_id, text))
                size += len(text)
                closed = ghost
                if len(held) > 1 and (ghost or size >= portion):
                    yield flush(held)
                    held, size = held[-1:], len(text)

    return run


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """For every row of docs(doc_id, text) its fingerprint, the edited text's, and the likeness to both that and the next document.

    Documents are dealt out in ranges of doc_id; each range also gets the first document of the range after it, so
    no range waits for another and no global order is made.
    """
    spark = docs.sparkSession
    graph.small_batches(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = slim.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # Range 0 holds the largest ids; null ids have the last range to themselves.
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("doc_id"))))
    dealt = slim.withColumn("bucket", bucket)
    firsts = sorted((r.bucket, r.first) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())  # one row a range
    if not firsts:
        return spark.createDataFrame([], OUT)
    # By range: its first id, and the range ahead of it among those that hold rows (of the first: the last), which also gets that document.
    first, ahead = [None] * (len(cuts) + 2), [0] * (len(cuts) + 2)
    for k, (b, i) in enumerate(firsts):
        first[b], ahead[b] = i, firsts[k - 1][0]
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket"))
    copies = [F.struct(F.col("bucket").alias("b"), F.lit(False).alias("ghost")), F.struct(at(ahead, "int").alias("b"), F.lit(True).alias("ghost"))]
    ghosts = F.when(F.col("doc_id").eqNullSafe(at(first, "long")), F.array(*copies)).otherwise(F.array(copies[0]))
    spread = dealt.select(F.explode(ghosts).alias("g"), "doc_id", "text").select("g.b", "g.ghost", "doc_id", "text")
    # A range a task, by its number.
    ordered = spread.repartitionById(len(cuts) + 2, F.col("b").cast("int")).sortWithinPartitions("b", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_compare(samples), OUT)
