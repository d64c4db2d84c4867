"""Best-fit packing (operator 4): best-two-fit over the histogram of piece lengths.

A bin is filled greedily with the longest pieces that fit; then its smallest piece is replaced by the two unpacked
pieces that fill the expanded gap best, when they fill it better.  Pieces of equal length are alike, so the plan is
made once for a pattern of lengths and repeated as often as the counts allow: the driver holds at most ``capacity``
counts and the patterns, whatever the number of documents.  Pieces then find their place by their rank
within their length: rank inside the task plus the counts of the tasks before.

Defined cases: null text is empty (one end token); strings of special tokens in a text become their ids; very long texts are cut in pieces (a worker
holds one text and its ids); ties: of equal lengths the earlier piece of the earlier task goes first; repeated rows are packed each; a null doc_id is
kept; extra columns are ignored whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import graph

CAPACITY, END_ID = 1024, 2


def encoder(path: str, special: bool = False):
    """Byte-level BPE of a tokenizers file: text -> list of ids.

    special: strings of the file's special tokens in a text become their ids, as the tokenizers library does by itself; else they are ordinary text.
    The ids come from the file's own merges; tiktoken runs them faster when the same vocabulary lies beside it as
    ranks, with the same ids (tests compare the two).
    """
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    try:
        import tiktoken
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        named = {}
        if special:
            with open(path, encoding="utf-8") as f:
                named = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=named)
        return functools.partial(own.encode, allowed_special="all") if named else own.encode_ordinary
    except (ImportError, FileNotFoundError):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = not special
        return lambda text: slow.encode(text, add_special_tokens=False).ids


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, longest first; number of such bins)] for counts[length]."""
    left = counts.astype(np.int64).copy()
    out = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return out
        used: dict[int, int] = {}

        def free(n, used=used):
            return left[n] - used.get(n, 0)

        gap, bins = capacity, []
        i = len(lengths) - 1
        while gap > 0 and i >= 0:
            i = min(i, int(np.searchsorted(lengths, gap, side="right")) - 1)
            while i >= 0 and free(int(lengths[i])) <= 0:
                i -= 1
            if i < 0:
                break
            n = int(lengths[i])
            bins.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(bins) > 1:
            least = bins[-1]
            used[least] -= 1
            pair = _best_two([int(n) for n in lengths if free(int(n)) > 0], free, gap + least)
            if pair and sum(pair) > least:
                bins = bins[:-1] + list(pair)
                for n in pair:
                    used[n] = used.get(n, 0) + 1
            else:
                used[least] += 1
        bins.sort(reverse=True)
        times = min(int(left[n]) // k for n, k in used.items() if k)
        for n, k in used.items():
            left[n] -= k * times
        out.append((bins, times))


def _best_two(lengths: list[int], free, room: int) -> tuple[int, int] | None:
    """The two free lengths with the largest sum that fits the room."""
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or (i == j and free(lengths[i]) < 2):
            j -= 1
        else:
            if best is None or total > sum(best):
                best = (lengths[j], lengths[i])
            i += 1
    return best


def _pieces(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches):
        encode = encoder(path, special=True)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py() or "") + [end_id], dtype="<u4")
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                begin = 0
                for piece, end in enumerate(ends):
                    n = end - begin
                    rows.append((doc_id, piece, begin, n, zlib.crc32(ids[begin:end].tobytes()), task, int(seen[n])))
                    seen[n] += 1
                    begin = end
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _place(slots: dict[int, np.ndarray]):
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, t = length == n, slots[int(n)]
                x = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                k = rank[own] - x[:, 0]
                seq[own], off[own] = x[:, 2] + k // x[:, 1], x[:, 3] + n * (k % x[:, 1])
            yield pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(off)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row a piece of docs(doc_id, text)."""
    graph.small_batches(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")
    pieces = graph.cut(cut)
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[n] = k
    slots: dict[int, list] = {}
    taken, sequence = np.zeros(capacity + 1, dtype=np.int64), 0
    for lengths, times in plan_bins(counts, capacity):
        at = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            slots.setdefault(n, []).append((int(taken[n]), k, sequence, at))
            taken[n] += k * times
            at += n * k
        sequence += times
    tables = {n: np.array(rows, dtype=np.int64) for n, rows in slots.items()}
    ranked = pieces.join(before.drop("n"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(tables), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
