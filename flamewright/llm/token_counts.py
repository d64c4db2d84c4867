"""Token counts (operator 10): separator scan over flat, unindexed token files.

A token file is a stream of 16-bit ids in which an end-of-document id closes every document; nothing says where
documents begin.  The stream is cut in blocks of equal size; each block is searched for separators in
one vectorised comparison; a prefix scan over the block summaries (ids, last separator) then gives the tokens that a block's
first document has in the blocks before, and with them every document's length.

Defined cases: null text is empty (0 tokens); special strings in a text are ordinary text, so a text never holds a separator; ties cannot arise;
repeated rows are counted each; a null doc_id is kept; very long texts run over many blocks (a worker holds one text and its ids); extra
columns are ignored whatever their names; empty tables or files give no rows; ids after the last separator of a file belong to no document and
are returned with a null ordinal by ``scan``.  ``read_token_files`` reads a file as one value of at most 2 GB; longer streams come in several files or
as a table of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import graph
from .packing import encoder

BLOCK_IDS, END_ID = 1 << 16, 50256
BLOCKS = "file string, block long, ids binary, doc_ids array<long>"
_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """docs(doc_id, text) as token files, one a task, in blocks that ignore document borders.

    doc_ids names the documents whose separators stand in the block, in order; it holds no positions.
    """

    graph.small_batches(docs.sparkSession)

    def run(batches):
        encode, name, block = encoder(tokenizer), f"part-{TaskContext.get().partitionId():05d}", 0
        held, size, names = [], 0, []

        def emit(ids, own):
            return pa.record_batch([pa.array([name]), pa.array([block], pa.int64()), pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], schema=_BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.array(encode(text.as_py() or "") + [end_id], dtype=np.int64))
                size += len(held[-1])
                names.append((doc_id, size))
                while size >= block_ids:
                    ids = np.concatenate(held)
                    own = [d for d, at in names if at <= block_ids]
                    yield emit(ids[:block_ids], own)
                    held, size, block = [ids[block_ids:]], size - block_ids, block + 1
                    names = [(d, at - block_ids) for d, at in names if at > block_ids]
        if size:
            yield emit(np.concatenate(held), [d for d, _ in names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def read_token_files(spark, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of flat little-endian 16-bit token files, read by Spark (any store); doc_ids is null."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(data.as_buffer())
                for k in range(0, -(-len(view) // (2 * block_ids))):
                    part = bytes(view[2 * k * block_ids : 2 * (k + 1) * block_ids])
                    yield pa.record_batch([pa.array([name]), pa.array([k], pa.int64()), pa.array([part], pa.binary()), pa.array([None], pa.list_(pa.int64()))], schema=_BLOCKS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, end_id: int = END_ID, with_tail: bool = True) -> DataFrame:
    """(file, ordinal, doc_id, n_tokens): a row for each document of the blocks, ordinals from 0 a file.

    n_tokens leaves the separator out.  doc_id is null where the blocks name no documents; ids after the last separator
    make a row with null ordinal (with_tail; not for streams that end with a separator).
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ends, sizes = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype="<u2")
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
                sizes.append(len(ids))
            if sizes:
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int32())), batch.column(3)], schema=schema)

    found = blocks.mapInArrow(run, "file string, block long, n long, ends array<int>, doc_ids array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = found.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("begin") + F.element_at("ends", -1))
    out = out.withColumn("last", last)
    out = out.withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("first", F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)))
    rows = out.select("file", "begin", "open", "first", "ends", "doc_ids", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") > 0, F.col("begin") + F.get("ends", F.col("k") - 1)).otherwise(F.col("open"))
    whole = rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.get("doc_ids", F.col("k")).alias("doc_id"), (F.col("begin") + F.col("end") - start - 1).alias("n_tokens"))
    if not with_tail:
        return whole
    tail = out.groupBy("file").agg((F.sum("n") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return whole.unionByName(tail.select("file", F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), "n_tokens"))
