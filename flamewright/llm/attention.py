"""LM scoring (operator 6): a causal self-attention model trained in numpy on subword ids.

Model: one attention head over the window before the id gives a state; the id is read off the state down a tree over the whole
vocabulary, a softmax over FAN branches at each node (hierarchical softmax).  The tree is the Huffman tree of the training ids' counts, so an id costs about
log_FAN of its rarity, and a node starts at its branches' shares: the untrained model is the smoothed frequency of ids.  A window holds
the STRIDE positions it scores and the STRIDE before them, so windows overlap by half and every id is scored once, with STRIDE to
2*STRIDE - 1 ids of context; all windows of a batch are one masked attention product.

Three passes.  ``read``: words and ids of every text are counted and its ids written beside it; distinct words are tokenized once for each 16 MB of text.  ``learn``: the training documents
are dealt into ROUNDS parts by content; in each round tasks of at least TASK_IDS ids train on their documents of the part from the last round's
parameters, and the tasks' parameters are averaged, weighted by the ids they saw (rows of the embedding and nodes of the tree by their own counts).  Every window
of every training document is used once, in any layout.  Parameters travel as blocks of rows that are summed before the driver gets
them: its share is a few MB, however many tasks there are.  ``score``: every id of every document once.

Word probabilities of the base score: words frequent enough (at least N / HEAD_WORDS, so at most HEAD_WORDS words) travel with
the scoring tasks; all other words are joined by shuffle, where none of them can be hot.

Defined cases: null text is empty (one end token); a null doc_id reads as empty text in the split (training); repeated rows count
each and score alike; with no training rows all counts are 0 and the model is the untrained start; very long texts are trained on and scored in
windows (a worker holds one text or 16 MB of texts, their ids and a batch); ties in the tree's order go by id; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import collections
import ctypes
import functools
import heapq
import itertools
import json
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import graph
from .packing import encoder

VOCAB, END, WIDTH, STRIDE, FAN = 50257, 50256, 16, 8, 16
BATCH, RATE, NODE_RATE, HEAD_WORDS = 1024, 3e-2, 0.15, 1_000_000
#: Averaging rounds, and the ids that a training task has at least (fewer tasks when there are fewer ids).
ROUNDS, TASK_IDS = 4, 4_000_000
#: Share of the step in each round.
RATES = (1.0, 0.7, 0.5, 0.35)
#: Stands for the end of a text among the words; no word holds white space.
END_WORD = "\n"
_DENSE = {"wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "wo": (WIDTH, WIDTH), "place": (STRIDE, 2 * STRIDE)}
_FUTURE = np.triu(np.full((STRIDE, 2 * STRIDE), -1e9, dtype=np.float32), STRIDE + 1)
_KEYS, _FANS = np.ones(2 * STRIDE, dtype=np.float32), np.ones(FAN, dtype=np.float32)
#: Rows of pairs (position, node) that share one matrix product.
_GROUP = 32


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Tree:
    """Huffman tree with FAN branches over the vocabulary.

    Node 0 is the root; ``node[first[i]:first[i] + depth[i]]`` and ``branch`` are the way from the root to id i; bias: log shares of the branches.
    """

    def __init__(self, seen: np.ndarray):
        mass = np.concatenate((seen + 0.5, np.full(-(len(seen) - 1) % (FAN - 1), 1e-9)))
        n, inner = len(mass), (len(mass) - 1) // (FAN - 1)
        heap = [(m, i) for i, m in enumerate(mass.tolist())]
        heapq.heapify(heap)
        parent, turn = np.full(n + inner, -1), np.zeros(n + inner, dtype=np.int64)
        self.bias = np.zeros((inner, FAN), dtype=np.float32)
        for k in range(inner):
            own = [heapq.heappop(heap) for _ in range(FAN)]
            total = sum(m for m, _ in own)
            for j, (m, i) in enumerate(own):
                parent[i], turn[i], self.bias[inner - 1 - k, j] = n + k, j, math.log(m / total)
            heapq.heappush(heap, (total, n + k))
        at, ways = np.arange(len(seen)), []
        while (parent[at] >= 0).any():
            live = parent[at] >= 0
            ways.append(np.where(live, (inner - 1 - (parent[at] - n)) * FAN + turn[at], -1))
            at = np.where(live, parent[at], at)
        ways = np.array(ways[::-1]).T  # a row an id, leaves at the right
        self.depth = (ways >= 0).sum(axis=1)
        self.first = np.cumsum(self.depth) - self.depth
        flat = ways[ways >= 0]
        self.node, self.branch = (flat // FAN).astype(np.uint16), (flat % FAN).astype(np.int64)

    def pairs(self, ids: np.ndarray):
        """(ids' positions, node, branch) of the ways to ids below the root, level by level, and where each level begins."""
        n, first = self.depth[ids], self.first[ids]
        who, at, levels = [], [], [0]
        own = np.flatnonzero(n > 1)
        while len(own):
            who.append(own)
            at.append(first[own] + len(who))
            levels.append(levels[-1] + len(own))
            own = own[n[own] > len(who) + 1]
        at = np.concatenate([np.zeros(0, np.int64), *at])
        return np.concatenate([np.zeros(0, np.int64), *who]), self.node[at], self.branch[at], levels


def start(tree: Tree) -> dict[str, np.ndarray]:
    """The common start of all tasks; node: the weights of each node's branches, the last row being added whatever the state."""
    r = np.random.default_rng(20)
    p = {k: (r.standard_normal(s) * WIDTH**-0.5).astype(np.float32) for k, s in _DENSE.items()}
    p["wo"] *= np.float32(0.5)
    p["place"][:] = 0
    p["embed"] = (r.standard_normal((VOCAB, WIDTH)) * 0.5).astype(np.float32)
    p["node"] = np.concatenate((np.zeros((len(tree.bias), WIDTH, FAN), np.float32), tree.bias[:, None, :]), axis=1)
    return p


def layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input ids, target ids, document or -1) in blocks of STRIDE, and the blocks that hold targets; each document has a blank block ahead."""
    n = np.array([len(d) for d in docs], dtype=np.int64)
    blocks = -(-n // STRIDE) + 1
    first = (np.cumsum(blocks) - blocks + 1) * STRIDE
    total = int(blocks.sum()) * STRIDE
    y = np.concatenate(docs).astype(np.int64, copy=False)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(y))
    target, given, own = np.full(total, END), np.full(total, END), np.full(total, -1)
    target[at], own[at] = y, np.repeat(np.arange(len(docs)), n)
    given[at] = np.concatenate(([END], y[:-1]))
    given[first] = END
    blank = np.zeros(total // STRIDE, dtype=bool)
    blank[first // STRIDE - 1] = True
    return given.reshape(-1, STRIDE), target.reshape(-1, STRIDE), own.reshape(-1, STRIDE), np.flatnonzero(~blank)


def _softmax(x: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """In place over the last axis.  Logits over 60 count as 60, which keeps float32 sums finite without a pass for the maximum."""
    np.minimum(x, np.float32(60), out=x)
    np.exp(x, out=x)
    total = x @ ones.astype(x.dtype, copy=False)
    x /= np.maximum(total, np.float32(1e-30))[..., None]
    return x


def _products(p) -> tuple[np.ndarray, np.ndarray]:
    """The weights of queries and keys (scaled) and of values and output, which the model uses by their products only."""
    return p["wq"] @ p["wk"].T * np.float32(WIDTH**-0.5), p["wv"] @ p["wo"]


def _windows(x: np.ndarray) -> np.ndarray:
    """[blocks * STRIDE, n] as the windows of all blocks but the first, [blocks - 1, 2 * STRIDE, n], without a copy."""
    row, item = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x) // STRIDE - 1, 2 * STRIDE, x.shape[1]), (STRIDE * row, row, item), writeable=False)


def _attention(p, q, e, own, out=None):
    """Shares of the keys of all windows [blocks - 1, STRIDE, 2 * STRIDE], for queries q that have the keys' weights in them."""
    s = np.matmul(q, _windows(e).transpose(0, 2, 1), out=out)
    s += p["place"] + _FUTURE
    # Blanks at a text's end are in the future of its ids; the blank block ahead is hidden.
    s[own[:-1, 0] < 0, :, :STRIDE] = -1e9
    return _softmax(s, _KEYS)


def _states(p, given, own):
    """States [positions, WIDTH] of all blocks but the first, and what the backward pass needs; those of blanks mean nothing."""
    e = p["embed"].take(given.ravel(), axis=0)
    n, (look, give) = len(given) - 1, _products(p)
    # Queries and shares are halves of matrices whose other halves the backward pass fills.
    pulls, shares = np.empty((n, 2 * STRIDE, WIDTH), e.dtype), np.empty((n, 2 * STRIDE, 2 * STRIDE), e.dtype)
    np.matmul(e[STRIDE:].reshape(-1, STRIDE, WIDTH), look, out=pulls[:, :STRIDE])
    s = _attention(p, pulls[:, :STRIDE], e, own, shares[:, STRIDE:])
    o = s @ _windows(e)
    h = o.reshape(-1, WIDTH) @ give
    h += e[STRIDE:]
    return h, (e, pulls, shares, o)


def attend(p, given, own, real):
    """States [blocks, STRIDE, WIDTH] of the real blocks, and what the backward pass needs."""
    h, held = _states(p, given, own)
    return h.reshape(-1, STRIDE, WIDTH)[real - 1], held


def _exponents(z: np.ndarray) -> np.ndarray:
    """Sums of exp(z), which replaces z."""
    np.minimum(z, np.float32(60), out=z)
    np.exp(z, out=z)
    return np.maximum(z @ _FANS.astype(z.dtype, copy=False), np.float32(1e-30))


def _choices(z: np.ndarray, at, branch: np.ndarray) -> np.ndarray:
    """Log probabilities of branches (rows ``at`` of z, flattened); z is used up."""
    log = np.minimum(z.reshape(-1, FAN)[at, branch], np.float32(60)).astype(np.float64)
    log -= np.log(_exponents(z).ravel()[at])
    return log


def descend(node, tree: Tree, h: np.ndarray, t: np.ndarray, back: bool = False):
    """Log probability of each id of t given the states h; with back the gradients of minus its mean instead: by h, (nodes, by their rows).

    All positions pass the root; pairs (position, node further down) are ordered by node and multiplied in groups of one node each.
    """
    first, every, count = tree.branch[tree.first[t]], np.arange(len(t)), len(t)
    one = np.ones((count + 1, WIDTH + 1), dtype=h.dtype)
    one[:count, :WIDTH] = h
    one[count] = 0  # fills up groups
    top = one[:count] @ node[0]
    owner, nodes, branch, levels = tree.pairs(t)
    order = np.argsort(nodes, kind="stable")
    nodes, branch, who = nodes[order], branch[order], owner[order]
    run = np.flatnonzero(np.concatenate((np.ones(min(1, len(nodes)), dtype=bool), nodes[1:] != nodes[:-1])))
    size = np.diff(np.append(run, len(nodes)))
    groups = -(-size // _GROUP)
    ahead = np.cumsum(groups) - groups
    slot = np.arange(len(nodes)) + np.repeat(ahead * _GROUP - run, size)
    total = int(groups.sum())
    source = np.full(total * _GROUP, count)
    source[slot] = who
    x = one.take(source, axis=0).reshape(total, _GROUP, WIDTH + 1)
    w = node.take(np.repeat(nodes[run], groups), axis=0)
    z = x @ w
    if not back:
        return _choices(top, every, first) + np.bincount(who, _choices(z, slot, branch), count)
    n = h.dtype.type(1 / count)
    top /= (_exponents(top) * count)[:, None]
    top[every, first] -= n
    dh = top @ node[0, :WIDTH].T
    z /= (_exponents(z) * count)[..., None]
    z.reshape(-1, FAN)[slot, branch] -= n
    dx = (z @ w[:, :WIDTH].transpose(0, 2, 1)).reshape(-1, WIDTH)
    place = np.empty(len(slot), dtype=np.int64)
    place[order] = slot
    for lo, hi in zip(levels, levels[1:]):
        dh[owner[lo:hi]] += dx.take(place[lo:hi], axis=0)
    dw = x.transpose(0, 2, 1) @ z
    of_nodes = np.empty((len(run) + 1, WIDTH + 1, FAN), dtype=h.dtype)
    of_nodes[0] = one[:count].T @ top
    of_nodes[1:] = dw[ahead]
    for k in np.flatnonzero(groups > 1).tolist():
        dw[ahead[k] : ahead[k] + groups[k]].sum(axis=0, out=of_nodes[k + 1])
    return dh, np.concatenate((np.zeros(1, nodes.dtype), nodes[run])), of_nodes


def gradients(p, tree, given, target, own, real):
    """(gradients, rows of the embedding and their gradients, nodes and theirs) of the mean log loss."""
    h, (e, pulls, shares, o) = _states(p, given, own)
    at = np.flatnonzero(own[1:].ravel() >= 0)
    back, nodes, of_nodes = descend(p["node"], tree, h.take(at, axis=0), target[1:].ravel()[at], True)
    dh = np.zeros_like(h)
    dh[at] = back
    look, give = _products(p)
    of_give = o.reshape(-1, WIDTH).T @ dh
    keys, do = _windows(e), (dh @ give.T).reshape(o.shape)
    # Shares times what values pull, and shares' gradients times queries, in one product a window.
    ds = np.matmul(do, keys.transpose(0, 2, 1), out=shares[:, :STRIDE])
    ds -= np.einsum("bij,bij->bi", do, o)[:, :, None]
    ds *= shares[:, STRIDE:]
    pulls[:, STRIDE:] = do
    part = shares.transpose(0, 2, 1) @ pulls
    dq = (ds @ keys).reshape(-1, WIDTH)
    of_look = e[STRIDE:].T @ dq * np.float32(WIDTH**-0.5)
    g = {"wq": of_look @ p["wk"], "wk": of_look.T @ p["wq"], "wv": of_give @ p["wo"].T, "wo": p["wv"].T @ of_give, "place": ds.sum(axis=0)}
    de = np.empty((len(given), STRIDE, WIDTH), h.dtype)
    de[0] = 0
    de[1:] = part[:, STRIDE:]
    de[:-1] += part[:, :STRIDE]
    de = de.reshape(-1, WIDTH)
    dh += dq @ look.T
    de[STRIDE:] += dh
    ids = given.ravel().astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begin = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return g, ids[begin], np.add.reduceat(de.take(order, axis=0), begin, axis=0), nodes, of_nodes


class Steps:
    """Adam for the dense parameters and the embedding; the tree's nodes, most of them rare, divide by the root of their summed squares."""

    def __init__(self, p, rate: float):
        self.p, self.step, self.rate = p, 0, rate
        self.m = {k: np.zeros_like(v) for k, v in p.items() if k != "node"}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, g, rows, of_rows, nodes, of_nodes) -> None:
        self.step += 1
        rate = self.rate * min(1.0, self.step / 5) * math.sqrt((1 - 0.99**self.step)) / (1 - 0.9**self.step)
        for k, at, grad in [*((k, slice(None), x) for k, x in g.items()), ("embed", rows, of_rows)]:
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * grad
            self.v[k][at] = v = 0.99 * self.v[k][at] + 0.01 * grad * grad
            self.p[k][at] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-6))
        self.v["node"][nodes] = v = self.v["node"][nodes] + of_nodes * of_nodes
        self.p["node"][nodes] -= np.float32(NODE_RATE * self.rate / RATE) * of_nodes / (np.sqrt(v) + np.float32(1e-6))


def train(p, tree, docs, rate: float = RATE) -> None:
    """One pass over an iterable of id lists."""
    steps, held, size = Steps(p, rate), [], 0
    for d in docs:
        for a in range(0, len(d), BATCH * STRIDE):
            part = d[a : a + BATCH * STRIDE]
            held.append(part)
            size += len(part)
            if size >= BATCH * STRIDE:
                steps.update(*gradients(p, tree, *layout(held)))
                held, size = [], 0
    if held:
        steps.update(*gradients(p, tree, *layout(held)))


@functools.cache
def _keep_freed() -> None:
    """Have a worker keep the arrays it frees: as set, glibc gives large ones back and has each new one mapped page by page."""
    try:
        own = ctypes.CDLL(None).mallopt
        for key in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            own(key, 1 << 28)
    except (AttributeError, OSError):
        pass


def score_ids(p, tree, docs: list[np.ndarray], tables=None) -> np.ndarray:
    """log10 probability of every id list; tables: those of ``look_ups``, if several calls share them."""
    out = np.zeros(len(docs))
    given, target, own, _ = layout(docs)
    size = 4 * BATCH
    queries, values = tables or look_ups(p)
    for a in range(1, len(given), size):
        stop, h = min(a + size, len(given)), []
        for b in range(a, stop, BATCH):
            block, ids = own[b - 1 : b + BATCH], given[b - 1 : b + BATCH].ravel()
            e = p["embed"].take(ids, axis=0)
            s = _attention(p, queries.take(ids[STRIDE:], axis=0).reshape(-1, STRIDE, WIDTH), e, block)
            h.append((s @ _windows(values.take(ids, axis=0))).reshape(-1, WIDTH))
            h[-1] += e[STRIDE:]
        of, t = own[a : a + size].ravel(), target[a : a + size].ravel()
        at = np.flatnonzero(of >= 0)
        out += np.bincount(of[at], descend(p["node"], tree, np.concatenate(h).take(at, axis=0), t[at]), len(docs))
    return out / math.log(10)


def look_ups(p) -> tuple[np.ndarray, np.ndarray]:
    """The query of each id and what it adds to a state as a value."""
    look, give = _products(p)
    return p["embed"] @ look, p["embed"] @ give


_READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("word", pa.string()), ("id", pa.int32()), ("n", pa.int64())])
#: Parts of the first pass's table besides 0 to ROUNDS - 1, the training documents: held-out documents, counts.
_HELD, _COUNTS = -1, -2


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts one after the other, A-Z in lower case and nothing else changed, and where each begins and ends."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _closed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte ahead of each place certainly ends no white space, be it beyond ASCII."""
    last, lead = data[at - 1], data[np.maximum(at - 3, 0)]
    return (last > 32) & (last < 127) | (last >= 128) & (data[np.maximum(at - 2, 0)] != 0xC2) & ((lead < 0xE1) | (lead > 0xE3))


def chunks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(chunks by their place among the distinct ones, distinct chunks, where each text's chunks begin and end).

    A chunk is a word with the white space ahead of it: texts are cut ahead of each space or line break that follows something else.  The tokenizer's pattern has a
    border there and looks no further back, so a text's ids are those of its chunks.
    """
    mark = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero((data[1:] == 32) | (data[1:] == 10)) + 1
    mark[at[_closed(data, at)]] = True
    mark[ends] = True
    begin = np.flatnonzero(mark).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.searchsorted(begin, ends)


@functools.cache
def _id_bytes(tokenizer: str) -> np.ndarray:
    """Bytes of each id; the file writes a byte as one character."""
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    out[list(vocab.values())] = list(map(len, vocab))
    return out


def encoded(encode, id_bytes: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each chunk's begin, how many it has) of distinct chunks, and behind them those of an end.

    Chunks that begin with white space and end in none are encoded as one text, in which borders stay, and told apart by the bytes of their ids; others one by one.
    """
    n, ends = len(distinct), np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
    data, ends = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    first = data[ends[:-1]]
    joint = ((first == 32) | (first == 10)) & _closed(data, ends[1:])
    text = data[np.repeat(joint, np.diff(ends))].tobytes().decode()
    ids = np.array(encode(text), dtype=np.uint16)
    stops, borders = np.cumsum(id_bytes[ids]), np.cumsum(np.diff(ends)[joint], dtype=np.int64)
    cut = np.searchsorted(stops, borders) + 1
    assert not len(cut) or cut[-1] == len(ids) and np.array_equal(stops[cut - 1], borders), "an id crosses a chunk's border"
    others = [np.array(encode(c), dtype=np.uint16) for c in distinct.filter(pa.array(~joint)).to_pylist()] + [np.array([END], np.uint16)]
    size = np.concatenate((np.diff(cut, prepend=0), np.array(list(map(len, others))))).astype(np.int32)
    order = np.concatenate((np.flatnonzero(joint), np.flatnonzero(~joint), [n]))
    begin, count = np.empty(n + 1, np.int32), np.empty(n + 1, np.int32)
    begin[order], count[order] = np.cumsum(size) - size, size
    return np.concatenate((ids, *others)), begin, count


def _read(tokenizer: str, group: int = 16 << 20, most_words: int = 1_000_000):
    def run(batches):
        encode, id_bytes = encoder(tokenizer), _id_bytes(tokenizer)
        seen = np.zeros(VOCAB, np.int64)
        words: list[pa.Table] = []

        def counts(names, ids, n):
            k = len(n)
            nulls = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), pa.binary())]
            return pa.record_batch([pa.array(np.full(k, _COUNTS), pa.int32()), *nulls, names, ids, pa.array(n, pa.int64())], schema=_READ)

        def summed():
            return pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def word_rows(table):
            # Words of several rows of counts are added up later; no word is cut.
            words.clear()
            for b in table.combine_chunks().to_batches(max_chunksize=100_000):
                yield counts(b.column("word"), pa.nulls(len(b), pa.int32()), b.column("n"))

        def documents(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            doc_ids, texts = (c.combine_chunks() for c in rows.columns[:2])
            n, (data, ends) = len(rows), lowered(texts)
            code, distinct, first = chunks(data, ends)
            flat, begin, count = encoded(encode, id_bytes, distinct)
            # Each text's chunks, then its end.
            every = np.insert(code, first[1:], len(distinct))
            own = np.repeat(np.arange(n, dtype=np.int32), np.diff(first) + 1)
            part = np.array([_HELD if held_out(d) else zlib.crc32(data[a:b]) % ROUNDS for d, a, b in zip(doc_ids.to_pylist(), ends.tolist(), ends[1:].tolist())])
            times = np.bincount(every[(part != _HELD)[own]], minlength=len(distinct) + 1)
            # The ids of the chunks from flat, one after the other.
            size = count[every]
            stop = np.cumsum(size, dtype=np.int32)
            at = np.repeat(begin[every] - (stop - size), size)
            at += np.arange(len(at), dtype=np.int32)
            ids = flat.take(at)
            stops = np.concatenate(([0], stop[np.cumsum(np.diff(first) + 1) - 1]))
            order = np.argsort(begin)
            seen[:] += np.bincount(flat, np.repeat(times[order], count[order]), VOCAB).astype(np.int64)
            split = pc.ascii_split_whitespace(distinct)
            of, names = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
            own_words = pa.array((times[of] > 0) & (pc.binary_length(names).to_numpy() > 0))
            table = pa.table({"word": names, "n": times[of]}).filter(own_words)
            words.append(pa.concat_tables([table, pa.table({"word": [END_WORD], "n": times[-1:]}).filter([bool(times[-1])])]))
            words[:] = [summed()]
            for a in range(0, n, 500):
                b = min(n, a + 500)
                coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((stops[a : b + 1] - stops[a]) * 2).astype(np.int32)), pa.py_buffer(ids[stops[a] : stops[b]])])
                nulls = [pa.nulls(b - a, t) for t in (pa.string(), pa.int32(), pa.int64())]
                yield pa.record_batch([pa.array(part[a:b], pa.int32()), doc_ids[a:b], texts[a:b].cast(pa.string()), coded, *nulls], schema=_READ)

        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size > group):
                yield from documents(held)
                held, size = [], 0
                if len(words[0]) > most_words:
                    yield from word_rows(words[0])
        if words:
            yield from word_rows(words[0])
        own = np.flatnonzero(seen)
        if len(own):
            yield counts(pa.nulls(len(own), pa.string()), pa.array(own, pa.int32()), seen[own])

    return run


def read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The first pass over docs(doc_id, text), as a table by part: documents with their ids, and counts of words and ids of the training ones."""
    graph.small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return graph.written(slim.mapInArrow(_read(tokenizer), "part int, doc_id long, text string, ids binary, word string, id int, n long"), "part")


#: Rows of a block of parameters that travel together.
_BLOCK = {"embed": 1024, "node": 128, "dense": 1 << 20}
_SUMS = pa.schema([("block", pa.string()), ("weight", pa.binary()), ("value", pa.binary())])


def _tables(p) -> dict[str, np.ndarray]:
    """The parameters as matrices; dense ones as one row."""
    return {"embed": p["embed"], "node": p["node"].reshape(len(p["node"]), -1), "dense": np.concatenate([p[k].ravel() for k in _DENSE])[None, :]}


def _train(p, tree, rate):
    def run(batches):
        _keep_freed()
        own = {k: v.copy() for k, v in p.items()}
        seen = np.zeros(VOCAB, np.int64)

        def documents():
            for batch in batches:
                for data in batch.column(0):
                    ids = np.frombuffer(data.as_buffer(), dtype=np.uint16)
                    np.add.at(seen, ids, 1)
                    yield ids

        train(own, tree, documents(), rate)
        if not seen.any():
            return
        visits = np.bincount(tree.node, np.repeat(seen, tree.depth), len(tree.bias))
        weights = {"embed": seen, "node": visits, "dense": np.array([seen.sum()])}
        for name, table in _tables(own).items():
            for a in range(0, len(table), _BLOCK[name]):
                w = weights[name][a : a + _BLOCK[name]].astype(np.float64)
                if w.any():
                    yield pa.record_batch([pa.array([f"{name}:{a}"]), pa.array([w.tobytes()], pa.binary()), pa.array([table[a : a + _BLOCK[name]].tobytes()], pa.binary())], schema=_SUMS)

    return run


def _mean(batches):
    """Rows of a block from several tasks -> one row: the sum of weights and the weighted mean."""
    sums: dict[str, list] = {}
    for batch in batches:
        for name, w, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            w = np.frombuffer(w.as_buffer(), np.float64)
            v = np.frombuffer(v.as_buffer(), np.float32).reshape(len(w), -1) * w[:, None]
            if name in sums:
                sums[name][0] += w
                sums[name][1] += v
            else:
                sums[name] = [w.copy(), v]
    for name, (w, v) in sums.items():
        yield pa.record_batch([pa.array([name]), pa.array([w.tobytes()], pa.binary()), pa.array([(v / np.maximum(w, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], schema=_SUMS)


def learn(table: DataFrame, rounds: int = ROUNDS, task_ids: int = TASK_IDS) -> tuple[dict[str, np.ndarray], Tree]:
    """Parameters and tree from the table that ``read`` wrote."""
    seen = np.zeros(VOCAB, np.int64)
    for r in table.where((F.col("part") == _COUNTS) & F.col("id").isNotNull()).groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary at most
        seen[r.id] = r.n
    tree = Tree(seen)
    p = start(tree)
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(rounds if seen.any() else 0):
        own = table.where(F.col("part") == k).select("ids")
        own = own.coalesce(max(1, int(seen.sum() // (rounds * task_ids))))
        summed = own.mapInArrow(_train(p, tree, RATE * RATES[k % len(RATES)]), "block string, weight binary, value binary")
        means = summed.repartition(min(n, 64), "block").mapInArrow(_mean, "block string, weight binary, value binary").collect()  # the parameters, once
        tables = _tables(p)
        for r in means:
            name, a = r.block.split(":")
            w = np.frombuffer(r.weight, np.float64)
            v = np.frombuffer(r.value, np.float32).reshape(len(w), -1)
            tables[name][int(a) : int(a) + len(w)][w > 0] = v[w > 0]
        p["node"] = tables["node"].reshape(p["node"].shape)
        at = 0
        for name, shape in _DENSE.items():
            size = shape[0] * shape[1]
            p[name] = tables["dense"][0, at : at + size].reshape(shape)
            at += size
    return p, tree


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<string>, times array<int>"


def _score(p, tree, head, den):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        _keep_freed()
        rid = TaskContext.get().partitionId() << 33
        (known, logs_of), tables = head, look_ups(p)
        rare = math.log10(0.5) - den
        for batch in batches:
            if not len(batch):
                continue
            n = len(batch)
            code, distinct, first = chunks(*lowered(batch.column(1)))
            # Each text's chunks, then its end: a chunk of one word.
            code, first = np.insert(code, first[1:], len(distinct)), first + np.arange(n + 1)
            split = pc.ascii_split_whitespace(distinct)
            words, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
            full = pc.binary_length(words).to_numpy() > 0
            words, of = pa.concat_arrays([words.filter(pa.array(full)), pa.array([END_WORD])]), np.append(of[full], len(distinct))
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            logs, unknown = np.append(logs_of, rare)[at], at < 0
            own, kinds = np.repeat(np.arange(n), np.diff(first)), len(distinct) + 1
            n_tokens = np.bincount(own, np.bincount(of, minlength=kinds)[code], n).astype(np.int64)
            base = np.bincount(own, np.bincount(of, logs, kinds)[code], n)
            # Rare words of each text and how often it holds them.
            others = np.bincount(of[unknown], minlength=kinds)
            n_others = others[code]
            stop, kinds = np.cumsum(n_others), max(1, int(others.sum()))
            at = np.repeat((np.cumsum(others) - others)[code] - (stop - n_others), n_others) + np.arange(n_others.sum())
            pair, times = np.unique(np.repeat(own, n_others) * kinds + at, return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(n + 1) * kinds), pa.int32())
            tail = words.filter(pa.array(unknown)).take(pa.array(pair % kinds))
            n_known = n_tokens - np.bincount(own, n_others, n).astype(np.int64)
            scores, ids, size = [], [], 0
            for k, data in enumerate(batch.column(2)):
                ids.append(np.frombuffer(data.as_buffer(), dtype=np.uint16))
                size += len(ids[-1])
                if size > 200_000 or k + 1 == n:
                    scores.append(score_ids(p, tree, ids, tables))
                    ids, size = [], 0
            cols = [np.arange(rid, rid + n), batch.column(0), pc.equal(batch.column(3), _HELD), n_tokens, n_known, base, np.concatenate(scores)]
            rid += n
            lists = [pa.ListArray.from_arrays(ends, tail), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*cols, *lists], schema)], schema=schema)

    return run


def score(docs: DataFrame, tokenizer: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text)."""
    table = read(docs, tokenizer)
    words = graph.written(table.where((F.col("part") == _COUNTS) & F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("c")))
    p, tree = learn(table)
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    den = math.log10(n + 0.5 * (v + 1))
    head = [(r.word, math.log10(r.c + 0.5) - den) for r in words.where(F.col("c") * head_words >= n).toLocalIterator()]  # at most head_words
    head = pa.array([w for w, _ in head], pa.string()), np.array([x for _, x in head])
    every = table.where(F.col("part") != _COUNTS).select("doc_id", "text", "ids", "part")
    scored = graph.written(every.mapInArrow(_score(p, tree, head, den), _SCORED))
    graph.release(table)
    rare = words.where(F.col("c") * head_words < n)
    tails = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("k"))
    more = tails.join(rare, "word").groupBy("rid").agg(F.sum("k").alias("known_tail"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - math.log10(0.5))).alias("base_tail"))
    out = scored.drop("tail", "times").join(more, "rid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_tail", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"), "score")
