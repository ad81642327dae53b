"""Approximate nearest neighbours by inner product: NN-descent graph, greedy search.

Equal vectors are folded into one node. Nodes are dealt by hash to parts of about
``PART``, and what one part has for another travels as one row of arrays, so that joins
carry a row for each pair of parts and not for each pair of nodes. The graph starts from
groups of vectors with the same signs on random hyperplanes; groups over ``LEAF`` are
split by hash. Then, in rounds, each node introduces its neighbours and those it is a
neighbour of to each other: a part asks the others for the vectors that its nodes are to
introduce, each once, and only pairs that beat a member's worst neighbour go back to it.
Pairs that met at the node in the round before don't meet again. In-neighbours of hubs are
thinned by hash to ``K``, which is the method's sampling; nothing else is dropped. No
part sends more than ``K`` in-neighbours or proposals for a node, as more can't be kept.

Rounds go on until fewer than ``LEAST_GAIN`` of all neighbours change.

Next to its links a node then has the vectors of those it is linked with. A query starts
at its own node and at the best ``ENTRIES`` others of its part. Each hop sends the query's
vector to the best nodes not yet expanded among the best ``BEAM`` (or the square root of
the number of nodes, if that is more): ``FIRST`` of them until that many are known, then a
quarter of them, and all when fewer than ``FIRST`` a query are left. They send back what they are linked with that beats the worst of the beam,
until the whole beam is expanded. A node that fell out of a beam is worse than all in it and
can't come back, so the beam is all that a query remembers. The best ``RERANK`` are scored
again in double precision on the original vectors. A query whose reachable part
is smaller than that is compared with all vectors, in blocks of queries.

Graph vectors are rounded to bytes, each on its own scale, and get one more
component in single precision, which makes all lengths equal so that the nearest
are those of largest inner product.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another length than the commonest (ties: the
shortest). Rows that repeat an identifier count once, with the smallest vector.
Null identifiers take no part. With fewer candidates than asked for, all are returned. Ties of score go to
the smaller identifier. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .workspace import Workspace

K = 32
TREES = 4
LEAF = 256
LEAST_GAIN = 0.1
"""Rounds end when fewer than this part of all neighbours changes."""
BEAM = 256
FIRST = 16
"""Best unexpanded nodes that one hop expands while a query's beam isn't full; later it is a quarter of the beam."""
ENTRIES = 8
RERANK = 64
QUERY_BLOCK = 512
PART = 4096
"""Nodes of a part, by mean; small tables have smaller ones, so that all cores have some."""
SLOT_BITS = 13
"""A node's number is its part's, then its place there. Parts are dealt by hash, so twice the mean is never reached."""
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, each identifier once, as doubles."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )
    return kept.groupBy("id").agg(F.min("v").alias("v"))


def top(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n)


def quantised(nodes: DataFrame, largest: float, dim: int) -> DataFrame:
    """(node, q): each vector over ``largest``, as its scale and lift in single precision and its bytes on that scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim) / largest
            squares = (x * x).sum(1)
            # What the component that makes all lengths 1 lacks to 1, without cancellation.
            lift = squares / (1 + np.sqrt(np.maximum(1 - squares, 0)))
            scale = np.abs(x).max(1) / 127
            q = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            heads = np.column_stack([scale, lift]).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.tobytes() + r.tobytes() for h, r in zip(heads, q)], pa.binary())], ["node", "q"]
            )

    return nodes.select("node", "v").mapInArrow(run, "node int, q binary")


def parts(blobs) -> tuple[np.ndarray, np.ndarray]:
    """(scale and lift, bytes) of each vector, of blobs or rows of bytes."""
    raw = blobs if isinstance(blobs, np.ndarray) else np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return raw[:, :8].copy().view("<f4"), raw[:, 8:].copy().view(np.int8).astype(np.float32)


def lifted(blobs) -> np.ndarray:
    """Vectors in their own scale, with the lift as last component."""
    head, x = parts(blobs)
    return np.hstack([x * head[:, :1], head[:, 1:]])


def likeness(x: np.ndarray) -> np.ndarray:
    """Inner products with the component for equal lengths, less 1: that component's share is -a - b + ab of the lifts."""
    s = x @ x.T
    s -= x[:, -1:]
    s -= x[:, -1]
    return s


# --- rows of arrays

def sent(part: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each part: the values of each column that go there, end to end."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    out = {"part": pa.array(part[edges], pa.int32())}
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        offsets = np.append(edges, len(part)) * (values.itemsize * math.prod(values.shape[1:]))
        out[name] = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return pa.table(out)


def row(part: int, **columns: np.ndarray) -> pa.Table:
    """One row; whole numbers stay such."""
    return pa.table(
        {"part": pa.array([part], pa.int32())}
        | {k: pa.array([v], pa.int64()) if isinstance(v, int) else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in columns.items()}
    )


def held(table: pa.Table, name: str, kind=np.int32) -> np.ndarray:
    """The values of a column of all rows, end to end."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def matrix(table: pa.Table, dim: int, name: str = "q") -> np.ndarray:
    return held(table, name, np.uint8).reshape(-1, dim + 8)


def each(blocks: DataFrame, send: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What every row of ``blocks`` sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from send(pa.Table.from_batches([batch.slice(k, 1)])).to_batches()

    return blocks.mapInArrow(run, f"part int, {schema}")


def met(messages: DataFrame, blocks: DataFrame, take: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``take`` of the messages for each part and of its row in ``blocks``."""
    return messages.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(take, f"part int, {schema}")


def best(a: np.ndarray, b: np.ndarray, s: np.ndarray, mark: np.ndarray, k: int | None) -> tuple[np.ndarray, ...]:
    """Of each ``a`` the ``k`` distinct ``b`` of greatest ``s``, best first, and whether any row of that pair has a mark."""
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return a, b, s, mark
    s, mark, key = np.maximum.reduceat(s[order], first), np.logical_or.reduceat(mark[order], first), key[first]
    a, b = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    if k is None:
        return a, b, s, mark
    # Single precision in the order of whole numbers.
    bits = (-s + np.float32(0)).view(np.int32)
    order = np.argsort((key >> 32 << 32) + ((bits ^ (bits >> 31 & 0x7FFFFFFF)).astype(np.int64) + 2**31), kind="stable")
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    order = order[rank < k]
    return a[order], b[order], s[order], mark[order]


def drawn(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 by hash of a pair."""
    x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(by)
    return (x >> np.uint64(40)).astype(np.float32)


def blocked(vectors: DataFrame) -> DataFrame:
    """(part, q): the vectors of each part, in the order of their numbers."""

    def gather(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part").combine_chunks()[:1], "q": pa.array([b"".join(group.sort_by("node").column("q").to_pylist())], pa.binary())})

    return vectors.select(F.shiftright("node", SLOT_BITS).alias("part"), "node", "q").groupBy("part").applyInArrow(gather, "part int, q binary")


# --- graph

LISTS = "q binary, a binary, b binary, s binary, old binary, gained long"
LINKED = f"{LISTS}, u binary, v binary, seen binary"


def first_lists(vectors: DataFrame, n: int) -> DataFrame:
    """(part, a, b, s) from groups on the same side of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / (LEAF / 2))))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x = parts(batch.column(1).to_pylist())
            for tree in range(TREES):
                planes = np.random.default_rng(100 + tree).standard_normal((x.shape[1], bits)).astype(np.float32)
                leaf = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(leaf), batch.column(0), batch.column(1)],
                    ["tree", "leaf", "node", "q"],
                )

    coded = vectors.mapInArrow(code, "tree int, leaf long, node int, q binary")
    sizes = coded.groupBy("tree", "leaf").agg(F.count("*").alias("size"))
    split = F.pmod(F.xxhash64("tree", "node"), F.ceil(F.col("size") / LEAF)).alias("split")

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        ids = group.column("node").to_numpy()
        s = likeness(lifted(group.column("q").to_pylist()))
        np.fill_diagonal(s, -np.inf)
        k = min(K, len(ids) - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
        a = np.repeat(ids, k)
        return sent(a >> SLOT_BITS, a=a, b=ids[near].ravel(), s=np.take_along_axis(s, near, 1).ravel())

    grouped = coded.join(sizes, ["tree", "leaf"]).select("tree", "leaf", split, "node", "q").groupBy("tree", "leaf", "split")
    return grouped.applyInArrow(within, "part int, a binary, b binary, s binary")


def merged(proposals: pa.Table, block: pa.Table) -> pa.Table:
    """The ``K`` best distinct neighbours of each node of a part."""
    a, b, s = (np.concatenate([held(block, c, kind), held(proposals, c, kind)]) for c, kind in (("a", np.int32), ("b", np.int32), ("s", np.float32)))
    there = np.arange(len(a)) < len(held(block, "a"))
    a, b, s, old = best(a, b, s, there, K)
    return row(block.column("part")[0].as_py(), q=held(block, "q", np.uint8), a=a, b=b, s=s, old=old, gained=int((~old).sum()))


def linked(lists: DataFrame, salt: int) -> DataFrame:
    """``lists`` with the pairs (u, v) of a node and those to introduce: its neighbours, seen if old, and K at most that it is a neighbour of."""

    def send(block: pa.Table) -> pa.Table:
        v, u = held(block, "b"), held(block, "a")
        v, u, *_ = best(v, u, drawn(v, u, salt), np.zeros(len(v), bool), K)
        return sent(v >> SLOT_BITS, v=v, u=u)

    def take(of: pa.Table, block: pa.Table) -> pa.Table:
        v, u = held(of, "v"), held(of, "u")
        v, u, *_ = best(v, u, drawn(v, u, salt), np.zeros(len(v), bool), K)
        a, b, old = held(block, "a"), held(block, "b"), held(block, "old", bool)
        u, v, _, seen = best(np.append(a, v), np.append(b, u), np.zeros(len(a) + len(v), np.float32), np.append(old, np.zeros(len(v), bool)), None)
        columns = {c: pa.array([x], pa.binary()) for c, x in (("u", u.tobytes()), ("v", v.tobytes()), ("seen", seen.tobytes()))}
        return pa.table({c: block.column(c) for c in block.column_names} | columns)

    return met(each(lists, send, "v binary, u binary"), lists, take, LINKED)


def asked_for(graph: DataFrame, dim: int) -> DataFrame:
    """(part, v, q, worst): for each part the vectors of all that it has to introduce, and what beats their worst neighbour."""

    def ask(block: pa.Table) -> pa.Table:
        v = np.unique(held(block, "v"))
        return sent(v >> SLOT_BITS, v=v, by=np.full(len(v), block.column("part")[0].as_py(), np.int32))

    def answer(asks: pa.Table, block: pa.Table) -> pa.Table:
        q, a, s, v = matrix(block, dim), held(block, "a"), held(block, "s", np.float32), held(asks, "v")
        at = a & (1 << SLOT_BITS) - 1
        worst = np.full(len(q), np.inf, np.float32)
        np.minimum.at(worst, at, s)
        worst[np.bincount(at, minlength=len(q)) < K] = -np.inf
        slot = v & (1 << SLOT_BITS) - 1
        return sent(held(asks, "by"), v=v, q=q[slot], worst=worst[slot])

    return met(each(graph, ask, "v binary, by binary"), graph, answer, "v binary, q binary, worst binary")


def introduce(graph: DataFrame, dim: int) -> DataFrame:
    """One round: (part, a, b, s), proposals better than the node's worst neighbour."""

    def take(answers: pa.Table, block: pa.Table) -> pa.Table:
        u, v, seen = held(block, "u"), held(block, "v"), held(block, "seen", bool)
        known, worst, x = held(answers, "v"), held(answers, "worst", np.float32), lifted(matrix(answers, dim))
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], v)]
        least = worst[at]
        edges = np.append(np.flatnonzero(np.diff(u, prepend=-1)), len(u)).tolist()
        out_a, out_b, out_s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.float32)]
        for lo, hi in zip(edges, edges[1:]):
            s = likeness(x[at[lo:hi]])
            hit = s > least[lo:hi, None]
            hit &= ~(seen[lo:hi, None] & seen[lo:hi])
            np.fill_diagonal(hit, False)
            i, j = np.divmod(np.flatnonzero(hit), hi - lo)
            out_a.append(i + lo)
            out_b.append(j + lo)
            out_s.append(s[i, j])
        a, b, s = v[np.concatenate(out_a)], v[np.concatenate(out_b)], np.concatenate(out_s)
        a, b, s, _ = best(a, b, s, np.zeros(len(a), bool), K)
        return sent(a >> SLOT_BITS, a=a, b=b, s=s)

    return met(asked_for(graph, dim), graph, take, "a binary, b binary, s binary")


def build_graph(vectors: DataFrame, blocks: DataFrame, n: int, n_parts: int, dim: int, ws: Workspace, table: str) -> DataFrame:
    """(part, v, q, ends, at): the nodes that those of a part are linked with, their vectors, and where each node's links end and point.

    Every hop reads the table, so it is bucketed by part and not shuffled again.
    """
    bare = blocks.select("part", "q", *[F.lit(b"").alias(c) for c in ("a", "b", "s", "old")], F.lit(0).cast("long").alias("gained"))
    lists = ws.keep(met(first_lists(vectors, n), bare, merged, LISTS), "lists")
    links = lists.agg(F.sum("gained")).first()[0]
    for k in itertools.count():
        graph = ws.keep(linked(lists, k), "linked")
        ws.drop(lists)
        lists = ws.keep(met(introduce(graph, dim), graph, merged, LISTS), "lists")
        ws.drop(graph)
        # Lists only ever improve, so this ends.
        if lists.agg(F.sum("gained")).first()[0] <= LEAST_GAIN * links:
            break
    graph = ws.keep(linked(lists, 99), "linked")
    ws.drop(lists)

    def take(answers: pa.Table, block: pa.Table) -> pa.Table:
        u, v, known = held(block, "u"), held(block, "v"), held(answers, "v")
        order = np.argsort(known)
        ends = np.cumsum(np.bincount(u & (1 << SLOT_BITS) - 1, minlength=len(matrix(block, dim)))).astype(np.int32)
        at = order[np.searchsorted(known[order], v)].astype(np.int32)
        return row(block.column("part")[0].as_py(), v=known, q=matrix(answers, dim), ends=ends, at=at)

    around = met(asked_for(graph, dim), graph, take, "v binary, q binary, ends binary, at binary")
    around.write.bucketBy(n_parts, "part").option("compression", "zstd").format("parquet").saveAsTable(table)
    ws.drop(graph)
    return ws.spark.table(table)


# --- search

BEAMS = "query binary, q binary, size binary, node binary, s binary, done binary, open long"


def expanded(state: pa.Table, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of beams are expanded next, ``most`` of a full beam, and the place of each row's query."""
    size, done = held(state, "size"), held(state, "done", bool)
    of = np.repeat(np.arange(len(size)), size)
    before = np.cumsum(~done) - ~done
    starts = np.cumsum(size) - size
    rank = before - np.repeat(before[starts], size)
    return ~done & (rank < np.where(size < width, FIRST, most)[of]), of


def greedy_search(queries: DataFrame, around: DataFrame, blocks: DataFrame, n: int, n_parts: int, dim: int, ws: Workspace) -> DataFrame:
    """(query, node, sim): the best ``RERANK`` of each query's beam; ``queries`` has the query's own node."""
    width = max(BEAM, math.isqrt(n))

    def beams(part: int, query, q, a, b, s, done) -> pa.Table:
        a, b, s, done = best(a, b, s, done, width)
        size = np.bincount(a, minlength=len(query)).astype(np.int32)
        return row(part, query=query, q=q, size=size, node=b, s=s, done=done, open=int((~done).sum()))

    def begin(asked: pa.Table, block: pa.Table) -> pa.Table:
        query = np.sort(asked.column("query").to_numpy())
        part, q = block.column("part")[0].as_py(), matrix(block, dim)
        slot = query & (1 << SLOT_BITS) - 1
        head, x = parts(q)
        # A query's own scale doesn't change its order.
        s = (x[slot] @ x.T) * head[:, 0]
        others = s.copy()
        others[np.arange(len(query)), slot] = np.inf
        k = min(1 + ENTRIES, len(q))
        at = np.argpartition(-others, k - 1, axis=1)[:, :k] if len(query) else np.zeros((0, k), int)
        a = np.repeat(np.arange(len(query)), k).astype(np.int32)
        b = (at.ravel() | part << SLOT_BITS).astype(np.int32)
        return beams(part, query, q[slot], a, b, np.take_along_axis(s, at, 1).ravel(), np.zeros(len(a), bool))

    def ask(state: pa.Table, most: int) -> pa.Table:
        next_, of = expanded(state, width, most)
        size, s, node = held(state, "size"), held(state, "s", np.float32), held(state, "node")
        worst = np.where(size < width, np.float32(-np.inf), s[np.cumsum(size) - 1]).astype(np.float32)
        node, of = node[next_], of[next_]
        return sent(node >> SLOT_BITS, node=node, query=held(state, "query")[of], worst=worst[of], q=matrix(state, dim)[of])

    def answer(asks: pa.Table, near: pa.Table) -> pa.Table:
        node, v, at = held(asks, "node"), held(near, "v"), held(near, "at")
        ends, q = held(near, "ends").tolist(), matrix(near, dim)
        order = np.argsort(node, kind="stable")
        node, query, worst = node[order], held(asks, "query")[order], held(asks, "worst", np.float32)[order, None]
        x = parts(matrix(asks, dim)[order])[1]
        scale, y = q[:, :4].copy().view("<f4")[:, 0], q[:, 8:].view(np.int8)
        edges = np.append(np.flatnonzero(np.diff(node, prepend=-1)), len(node)).tolist()
        out_a, out_b, out_s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.float32)]
        for lo, hi in zip(edges, edges[1:]):
            slot = node[lo] & (1 << SLOT_BITS) - 1
            to = at[ends[slot - 1] if slot else 0 : ends[slot]]
            if not len(to):
                continue
            s = x[lo:hi] @ y[to].astype(np.float32).T * scale[to]
            i, j = np.divmod(np.flatnonzero(s > worst[lo:hi]), len(to))
            out_a.append(i + lo)
            out_b.append(to[j])
            out_s.append(s[i, j])
        a = query[np.concatenate(out_a)]
        return sent(a >> SLOT_BITS, query=a, node=v[np.concatenate(out_b)], s=np.concatenate(out_s))

    def absorb(found: pa.Table, state: pa.Table, most: int) -> pa.Table:
        next_, of = expanded(state, width, most)
        query = held(state, "query")
        a = np.append(of, np.searchsorted(query, held(found, "query")))
        b, s = np.append(held(state, "node"), held(found, "node")), np.append(held(state, "s", np.float32), held(found, "s", np.float32))
        done = np.append(held(state, "done", bool) | next_, np.zeros(len(a) - len(of), bool))
        return beams(state.column("part")[0].as_py(), query, matrix(state, dim), a, b, s, done)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                state = pa.Table.from_batches([batch.slice(k, 1)])
                size = held(state, "size")
                of = np.repeat(np.arange(len(size)), size)
                top = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) < RERANK
                columns = held(state, "query")[of[top]], held(state, "node")[top], held(state, "s", np.float32)[top]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "node", "sim"])

    asked = queries.select("query", F.shiftright("query", SLOT_BITS).alias("part"))
    state = ws.keep(met(asked, blocks, begin, BEAMS).filter(F.length("query") > 0), "beams")
    over = []
    while True:
        # A part whose queries have all ended is not read again.
        going, ended, n_asked = state.agg(F.sum("open"), F.count_if(F.col("open") == 0), F.sum(F.length("query") / 4)).first()
        if ended:
            over.append(state.filter("open = 0"))
        if not going:
            return reduce(DataFrame.unionByName, over or [state]).mapInArrow(ends, "query int, node int, sim float")
        left, near = state.filter("open > 0"), around
        # A hop costs the reading of all links, so the last queries expand all that they have open.
        most = width if going < FIRST * n_asked else width // 4
        asks = each(left, partial(ask, most=most), "node binary, query binary, worst binary, q binary")
        if going < n_parts:
            asks = ws.keep(asks, "asks")
            near = around.filter(F.col("part").isin([r["part"] for r in asks.select("part").distinct().collect()]))
        found = met(asks, near, answer, "query binary, node binary, s binary")
        new = ws.keep(met(found, left, partial(absorb, most=most), BEAMS), "beams")
        if not ended:
            ws.drop(state)
        state = new


def compare_all(asked: DataFrame, vectors: DataFrame, n_asked: int) -> DataFrame:
    """(query, node, sim): the best ``RERANK`` of all nodes for every query of (query, qq), a block of queries at a time."""
    blocks = -(-n_asked // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    queries = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query", "qq")).alias("asked"))
    spread = vectors.select("node", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    part = F.pmod(F.xxhash64("node"), F.lit(1024)).cast("int")

    def nearer(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        rows = pdf["asked"].iloc[0]
        head, x = parts(list(pdf["q"]))
        _, y = parts([r["qq"] for r in rows])
        s = (y @ x.T) * head[:, 0]
        k = min(RERANK, len(ids))
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"query": np.repeat([r["query"] for r in rows], k), "node": ids[at].ravel(), "sim": np.take_along_axis(s, at, 1).ravel()})

    found = spread.withColumn("part", part).join(queries, "block").groupBy("block", "part").applyInPandas(nearer, "query int, node int, sim float")
    return top(found, "query", RERANK, F.desc("sim"), "node").select("query", "node", "sim")


def nearest(
    rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest of each row whose identifier ``every`` divides: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    try:
        # The graph is shuffled again and again; what one job has shuffled no other reads.
        spark.conf.set(CLEAN_UP, "true")
        return _nearest(rows, every, k, id_col, vector_col)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def _nearest(rows: DataFrame, every: int, k: int, id_col: str, vector_col: str) -> DataFrame:
    spark = rows.sparkSession
    ws = Workspace(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    good = ws.keep(usable(rows, id_col, vector_col), "usable")
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    good = good.filter(F.size("v") == dim)
    folded = good.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    n_parts = max(1, -(-dims["c"] // PART), min(64, dims["c"] // 256))
    part = F.pmod(F.xxhash64("first"), F.lit(n_parts)).cast("int")
    slot = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    numbered = folded.withColumn("part", part).withColumn("node", F.shiftleft("part", SLOT_BITS) + slot)
    nodes = ws.keep(numbered.select("node", "v", "first", "copies"), "nodes")
    # Of equal vectors only the k + 1 smallest identifiers can be among the nearest.
    copies = good.join(nodes.filter("copies > 1").select("v", "node"), "v").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = copies.withColumn("_r", F.row_number().over(Window.partitionBy("node", "salt").orderBy("id"))).filter(F.col("_r") <= k + 1)
    alike = top(some.select("node", "id"), "node", k + 1, "id").select("node", "id")
    members = ws.keep(nodes.filter("copies = 1").select("node", F.col("first").alias("id")).unionByName(alike), "members")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = nodes.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    n = stats["n"]
    vectors = ws.keep(quantised(nodes, stats["norm"], dim), "vectors")
    blocks = ws.keep(blocked(vectors), "blocks")
    wanted = good.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v")
    owners = ws.keep(wanted.join(nodes.select("v", "node"), "v").select(F.col("id").alias("query_id"), "node", "v"), "owners")
    queries = ws.keep(owners.select(F.col("node").alias("query")).distinct(), "queries")
    links = f"ann_links_{uuid.uuid4().hex}"
    try:
        around = build_graph(vectors, blocks, n, n_parts, dim, ws, links)
        beam = ws.keep(greedy_search(queries, around, blocks, n, n_parts, dim, ws).select("query", "node"), "best")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {links}")
    short = ws.keep(beam.groupBy("query").agg(F.count("*").alias("found")).filter(F.col("found") < min(RERANK, n)).select("query"), "short")
    if n_short := short.count():
        asked = short.join(vectors, F.col("query") == F.col("node")).select("query", F.col("q").alias("qq"))
        rest = compare_all(asked, vectors, n_short).select("query", "node")
        beam = beam.join(short, "query", "left_anti").unionByName(rest)
    near = ws.keep(beam, "near")

    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = (
        owners.withColumnRenamed("node", "query").join(near, "query")
        .join(nodes.select("node", F.col("v").alias("w")), "node")
        .select("query_id", "node", dot.alias("score"))
    )
    answers = exact.join(members, "node").filter("id != query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
