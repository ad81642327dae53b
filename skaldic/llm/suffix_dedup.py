"""Removal of repeated substrings through enhanced suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller identifier. The strings are judged on the input.

Equal texts are folded first: a copy's strings all start in its smallest
document. The distinct texts are dealt by hash to cells of bounded size, a
bucketed table that the later steps read without moving text.

Every string of ``LENGTH`` bytes is assigned to an anchor within it: of its
``ANCHOR``-byte substrings the one with the smallest hash. Equal strings have
equal anchors, and the strings of one anchor occurrence are neighbours, so they
are the suffixes, long enough, of one short context.

1. Cells send the hashes of their anchors, each once, to shards; a shard
   answers with those that lie in more than one document.
2. Cells send the contexts of those anchors, each distinct one once with the
   smallest identifier that has it. A shard builds the suffix array of its
   contexts with the longest common prefixes, scans the intervals of common
   prefixes of ``LENGTH`` bytes or more with a stack, and tests whether the
   bytes to the left differ. Intervals that pass are groups of maximal repeats
   with all their occurrences. A context whose anchor has no other context is
   an interval by itself.
3. Shards answer to each context with the repeats in it and the smallest
   identifier of each group; cells lay them on all occurrences of the context.

A shard meets a context once per cell, however many documents repeat it, so
hot passages are met by as many rows as there are cells. A cell writes a row for
each shard that it has anchors for, at most one an anchor. Contexts are told apart by two independent
64-bit hashes, suffixes by their bytes; an anchor's hash only says where to look.
The cells are a bucketed table, with a bucket for each cell as long as Spark allows
so many, else with several cells a bucket; it is dropped also when a step fails.

Cases: null text is empty. A row without identifier is never a smaller document and loses
nothing. Rows that repeat an identifier are judged against smaller ones only.
Of equal strings those of the smallest identifier stay, however often it has them.
Texts under ``LENGTH`` bytes lose nothing. Very long texts are read whole, a text at a time. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .bytestext import prefix_sums, span_hashes, text_bytes
from .workspace import Workspace

LENGTH = 50
ANCHOR = 24
WINDOW = LENGTH - ANCHOR + 1
CELL_BYTES = 16 << 20
SHARD_BYTES = 12 << 20
"""Bytes of text whose anchors make a shard."""
SLICE_BYTES = 1 << 20
LONGEST = LENGTH + WINDOW - 1
NOBODY = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def anchors(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, owner, context hash) of each anchor's context within its text.

    The strings that start in [start, end - LENGTH] have this anchor.
    """
    n = len(buffer)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    sums = prefix_sums(buffer)
    at = np.arange(n - ANCHOR + 1)
    value = span_hashes(sums, at, at + ANCHOR)
    low, where, width = value, np.arange(len(value), dtype=np.int32), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        left, right = low[:-step], low[step:]
        later = right < left
        low = np.where(later, right, left)
        where = np.where(later, where[step:], where[:-step])
        width += step
    starts = np.arange(n - LENGTH + 1)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + LENGTH <= offsets[owner + 1]
    starts, owner, where = starts[inside], owner[inside], where[: n - LENGTH + 1][inside]
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + LENGTH
    return value[where[first]], begin, end, owner[first], span_hashes(sums, begin, end)


# Odd multipliers of two sums over words of four bytes; their high halves are independent of the first hash.
_MULTIPLIERS = np.random.default_rng(8).integers(0, 1 << 63, (2, LONGEST // 4 + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(n, LONGEST) bytes from each beginning, zeros from ``size`` on; ``flat`` goes on for ``LONGEST`` bytes after the last."""
    rows = np.lib.stride_tricks.sliding_window_view(flat, LONGEST)[begin]
    rows *= np.arange(LONGEST) < size[:, None]
    return rows


def bodies(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of contexts within a buffer."""
    return windows(np.concatenate([buffer, np.zeros(LONGEST, np.uint8)]), begin, size)


def second_hashes(size: np.ndarray, body: np.ndarray) -> np.ndarray:
    """A hash of each context from its bytes, independent of the first: both together tell contexts apart."""
    words = np.ascontiguousarray(body).view("<u4")
    one, two = (size.astype(np.uint64) * m[-1] for m in _MULTIPLIERS)
    for k in range(words.shape[1]):
        word = words[:, k].astype(np.uint64)
        one += word * _MULTIPLIERS[0][k]
        two += word * _MULTIPLIERS[1][k]
    return (one >> np.uint64(32) << np.uint64(32)) | (two >> np.uint64(32))


def first_of_each(context: np.ndarray, check: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows by context, smallest identifier first; ``new`` marks a context's first row."""
    order = np.lexsort((who, check, context))
    new = np.ones(len(order), bool)
    new[1:] = (context[order][1:] != context[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, new


def slices(table: pa.Table):
    """(first row, buffer, offsets) of runs of texts of a bounded size."""
    texts = table.column("body").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
    buffer, offsets = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, buffer[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


_SENT = [("shard", pa.int64()), ("cell", pa.int64()), ("blob", pa.binary())]
SENT = "shard long, cell long, blob binary"
_BACK = [("cell", pa.int64()), ("blob", pa.binary())]
BACK = "cell long, blob binary"


def _by_shard(keys: np.ndarray, n_shards: int):
    """(shard, rows of that shard) of sorted order by shard."""
    shard = (keys >> np.uint64(11)) % np.uint64(n_shards)
    order = np.argsort(shard, kind="stable")
    held = shard[order]
    edges = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else []
    for lo, hi in zip(edges, [*edges[1:], len(held)]):
        yield int(held[lo]), order[lo:hi]


def send_anchors(table: pa.Table, n_shards: int) -> pa.Table:
    """Each anchor of a cell once; the lowest bit tells whether two of its texts have it."""
    cell = table.column("cell")[0].as_py()
    values, owners = [], []
    for first, buffer, offsets in slices(table):
        value, _, _, owner, _ = anchors(buffer, offsets)
        values.append(value)
        owners.append(owner + first)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(value)) - 1 if len(value) else begin
    several = owner[begin] != owner[end]
    distinct = value[begin]
    rows = []
    for shard, at in _by_shard(distinct, n_shards):
        held = distinct[at]
        deltas = np.diff(held, prepend=np.uint64(0))
        # Bytes of equal weight together compress best.
        planes = deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()
        rows.append((shard, cell, _pack(planes, np.packbits(several[at]))))
    return _rows(_SENT, rows)


def _sent_values(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(_unpack(blob), np.uint8)
    n = len(raw) * 8 // 65
    while 8 * n + (n + 7) // 8 < len(raw):
        n += 1
    planes = raw[: 8 * n].reshape(8, n)
    values = np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)
    return values, np.unpackbits(raw[8 * n :], count=n).astype(bool)


def find_shared(table: pa.Table) -> pa.Table:
    """For each cell its anchors that lie in more than one text."""
    cells = table.column("cell").to_pylist()
    got = [_sent_values(b) for b in table.column("blob").to_pylist()]
    value = np.concatenate([v for v, _ in got])
    order = np.argsort(value, kind="stable")
    held = value[order]
    same = held[1:] == held[:-1]
    shared = np.zeros(len(held), bool)
    shared[1:] |= same
    shared[:-1] |= same
    flag = np.empty(len(held), bool)
    flag[order] = shared
    rows, at = [], 0
    for cell, (v, several) in zip(cells, got, strict=True):
        mine = v[flag[at : at + len(v)] | several]
        at += len(v)
        if len(mine):
            rows.append((cell, _pack(mine)))
    return _rows(_BACK, rows)


def send_contexts(table: pa.Table, shared: pa.Table, n_shards: int) -> pa.Table:
    """Each distinct context of a shared anchor once, with the smallest identifier that has it."""
    if not table.num_rows or not shared.num_rows:
        return _rows(_SENT, [])
    cell = table.column("cell")[0].as_py()
    wanted = np.sort(np.concatenate([np.frombuffer(_unpack(b), np.uint64) for b in shared.column("blob").to_pylist()]))
    least = table.column("least").to_numpy()
    found: list[list[np.ndarray]] = []
    for first, buffer, offsets in slices(table):
        value, begin, end, owner, context = anchors(buffer, offsets)
        at = np.searchsorted(wanted, value)
        hit = wanted[np.minimum(at, len(wanted) - 1)] == value
        value, begin, end, owner, context = (x[hit] for x in (value, begin, end, owner, context))
        if not len(value):
            continue
        who, size = least[owner + first], end - begin
        body = bodies(buffer, begin, size)
        check = second_hashes(size, body)
        order, new = first_of_each(context, check, who)
        pick = order[new]
        found.append([x[pick] for x in (value, context, check, who, size, body)])
    if not found:
        return _rows(_SENT, [])
    value, context, check, who, size, body = (np.concatenate(x) for x in zip(*found, strict=True))
    order, new = first_of_each(context, check, who)
    order = order[new]
    value, context, who, size, body = (x[order] for x in (value, context, who, size, body))
    rows = []
    for shard, at in _by_shard(value, n_shards):
        mask = np.arange(LONGEST) < size[at][:, None]
        head = np.array([len(at)], np.int64)
        rows.append((shard, cell, _pack(head, value[at], context[at], who[at], size[at].astype(np.uint8), body[at][mask])))
    return _rows(_SENT, rows)


def _contexts(blob: bytes):
    raw = _unpack(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    value = np.frombuffer(raw, np.uint64, n, 8)
    context = np.frombuffer(raw, np.uint64, n, 8 + 8 * n)
    who = np.frombuffer(raw, np.int64, n, 8 + 16 * n)
    size = np.frombuffer(raw, np.uint8, n, 8 + 24 * n).astype(np.int64)
    flat = np.frombuffer(raw, np.uint8, offset=8 + 25 * n)
    body = np.zeros((n, LONGEST), np.uint8)
    body[np.arange(LONGEST) < size[:, None]] = flat
    return value, context, who, size, body


class EnhancedSuffixArray:
    """Suffixes of at least ``LENGTH`` bytes of short contexts, sorted, with common prefix lengths and left bytes."""

    def __init__(self, size: np.ndarray, body: np.ndarray):
        per = size - LENGTH + 1
        self.text = np.repeat(np.arange(len(size)), per)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        length = size[self.text] - self.place
        wide = np.zeros((len(size) + 1, 2 * LONGEST), np.uint8)
        wide[:-1, :LONGEST] = body
        rows = windows(wide.ravel(), 2 * LONGEST * self.text + self.place, length)
        # Zero bytes of a text and those beyond its end sort alike; the common prefix looks at the lengths.
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{LONGEST}").ravel(), kind="stable")
        self.text, self.place, length, rows = self.text[order], self.place[order], length[order], rows[order]
        same = rows[1:] == rows[:-1]
        lcp = np.where(same.all(1), LONGEST, (~same).argmax(1))
        lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
        #: lcp[i] is that of suffixes i - 1 and i; zeros close the scan.
        self.lcp = np.concatenate([[0], lcp, [0]]).astype(np.int64)
        left = body[self.text, np.maximum(self.place - 1, 0)].astype(np.int64)
        # What stands before a context is another anchor's: unlike anything.
        self.left = np.where(self.place > 0, left, -1)

    def maximal_repeats(self, least: int = LENGTH):
        """(length, first, last) of the intervals of common prefix ``length`` >= ``least`` whose left bytes differ.

        ``change[i]`` counts where neighbouring left bytes differ, so an
        interval's diversity is a difference of two counts.
        """
        lcp, left = self.lcp.tolist(), self.left
        differs = np.ones(len(left), np.int64)
        if len(left):
            differs[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
        change = np.cumsum(differs).tolist()
        unknown = (left < 0).tolist()
        hot = np.flatnonzero(self.lcp >= least).tolist()
        stack: list[tuple[int, int]] = []
        at = 0
        while at < len(hot):
            i = hot[at]
            stack.append((lcp[i], i - 1))
            i += 1
            while stack:
                now = lcp[i]
                begin = i - 1
                while stack and stack[-1][0] > now:
                    length, begin = stack.pop()
                    if change[i - 1] > change[begin] or unknown[begin]:
                        yield length, begin, i - 1
                if now >= least and (not stack or stack[-1][0] < now):
                    stack.append((now, begin))
                if now < least:
                    stack.clear()
                    break
                i += 1
            while at < len(hot) and hot[at] < i:
                at += 1


def find_repeats(table: pa.Table) -> pa.Table:
    """For each cell: (context, place, length, smallest identifier) of the repeats in its contexts."""
    cells = table.column("cell").to_numpy()
    got = [_contexts(b) for b in table.column("blob").to_pylist()]
    source = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    value, context, who, size, body = (np.concatenate(x) for x in zip(*got, strict=True))
    del got, table
    # Contexts met from several cells are one text of the array.
    check = second_hashes(size, body)
    order, new = first_of_each(context, check, who)
    pick = order[new]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    kinds = len(pick)
    value_k, who_k, size_k = value[pick], who[pick], size[pick]
    _, inverse, count = np.unique(value_k, return_inverse=True, return_counts=True)
    alone = count[inverse] == 1
    # (kind, place, length, smallest identifier) of each occurrence of a repeat.
    marks = [np.column_stack([np.flatnonzero(alone), np.zeros(int(alone.sum()), np.int64), size_k[alone], who_k[alone]])]
    mixed_kinds = np.flatnonzero(~alone)
    if len(mixed_kinds):
        # Anchors are kept whole while the array is built over a bounded number of contexts.
        by_anchor = mixed_kinds[np.argsort(inverse[mixed_kinds], kind="stable")]
        group = inverse[by_anchor]
        lo = 0
        while lo < len(by_anchor):
            hi = min(lo + 20_000, len(by_anchor))
            while hi < len(by_anchor) and group[hi] == group[hi - 1]:
                hi += 1
            part = by_anchor[lo:hi]
            array = EnhancedSuffixArray(size_k[part], body[pick[part]])
            owner, place = part[array.text], array.place
            holder = who_k[owner]
            for length, first, last in array.maximal_repeats():
                rows = slice(first, last + 1)
                smallest = holder[rows].min()
                n = last + 1 - first
                marks.append(np.column_stack([owner[rows], place[rows], np.full(n, length), np.full(n, smallest)]))
            # What a context has beyond its repeats is still its own, for occurrences in larger documents.
            marks.append(np.column_stack([part, np.zeros(len(part), np.int64), size_k[part], who_k[part]]))
            lo = hi
    mark = np.concatenate(marks)
    mark = mark[np.argsort(mark[:, 0], kind="stable")]
    begin = np.searchsorted(mark[:, 0], np.arange(kinds))
    end = np.searchsorted(mark[:, 0], np.arange(kinds), side="right")
    rows = []
    for k, cell in enumerate(cells.tolist()):
        mine = np.arange(np.searchsorted(source, k), np.searchsorted(source, k, side="right"))
        own = kind[mine]
        n = end[own] - begin[own]
        take = np.repeat(begin[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        m = mark[take]
        head = np.array([len(m)], np.int64)
        key, second = np.repeat(context[mine], n), np.repeat(check[mine], n)
        rows.append((cell, _pack(head, key, second, m[:, 3].astype(np.int64), m[:, 1].astype(np.uint8), m[:, 2].astype(np.uint8))))
    return _rows(_BACK, rows)


def _marks(blob: bytes):
    raw = _unpack(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return (
        np.frombuffer(raw, np.uint64, n, 8),
        np.frombuffer(raw, np.uint64, n, 8 + 8 * n),
        np.frombuffer(raw, np.int64, n, 8 + 16 * n),
        np.frombuffer(raw, np.uint8, n, 8 + 24 * n).astype(np.int64),
        np.frombuffer(raw, np.uint8, n, 8 + 25 * n).astype(np.int64),
    )


_RESULT = [("cell", pa.int64()), ("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
RESULT = "cell long, digest binary, n_removed long, n_spans long, kept_sha256 string"


def remove_spans(table: pa.Table, marks: pa.Table) -> pa.Table:
    """For each text of a cell what its smallest document loses and the digest of what stays."""
    if not table.num_rows:
        return _rows(_RESULT, [])
    got = [_marks(b) for b in marks.column("blob").to_pylist()] if marks.num_rows else []
    if got:
        key, second, who, place, length = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(key, kind="stable")
        key, second, who, place, length = (x[order] for x in (key, second, who, place, length))
    else:
        key = np.zeros(0, np.uint64)
    least = table.column("least").to_numpy()
    digest, cell = table.column("digest").to_pylist(), table.column("cell")[0].as_py()
    rows = []
    for first, buffer, offsets in slices(table):
        gone = np.zeros(len(buffer) + 1, np.int32)
        if len(key):
            _, begin, end, owner, context = anchors(buffer, offsets)
            lo, hi = np.searchsorted(key, context), np.searchsorted(key, context, side="right")
            hit = hi > lo
            lo, hi, begin, end, owner = (x[hit] for x in (lo, hi, begin, end, owner))
            check = second_hashes(end - begin, bodies(buffer, begin, end - begin))
            n = hi - lo
            take = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            smaller = (who[take] < np.repeat(least[owner + first], n)) & (second[take] == np.repeat(check, n))
            start = (np.repeat(begin, n) + place[take])[smaller]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + length[take][smaller], -1)
        removed = np.cumsum(gone[:-1]) > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        edge = offsets[:-1][offsets[:-1] < len(buffer)]
        opens[edge] |= removed[edge]
        n_removed = np.concatenate([[0], np.cumsum(removed)])
        n_opens = np.concatenate([[0], np.cumsum(opens)])
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            lost = int(n_removed[b] - n_removed[a])
            text = buffer[a:b]
            kept = text[~removed[a:b]] if lost else text
            rows.append((cell, digest[first + i], lost, int(n_opens[b] - n_opens[a]), hashlib.sha256(kept.tobytes()).hexdigest()))
    return _rows(_RESULT, rows)


def judge_cells(cells: DataFrame, n_shards: int, ws: Workspace) -> DataFrame:
    """The three steps between cells and shards."""
    sent = cells.groupBy("cell").applyInArrow(lambda t: send_anchors(t, n_shards), SENT)
    shared = ws.keep(sent.groupBy("shard").applyInArrow(find_shared, BACK), "shared")
    asked = cells.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(lambda a, b: send_contexts(a, b, n_shards), SENT)
    marks = ws.keep(asked.groupBy("shard").applyInArrow(find_repeats, BACK), "marks")
    texts = cells.select("cell", "digest", "least", "body").groupBy("cell")
    return texts.cogroup(marks.groupBy("cell")).applyInArrow(remove_spans, RESULT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), "t"
    )
    narrow = ws.keep(rows.drop("t"), "narrow")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    n_cells, n_shards = max(1, -(-total // CELL_BYTES)), max(1, -(-total // SHARD_BYTES))
    owners = f"suffix_cells_{uuid.uuid4().hex}"
    cell = F.pmod(F.xxhash64("digest"), F.lit(n_cells)).alias("cell")
    buckets = min(int(n_cells), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    try:
        (
            rows.filter(F.col("n_bytes") >= LENGTH)
            .select(cell, "digest", F.coalesce("doc_id", F.lit(int(NOBODY))).alias("doc_id"), F.col("t").cast("binary").alias("body"))
            .repartition(buckets, "cell")
            # Equal texts share a cell, so copies are folded where they arrive.
            .groupBy("cell", "digest")
            .agg(F.min("doc_id").alias("least"), F.first("body").alias("body"))
            .write.bucketBy(buckets, "cell").option("compression", "zstd").format("parquet").saveAsTable(owners)
        )
        judged = ws.keep(judge_cells(spark.table(owners), n_shards, ws), "judged")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {owners}")
    # A row is its text's smallest document or a copy, all of whose strings start in that one.
    first = ws.keep(narrow.groupBy("digest").agg(F.min("doc_id").alias("least")), "first")
    met = narrow.join(first, "digest").join(judged.drop("cell"), "digest", "left")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    lost = F.when(F.col("doc_id").isNull(), 0).when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    nothing = F.sha2(F.lit(""), 256)
    return met.select(
        "doc_id",
        "n_bytes",
        lost.cast("long").alias("n_removed"),
        F.when(F.col("doc_id").isNull(), 0).when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("doc_id").isNull() | F.col("kept_sha256").isNull(), F.lower(F.hex("digest")))
        .when(copy, nothing)
        .otherwise(F.col("kept_sha256"))
        .alias("kept_sha256"),
    )
