"""Near-duplicate groups by SetSketch registers, banded, estimated and verified.

A document is the set of its word shingles. Each of ``REGISTERS`` registers keeps
the smallest exponential hash of the set, truncated to exponentially spaced
levels, so registers of parts merge by maximum and two sets agree in a register
with a probability near their similarity. Equal sets are first folded into
one class. Bands of ``BAND`` registers deal classes to buckets.

1. A bucket proposes each member with its smallest member: a star, not all
   pairs. Each class tries its likeliest proposal, judged by the joint
   likelihood of the registers given both set sizes, and the link is verified
   on the full sets. Linked classes are joined into components.
2. Only pairs that share a bucket and are still in different components can add
   anything. Such a bucket's smallest component label is its centre, and each
   member meets the centre once, not its bucket mates: a member is written as
   its difference from the centre, the centre's shingles that it lacks and its
   own that the centre lacks. From differences to one centre the similarity of
   any two members is exact, so blocks of members are compared by counting,
   and only one link per member and component leaves a block.

The estimate only ranks proposals and drops those far below the limit, which
step 2 takes up again; two sets at the limit of 0.8 share no band with
probability under 1e-7.
Components grow by smallest labels over written tables, never on the driver.

Cases: null and empty texts, and texts without words, have no shingles and
link to nothing. A text with fewer words than a shingle is one shingle. Rows
that repeat an identifier are one node. A null identifier is a row of its own
without component (null), kept. An empty table gives no rows. Very long texts
are whole sets. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytestext import lean, mixed, prefix_sums, span_hashes, text_bytes, word_spans
from .workspace import Workspace, unused_names

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
LEVELS = (1 << 16) - 2
LEAST_ESTIMATE = 0.6
SIMILARITY_PERCENT = 80
SLICE_BYTES = 1 << 20
PART_ROWS = 1 << 14
HOT_KEYS = 1 << 12
"""A key with over ``PART_ROWS`` rows and over one in ``HOT_KEYS`` of a join's rows is dealt to parts."""

_RNG = np.random.default_rng(10)
_MULTIPLY = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_UP = np.arange(256, dtype=np.uint8)
_UP[65:91] += 32


def shingle_hashes(buffer: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]], sorted."""
    starts, ends, owner = word_spans(buffer, offsets)
    n_texts = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    w = span_hashes(prefix_sums(buffer), starts, ends)
    counts = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(w), np.uint64)
        length = np.minimum(words, (first + counts)[owner] - np.arange(len(w)))
        for k in range(words):
            inside = length > k
            rolled[inside] = mixed(rolled[inside] * np.uint64(0x9E3779B97F4A7C15) + w[np.flatnonzero(inside) + k])
    # A shingle starts where enough words follow, or at the first word of a short text.
    whole = (length == words) | ((np.arange(len(w)) == first[owner]) & (counts[owner] < words))
    h, own = rolled[whole], owner[whole]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n_texts))])


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of one set, as unsigned 16-bit levels; more of an element's set never lowers one."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            h = hashes[at : at + 1024, None] * _MULTIPLY + _ADD
            np.minimum(low, (h ^ (h >> np.uint64(29))).min(0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likeliest_similarity(up: np.ndarray, down: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Similarity that maximises the likelihood of ``up`` larger and ``down`` smaller registers, for sets of n1 and n2.

    With u = n1 / (n1 + n2) and v = 1 - u, a register of the first exceeds the
    second's with probability p(u - vJ), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    u = n1 / (n1 + n2)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)[None, :] * top[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    same = REGISTERS - up - down
    tiny = 1e-12
    score = up[:, None] * np.log(a + tiny) + down[:, None] * np.log(b + tiny) + same[:, None] * np.log(np.maximum(1 - a - b, 0) + tiny)
    return np.take_along_axis(grid, score.argmax(1)[:, None], 1)[:, 0]


def _slices(texts: pa.Array):
    """(first, last, lower-cased bytes, offsets) of runs of texts of a bounded size."""
    buffer, offsets = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, last, _UP[buffer[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        first = last


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, hi, lo, regs): set size, two sums that identify the set, registers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buffer, offsets in _slices(batch.column(1)):
                h, bounds = shingle_hashes(buffer, offsets, words)
                n = np.diff(bounds)
                regs = [registers(h[a:b]).astype(">u2").tobytes() if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mixed(h), mixed(h ^ np.uint64(0xD1B54A32D192ED03)))]
                    hi, lo = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(regs, pa.binary())],
                    ["doc_id", "n", "hi", "lo", "regs"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n long, hi long, lo long, regs binary")


def band_keys(regs: Column) -> Column:
    size = 2 * BAND
    return F.array(
        *[F.xxhash64(F.lit(k), F.substring(regs, k * size + 1, size)) for k in range(REGISTERS // BAND)]
    )


def estimated(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb, ra, rb) with ``likely``, registers dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            ra, rb = (np.frombuffer(b"".join(cols[c].to_pylist()), ">u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (cols[c].to_numpy().astype(np.float64) for c in ("na", "nb"))
            likely = likeliest_similarity((ra > rb).sum(1), (ra < rb).sum(1), na, nb)
            yield pa.RecordBatch.from_arrays([cols["a"], cols["b"], pa.array(likely)], ["a", "b", "likely"])

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lean(run), "a long, b long, likely double")


def hot_keys(counts: DataFrame, keys: list[str], total: int, ws: Workspace) -> DataFrame:
    """(keys, parts) of the keys that hold many rows, from ``counts`` (keys, n); fewer than ``HOT_KEYS`` by construction."""
    hot = counts.filter((F.col("n") > PART_ROWS) & (F.col("n") * HOT_KEYS > total))
    return ws.keep(hot.select(*keys, F.ceil(F.col("n") / PART_ROWS).alias("parts")), "hot")


def hot_centres(pairs: DataFrame, key: str, ws: Workspace) -> DataFrame:
    return hot_keys(pairs.groupBy(key).agg(F.count("*").alias("n")), [key], pairs.count(), ws)


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], other: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has a key once: a hot key's rows are dealt by ``other``, its ``side`` row goes to each part."""
    hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    copies = side.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(copies, [*keys, "part"], how).drop("part")


def with_registers(pairs: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs whose sizes allow the similarity, with both sides' registers."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    met = join_hot(pairs, left, ["a"], "b", hot_centres(pairs, "a", ws)).join(right, "b")
    return met.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY_PERCENT)


def full_sets(wanted: DataFrame, docs: DataFrame, words: int, ws: Workspace, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the sorted shingle set of each wanted document; other texts are not read into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buffer, offsets in _slices(batch.column(1)):
                h, bounds = shingle_hashes(buffer, offsets, words)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), sets], ["id", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ws.keep(texts.join(wanted, "id", "left_semi").mapInArrow(lean(run), "id long, s array<long>"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, words: int, ws: Workspace, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The pair travels with one set to the other's, so memory holds two sets at a time.
    """
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, words, ws, id_col, text_col)
    one = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common * 100 >= (F.size("sa") + F.size("sb") - common) * SIMILARITY_PERCENT
    met = join_hot(pairs.select("a", "b").join(one, "b"), two, ["a"], "b", hot_centres(pairs, "a", ws))
    links = ws.keep(met.filter(alike).select("a", "b"), "links")
    ws.drop(sets)
    return links


def differences(pairs: DataFrame, docs: DataFrame, words: int, ws: Workspace, id_col: str, text_col: str) -> DataFrame:
    """``pairs`` (x, c, ...) with ``nc``, ``nx``, ``lacks`` (places in c's sorted set) and ``adds`` (own shingles)."""
    sets = full_sets(pairs.select(F.explode(F.array("x", "c")).alias("id")).distinct(), docs, words, ws, id_col, text_col)
    mine = sets.select(F.col("id").alias("x"), F.col("s").alias("sx"))
    centre = sets.select(F.col("id").alias("c"), F.col("s").alias("sc"))
    met = join_hot(pairs.join(mine, "x"), centre, ["c"], "x", hot_centres(pairs, "c", ws))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sx, sc = part.column(len(names)), part.column(len(names) + 1)
                lacks, adds, nx, nc = [], [], [], []
                for k in range(part.num_rows):
                    own = sx[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    other = sc[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    lacks.append(np.flatnonzero(~np.isin(other, own, assume_unique=True)).astype("<u4").tobytes())
                    adds.append(own[~np.isin(own, other, assume_unique=True)].astype("<u8").tobytes())
                    nx.append(len(own))
                    nc.append(len(other))
                cols = [*part.columns[: len(names)], pa.array(nx, pa.int64()), pa.array(nc, pa.int64()), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "nx", "nc", "lacks", "adds"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema], "nx long, nc long, lacks binary, adds binary"])
    out = ws.keep(met.select(*names, "sx", "sc").mapInArrow(lean(run), schema), "differences")
    ws.drop(sets)
    return out


def incidence(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 matrix of which sorted column values each row has."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(columns, r)
        at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == r)] if len(columns) else at[:0]
        out[i, at] = 1
    return out


def compare_block(table: pa.Table) -> pa.Table:
    """Links (a, b) between the A members of a block and all its members, one for each label that a member meets.

    Members x and y share nc - |lacks of either| shingles of the centre, and
    those of their own that both add.
    """
    side = np.array(table.column("is_a").to_pylist())
    ids, label, nx = (table.column(c).to_numpy() for c in ("x", "label", "nx"))
    nc = int(table.column("nc")[0].as_py())
    lacks = [np.frombuffer(v, "<u4") for v in table.column("lacks").to_pylist()]
    adds = [np.frombuffer(v, "<u8") for v in table.column("adds").to_pylist()]
    first, second = np.flatnonzero(side), np.flatnonzero(~side)
    out_a, out_b = [], []
    width = max(16, min(1024, (4 << 20) // max(nc, 1)))
    for lo in range(0, len(first), width):
        mine = first[lo : lo + width]
        places = np.unique(np.concatenate([lacks[i] for i in mine])) if len(mine) else np.zeros(0, np.uint32)
        own = np.unique(np.concatenate([adds[i] for i in mine]))
        met: set[tuple[int, int]] = set()
        for at in range(0, len(second), width):
            theirs = second[at : at + width]
            size_x, size_y = nx[mine][:, None], nx[theirs][None, :]
            missing = incidence([lacks[i] for i in mine], places) @ incidence([lacks[i] for i in theirs], places).T
            n_x, n_y = (np.array([len(lacks[i]) for i in part]) for part in (mine, theirs))
            common = nc - n_x[:, None] - n_y[None, :] + missing
            for k in range(0, len(own), 8192):
                columns = np.intersect1d(own[k : k + 8192], np.concatenate([adds[i] for i in theirs])) if len(theirs) else own[:0]
                if len(columns):
                    common += incidence([adds[i] for i in mine], columns) @ incidence([adds[i] for i in theirs], columns).T
            common = np.rint(common).astype(np.int64)
            alike = (common * 100 >= (size_x + size_y - common) * SIMILARITY_PERCENT) & (label[mine][:, None] != label[theirs][None, :])
            for i, j in zip(*np.nonzero(alike)):
                key = (int(i), int(label[theirs[j]]))
                if key not in met:
                    met.add(key)
                    out_a.append(int(ids[mine[i]]))
                    out_b.append(int(ids[theirs[j]]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


A_BLOCK, B_BLOCK = 512, 4096
BLOCK_BYTES = 8 << 20
"""Members, and bytes of their differences, that one side of a group of blocks holds on average."""


def links_across(members: DataFrame, ws: Workspace) -> DataFrame:
    """Links between members (x, c, label, nx, nc, lacks, adds) of a centre with different labels.

    A members are those outside the centre's commonest label; two members of
    that label have nothing to find. A and all members are cut into blocks by hash, so
    many that a block is bounded in members and in bytes, and each pair of
    blocks is a group.
    """
    size = F.sum(F.octet_length("lacks") + F.octet_length("adds")).alias("b")
    per_label = members.groupBy("c", "label").agg(F.count("*").alias("n"), size)
    sums = per_label.groupBy("c").agg(
        F.max_by(F.struct("label", "n", "b"), F.struct("n", -F.col("label"))).alias("most"), F.sum("n").alias("n_all"), F.sum("b").alias("b_all")
    )

    def parts(n: Column, b: Column, most: int) -> Column:
        return F.greatest(F.ceil(n / most), F.ceil(b / BLOCK_BYTES), F.lit(1))

    n_a, b_a = F.col("n_all") - F.col("most.n"), F.col("b_all") - F.col("most.b")
    cut = sums.filter(n_a > 0).select(
        "c", F.col("most.label").alias("main"), parts(n_a, b_a, A_BLOCK).alias("p"), parts(F.col("n_all"), F.col("b_all"), B_BLOCK).alias("q")
    )
    main = ws.keep(cut, "main")
    known = members.join(main, "c")
    h = F.xxhash64("x")
    a = known.filter("label != main").withColumn("i", F.pmod(h, F.col("p"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    b = known.withColumn("j", F.pmod(h, F.col("q"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    columns = ["c", "i", "j", "x", "label", "nx", "nc", "lacks", "adds"]
    both = a.select(*columns, F.lit(True).alias("is_a")).unionByName(b.select(*columns, F.lit(False).alias("is_a")))
    found = both.groupBy("c", "i", "j").applyInArrow(compare_block, "a long, b long")
    return ws.keep(found, "across")


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes of some link.

    Large stars and small stars in turn: each node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones, until nothing
    changes. The rounds grow with the logarithm of the longest path.
    """
    edges = ws.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        # A hub's neighbours are met through a join, so its list is never held in one place.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    before = None
    while True:
        grown = ws.keep(star(edges, True), "large")
        new = ws.keep(star(grown, False), "small")
        ws.drop(grown)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        ws.drop(edges)
        edges = new
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, class_id, component_id, kept."""
    ws = Workspace(docs.sparkSession, "neardup")
    sketched = ws.keep(sketch(docs, words, id_col, text_col), "sketch")
    real = sketched.filter("n > 0 and doc_id is not null")
    narrow = ws.keep(real.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "narrow")
    classes = ws.keep(
        real.join(narrow.select(F.col("n").alias("cn"), F.col("hi").alias("ch"), F.col("lo").alias("cl"), "rep"),
                  F.expr("doc_id = rep and n = cn and hi = ch and lo = cl"))
        .select("rep", "n", "regs").dropDuplicates(["rep", "n", "regs"]),
        "classes",
    )
    members = ws.keep(classes.select("rep", F.explode(band_keys(F.col("regs"))).alias("band")), "members")
    buckets = ws.keep(
        members.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high"), "buckets"
    )
    hot_bands = hot_keys(buckets, ["band"], members.count(), ws)
    shared = ws.keep(join_hot(members, buckets.drop("n"), ["band"], "rep", hot_bands), "shared")
    ws.drop(members)
    ws.drop(buckets)
    proposals = ws.keep(shared.filter("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "proposals")
    judged = estimated(with_registers(proposals, classes, ws)).filter(F.col("likely") >= LEAST_ESTIMATE)
    tried = ws.keep(
        judged.groupBy("b").agg(F.max_by("a", F.struct("likely", -F.col("a"))).alias("a")).select("a", "b"), "tried"
    )
    first = verified(tried, docs, words, ws, id_col, text_col)
    found = ws.keep(components(first, ws), "first")

    # What is left: members of a bucket in different components.
    labelled = ws.keep(
        shared.select("rep", "band").join(found, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("label", "rep").alias("label")),
        "labelled",
    )
    ws.drop(shared)
    torn = ws.keep(
        labelled.groupBy("band").agg(F.min("label").alias("c"), F.max("label").alias("y")).filter("c < y").select("band", "c"), "torn"
    )
    meeting = ws.keep(join_hot(labelled, torn, ["band"], "rep", hot_bands).select(F.col("rep").alias("x"), "c", "label").distinct(), "meeting")
    second = links_across(differences(meeting, docs, words, ws, id_col, text_col), ws)
    links = first.unionByName(second)
    final = ws.keep(components(links, ws), "components")

    keyed = sketched.select("doc_id", "n", "hi", "lo")
    sets = ["n", "hi", "lo"]
    many = narrow.select(F.col("n").alias("size"), "hi", "lo", F.col("copies").alias("n"))
    hot_sets = hot_keys(many, ["size", "hi", "lo"], sketched.count(), ws).withColumnRenamed("size", "n")
    with_class = ws.keep(join_hot(keyed, narrow.drop("copies"), sets, "doc_id", hot_sets, "left"), "with-class")
    named = F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("label", "rep", "doc_id"))
    return with_class.join(final, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(named, F.coalesce("rep", "doc_id")).alias("class_id"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one identifier of each group, rows without identifier all.

    Identifiers are what is judged: of rows that repeat one, all stay or all go.
    """
    ws = Workspace(docs.sparkSession, "neardup-keep")
    found = near_duplicates(docs, words, id_col, text_col)
    (lost_id,) = unused_names(docs, "lost_id")
    lost = ws.keep(found.filter(~F.col("kept")).select(F.col("doc_id").alias(lost_id)).distinct(), "lost")
    return docs.join(lost, F.col(id_col).cast("long") == F.col(lost_id), "left_anti")
