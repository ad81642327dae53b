"""Maximal periodic runs of words, found on a harmonic grid.

A run of period q that is at least 2 * q words long covers two neighbouring
multiples of q, and these two words are equal. So for every period q all pairs of
places (k * q, (k + 1) * q) are tried, n / q of them, n log n over all
periods. Pairs of equal words are extended to both sides by a binary search
for the longest common extension, every pair of a slice of texts at once, on
prefix sums of a polynomial hash in numpy. Each extension is a maximal stretch
of that period; the same stretch is also met by multiples of its period and from
every grid point in it, so stretches are deduplicated by their ends and the
smallest period stays, which divides the others.

Every run is verified word for word. A hash can only make an extension too
long, which the verification notices; that text is then searched again with
names of all substrings of power-of-two lengths in place of hashes, which are exact.

Cases: words lie between ASCII white space. Null and empty texts, and texts
of white space alone, have no words and no runs. Very long texts are searched
whole, their pairs in blocks of bounded size. Repeated rows give a result each,
rows without identifier too. Equal runs can't be; runs of equal length are
listed by start, then period. An empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bytestext import lean, mixed

LEAST_WORDS = 12
SLICE_BYTES = 1 << 20
PAIRS = 1 << 20
"""Grid pairs that are looked at together; one period of one text is never split."""
_BASE = 0x9E3779B97F4A7C15

Equal = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def hash_equality(words: np.ndarray, values: Callable[[np.ndarray], np.ndarray] = mixed) -> Equal:
    """equal(i, j, m), i < j: whether the m words from i and from j have one hash. Equal words always do."""
    with np.errstate(over="ignore"):
        powers = np.ones(len(words) + 1, np.uint64)
        np.cumprod(np.full(len(words), _BASE, np.uint64), out=powers[1:])
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values(words.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])

    def equal(i, j, m):
        with np.errstate(over="ignore"):
            return (sums[i + m] - sums[i]) * powers[j - i] == sums[j + m] - sums[j]

    return equal


def name_equality(words: np.ndarray) -> Equal:
    """The same without error: a stretch is two overlapping ones of a power of two, and each of those has a name."""
    names = [words.astype(np.int64)]
    while 2 << (len(names) - 1) <= len(words):
        last, step = names[-1], 1 << (len(names) - 1)
        pairs = last[:-step] * (int(last.max()) + 1) + last[step:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def equal(i, j, m):
        out = np.ones(len(i), bool)
        level = np.frexp(np.maximum(m, 1))[1] - 1
        for k in np.unique(level[m > 0]):
            at = np.flatnonzero((level == k) & (m > 0))
            a, b, late = i[at], j[at], m[at] - (1 << int(k))
            out[at] = (names[k][a] == names[k][b]) & (names[k][a + late] == names[k][b + late])
        return out

    return equal


def _longest(holds: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each place the largest m up to ``most`` for which ``holds(places, m)``, which holds below it too."""
    low, high = np.zeros_like(most), most.copy()
    left = np.flatnonzero(low < high)
    while len(left):
        mid = (low[left] + high[left] + 1) >> 1
        ok = holds(left, mid)
        low[left[ok]] = mid[ok]
        high[left[~ok]] = mid[~ok] - 1
        left = left[low[left] < high[left]]
    return low


def _first_of_ends(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) with distinct ends, each with its smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def stretches(words: np.ndarray, bounds: np.ndarray, equal: Equal, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, end, period) of all texts, text t being words[bounds[t]:bounds[t + 1]]."""
    sizes = np.diff(bounds)
    periods = sizes // 2
    base = np.repeat(bounds[:-1], periods)
    end = np.repeat(bounds[1:], periods)
    period = np.arange(len(base)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    total = np.concatenate([[0], np.cumsum((end - base - 1) // period)])
    out, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(period):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        counts = total[at + 1 : upto + 1] - total[at:upto]
        row = np.repeat(np.arange(at, upto), counts)
        q = period[row]
        i = base[row] + (np.arange(len(row)) - (total[row] - total[at])) * q
        meets = np.flatnonzero(words[i] == words[i + q])
        i, q, lo, hi = i[meets], q[meets], base[row[meets]], end[row[meets]]
        j = i + q
        # A run has at least half of ``least`` matching words around a pair, so some of them on one of its sides.
        near = max(1, least // 4)
        ahead, behind = j + near <= hi, i - near >= lo
        three = np.full(len(i), near)
        ahead[ahead] = equal(i[ahead], j[ahead], three[ahead])
        behind[behind] = equal(i[behind] - near, j[behind] - near, three[behind])
        i, j, q, lo, hi = (x[ahead | behind] for x in (i, j, q, lo, hi))
        forth = _longest(lambda at, m: equal(i[at], j[at], m), hi - j)
        back = _longest(lambda at, m: equal(i[at] - m, j[at] - m, m), i - lo)
        found = np.stack([i - back, j + forth, q], 1)
        out.append(_first_of_ends(found[back + forth + q >= np.maximum(least, 2 * q)]))
        at = upto
    return _first_of_ends(np.concatenate(out))


def runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, values=mixed) -> np.ndarray:
    """Verified rows (start, end, period), by start and period, of texts of word numbers."""
    found = stretches(words, bounds, hash_equality(words, values), least)
    wrong = [s for s, e, q in found.tolist() if not np.array_equal(words[s : e - q], words[s + q : e])]
    if wrong:
        texts = np.searchsorted(bounds, found[:, 0], side="right") - 1
        again = np.unique(np.searchsorted(bounds, wrong, side="right") - 1)
        parts = [found[~np.isin(texts, again)]]
        for t in again:
            own = words[bounds[t] : bounds[t + 1]]
            exact = stretches(own, np.array([0, len(own)]), name_equality(own), least)
            parts.append(exact + np.array([bounds[t], bounds[t], 0]))
        found = np.concatenate(parts)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _slice(ids: pa.Array, texts: list[bytes | None], least: int) -> pa.RecordBatch:
    cut = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in cut for w in ws), np.int64, int(bounds[-1]))
    found = runs(words, bounds, least)
    owner = np.searchsorted(bounds, found[:, 0], side="right") - 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    collapsed = []
    for t, ws in enumerate(cut):
        keep = kept[bounds[t] : bounds[t + 1]]
        collapsed.append(b" ".join(ws if keep.all() else [ws[k] for k in np.flatnonzero(keep)]))
    start = found[:, 0] - bounds[owner] if len(found) else found[:, 0]
    items = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], names=["start", "length", "period"]
    )
    places = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(cut)))]).astype(np.int32)
    columns = [ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(places, pa.int32()), items), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def _search(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                yield _slice(ids[at:upto], texts[at:upto].to_pylist(), least)
                at = upto

    return lean(run)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs, collapsed: a row per row of ``docs``.

    ``runs`` lists (start, length, period) by start and period, of at least
    ``least`` words and two periods. ``collapsed`` has the words that lie in no run after its
    first period, joined by one space. Texts are searched where they are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(_search(least), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", "doc_id")
