"""Best-fit packing of token pieces into sequences, improved by swaps.

A document's ids, closed by an end id, are cut into pieces only where it is
longer than a sequence. Full pieces are sequences of their own. The others are
dealt by hash to shards of a bounded number of pieces; each shard is packed by
best fit, longest first, and then, unless that is already the least number of
sequences its tokens need, by local search: underfull bins, the emptiest first,
are unpacked by moving their pieces into other bins, exchanging a piece for a
shorter one, or for two, of another bin. Every step raises the sum of squared
fills, so the search ends; a bin that runs empty is a sequence saved.

A shard loses at most about one bin against packing all pieces together, so
the number of pieces per shard is a few tens of thousands, not a machine's memory.

Cases: null text counts as empty and is one piece of the end id alone. Rows
that repeat an identifier are pieces of their own; a null identifier stays null.
Very long texts give many pieces. Pieces of equal length are placed by falling
identifier, piece and CRC, each into the bin that was filled last of those with the
same room. An empty table gives no rows. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytestext import lean
from .workspace import Workspace

SEQUENCE = 2048
END_ID = 0
PIECES_PER_SHARD = 32_768
CACHED_WORDS = 120_000
"""Words whose ids a Python worker remembers."""

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"

# White space, printable ASCII and Latin letters in their composed form: here lower-casing is
# letter by letter, composition changes nothing, and a word's ids don't depend on its neighbours.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
_LEADING_LETTERS = re.compile(r"[^\W\d_]*")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo(dict):
    """Word to ids; a missing word is looked up among those of the generation before, or made."""

    def __init__(self, make, before: dict):
        self.make, self.before = make, before

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found


class WordEncoder:
    """Ids of texts by a tokenizer that never merges across white space.

    A text of plain characters is the concatenation of its words' ids, and
    those are remembered, up to a bound: when it is reached, what was not used since it
    last was is forgotten. Any other text, and one that holds an added token's
    literal, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.cached = cached
        self.known = _Memo(self._word, {})

    def _encode(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Its leading letters and the rest, apart: a piece for the merges ends between them.

        Letters alone are one piece, so the model answers without the tokenizer's other steps.
        """
        end = _LEADING_LETTERS.match(word).end()
        if end < len(word):
            rest = self._encode(word) if not end else self.known[word[end:]]
            return self.known[word[:end]] + rest if end else rest
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.cached:
            self.known.before = {}
            self.known = _Memo(self._word, self.known)
        for t in texts:
            if not t:
                yield b""
            elif _PLAIN.match(t) and not self.added.search(t):
                yield b"".join(map(self.known.__getitem__, t.lower().split()))
            else:
                yield self._encode(t)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.uint32(END_ID).astype("<u4").tobytes()
    size = 4 * sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, rows = part.column(0).to_pylist(), []
                for doc, found in zip(ids, enc.encode(part.column(1).to_pylist()), strict=True):
                    whole = found + end
                    for k in range(0, len(whole), size):
                        piece = whole[k : k + size]
                        rows.append((doc, k // size, k // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(lean(cut), PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[list[int]]:
    """Bins of indices: longest first, each into the bin with the least room that takes it.

    ``room`` has the bins by room left; a bit mask finds the least room in use.
    """
    room: list[list[int]] = [[] for _ in range(sequence + 1)]
    used = 0
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = used >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                used &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), sequence
            bins.append([i])
        left = r - n
        room[left].append(b)
        used |= 1 << left
    return bins


class _Offers:
    """What bins can give back for a piece: their distinct single sizes and sums of two, as flat arrays."""

    def __init__(self, size: list[int], members: list[list[int]]):
        self.size, self.members = size, members
        parts = [self._of(b) for b in range(len(members))]
        self.bin = np.concatenate([np.full(len(p[0]), b) for b, p in enumerate(parts)])
        self.sum, self.one, self.two = (np.concatenate([p[k] for p in parts]) for k in range(3))

    def _of(self, b: int):
        """(sum, piece, other piece or -1) of a bin; of pieces of one size one, or two for pairs, stand for all."""
        by_size: dict[int, list[int]] = {}
        for i in self.members[b]:
            held = by_size.setdefault(self.size[i], [])
            if len(held) < 2:
                held.append(i)
        sums, one, two = [], [], []
        keys = sorted(by_size)
        for k, n in enumerate(keys):
            sums.append(n)
            one.append(by_size[n][0])
            two.append(-1)
            for m in keys[k:]:
                if m != n or len(by_size[n]) > 1:
                    sums.append(n + m)
                    one.append(by_size[n][0])
                    two.append(by_size[m][1 if m == n else 0])
        return np.array(sums, np.int64), np.array(one, np.int64), np.array(two, np.int64)

    def refresh(self, b: int) -> None:
        keep = self.bin != b
        sums, one, two = self._of(b)
        self.bin = np.concatenate([self.bin[keep], np.full(len(sums), b)])
        self.sum, self.one, self.two = (
            np.concatenate([old[keep], new]) for old, new in ((self.sum, sums), (self.one, one), (self.two, two))
        )


def swap_search(lengths: np.ndarray, bins: list[list[int]], sequence: int = SEQUENCE) -> list[list[int]]:
    """Unpack underfull bins into others by moves, exchanges one for one and two for one.

    Every underfull bin is a donor in turn, the emptiest first. A step gives the
    donor's piece x to a bin that has room for it, or takes back one shorter
    piece, or two, such that the other bin grows and still fits; the step of the
    largest gain in the sum of squared fills is made, if there is a gain. A donor that
    can give nothing is left for the next. Passes go on while they empty bins, and end when no
    packing can have fewer.
    """
    least = max(1, -(-int(lengths.sum()) // sequence))
    left = len(bins)
    if left <= least:
        return bins
    size, members = lengths.tolist(), [list(b) for b in bins]
    fill = np.array([sum(size[i] for i in b) for b in members], np.int64)
    offers = _Offers(size, members)
    emptied = True
    while emptied and left > least:
        emptied = False
        for donor in np.argsort(fill, kind="stable").tolist():
            if not members[donor] or fill[donor] == sequence:
                continue
            stepped = False
            while members[donor] and (step := _best_step(size, members, fill, offers, donor, sequence)):
                x, other, back = step
                members[donor].remove(x)
                members[other].append(x)
                for y in back:
                    members[other].remove(y)
                    members[donor].append(y)
                change = size[x] - sum(size[y] for y in back)
                fill[donor] -= change
                fill[other] += change
                offers.refresh(other)
                stepped = True
            if stepped:
                offers.refresh(donor)
            if not members[donor]:
                left, emptied = left - 1, True
                if left <= least:
                    break
    return [b for b in members if b]


def _best_step(size, members, fill, offers, donor, sequence):
    """(piece, other bin, pieces taken back) of the largest gain in squared fill, or None."""
    # Raising another bin by c raises the squares by 2c(lead + c).
    lead = fill - fill[donor]
    room = np.where(fill > 0, sequence - fill, 0)
    room[donor] = 0
    room_at, lead_at = room[offers.bin], lead[offers.bin]
    best, gain = None, 0
    for n, x in {size[i]: i for i in members[donor]}.items():
        g = np.where(room >= n, 2 * n * (lead + n), 0)
        k = int(g.argmax())
        if g[k] > gain:
            best, gain = (x, k, ()), int(g[k])
        if not len(offers.sum):
            continue
        c = n - offers.sum
        g = np.where((c > 0) & (c <= room_at), 2 * c * (lead_at + c), 0)
        k = int(g.argmax())
        if g[k] > gain:
            pair = (int(offers.one[k]), int(offers.two[k]))
            best, gain = (x, int(offers.bin[k]), pair if pair[1] >= 0 else pair[:1]), int(g[k])
    return best


def pack_lengths(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[list[int]]:
    return swap_search(lengths, best_fit(lengths, sequence), sequence)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and its place there; see the module's text."""
    ws = Workspace(docs.sparkSession, "packing")
    cut = ws.keep(pieces(docs, tokenizer, id_col, text_col, sequence), "pieces")
    n = cut.filter(F.col("length") < sequence).count()
    shards = max(1, -(-n // PIECES_PER_SHARD))
    # Repeated rows agree in every column, so a number of the row deals them out evenly.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    short = cut.filter(F.col("length") < sequence).withColumn("shard", shard)
    full = cut.filter(F.col("length") == sequence).select(
        "*",
        # Below the numbers of shards, which start at 0.
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["shard"].iloc[0]) << 32
        pdf = pdf.drop(columns="shard").sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
        pdf = pdf.reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence_id, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for b, members in enumerate(pack_lengths(lengths, sequence)):
            held = lengths[members]
            sequence_id[members] = base + b
            offset[members] = np.cumsum(held) - held
        return pdf.assign(sequence_id=sequence_id, offset=offset)

    return short.groupBy("shard").applyInPandas(pack_shard, PACKED_SCHEMA).unionByName(full)
