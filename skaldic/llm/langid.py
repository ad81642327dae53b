"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position of a text gets a label distribution; a document's is the
mean over its letter positions. The state starts anew at white space, so equal
words share one evaluation: a batch runs the network once per distinct word and
weighs the result by the word's count. What the network sees around a position is
thus its word, and not the words beside it. Words longer than ``STEPS`` bytes, as
in scripts without spaces, are evaluated in pieces of up to that length, cut between characters. Whole texts are read.

The network is trained in numpy by backpropagation through time on a bounded
sample: about ``TRAIN_DOCS`` training documents, as many of each label, those of
smallest hash, and of each a window of ``TRAIN_CHARS`` characters at a hashed
place; of their words ``TRAIN_WORDS`` are drawn. Identifiers and labels alone
are sampled, so only the texts of the sample reach the driver.

Cases: null texts and texts without a letter are ``und`` with score 0, and so is
everything where no labelled document exists. Null labels are not learned from, nor
are rows without identifier. Of labels that tie the first in their order is taken.
Repeated rows get equal results and count once in the sample. Very long texts are one row and are read in
slices of words. An empty table gives no rows. Other columns are ignored, or kept by
``identified_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from .bytestext import hashed_spans, lean, text_bytes
from .workspace import own_columns

TRAIN_DOCS = 1200
TRAIN_CHARS = 3000
TRAIN_WORDS = 60_000
STEPS = 24
HIDDEN = 12
ROUNDS = 200
BATCH = 512
CACHED_WORDS = 300_000
SLICE_BYTES = 1 << 20
ROWS = 256
UNDETERMINED = "und"

# ASCII letters are lower-cased; a letter position is one of an ASCII letter or of a byte beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Gru:
    """One direction: update gate, reset gate and candidate, side by side in the columns."""

    w: np.ndarray  # 256 x 3h, input weights by byte, biases within
    u: np.ndarray  # h x 3h
    b: np.ndarray  # h, bias of the candidate's recurrent part

    @classmethod
    def new(cls, h: int, rng: np.random.Generator) -> Gru:
        w = rng.standard_normal((256, 3 * h)) * 0.3
        w[:, :h] -= 0.5
        return cls(w.astype(np.float32), (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32), np.zeros(h, np.float32))

    def step(self, byte: np.ndarray, h: np.ndarray):
        n = h.shape[1]
        x, r = self.w[byte], h @ self.u
        gates = _sigmoid(x[:, : 2 * n] + r[:, : 2 * n])
        z, reset = gates[:, :n], gates[:, n:]
        inner = r[:, 2 * n :] + self.b
        c = np.tanh(x[:, 2 * n :] + reset * inner)
        return c + z * (h - c), z, reset, inner, c

    def forward(self, words: np.ndarray, active: np.ndarray) -> np.ndarray:
        """States (steps, words, h); ``active`` words of the first lines go on at each step."""
        steps, n = words.shape
        out = np.zeros((steps, n, len(self.b)), np.float32)
        h = np.zeros((n, len(self.b)), np.float32)
        for t in range(steps):
            k = active[t]
            if not k:
                break
            out[t, :k] = h = self.step(words[t, :k], h[:k])[0]
        return out

    def train_forward(self, words, mask):
        h, tape = np.zeros((words.shape[1], len(self.b)), np.float32), []
        out = np.zeros((*words.shape, len(self.b)), np.float32)
        for t in range(len(words)):
            new, *rest = self.step(words[t], h)
            tape.append((h, *rest))
            h = np.where(mask[t][:, None], new, h)
            out[t] = h
        return out, tape

    def backward(self, words, mask, tape, grad_out):
        """Gradients by backpropagation through time of the states' gradients."""
        gw, gu, gb = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        carry = np.zeros_like(grad_out[0])
        for t in range(len(words) - 1, -1, -1):
            h, z, reset, inner, c = tape[t]
            carry = carry + grad_out[t]
            g = np.where(mask[t][:, None], carry, 0)
            gz = g * (h - c) * z * (1 - z)
            gc = g * (1 - z) * (1 - c * c)
            greset = gc * inner * reset * (1 - reset)
            gx = np.concatenate([gz, greset, gc], 1)
            gr = np.concatenate([gz, greset, gc * reset], 1)
            gw += (words[t] == np.arange(256, dtype=np.uint8)[:, None]).astype(np.float32) @ gx
            gu += h.T @ gr
            gb += (gc * reset).sum(0)
            carry = np.where(mask[t][:, None], g * z + gr @ self.u.T, carry)
        return [gw, gu, gb]


@dataclass
class Model:
    languages: list[str]
    ahead: Gru
    back: Gru
    v: np.ndarray
    c: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def word_sums(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities summed over each word's letter positions. words: (n, STEPS) bytes."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), 8192):
            rows = order[at : at + 8192]
            held, n = words[rows], lengths[rows]
            steps = int(n[0])
            active = np.searchsorted(-n, -np.arange(steps), side="left")
            ahead = held[:, :steps].T
            place = np.clip(n[:, None] - 1 - np.arange(steps), 0, None)
            back = np.take_along_axis(held, place, 1).T
            hf, hb = self.ahead.forward(ahead, active), self.back.forward(back, active)
            hb = np.take_along_axis(hb, place.T[:, :, None], 0)
            logits = hf @ self.v[: hf.shape[2]] + hb @ self.v[hf.shape[2] :] + self.c
            p = np.exp(logits - logits.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            counts = _LETTER[ahead] & (np.arange(steps)[:, None] < n)
            out[rows] = np.einsum("tnk,tn->nk", p, counts.astype(np.float32))
        return out


def word_table(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, STEPS) bytes of spans, zeros beyond their ends."""
    at = starts[:, None] + np.arange(STEPS)
    inside = np.arange(STEPS) < lengths[:, None]
    return np.where(inside, buffer[np.minimum(at, len(buffer) - 1)], 0).astype(np.uint8)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model | None:
    """Fit to words that carry the labels of their texts; languages count alike."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    ahead, back = Gru.new(HIDDEN, rng), Gru.new(HIDDEN, rng)
    v = (rng.standard_normal((2 * HIDDEN, len(languages))) * 0.3).astype(np.float32)
    model = Model(languages, ahead, back, v, np.zeros(len(languages), np.float32))
    buffer, offsets = text_bytes(pa.array(texts, pa.string()))
    buffer = _LOWER[buffer]
    starts, ends, owner, _ = hashed_spans(buffer, offsets, STEPS)
    if not len(starts):
        return model
    label = np.searchsorted(languages, labels)[owner]
    picks = [rng.choice(np.flatnonzero(label == k), TRAIN_WORDS // len(languages)) for k in range(len(languages)) if (label == k).any()]
    pick = np.concatenate(picks)
    words, lengths, label = word_table(buffer, starts[pick], (ends - starts)[pick]), (ends - starts)[pick], label[pick]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    for step in range(1, ROUNDS + 1):
        rows = rng.integers(0, len(words), BATCH)
        grads = _gradients(model, words[rows], lengths[rows], label[rows])
        rate = 0.02 * (1 - 0.9 * step / ROUNDS)
        for p, g, m in zip(model.parameters(), grads, moment, strict=True):
            g = np.clip(g, -1, 1)
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _gradients(model: Model, held: np.ndarray, n: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    steps, h = int(n.max()), HIDDEN
    mask = np.arange(steps)[:, None] < n
    ahead = held[:, :steps].T
    place = np.clip(n[:, None] - 1 - np.arange(steps), 0, None)
    back = np.take_along_axis(held, place, 1).T
    hf, tape_f = model.ahead.train_forward(ahead, mask)
    hb_own, tape_b = model.back.train_forward(back, mask)
    hb = np.take_along_axis(hb_own, place.T[:, :, None], 0)
    both = np.concatenate([hf, hb], 2)
    logits = both @ model.v + model.c
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    np.put_along_axis(p, np.broadcast_to(label, p.shape[:2])[:, :, None], np.take_along_axis(p, np.broadcast_to(label, p.shape[:2])[:, :, None], 2) - 1, 2)
    g = p * mask[:, :, None] / mask.sum()
    gv, gc = np.einsum("tni,tnk->ik", both, g), g.sum((0, 1))
    gboth = g @ model.v.T
    gf, gb = gboth[:, :, :h], np.zeros_like(hb_own)
    # Within a word's length the places are a permutation, and beyond it nothing flows back.
    np.put_along_axis(gb, np.where(mask, place.T, np.arange(steps)[:, None])[:, :, None], gboth[:, :, h:] * mask[:, :, None], 0)
    return [
        x.astype(np.float32)
        for x in [*model.ahead.backward(ahead, mask, tape_f, gf), *model.back.backward(back, mask, tape_b, gb), gv, gc]
    ]


class Labeller:
    """Pools the network over texts; remembers the sums of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(model.languages)), np.float32)

    def _sums(self, buffer, starts, lengths, hashes):
        """Sums of distinct words, by hash."""
        at = np.searchsorted(self.hashes, hashes)
        known = (at < len(self.hashes)) & (self.hashes[np.minimum(at, max(len(self.hashes) - 1, 0))] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), len(self.model.languages)), np.float32)
        out[known] = self.sums[at[known]]
        new = ~known
        if new.any():
            out[new] = self.model.word_sums(word_table(buffer, starts[new], lengths[new]), lengths[new])
            if len(self.hashes) + int(new.sum()) > CACHED_WORDS:
                self.hashes, self.sums = hashes, out
            else:
                merged = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(merged, kind="stable")
                self.hashes, self.sums = merged[order], np.concatenate([self.sums, out[new]])[order]
        return out

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 without letters; score) of each text."""
        buffer, offsets = text_bytes(texts)
        buffer = _LOWER[buffer]
        total = np.zeros((len(texts), len(self.model.languages)), np.float64)
        count = np.zeros(len(texts), np.int64)
        letters = np.concatenate([[0], np.cumsum(_LETTER[buffer], dtype=np.int64)])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
            lo = offsets[first]
            part = buffer[lo : offsets[last]]
            starts, ends, owner, hashes = hashed_spans(part, offsets[first : last + 1] - lo, STEPS)
            n = letters[lo + ends] - letters[lo + starts]
            useful = n > 0
            starts, ends, owner, hashes, n = starts[useful], ends[useful], owner[useful], hashes[useful], n[useful]
            if len(starts):
                distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                sums = self._sums(part, starts[where], (ends - starts)[where], distinct)[inverse]
                edge = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
                total[first + owner[edge]] += np.add.reduceat(sums, edge, axis=0, dtype=np.float64)
                count[first + owner[edge]] += np.add.reduceat(n, edge)
            first = last
        ascii_letter = np.concatenate([[0], np.cumsum((buffer >= 97) & (buffer <= 122), dtype=np.int64)])
        sure = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
        for i in np.flatnonzero((count > 0) & ~sure):
            sure[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        ok = sure & (count > 0)
        best = np.where(ok, total.argmax(1), -1)
        score = np.where(ok, total.max(1) / np.maximum(count, 1), 0.0)
        return best, np.clip(score, 0.0, 1.0)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


HASH_RANGE = 1 << 40


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, held_out: Column) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``TRAIN_DOCS`` rows outside the held-out fold, each label's share alike."""
    ident, text = F.col(id_col), F.col(text_col).cast("string")
    label = F.col(label_col).cast("string")
    open_rows = docs.filter(label.isNotNull() & ~F.coalesce(held_out, F.lit(True)))
    hashed = open_rows.select(ident.alias("i"), label.alias("l"), F.pmod(F.xxhash64(F.lit(3), ident), F.lit(HASH_RANGE)).alias("h"))
    # More labels than sampled documents can't all be learned; the commonest are.
    counts = hashed.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(TRAIN_DOCS).collect()
    if not counts:
        return [], []
    share = max(1, TRAIN_DOCS // len(counts))
    # A label's hashes are thinned to some twice its share before they are ordered.
    limits = docs.sparkSession.createDataFrame([(r["l"], min(HASH_RANGE, 2 * share * HASH_RANGE // r["n"] + 1)) for r in counts], "l string, most long")
    few = hashed.join(F.broadcast(limits), "l").filter("h < most").groupBy("l", "i").agg(F.min("h").alias("h"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).filter(F.col("r") <= share)
    chosen = {(r["i"], r["l"]) for r in ranked.select("i", "l").collect()}
    room = F.greatest(F.length(text) - TRAIN_CHARS, F.lit(0)) + 1
    window = F.substr(text, F.pmod(F.xxhash64(F.lit(4), ident), room).cast("int") + 1, F.lit(TRAIN_CHARS))
    found = open_rows.filter(ident.isin([i for i, _ in chosen])).select(ident.alias("i"), label.alias("l"), window.alias("t"))
    rows = found.filter("t is not null").groupBy("i", "l").agg(F.min("t").alias("t")).collect()
    rows = sorted((r["l"], r["i"], r["t"]) for r in rows if (r["i"], r["l"]) in chosen)
    return [t for _, _, t in rows], [label for label, _, _ in rows]


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", carry: list[Column] | None = None
) -> DataFrame:
    """One row per input row: the columns ``carry`` (all of ``docs``, renamed; else the identifier), then held_out, lang_pred, score."""
    held = fold(F.col(id_col), 4) == 2
    model = train(*training_sample(docs, id_col, text_col, label_col, held))
    kept = docs.select(*(carry if carry is not None else [F.col(id_col)]), F.coalesce(held, F.lit(False)).alias("held_out"))
    schema = kept.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    # A carried text is read where it stands; otherwise it comes along as the last column.
    text_at, width = len(kept.columns), len(kept.columns)
    if carry is not None and docs.schema[text_col].dataType == StringType():
        text_at = docs.columns.index(text_col)
        rows = kept
    else:
        rows = docs.select(*(carry if carry is not None else [F.col(id_col)]), F.coalesce(held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text_in"))
    languages = model.languages if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model) if model else None
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = batch.column(text_at)
                if labeller is None:
                    best, score = np.full(len(texts), -1), np.zeros(len(texts))
                else:
                    best, score = labeller.label(texts)
                names_out = [languages[i] if i >= 0 else UNDETERMINED for i in best]
                cols = [*batch.columns[:width], pa.array(names_out, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(lean(run), schema)


def identified_documents(docs: DataFrame, least_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows with a language: not ``und``, and labelled with a mean probability of at least ``least_score``."""
    # Columns of the input pass under numbers, so that their names meet none of this operator's.
    numbered = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(docs, id_col, text_col, label_col, [c.alias(n) for c, n in zip(own_columns(docs), numbered, strict=True)])
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return kept.select(*[F.col(n).alias(name) for n, name in zip(numbered, docs.columns, strict=True)])
