"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers are composed and run over each clause. A lexicon turns words into
symbols (slur, harm, modal, target, negation, report, other). The insult transducer
turns slurs into insults, one right after another into stronger ones; the threat
transducer turns verbs of harm into threats, after a modal into stronger ones; the
report transducer marks what follows a reporting verb; the negation transducer marks
what follows a negation; the target transducer joins insults and threats to an
addressee nearby. The composed machine gives a clause its matches with weights;
what is reported or negated is no match, whatever its weight.
A document's features are sums over its matched clauses, and a logistic
regression, fitted to labelled rows, turns them into a score. A word that no
clause pattern matches counts nothing.

The insult lexicon holds stems with log-odds weights, learned from labelled
training rows, beside a fixed list. A stem is a word's beginning of ``STEM`` to
``LONGEST_STEM`` letters or a whole word, marked by a space at its end. It is kept
if at least ``LEAST_TOXIC`` toxic texts have it, next to no clean ones, and
chance gives so uneven a split with a probability of at most ``CHANCE``; of stems
that begin one another the longer is kept only if it weighs more. Both fits use a
bounded sample: at most ``TRAIN_DOCS`` labelled rows of each label, those of
smallest hash, and of equal texts one. Of near copies with one label one text
counts for stems, as they are no evidence of their own. Counts of stems are
aggregated in Spark; only the best ``MAX_STEMS``, and a sketch of each text of the
sample, reach the driver.

Cases: rows without identifier are not learned from; of hashes that tie the smaller identifier is sampled.
Null and empty texts have no clauses and get the score of an
empty text; so does every text if there are no labels. Null labels are not learned from. Repeated rows
get equal scores. Very long texts are scanned whole. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import fold
from .workspace import Workspace

TRAIN_DOCS = 3000
MAX_STEMS = 512
STEM = 4
LONGEST_STEM = 10
LEAST_TOXIC = 4
CHANCE = 1e-4
SHINGLE = 3
HASHES, BAND = 32, 4
"""Minima of a text's sketch, and of one band; texts that share a band and half of the minima are near copies."""
THRESHOLD = 0.7

# Words of the grammar's classes.
INSULTS = "idiot moron stupid worthless pathetic disgusting scum trash loser clown dumb fool bastard dummkopf imbécile estúpido"
THREATS = "kill hurt destroy beat burn shoot stab crush töten umbringen tuer frapper matar golpear"
MODALS = "will would gonna going must shall should werde wirst wird muss vais vas va voy vamos"
TARGETS = "you your yours they them these those this that he she du dich euch ihr diese tu toi vous ce cette tú usted ustedes este esta"
NEGATIONS = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún"
REPORTS = "said says say called calls wrote writes quoted claimed reported sagte nannte schrieb dit écrit appelé dijo llamó escribió"

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SLUR, HARM, MODAL = "slur", "harm", "modal"
REPORTED, NEGATED, JOINED = "reported ", "negated ", "joined "

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# Each run of marks is tried once, from its beginning, so that long runs stay linear.
_CLAUSE_END = re.compile(r"(?<![.!?;\n])[.!?;\n]++(?=\s|\Z)|\n+")
_WORDS = re.compile(r"[^\W\d_]{%d,}" % STEM)


class Transducer:
    """States with arcs (state, symbol) -> (state, symbol out, weight); other symbols loop unchanged at no weight."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str, float]], start: str = "0"):
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


class Composed(Transducer):
    """The product of two transducers: what the first writes, the second reads; weights add."""

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__({}, (first.start, second.start))
        self.first, self.second = first, second

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            a, middle, w = self.first.step(state[0], symbol)
            b, out, v = self.second.step(state[1], middle)
            found = self.arcs[state, symbol] = ((a, b), out, w + v)
        return found


REACH = 4
"""Words over which a negation or an addressee acts."""


def insulting() -> Transducer:
    """Slurs are insults; one right after another weighs more."""
    back = {("1", x): ("0", x, 0.0) for x in (OTHER, TARGET, NEGATION, REPORT, HARM, MODAL)}
    return Transducer({("0", SLUR): ("1", INSULT, 0.0), ("1", SLUR): ("1", INSULT, 0.5)} | back)


def threatening() -> Transducer:
    """Verbs of harm are threats; within reach of a modal they weigh more."""
    arcs = {("0", HARM): ("0", THREAT, 0.0), ("0", MODAL): ("1", OTHER, 0.0)}
    for k in range(1, REACH + 1):
        after = str(k + 1) if k < REACH else "0"
        arcs |= {(str(k), x): (after, x, 0.0) for x in (OTHER, TARGET, NEGATION, REPORT, INSULT)}
        arcs |= {(str(k), HARM): ("0", THREAT, 0.5), (str(k), MODAL): ("1", OTHER, 0.0)}
    return Transducer(arcs)


def reporting() -> Transducer:
    """After a reporting verb the rest of the clause is reported."""
    return Transducer(
        {("0", REPORT): ("in", REPORT, 0.0)} | {("in", x): ("in", REPORTED + x, 0.0) for x in (INSULT, THREAT)}
    )


def negating() -> Transducer:
    """A negation acts on the next words."""
    arcs = {("0", NEGATION): ("1", NEGATION, 0.0)}
    plain = (OTHER, TARGET, REPORT, REPORTED + INSULT, REPORTED + THREAT)
    for k in range(1, REACH + 1):
        after = str(k + 1) if k < REACH else "0"
        arcs |= {(str(k), x): (after, x, 0.0) for x in plain}
        arcs |= {(str(k), x): ("0", NEGATED + x, 0.0) for x in (INSULT, THREAT)}
        arcs |= {(str(k), NEGATION): ("0", NEGATION, 0.0)}
    return Transducer(arcs)


def targeting() -> Transducer:
    """An addressee before joins an insult or a threat to it; an insult before is joined when the addressee comes."""
    arcs = {("0", TARGET): ("t1", TARGET, 0.0), ("0", INSULT): ("i1", INSULT, 1.0), ("0", THREAT): ("0", THREAT, 0.5)}
    plain = (OTHER, REPORT, NEGATION, *(p + x for p in (REPORTED, NEGATED) for x in (INSULT, THREAT)))
    for k in range(1, REACH + 1):
        t_next, i_next = (f"t{k + 1}", f"i{k + 1}") if k < REACH else ("0", "0")
        arcs |= {(f"t{k}", x): (t_next, x, 0.0) for x in plain} | {(f"i{k}", x): (i_next, x, 0.0) for x in plain}
        arcs |= {
            (f"t{k}", TARGET): ("t1", TARGET, 0.0),
            (f"t{k}", INSULT): ("i1", JOINED + INSULT, 1.5),
            (f"t{k}", THREAT): ("0", JOINED + THREAT, 1.5),
            (f"i{k}", TARGET): ("t1", JOINED + TARGET, 0.5),
            (f"i{k}", INSULT): ("i1", INSULT, 1.0),
            (f"i{k}", THREAT): ("0", THREAT, 0.5),
        }
    return Transducer(arcs)


def grammar() -> Transducer:
    out: Transducer = insulting()
    for t in (threatening(), reporting(), negating(), targeting()):
        out = Composed(out, t)
    return out


FEATURES = 6


class Scanner:
    """Finds clauses with a lexicon word and runs the grammar over them."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.machine = grammar()
        self.words = {w: c for c, ws in ((MODAL, MODALS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (HARM, THREATS)) for w in ws.split()}
        self.stems = {w: 3.0 for w in INSULTS.split()} | {s: w for s, w in stems.items() if not s.endswith(" ")}
        self.wholes = {s[:-1]: w for s, w in stems.items() if s.endswith(" ")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.triggers = ahocorasick.Automaton()
        for w in [*self.stems, *self.wholes, *THREATS.split()]:
            self.triggers.add_word(w, len(w))
        self.triggers.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found:
            return found, 1.0
        weight = self.wholes.get(word)
        if weight is not None:
            return SLUR, weight
        for n in self.lengths:
            weight = self.stems.get(word[:n])
            if weight is not None:
                return SLUR, weight
        return OTHER, 0.0

    def clauses(self, low: str) -> Iterator[str]:
        """The whole clauses with a trigger at the start of a word, each once."""
        ends = _CLAUSE_END.finditer(low)
        begin = stop = after = 0
        for end, n in self.triggers.iter(low):
            at = end - n + 1
            if at < stop or at and low[at - 1].isalpha():
                continue
            while stop <= at:
                begin = after
                mark = next(ends, None)
                stop, after = mark.span() if mark else (len(low), len(low))
            yield low[begin:stop]

    def features(self, text: str | None) -> np.ndarray:
        """Sums over clauses: weight of direct, joined, negated and reported matches, threats; number of clauses."""
        out = np.zeros(FEATURES)
        for clause in self.clauses((text or "").lower()):
            state, matched = self.machine.start, False
            for word in _TOKEN.findall(clause):
                symbol, weight = self.symbol(word)
                state, said, w = self.machine.step(state, symbol)
                if said.startswith(NEGATED):
                    out[2] += weight
                elif said.startswith(REPORTED):
                    out[3] += weight
                elif w:
                    place = 4 if THREAT in said else 1 if said.startswith(JOINED) else 0
                    out[place] += w * (weight or 1.0)
                    matched = True
            out[5] += matched
        return np.log1p(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, ws: Workspace) -> DataFrame:
    """(text, label) of at most 2 * ``TRAIN_DOCS`` training rows, of equal texts one."""
    parts = []
    open_rows = labels.filter((fold(F.col(id_col), 3) != 1) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.xxhash64(F.lit(6), F.col(id_col)).alias("_h")
    )
    for value in (0, 1):
        parts.append(open_rows.filter(F.col("_label") == value).orderBy("_h", "_id").limit(TRAIN_DOCS))
    # At most 2 * TRAIN_DOCS narrow rows.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = texts.join(chosen, F.col("_doc") == F.col("_id")).groupBy("text").agg(F.max("_label").alias("label"))
    return ws.keep(met, "sample")


def beginnings(word: str) -> list[str]:
    """What a word offers as stems: its beginnings, and itself with a space."""
    return [*(word[:n] for n in range(STEM, min(len(word), LONGEST_STEM) + 1)), word + " "]


def sketch(text: str) -> np.ndarray:
    """Minima of ``HASHES`` hashes over runs of ``SHINGLE`` words; texts with most runs in common share most of them."""
    rng = np.random.default_rng(6)
    a, b = (rng.integers(1, 1 << 31, HASHES).astype(np.uint64) for _ in range(2))
    words = _TOKEN.findall(text.lower())
    runs = {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    hashes = np.array([zlib.crc32(r.encode()) for r in runs], np.uint64)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 4096):
        mixed = hashes[k : k + 4096, None] * (a | np.uint64(1)) + b
        least = np.minimum(least, ((mixed >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).min(0))
    return least


def near_copies(rows: list[tuple[int, int, bytes]]) -> set[int]:
    """Of (key, label, sketch): the keys of all but one of each group of near copies with one label."""
    first: dict[tuple, int] = {}
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = sorted(rows)
    sketches = [np.frombuffer(r[2], np.uint32) for r in rows]
    for i, (_, label, _) in enumerate(rows):
        for k in range(0, HASHES, BAND):
            j = first.setdefault((label, k, sketches[i][k : k + BAND].tobytes()), i)
            if j != i and (sketches[i] == sketches[j]).mean() >= 0.5:
                parent[root(i)] = root(j)
    return {r[0] for i, r in enumerate(rows) if root(i) != i}


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Word beginnings and words that mark toxic texts: next to absent elsewhere, and more often there than by chance."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "label", "sketch"])

    keyed = sample.select(F.xxhash64("text").alias("key"), F.col("label").cast("int").alias("label"), "text")
    # 128 bytes for each row of the bounded sample.
    drawn = [tuple(r) for r in keyed.mapInArrow(draw, "key long, label int, sketch binary").collect()]
    copies = near_copies([(k, y, bytes(s)) for k, y, s in drawn])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for key, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in copies:
                    words = set(_WORDS.findall(text.lower()))
                    (toxic if label else clean).update({s for w in words for s in beginnings(w)})
        keys = list(toxic | clean)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean))],
                ["stem", "n_toxic", "n_clean"],
            )

    n = Counter(y for k, y, _ in drawn if k not in copies)
    n1, n0 = n[1], n[0]
    if not n1 or not n0:
        return {}
    toxic, clean, both = F.col("n_toxic"), F.col("n_clean"), F.col("n_toxic") + F.col("n_clean")
    share = n1 / (n1 + n0)
    # The bound of Chernoff on the binomial tail.
    surprise = toxic * F.log(toxic / (both * F.lit(share))) + F.when(clean > 0, clean * F.log(clean / (both * F.lit(1 - share)))).otherwise(0.0)
    weight = F.log((toxic + 0.5) / F.lit(n1 + 1.0)) - F.log((clean + 0.5) / F.lit(n0 + 1.0))
    good = Workspace(sample.sparkSession, "stems").keep(
        keyed.mapInArrow(count, "stem string, n_toxic long, n_clean long")
        .groupBy("stem")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .filter((toxic >= LEAST_TOXIC) & (clean * F.lit(n1) * 50 <= toxic * F.lit(n0)) & (surprise >= -math.log(CHANCE)))
        .select("stem", weight.alias("weight"), surprise.alias("surprise")),
        "good",
    )
    length = F.least(F.length("stem"), F.lit(LONGEST_STEM + 1))
    shorter = (
        good.filter(length > STEM)
        .select("stem", F.col("weight").alias("own"), F.explode(F.transform(F.sequence(F.lit(STEM), length - 1), lambda k: F.substring("stem", F.lit(1), k))).alias("begin"))
        .join(good.select(F.col("stem").alias("begin"), "weight"), "begin")
        .filter("weight >= own")
        .select("stem")
        .distinct()
    )
    rows = good.join(shorter, "stem", "left_anti").orderBy(F.desc("surprise"), "stem").limit(MAX_STEMS).collect()
    return {r["stem"]: r["weight"] for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 0.02) -> np.ndarray:
    """Coefficients, intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) / len(y) + penalty * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return beta


SIGNS = np.array([1, 1, -1, -1, 1, 1])
"""Matches and threats never speak against toxicity, what is negated or reported never for it."""


def fit_signed(x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS) -> np.ndarray:
    """Coefficients that keep to ``signs``, intercept last: the one furthest on the wrong side is left out until none is."""
    free = np.arange(x.shape[1])
    while True:
        beta = fit_logistic(x[:, free], y, ridge=1e-5)
        wrong = beta[:-1] * signs[free]
        if not len(free) or wrong.min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[free], out[-1] = beta[:-1], beta[-1]
            return out
        free = np.delete(free, int(np.argmin(wrong)))


def fit(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(stems, coefficients) from a labelled sample."""
    stems = learn_stems(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(stems)
        for batch in batches:
            found = [scanner.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    # A few numbers for each row of the bounded sample.
    rows = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(measure, "x array<double>, y int").collect()
    if not rows:
        beta = np.zeros(FEATURES + 1)
        beta[:2], beta[-1] = 1.5, -3.0
        return stems, beta
    rows.sort(key=lambda r: (r["y"], r["x"]))
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    return stems, fit_signed(x, y)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ws = Workspace(docs.sparkSession, "toxicity")
    stems, beta = fit(labelled_sample(docs, labels, id_col, text_col, label_col, ws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(stems)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                x = np.array([scanner.features(t) for t in batch.column(2).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
                cols = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
