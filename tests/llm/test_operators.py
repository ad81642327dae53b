"""Operators on small hand-made tables: against brute force, round trips, and the odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from skaldic.llm import ann, bytestext, catalog, exact_dedup, langid, mixing, neardup, packing, suffix_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text_in string"
WORDS = "the of and to in is that for it was der die und zu den das von mit sich des le la les et des en un du que dans el los".split()


def corpus(n=60, seed=1):
    """Copies, near copies, shared passages, nulls, empties, repeated rows, a very long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(texts) < 6:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 120))))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            w = (rng.choice(texts) or "x y z").split() or ["x"]
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(" ".join(word() for _ in range(9)) + " " + passage + " " + word())
        elif kind == 4:
            texts.append(rng.choice([None, "", "  \n", "a", "Ab  c\n", "ab c ", "1 2 3 !", "aaaa" * 40]))
        else:
            texts.append(rng.choice(texts[:6]).upper() if rng.random() < 0.5 else rng.choice(texts[:6]))
    texts.append(" ".join(word() for _ in range(20_000)))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None, ""]), 1, "x") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[7]]


def plain_rows(rows):
    """Each identifier once."""
    return list({r[0]: r for r in rows}.values())


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup

def test_exact_dedup(docs, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter(
        (r[0], min(g), len(g), r[0] == min(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows for g in [groups[norm(r[1])]]
    )
    assert Counter(tuple(x) for x in exact_dedup.exact_dedup(docs).collect()) == want
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(r[0] for r in rows if r[0] == min(groups[norm(r[1])]))


def test_exact_dedup_has_sorted_runs_and_no_python(docs):
    plan = exact_dedup.exact_groups(exact_dedup.digests(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 * 3 and "HashAggregate" not in plan and "Python" not in plan and "Arrow" not in plan


def test_exact_dedup_of_null_identifiers(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "a"), (1, "a "), (None, "z"), (None, "z")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {(None, 2, 2, False), (2, 2, 2, True), (1, 1, 1, True), (None, None, 2, True)}
    assert exact_dedup.keep_first(rows).count() == 5


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0


# --- url filter

URLS = [
    None, "", "no-scheme.net/x", "http://A.Net/", "http://a.net", "https://x.example.net/en/1?q#f", "https://x.EXAMPLE.net/EN/1", "http://notexample.com/de/",
    "http://example.com/de/x", "http://m.example.com/de", "ftp://org/fr/?x", "http://a.org/fr/b/c", "http://net/en/", "http://x.net?y=/z", "http://ünet.net/é", "http://a..net/",
]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for rule in catalog.RULES:
        h, p = rule.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.text) > len(best.text)):
            best = rule
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[3:5])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, catalog.RULES).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS + URLS[3:5])}
    assert url_filter.judge_urls(pages.limit(0), catalog.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_and_has_levels(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 10 = 0")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.filter(url_filter.is_listed(F.col("key"), levels) != (F.crc32("key") % 10 == 0))
    assert wrong.count() == 0


# --- mixing

def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), ["big"] * 8 + ["mid", None, ""]) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, rng.choice(s)) for i, t, s in rows], "doc_id long, text string, source string")
    target = mixing.MixTarget(entropy=0.9, repetitions=None)
    got = mixing.mix(docs, target).toPandas()
    assert set(got["doc_id"]) == set(range(2000))
    tokens = Counter()
    for r in docs.collect():
        tokens[r["source"]] += len(r["text"].split())
    weight = got.assign(source=got["source"].fillna("<null>")).groupby("source")["weight"].first()
    assert abs(weight.sum() - 1) < 1e-9
    assert abs(-(weight * np.log(weight)).sum() / math.log(len(weight)) - 0.9) < 1e-6
    drawn = got.assign(source=got["source"].fillna("<null>")).groupby("source")["tokens"].sum()
    assert np.abs(drawn / drawn.sum() - weight).max() < 0.01
    # Every mix block shows the weights.
    big = got[got["source"] == "big"].groupby("mix_block")["tokens"].sum()
    assert big.std() / big.mean() < 0.35
    # Positions are the running token counts of each source.
    for _, g in got.groupby(got["source"].fillna("<null>")):
        g = g.sort_values("position")
        assert (g["position"].to_numpy() == np.cumsum(g["tokens"]) - g["tokens"]).all()
    stage = mixing.mixed_documents(docs, target)
    assert stage.columns == docs.columns and stage.count() == len(got)


def test_mix_replays_its_permutation(spark, monkeypatch):
    """Every draw again in plain Python from the written weights: blocks in their epoch's order, rows in hash order, a cut at the budget."""
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(mixing, "STRETCH_BITS", 2)
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 9])), rng.choice(["a"] * 9 + ["b", None])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for target in (mixing.MixTarget(entropy=0.9, repetitions=4.0), mixing.MixTarget(entropy=None, repetitions=None, budget=1500), mixing.MixTarget(budget=9000, entropy=0.99, repetitions=None)):
        got = mixing.mix(docs, target).toPandas()
        narrow = docs.select("doc_id", "source", mixing.row_hash(F.col("doc_id"), F.col("text"), target.seed).alias("h"), mixing.token_count(F.col("text")).alias("t")).collect()
        per = Counter()
        for r in narrow:
            per[r["source"]] += r["t"]
        total = sum(per.values())
        p = {k: v / total for k, v in per.items()}

        def weights(a):
            z = sum(x**a for x in p.values())
            return {k: x**a / z for k, x in p.items()}

        def entropy(a):
            return -sum(w * math.log(w) for w in weights(a).values())

        lo, hi = 0.0, 1.0
        if target.entropy is not None and entropy(1.0) < target.entropy * math.log(3):
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if entropy(mid) < target.entropy * math.log(3) else (mid, hi)
            a = lo
        else:
            a = 1.0

        def worst(a):
            w = weights(a)
            return max(w[k] / p[k] for k in p) / (min(w[k] / p[k] for k in p) if target.budget is None else total / target.budget)

        if target.repetitions is not None and worst(a) > target.repetitions:
            lo, hi = a, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if worst(mid) <= target.repetitions else (mid, hi)
            a = hi
        want_weight = weights(a)
        assert all(abs(w - want_weight[None if s is None or s != s else s]) < 1e-9 for s, w in zip(got["source"], got["weight"]))
        whole = target.budget or total * sum(x**a for x in p.values()) / min(x ** (a - 1) for x in p.values())
        n_blocks = 1 << max(0, math.ceil(math.log2(len(rows) / 16)))
        epochs = range(int(got["epoch"].max()) + 1)
        pairs = [(e, b) for e in epochs for b in range(n_blocks)]
        visit = {(r["e"], r["b"]): r["v"] for r in spark.createDataFrame(pairs, "e long, b long").select("e", "b", F.xxhash64(F.lit(target.seed), "e", "b").alias("v")).collect()}
        want = Counter()
        for source in per:
            mine = [r for r in narrow if r["source"] == source]
            budget = round(want_weight[source] * whole) if target.budget else max(round(want_weight[source] * whole), per[source])
            for e in epochs:
                at = e * per[source]
                for b in sorted({r["h"] % n_blocks for r in mine}, key=lambda b: (visit[e, b], b)):
                    for r in sorted((r for r in mine if r["h"] % n_blocks == b), key=lambda r: r["h"]):
                        if at < budget or e == 0 and at == budget and r["t"] == 0:
                            want[r["doc_id"], e, at] += 1
                        at += r["t"]
        assert Counter(zip(got["doc_id"], got["epoch"], got["position"])) == want
        assert mixing.mixed_documents(docs, target).count() == len(got)
        if target.budget is None:
            assert set(got["doc_id"]) == {r[0] for r in rows}


def test_mix_repetition_limit_and_budget(spark):
    rows = [(i, "w " * 10, "a" if i < 900 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.MixTarget(entropy=1.0, repetitions=3.0)).toPandas()
    per = got.groupby("source")["tokens"].sum()
    assert per["a"] == 9000 and abs(per["b"] - 3000) <= 10
    got = mixing.mix(docs, mixing.MixTarget(entropy=None, repetitions=None, budget=2000)).toPandas()
    per = got.groupby("source")["tokens"].sum()
    assert abs(per["a"] - 1800) <= 10 and abs(per["b"] - 200) <= 10
    assert mixing.mixed_documents(docs, mixing.MixTarget(entropy=None, repetitions=None, budget=2000)).count() == len(got)


def test_mix_odd_rows(docs, empty, rows):
    got = mixing.mix(docs).toPandas()
    assert set(got["doc_id"]) == {r[0] for r in rows}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- packing

def test_packing(docs, rows, empty):
    path = catalog.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).toPandas()
    import zlib

    want = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) + 2
    assert packing.pack(empty, path).count() == 0


def test_tokens_agree_on_odd_texts():
    enc = packing.WordEncoder(catalog.tokenizer_path(), cached=5)
    texts = ["It's we'll o'clock x's'd 12a3 é'ü ab'cd''s", "İstanbul ﬁ ǆ", "naïve-café's!!", "<|endoftext|> hi", "a1b2's c_d__e", "can't've", None, "", "tab\tnl\n\x0b", "don't|a | b||"] * 2
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.whole.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_are_found_as_in_the_plain_call():
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["a note <|endoftext|> here", "x<|startoftext|>y", "é <|endoftext|>", "<|ENDOFTEXT|> a", "< |endoftext|> <|endoftext", "plain words"]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_swaps_save_sequences():
    lengths = np.array([6, 5, 5, 4] * 3 + [7, 3])
    start = [[i] for i in range(len(lengths))]
    before = sum(int(lengths[b].sum()) ** 2 for b in start)
    bins = packing.swap_search(lengths, start, 10)
    assert len(bins) == 7 and sum(int(lengths[b].sum()) ** 2 for b in bins) > before
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 10 for b in bins)
    rng = np.random.default_rng(0)
    saved = 0
    for _ in range(60):
        lengths = rng.integers(18, 60, 80)
        packed, plain = packing.pack_lengths(lengths, 100), packing.best_fit(lengths, 100)
        assert sorted(i for b in packed for i in b) == list(range(80)) and all(lengths[b].sum() <= 100 for b in packed)
        assert len(packed) <= len(plain)
        saved += len(plain) - len(packed)
    # Best fit isn't the best here, and swaps find what it misses.
    assert saved >= 10


def test_a_stuck_donor_does_not_end_the_search():
    # The emptiest bin can give nothing; the next one's pieces fit the others.
    lengths = np.array([51, 52, 3, 48, 48, 50, 50])
    bins = [[0], [1, 2], [3], [4], [5], [6]]
    assert len(packing.swap_search(lengths, bins, 100)) == 4
    assert len(packing.swap_search(np.full(40, 60), [[i] for i in range(40)], 100)) == 40


def test_search_over_many_bins_takes_bounded_time():
    import time

    began = time.time()
    lengths = np.random.default_rng(1).integers(700, 1400, 6000)
    packed = packing.pack_lengths(lengths)
    assert time.time() - began < 60 and len(packed) <= len(packing.best_fit(lengths))


# --- language

def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    model = langid.Model(["x", "y"], langid.Gru.new(langid.HIDDEN, rng), langid.Gru.new(langid.HIDDEN, rng), rng.standard_normal((2 * langid.HIDDEN, 2)).astype(np.float32), np.zeros(2, np.float32))
    words = rng.integers(97, 123, (5, langid.STEPS)).astype(np.uint8)
    lengths, label = np.array([1, 3, 7, 24, 5]), np.array([0, 1, 1, 0, 1])

    def loss():
        total = n = 0
        for w, k, y in zip(words, lengths, label):
            f = model.ahead.train_forward(w[:k, None], np.ones((k, 1), bool))[0][:, 0]
            b = model.back.train_forward(w[:k][::-1, None], np.ones((k, 1), bool))[0][::-1, 0]
            z = np.concatenate([f, b], 1).astype(np.float64) @ model.v + model.c
            total -= (z[:, y] - np.log(np.exp(z).sum(1))).sum()
            n += k
        return total / n

    grads = langid._gradients(model, words, lengths, label)
    for p, g in zip(model.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_language_id(spark):
    rng = random.Random(2)
    tongue = {"xx": "qua kwa zik zok vek".split(), "yy": "lume nalo sire mona elia".split()}
    rows = [(i, " ".join(rng.choice(tongue[l]) for _ in range(12)), l) for i in range(200) for l in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !? ", "yy"), (1003, "— €", None), (1004, "ZIK " * 30_000, None), (None, "lume nalo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    import zlib

    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows[:200] if got[r[0]]["held_out"]]
    assert held and all(a == b for a, b in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und"] * 4 + ["xx"] and got[1000]["score"] == 0
    kept = langid.identified_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_pooled_scores_agree_with_a_plain_evaluation(spark):
    """The network position by position, word by word, without sharing words, batches or slices."""
    rng = random.Random(3)
    tongue = {"xx": "qua kwa zik zok vék".split(), "yy": "lume nalo sire mona ælia".split()}
    texts = [" ".join(rng.choice(tongue[l]) for _ in range(15)) for _ in range(60) for l in ["xx", "yy"]]
    model = langid.train(texts, ["xx", "yy"] * 60)
    tests = ["Qua 12 zik! lume", "日本語" * 9 + " kwa", "x", "vék\n\tvék nalo", "— 7"]
    best, score = langid.Labeller(model).label(pa.array(tests))

    def positions(word):
        f = b = np.zeros((1, langid.HIDDEN), np.float32)
        ahead, back = [], []
        for x in word:
            f = model.ahead.step(np.array([x]), f)[0]
            ahead.append(f[0])
        for x in word[::-1]:
            b = model.back.step(np.array([x]), b)[0]
            back.insert(0, b[0])
        for x, u, v in zip(word, ahead, back):
            if langid._LETTER[x]:
                z = np.exp(np.concatenate([u, v]) @ model.v + model.c)
                yield z / z.sum()

    for text, k, s in zip(tests, best, score):
        pieces = []
        for word in text.split():
            data = langid._LOWER[np.frombuffer(word.encode(), np.uint8)]
            # The only long word has characters of three bytes, so cuts need no moving.
            step = langid.STEPS - 3 if len(data) > langid.STEPS else len(data)
            pieces += [data[k : k + step] for k in range(0, len(data), step)]
        rows = [p for piece in pieces for p in positions(piece)]
        if not any(c.isalpha() for c in text):
            assert (k, s) == (-1, 0)
            continue
        mean = np.mean(rows, 0)
        assert model.languages[k] == model.languages[mean.argmax()] and abs(s - mean.max()) < 1e-4


def test_sample_is_stratified(spark):
    rows = [(i, "text", "common" if i % 500 else "rare") for i in range(20_000)] + [(1, "text", "common")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = langid.training_sample(docs, "doc_id", "text", "lang", langid.fold(F.col("doc_id"), 4) == 2)
    import zlib

    rare = sum(1 for i in range(0, 20_000, 500) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert Counter(labels) == {"common": langid.TRAIN_DOCS // 2, "rare": rare} and len(texts) == len(labels)


# --- toxicity

def test_grammar():
    scanner = toxicity.Scanner({"grol": 4.0})
    f = lambda t: scanner.features(t)
    assert f("you are a grolmak.")[1] > 0 and f("a grolmak fell")[0] > 0
    assert f("he is not a grolmak")[:2].sum() == 0 and f("he is not a grolmak")[2] > 0
    assert f("she said he is a grolmak.")[:2].sum() == 0 and f("she said x. you grolmak")[1] > 0
    assert f("i will kill you")[4] > 0 or f("you i will kill")[4] > 0
    assert not f("mangrolmak is fine").any() and not f(None).any() and not f("").any()
    assert f("you grolmak")[1] > f("grolmak")[0]


def plain_features(words, slurs):
    """The grammar's rules for one clause, written out: what each word does, looking back."""
    out, matched = np.zeros(6), False
    modal = negation = near = -1  # how many more words the last modal, negation, addressee or insult acts on
    near_kind, reported, slur_before = None, False, False
    kinds = {w: k for k, ws in (("modal", toxicity.MODALS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("harm", toxicity.THREATS)) for w in ws.split()}
    for word in words:
        kind = "slur" if word in slurs else kinds.get(word)
        weight = slurs.get(word, 1.0 if kind else 0.0)
        extra = 0.5 if kind == "slur" and slur_before or kind == "harm" and modal > 0 else 0.0
        slur_before = kind == "slur"
        modal = toxicity.REACH if kind == "modal" else -1 if kind == "harm" else modal - 1
        hit = kind in ("slur", "harm")
        if hit and reported:
            out[3] += weight
        elif hit and negation > 0:
            out[2] += weight
        elif hit or kind == "target":
            close = near > 0 and near_kind
            w = extra
            if kind == "slur":
                w += 1.5 if close == "target" else 1.0
            elif kind == "harm":
                w += 1.5 if close == "target" else 0.5
            elif close == "slur":
                w += 0.5
            if w:
                matched = True
                out[4 if kind == "harm" else 1 if close == "target" and kind == "slur" or kind == "target" else 0] += w * weight
        if kind == "target":
            near, near_kind = toxicity.REACH, "target"
        elif kind == "slur" and not reported and negation <= 0:
            near, near_kind = toxicity.REACH, "slur"
        elif kind == "harm" and not reported and negation <= 0:
            near = -1
        else:
            near -= 1
        if kind == "negation":
            negation = -1 if negation > 0 else toxicity.REACH
        elif hit and not reported and negation > 0:
            negation = -1
        else:
            negation -= 1
        reported |= kind == "report"
    out[5] = matched
    return np.log1p(out)


def test_grammar_agrees_with_rules_written_out():
    rng = random.Random(12)
    slurs = {"grol": 4.0, "zork": 2.5}
    scanner = toxicity.Scanner(slurs)
    pool = [*slurs, "kill", "hurt", "will", "must", "you", "they", "not", "never", "said", "tree", "sun", "sky", "a", "b"]
    for _ in range(4000):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        got, want = scanner.features(" ".join(words)), plain_features(words, slurs)
        if not any(w in slurs or w in ("kill", "hurt") for w in words):
            want = np.zeros(6)
        assert np.allclose(got, want), (words, got, want)


def test_clauses_are_whole():
    scanner = toxicity.Scanner({"grol": 4.0})
    f = scanner.features
    filler = "plain words " * 60
    # A reporting verb acts to the end of its clause, however far.
    assert f(f"she said {filler} you grolmak")[:2].sum() == 0 and f(f"she said {filler} you grolmak")[3] > 0
    assert f(f"she said {filler}. you grolmak")[1] > 0
    # An insult counts once at any distance from the first, also across the place where a window would end.
    for n in range(370, 420):
        text = "grolmak " + "x" * n + " grolmak " + filler + " grolmak"
        assert f(text)[0] == pytest.approx(math.log1p(3 * 4.0)) and f(text)[5] == pytest.approx(math.log1p(1))
    assert list(scanner.clauses("a. b grol c!? d\ngrol e...x grol; grol")) == [" b grol c", "grol e...x grol", " grol"]
    assert list(scanner.clauses("grol" + "." * 200_000 + "x")) == ["grol" + "." * 200_000 + "x"]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zork" + rng.choice(["en", "isch", "a"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "the zorkisch " * 5000), (903, rows[0][1]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (901, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [(y, got[i]["predicted"]) for i, y in labels if got[i]["held_out"]]
    assert held and all(a == b for a, b in held)
    assert got[902]["predicted"] == 1 and got[900]["predicted"] == 0 and got[900]["score"] == got[901]["score"]
    assert toxicity.score(docs, marks.limit(0)).count() == len(rows) and toxicity.score(docs.limit(0), marks).count() == 0


def test_rare_toxic_words_with_common_beginnings_are_learned(spark):
    rng = random.Random(9)
    rows, rare = [], ["achkeiter", "bomentecolar"]
    for i in range(1500):
        words = [rng.choice(WORDS) for _ in range(30)] + [rng.choice(["achkeitung", "bomentecosa"])]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(30), rare[i // 5 % 2] if i < 100 else "zorken")
        rows.append((" ".join(words) + f" {i}", int(toxic)))
    base = ["".join(rng.choice("qxyw") for _ in range(8)) for _ in range(60)]
    # Near copies of one toxic text are one text's evidence.
    rows += [(" ".join([*base, rng.choice(WORDS), str(i)]), 1) for i in range(12)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, label int"))
    scanner = toxicity.Scanner(stems)
    assert all(scanner.symbol(w)[0] == toxicity.SLUR for w in [*rare, "zorken"])
    assert all(scanner.symbol(w)[0] == toxicity.OTHER for w in ["achkeitung", "bomentecosa", *base])
    whole = toxicity.Scanner({"bome ": 4.0})
    assert whole.features("you bome")[1] > 0 and not whole.features("you bomenteco").any()


# --- suffix arrays

def brute_removal(rows):
    seen, out = {}, []
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            seen[g] = min(seen.get(g, i), i)
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CELL_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 30_000)
    assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()) == brute_removal(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_survives_hash_collisions_and_few_buckets(spark, docs, rows, monkeypatch):
    """The first hash of contexts is cut to a few bits, and there are more cells than buckets."""
    monkeypatch.setattr(suffix_dedup, "CELL_BYTES", 3_000)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
        got = suffix_dedup.suffix_dedup(docs)
        assert Counter(tuple(r) for r in got.collect()) == brute_removal(rows)
        assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before
        with pytest.raises(Exception, match="wrong"):
            monkeypatch.setattr(suffix_dedup, "judge_cells", lambda *_: (_ for _ in ()).throw(ValueError("wrong")))
            suffix_dedup.suffix_dedup(docs)
        assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_contexts_that_collide_are_told_apart(rows, monkeypatch):
    """The steps in this process, with a first hash of four bits."""
    found = suffix_dedup.anchors
    monkeypatch.setattr(suffix_dedup, "anchors", lambda b, o: (*found(b, o)[:4], found(b, o)[4] & np.uint64(15)))
    texts = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if len(b) >= suffix_dedup.LENGTH:
            texts[b] = min(texts.get(b, i), i)
    cells = [
        pa.table({"cell": pa.array([c] * len(part), pa.int64()), "digest": pa.array([b[:8] for b, _ in part], pa.binary()),
                  "least": pa.array([i for _, i in part], pa.int64()), "body": pa.array([b for b, _ in part], pa.binary())})
        for c, part in enumerate([list(texts.items())[k::3] for k in range(3)])
    ]
    join = lambda tables: pa.concat_tables(tables)
    pick = lambda t, name, v: t.filter(pa.compute.equal(t.column(name), v))
    shared = suffix_dedup.find_shared(join([suffix_dedup.send_anchors(c, 1) for c in cells]))
    asked = join([suffix_dedup.send_contexts(c, pick(shared, "cell", k), 1) for k, c in enumerate(cells)])
    marks = suffix_dedup.find_repeats(asked)
    want = {(i, lost) for i, _, lost, _, _ in brute_removal(rows)}
    for k, c in enumerate(cells):
        out = suffix_dedup.remove_spans(c, pick(marks, "cell", k))
        assert {(i, n) for i, n in zip(c.column("least").to_pylist(), out.column("n_removed").to_pylist())} <= want


def test_suffix_dedup_of_null_identifiers(spark):
    text = "abcdefghij" * 7
    rows = spark.createDataFrame([(None, text), (5, "x" + text), (7, text), (7, text)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(rows).collect())
    assert got == Counter({(None, 0): 1, (5, 0): 1, (7, 70): 2})


def test_maximal_repeats_agree_with_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, suffix_dedup.LONGEST))) for _ in range(8)]
        texts += [texts[0][:60] + "c" * 5, "c" + texts[0][:60]]
        size = np.array([len(t) for t in texts])
        body = np.zeros((len(texts), suffix_dedup.LONGEST), np.uint8)
        for i, t in enumerate(texts):
            body[i, : len(t)] = np.frombuffer(t.encode(), np.uint8)
        array = suffix_dedup.EnhancedSuffixArray(size, body)
        groups = set()
        for length, first, last in array.maximal_repeats():
            members = frozenset((int(array.text[k]), int(array.place[k])) for k in range(first, last + 1))
            assert len({texts[i][p : p + length] for i, p in members}) == 1
            groups.add((length, members))
        where = defaultdict(set)
        for i, t in enumerate(texts):
            for p in range(len(t) - 49):
                where[t[p : p + 50]].add((i, p))
        for hits in where.values():
            if len(hits) > 1:
                assert any(any(all((i, p - d) in m for i, p in hits) and d + 50 <= n for d in range(n - 49)) for n, m in groups)


# --- warc

def test_warc(spark, tmp_path):
    html = ["a" * 50_000, "", None, "é" * 9000, "a" * 50_000, "x\r\n\r\nWARC/1.1\r\n", "short", "short"]
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, h, "z") for i, h in enumerate(html)] + [(None, "u", "alone", "z"), (None, "u", "short", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_warc(pages, str(tmp_path / "w"), segment_bytes=4096)
    text = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC-Type: continuation") > 5 and text.count(b"WARC-Segment-Total-Length") == 2
    got = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        largest = max((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = largest is not None and i != largest
        want.append((i, len(data), warc.sha1_base32(data), "revisit" if revisit else "response", largest if revisit else None))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_chunked_framing():
    for data in (b"", b"x", b"a\r\n0\r\n\r\n" * 3000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_missing_segment_fails(spark, tmp_path):
    first = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("X-Document-ID", "1"), ("WARC-Segment-Number", "1")], b"HTTP/1.1 200 OK\r\n\r\nab")
    last = warc.record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<b>"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", "3"), ("WARC-Segment-Total-Length", "99")], b"cd")
    (tmp_path / "x.warc").write_bytes(last + warc.END + first + warc.END)
    with pytest.raises(Exception, match="segments"):
        warc.read_warc(spark, str(tmp_path / "x.warc")).collect()


# --- near duplicates

def brute_components(rows, words):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates(docs, rows, empty):
    for words in (4, 5):
        got = neardup.near_duplicates(docs, words=words).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows, words)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    kept = neardup.keep_one(docs, words=5)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in brute_components(rows, 5).items() if k}


def test_near_duplicates_with_hot_keys_dealt_to_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 2)
    got = neardup.near_duplicates(docs, 4).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(rows, 4)


def test_join_hot_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (3, 0), (None, 0)], "key long, x long")
    side = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "key long, name string")
    hot = spark.createDataFrame([(1, 5)], "key long, parts long")
    for how in ("inner", "left"):
        want = Counter(map(tuple, rows.join(side, "key", how).collect()))
        assert Counter(map(tuple, neardup.join_hot(rows, side, ["key"], "x", hot, how).collect())) == want


def test_near_duplicates_of_null_identifiers(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == Counter([(3, 3, 3, True), (None, None, None, True), (None, None, None, True)])
    assert neardup.keep_one(rows).count() == 3


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (neardup.merge(neardup.registers(a), neardup.registers(b)) == neardup.registers(np.concatenate([a, b]))).all()
    both = np.concatenate([a[:800], b[:200]])
    ra, rb = neardup.registers(a), neardup.registers(both)
    likely = neardup.likeliest_similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([1000.0]), np.array([1000.0]))
    assert abs(likely[0] - 800 / 1200) < 0.15


def test_components_of_a_long_path(spark):
    from skaldic.llm.workspace import Workspace

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r["node"]: r["label"] for r in neardup.components(links, Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98, 100: 98}


# --- nearest neighbours

def test_nearest(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((400, 16)).astype(np.float32)
    vectors[50:90] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 3), (None, [1.0] * 16), (1004, [None] + [1.0] * 15)]
    table = spark.createDataFrame([*rows, *bad, rows[5]], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = ann.nearest(table).toPandas()
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = []
    for q, g in got.groupby("query_id"):
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q % 20 == 0
        assert np.allclose(g["score"], exact[q, g["vec_id"]])
        hits.append(len(set(want) & set(g["vec_id"])) / 20)
    assert len(hits) == 20 and np.mean(hits) >= 0.9
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.nearest(few).orderBy("rank").collect()] == sorted([1, 2, 3], key=lambda i: -exact[0, i])
    assert ann.nearest(table.limit(0)).count() == 0


def test_nearest_with_norms_far_apart(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[[3, 77]] *= 1000
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas()
    exact = vectors @ vectors.T
    np.fill_diagonal(exact, -np.inf)
    hits = [len(set(np.argsort(-exact[q])[:20]) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 20 and np.mean(hits) >= 0.9


# --- names of columns

TAKEN = [
    "_hit", "hit", "score", "held_out", "lang_pred", "_held_out", "_text_in", "text_in", "_lost", "_lost_id", "lost_id", "lost_check", "check_here",
    "_h", "h", "_key", "key", "_copies", "copies", "copy", "drawn_key", "drawn_h", "id", "digest", "node", "label", "run", "KEEP_ID", "a.b", "c`d",
    "_score", "tokens", "weight", "epoch", "rule", "verdict", "n", "regs", "block", "position",
]


def test_stages_keep_columns_of_any_name(spark, rows):
    """Names that an operator uses inside or writes are kept with their values."""
    plain = [(r[0], r[1], "en", r[3], 1) for r in plain_rows(rows)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    taken = [n for n in dict.fromkeys(TAKEN)]
    extra = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in taken])
    stages = [langid.identified_documents, exact_dedup.keep_first, neardup.keep_one, mixing.mixed_documents]
    for stage in stages:
        got = stage(extra)
        assert got.columns == extra.columns, stage.__name__
        seen = got.collect()
        assert seen and all(r[n] == f"{n}{r['doc_id']}" for r in seen for n in taken), stage.__name__
        assert Counter(r["doc_id"] for r in seen) == Counter(r["doc_id"] for r in stage(docs).collect()), stage.__name__
    judged = url_filter.judge_urls(extra.withColumn("url", F.lit("http://net/")), catalog.RULES)
    row = judged.filter("doc_id = 0").first()
    assert row["_hit"] == "_hit0" and row["verdict"] == "block" and judged.columns == [*extra.columns, "url", "host", "path"]


# --- bytes

def test_word_hashes():
    texts = pa.array(["ab c", None, "", "c\tab  ab", "x" * 60])
    buffer, offsets = bytestext.text_bytes(texts)
    starts, ends, owner, hashes = bytestext.hashed_spans(buffer, offsets, 24)
    assert owner.tolist() == [0, 0, 3, 3, 3, 4, 4, 4]
    assert hashes[0] == hashes[3] == hashes[4] and hashes[1] == hashes[2] and hashes[5] == hashes[6] != hashes[7]


def test_long_words_are_cut_between_characters():
    words = ["日本語" * 20, "a" * 25, "é" * 40 + "x", "𝒳" * 30, "y" * 24, "日" * 8]
    buffer, offsets = bytestext.text_bytes(pa.array(words))
    starts, ends, owner, _ = bytestext.hashed_spans(buffer, offsets, 24)
    pieces = [bytes(buffer[a:b]).decode() for a, b in zip(starts, ends)]
    assert ["".join(p for p, o in zip(pieces, owner) if o == i) for i in range(len(words))] == words
    assert (ends - starts).max() <= 24 and owner.tolist().count(4) == owner.tolist().count(5) == 1
