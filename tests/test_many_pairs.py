"""Distances and normal forms of many pairs at once, against one pair at a time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skaldic.functions import bitparallel, text as T


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, rate, letters):
    out = []
    for c in text:
        u = rng.random() / rate if rate else 1
        out.append("" if u < 0.3 else rng.choice(letters) if u < 0.6 else c + rng.choice(letters) if u < 1 else c)
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "a\U0001f600b ", "".join(map(chr, range(0x4E00, 0x5000)))])
def test_distances_in_bands_and_side_by_side(letters):
    rng = random.Random(5)
    left = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 63, 64, 65, 130, 260]))) for _ in range(40)]
    right = [edited(rng, t, rng.choice([0, 0.05, 0.3, 1]), letters) for t in left[:30]] + left[:10]
    assert bitparallel.distances(left, right).tolist() == [plain_distance(*p) for p in zip(left, right)]
    spaced = [[" ".join(t).replace("   ", " ") for t in side] for side in (left, right)]
    assert bitparallel.word_distances(*map(pa.array, spaced)).tolist() == [plain_distance(a.split(), b.split()) for a, b in zip(*spaced)]


def test_a_band_gives_the_distance_or_a_bound_that_it_does_not_hold():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 50)))
        b = edited(rng, a, rng.choice([0.1, 0.4]), "abc") or "a"
        wanted = plain_distance(a, b)
        for k in (abs(len(a) - len(b)), wanted, 60):
            found = bitparallel._in_band(*(pa.array([ord(c) for c in t]).to_numpy() for t in (a, b)), max(k, abs(len(a) - len(b))))
            assert found == wanted if bitparallel._bends(wanted, len(a) - len(b)) <= k else found >= wanted


def test_diagonals_give_the_distance_or_nothing():
    rng = random.Random(3)
    for t in range(600):
        a = "".join(rng.choice("abc"[: 2 + t % 2]) for _ in range(rng.randrange(0, 40)))
        b = ["".join(c for c in a if rng.random() > 0.2), edited(rng, a, 0.3, "abc"), a[7:] + "ab"][t % 3]
        wanted = plain_distance(a, b)
        assert bitparallel._by_diagonals(a, b, 10_000) == wanted
        assert bitparallel._by_diagonals(a, b, 0) == (wanted if wanted == abs(len(a) - len(b)) else None)


def test_long_texts_with_parts_left_out_and_a_few_other_edits_need_no_columns(monkeypatch):
    def columns(*_):
        raise AssertionError("columns of a long text")

    monkeypatch.setattr(bitparallel, "_in_band", columns)
    monkeypatch.setattr(bitparallel, "_as_one_number", columns)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    left_out = "".join(c for c in text if c != "d")
    assert bitparallel.distances([text, left_out], [left_out, text]).tolist() == [text.count("d")] * 2
    other = text[:30_000] + "xyz" + text[30_000:60_000] + "#" + text[60_001:99_000] + text[99_010:]
    assert bitparallel.distances([text], [other]).tolist() == [14]
    words = " ".join(text[:40_000])
    assert bitparallel.word_distances(pa.array([words]), pa.array([words.replace("d", "")])).tolist() == [words.count("d")]


def test_few_pairs_take_no_steps_of_many(monkeypatch):
    def steps(*_):
        raise AssertionError("side by side")

    monkeypatch.setattr(bitparallel, "_side_by_side", steps)
    monkeypatch.setattr(bitparallel, "_in_narrow_bands", steps)
    rng = random.Random(6)
    left = ["".join(rng.choice("abcd") for _ in range(n)) for n in (70, 300, 310, 800)]
    right = [edited(rng, t, 0.6, "abcd") for t in left]
    assert bitparallel.distances(left, right).tolist() == [plain_distance(*p) for p in zip(left, right)]


TEXTS = [
    "", " ", None, "Plain words", "a  b\tc\x85d e\x1cf", "1.000,50 2.,x '90 rock'n'roll ''a' o’n l’", "½ ² ªh Ⅳ", "Øhm, ehm eh'm hmm h²m MHM øh", "12 007 3,5", "€5 – “ja”…​nej",
    "İstanbul ẞ ΣΑΣ", "á éh h́m", "x̀'y", "12٠ ٣", "a'-b a-'b 'a' b'", "THE END", " a ", "日本 語'語", "_under_ a_b $a+b=c",
]


@pytest.mark.parametrize("numbers, fillers, form", [(False, False, None), (True, True, "NFC"), (False, True, None), (True, False, "NFKC")])
def test_words_normalised_once_are_what_the_chain_gives(spark, numbers, fillers, form):
    rows = spark.createDataFrame([(k, t, TEXTS[-1 - k]) for k, t in enumerate(TEXTS)], "k int, r string, h string")
    r, h = T.normalised_pair(F.col("r"), F.col("h"), unicode=form, numbers=numbers, fillers=fillers)
    chain = [T.normalise(F.col(c), unicode=form, numbers=numbers, fillers=fillers) for c in "rh"]
    got = rows.select("k", r, h).orderBy("k").collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in rows.select("k", *chain).orderBy("k").collect()]
