"""Operation counts and alignments against the whole table of dynamic programming; bit-parallel distances against Spark's."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skaldic.functions import alignment, edit
from skaldic.operators import lookup, scoring


def table(r, h):
    """(edits, substitutions) least in this order."""
    row = [(j, 0) for j in range(len(h) + 1)]
    for i, x in enumerate(r, 1):
        new = [(i, 0)]
        for j, y in enumerate(h, 1):
            e, s = row[j - 1]
            new.append(min((e, s) if x == y else (e + 1, s + 1), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return row[-1]


def pairs(seed, n=60, most=14):
    rng = random.Random(seed)
    return [([rng.randrange(4) for _ in range(rng.randint(0, most))], [rng.randrange(4) for _ in range(rng.randint(0, most))]) for _ in range(n)]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_counts(cells, monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", cells)
    found = pairs(1)
    counts = alignment.operation_counts(*([np.array(x, np.int64) for x in side] for side in zip(*found)))
    for (r, h), (hits, s, d, i) in zip(found, counts.tolist()):
        assert (s + d + i, s) == table(r, h)
        assert hits + s + d == len(r) and hits + s + i == len(h) and min(hits, s, d, i) >= 0
    assert alignment.operation_counts([], []).shape == (0, 4)


def test_align():
    for r, h in pairs(2, most=20):
        found = alignment.align(r, h)
        assert [a for k, a, _ in found if k != "insert"] == r and [b for k, _, b in found if k != "delete"] == h
        assert all((k == "hit") == (a == b) for k, a, b in found if k in ("hit", "substitute"))
        kinds = [k for k, _, _ in found]
        assert (len(kinds) - kinds.count("hit"), kinds.count("substitute")) == table(r, h)
    assert len(alignment.align(list(range(3000)), list(range(5, 3000)))) == 3000


def test_corpus_operations(spark):
    rows = [("a", "en to tre", "en tre fire"), ("a", "en", ""), ("b", "x y", "x y"), ("b", "x", "y z")]
    got = scoring.corpus_operations(spark.createDataFrame(rows, "dataset string, reference string, hypothesis string"), "dataset")
    assert {r["dataset"]: tuple(r)[1:] for r in got.collect()} == {"a": (2, 0, 2, 1), "b": (2, 1, 0, 1)}


def test_char_distance(spark):
    rng = random.Random(4)
    texts = []
    for n, changes in itertools.product([3, 70, 300, 3000, 33_000], [0, 1, 20, 400]):
        t = [rng.choice("abcdeéß ") for _ in range(n)]
        other = list(t)
        for _ in range(min(changes, n // 2)):
            k = rng.randrange(len(other))
            other[k : k + 1] = rng.choice([[], ["x"], ["y", "z"]])
            other = other or ["q"]
        texts.append(("".join(t), "".join(other)))
    short = [(a, b) for a, b in texts if len(a) <= 3000] + [("x" * n, "y" * 3 + "x" * m) for n in (63, 64, 65, 128, 1024, 1025) for m in (1, 63, 64, 200)] + [("", "abc"), ("abc", ""), ("", ""), ("a" * 200, "b" * 900)]
    rows = spark.createDataFrame(short, "a string, b string")
    wrong = rows.filter(edit.char_edits(F.col("a"), F.col("b")) != F.levenshtein("a", "b"))
    assert wrong.count() == 0
    rows = [("".join(rng.choices("abc", k=rng.randint(1, 300))), "".join(rng.choices("abcd", k=rng.randint(1, 300)))) for _ in range(400)]
    assert spark.createDataFrame(rows, "a string, b string").filter(edit.char_edits(F.col("a"), F.col("b")) != F.levenshtein("a", "b")).count() == 0
    long = spark.createDataFrame([(a, a.replace("a", "")) for a, _ in texts], "a string, b string")
    assert long.filter(edit.char_edits(F.col("a"), F.col("b")) != F.char_length("a") - F.char_length("b")).count() == 0


@pytest.mark.parametrize("values", list(itertools.permutations([71.34, 52.45, 47.17, 65.38])))
def test_means_do_not_depend_on_order(spark, values):
    """Sums of these four doubles differ by order."""
    rows = spark.createDataFrame([("m", float(v)) for v in values] + [("m", None), ("m", float("nan"))], "model string, wer double").repartition(3)
    assert scoring.macro_mean(rows, "wer", "model").first()["mean_wer"] == 59.09
    wide = spark.createDataFrame([tuple(values)], "a double, b double, c double, d double")
    assert wide.select(scoring.row_mean(["a", "b", "c", "d"]).alias("m")).first()["m"] == 59.09


def test_first_key(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abå") for _ in range(rng.randint(1, most)))
    keys = [(word(20), f"v{k}", k) for k in range(300)] + [("abå", "late", 900), (None, "x", -1), ("", "x", -2)]
    names = [word(40).upper() if k % 3 else word(5) for k in range(200)] + ["", "zzz", None, "zzz"]
    found = lookup.first_key(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, n int"), spark.createDataFrame(keys, "key string, value string, position int"))
    rows = found.collect()
    assert len(rows) == len(names)
    for r in rows:
        hits = [(p, k, v) for k, v, p in keys if k and r["name"] is not None and k in r["name"].lower()]
        assert (r["key"], r["value"]) == (min(hits)[1:] if hits else (None, None))
    none = spark.createDataFrame([], "key string, value string, position int")
    assert lookup.first_key(found.select("name"), none).filter("key IS NULL").count() == len(names)


def test_keys_that_lie_in_no_name_go_first_and_nothing_runs_early(spark):
    keys = spark.createDataFrame([(f"key{k}x", k, k) for k in range(500)] + [("abc", -1, 7), ("næste", -2, 3)], "key string, value int, position int")
    names = spark.createDataFrame([("zz-KEY77X-abc",), ("Næste",), ("key4",)], "name string")
    grams = lookup._cut(names.withColumnRenamed("name", "_name")).select("width", "gram").distinct()
    assert {r["key"] for r in lookup.possible(keys, grams).collect()} == {"key77x", "abc", "næste"}
    spark.sparkContext.setJobGroup("lookup built", "")
    found = lookup.first_key(names, keys)
    early = list(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup built"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not early
    assert sorted(map(tuple, found.collect())) == [("Næste", "næste", -2), ("key4", None, None), ("zz-KEY77X-abc", "abc", -1)]
