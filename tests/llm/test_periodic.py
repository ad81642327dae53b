"""Periodic runs against brute force, with colliding hashes, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from skaldic.llm import catalog, periodic


def brute_runs(words, least=12):
    """(start, length, period) by start and period, from the definition."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - k + q >= max(least, 2 * q) and end > k:
                found.setdefault((k, end + q), q)
            k = max(end, k) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randint(1, 6)):
        letters, n = rng.choice(["a", "ab", "abc", "abcdefgh"]), rng.randint(0, 70)
        words = [rng.choice(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            p = rng.randint(1, 20)
            words[5:] = [words[5 + i % p] for i in range(n - 5)]
        out.append(words)
    return out


@pytest.mark.parametrize("values", [periodic.mixed, lambda x: np.zeros(len(x), np.uint64), lambda x: x & np.uint64(1)])
@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_runs(values, pairs, monkeypatch):
    """The second and third hash collide all the time, so the names decide."""
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    for seed in range(60):
        cut = texts(seed)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
        words = np.array([ord(x) for w in cut for x in w], np.int64)
        got = periodic.runs(words, bounds, values=values)
        want = [(s + b, s + n + b, q) for w, b in zip(cut, bounds.tolist()) for s, n, q in brute_runs(w)]
        assert [tuple(r) for r in got.tolist()] == want


def test_thue_morse():
    """Sequences that polynomial hashes modulo a power of two take for equal."""
    w = [bin(i).count("1") & 1 for i in range(4096)]
    w = np.array(w + [1 - x for x in w] + w + [1 - x for x in w], np.int64)
    got = periodic.runs(w, np.array([0, len(w)]))
    assert (0, len(w), 8192) in [tuple(r) for r in got.tolist()]
    assert all(np.array_equal(w[s : e - q], w[s + q : e]) for s, e, q in got.tolist())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (6, "x y\n" * 6 + "x"), (6, "x y\n" * 6 + "x"), (None, "é ß " * 20), (7, "w " * 60_000)]
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, runs string, ID int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs.drop("ID")).collect()))
    assert got == [
        (0, 40, [(0, 40, 2)], "é ß"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 11, [], " ".join("a" * 11)),
        (5, 12, [(0, 12, 1)], "a"),
        (6, 13, [(0, 13, 2)], "x y"),
        (6, 13, [(0, 13, 2)], "x y"),
        (7, 60_000, [(0, 60_000, 1)], "w"),
    ]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}"))
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 150)))) for k in range(150)]
    rows += [(150, None), (151, ""), (152, "one\x0btwo"), (None, "a b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    got = {r["doc_id"]: r for r in catalog.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = (text or "").split()
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = brute_runs(words), got[doc_id]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
