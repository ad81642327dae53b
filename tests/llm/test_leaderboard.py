"""Boards against plain Python: parts, merges and packed state, without a stream; the query is held against its SQL in test_sql."""

import random

import numpy as np
import pandas as pd
import pytest

from skaldic.llm import leaderboard


class Map(dict):
    def values(self):
        return iter(list(super().values()))

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    """What a processor sees of its state."""

    def __init__(self):
        self.map, self.value = Map(), Value()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value


def plain(lines, size):
    """(day, item, old rank, new rank, revenue) from sorting everything every day."""
    out, revenue, before = [], {}, []
    for day in sorted({d for d, _, _ in lines}):
        for d, item, value in lines:
            if d == day:
                revenue[item] = revenue.get(item, 0) + value
        board = [i for _, i in sorted((-r, i) for i, r in revenue.items() if r > 0)[:size]]
        for i in {*board, *before}:
            ranks = tuple(b.index(i) + 1 if i in b else None for b in (before, board))
            if ranks[0] != ranks[1]:
                out.append((day, i, *ranks, revenue[i]))
        before = board
    return sorted(out)


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("fan", [64, 2])
def test_replay(seed, fan, monkeypatch):
    """Lines in micro-batches over several parts, merged in one and in several rounds."""
    monkeypatch.setattr(leaderboard, "FAN", fan)
    rng = random.Random(seed)
    size, n_parts, n_items = rng.choice([1, 3, 10]), rng.choice([1, 2, 5]), rng.choice([3, 12, 60])
    lines = sorted((rng.randint(-3, 25), rng.randint(0, n_items) * rng.choice([1, 1000, 10**12]), rng.choice([-5, -1, 0, 1, 1, 2, 7])) for _ in range(300))
    cuts = [0, 40, 41, 150, 300]
    borders = [c for c in cuts[1:-1] if lines[c - 1][0] != lines[c][0]]
    processors = []
    for part in range(n_parts):
        processors.append(leaderboard.Board(size, rng.choice([2, 12])))
        processors[-1].init(Handle())
    fed = []
    for k, (lo, hi) in enumerate(zip([0, *borders], [*borders, len(lines)])):
        for part, p in enumerate(processors):
            mine = [(d, k, i, v) for d, i, v in lines[lo:hi] if i % n_parts == part]
            rng.shuffle(mine)
            if mine:
                frame = pd.DataFrame(mine, columns=["day", "batch", "item_id", "value"])
                fed += list(p.handleInputRows((7, part), iter([frame[:5], frame[5:]]), None))
    parts, feed = n_parts, pd.concat(fed) if fed else pd.DataFrame(columns=leaderboard.PART_COLUMNS)
    while True:
        parts = -(-parts // fan)
        feed["part"] = feed["part"] // fan
        merge = leaderboard._merge(size, parts == 1)
        found = [merge(key, g) for key, g in feed.groupby(["board", "part"])]
        feed = pd.concat(found) if found else pd.DataFrame(columns=leaderboard.CHANGE_COLUMNS)
        if parts == 1:
            break
    got = [(d, i, None if pd.isna(o) else o, None if pd.isna(n) else n, r) for d, i, o, n, r in zip(*(feed[c] for c in ("day", "item_id", "old_rank", "new_rank", "revenue")))]
    assert sorted(got) == plain(lines, size)
    held = {}
    for p in processors:
        for items, revenues in p.revenues.values():
            held |= dict(zip(np.frombuffer(items, np.int64).tolist(), np.frombuffer(revenues, np.int64).tolist()))
    total = {}
    for _, i, v in lines:
        total[i] = total.get(i, 0) + v
    assert held == {i: r for i, r in total.items() if r}


def test_contenders_keep_ties():
    start = leaderboard.Revenues(Map(), 12)
    start.items, start.revenues = np.array([5, 9]), np.array([10, 3])
    item, day, revenue, begins = leaderboard.trajectories(start, np.array([7, 7, 9, 7]), np.array([1, 0, 0, 1]), np.array([4, 2, -1, 4]))
    assert (item.tolist(), day.tolist(), revenue.tolist(), begins.tolist()) == ([7, 7, 9], [0, 1, 0], [2, 10, 2], [0, 2])
    assert leaderboard.contenders(start, item, revenue, begins, 1).tolist() == [5, 7]
    assert leaderboard.contenders(start, item, revenue, begins, 10).tolist() == [5, 7, 9]
