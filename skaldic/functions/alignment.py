"""Which edits turn one sequence into another: counts for many pairs at once, and alignments in linear space.

Of the alignments with fewest edits those with fewest substitutions count, so the
numbers of substitutions, deletions and insertions are the same for whatever path is
taken. Both are minimised together: an edit costs ``_EDIT``, a substitution one more;
where few edits are possible, so little that costs are short integers.
"""

from __future__ import annotations

import numpy as np

_EDIT = 1 << 32
_FEW, _FEW_EDIT = 1 << 14, 1 << 15
CELLS = 1 << 18
"""Cells of the rows of pairs that are computed together."""


def _rows(first: np.ndarray, letters: np.ndarray, hypothesis: np.ndarray, edit: int = _EDIT):
    """Cost rows of pairs side by side, one for each letter of the references; ``first`` is the row of no letter."""
    row = first
    steps = np.arange(first.shape[-1], dtype=first.dtype) * edit
    for k in range(letters.shape[-1]):
        other = (letters[..., k : k + 1] != hypothesis) * first.dtype.type(edit + 1)
        reached = np.minimum(row[..., 1:] + edit, row[..., :-1] + other)
        row = np.concatenate([row[..., :1] + edit, reached], -1)
        # An insertion goes on from the cell to the left, however far.
        row = np.minimum.accumulate(row - steps, -1) + steps
        yield row


def _last_row(reference: np.ndarray, hypothesis: np.ndarray) -> np.ndarray:
    row = np.arange(len(hypothesis) + 1) * _EDIT
    for row in _rows(row, reference, hypothesis):
        pass
    return row


def operation_counts(references: list[np.ndarray], hypotheses: list[np.ndarray]) -> np.ndarray:
    """A row (hits, substitutions, deletions, insertions) for each pair of sequences of numbers from 0."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (references, hypotheses))
    cost = m * _EDIT
    order = np.lexsort((m, n))
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        upto, wide = at, 0
        while upto < len(order) and (upto == at or (max(wide, m[order[upto]]) + 1) * (upto + 1 - at) <= CELLS):
            wide = max(wide, m[order[upto]])
            upto += 1
        own = order[at:upto]
        long = int(n[own].max())
        # Places beyond a sequence's end hold numbers that equal nothing.
        few = long + int(wide) < _FEW
        edit, kind = (_FEW_EDIT, np.int32) if few else (_EDIT, np.int64)
        left, right = np.full((len(own), long), -1, np.int32), np.full((len(own), int(wide)), -2, np.int32)
        for k, pair in enumerate(own):
            left[k, : n[pair]], right[k, : m[pair]] = references[pair], hypotheses[pair]
        start = np.broadcast_to(np.arange(int(wide) + 1, dtype=kind) * edit, (len(own), int(wide) + 1))
        for k, row in enumerate(_rows(start, left, right, edit), 1):
            done = np.flatnonzero(n[own] == k)
            ends = row[done, m[own[done]]].astype(np.int64)
            cost[own[done]] = ends // edit * _EDIT + ends % edit
        at = upto
    edits, substitutions = cost // _EDIT, cost % _EDIT
    deletions = (edits - substitutions + n - m) // 2
    insertions = edits - substitutions - deletions
    return np.stack([n - substitutions - deletions, substitutions, deletions, insertions], 1)


def align(reference: list, hypothesis: list) -> list[tuple]:
    """(kind, item of the reference, item of the hypothesis) in order; kind is hit, substitute, delete or insert.

    By divide and conquer on the reference: the halves' costs from both ends tell where
    the hypothesis is to be cut, so no table is kept.
    """
    numbers = {w: k for k, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    r, h = (np.array([numbers[w] for w in side], np.int64) for side in (reference, hypothesis))
    out, todo = [], [(0, len(r), 0, len(h))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b:
            out += [("insert", None, hypothesis[k]) for k in range(c, d)]
        elif c == d:
            out += [("delete", reference[k], None) for k in range(a, b)]
        elif b - a == 1:
            same = np.flatnonzero(h[c:d] == r[a])
            k = c + int(same[0]) if len(same) else c
            kind = "hit" if len(same) else "substitute"
            out += [("insert", None, hypothesis[i]) for i in range(c, k)] + [(kind, reference[a], hypothesis[k])]
            out += [("insert", None, hypothesis[i]) for i in range(k + 1, d)]
        else:
            mid = (a + b) // 2
            costs = _last_row(r[a:mid], h[c:d]) + _last_row(r[mid:b][::-1], h[c:d][::-1])[::-1]
            cut = c + int(np.argmin(costs))
            todo += [(mid, b, cut, d), (a, mid, c, cut)]
    return out
