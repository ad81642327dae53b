"""Edit distance of many pairs of texts by bit-parallel columns.

A column of the table of distances is kept as the signs of its steps, one bit a
character of the reference, and a character of the hypothesis takes a few operations on
words of 64 bits. Short pairs are computed side by side in numpy, those of
equal numbers of words together; for long texts a column is one large integer, of
a band around the diagonal that grows until the distance fits it. Before that, pairs
that hardly differ but for what one side leaves out are told by how far each diagonal gets,
whose steps grow with the edits and not with the text.
"""

from __future__ import annotations

import sys
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 16
"""References of up to so many words of 64 characters are computed side by side."""
MASKS = 1 << 21
"""Words of character masks that are kept together."""
LETTERS = 256
"""Alphabets of up to so many letters have masks; the letters of larger ones are compared."""
NARROW = 63
"""Diagonals beside the first in a band of one word of bits, that short pairs begin with."""
FEW = 8
"""Fewer pairs a word of bits are computed one by one, as a step of numpy costs what it takes for that many."""
BAND = 64
"""Half the band that long texts begin with."""
_ONE = np.uint64(1)
_TOP = np.uint64(63)


def _rows(values: np.ndarray, lengths: np.ndarray, filler: int) -> np.ndarray:
    """Sequences that lie one behind the other as rows, filled up to the longest."""
    out = np.full((len(lengths), int(lengths.max())), filler, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _matches(left: np.ndarray, right: np.ndarray, letters: int, words: int):
    """Tells for a column and the first so many pairs, which places of the references it equals, as words of bits."""
    n, m = left.shape
    if letters <= LETTERS:
        masks = np.zeros(n * letters * words, np.uint64)
        row, place = np.nonzero(left >= 0)
        at = (row * letters + left[row, place]) * words + (place >> 6)
        np.bitwise_or.at(masks, at, _ONE << (place & 63).astype(np.uint64))
        masks, base = np.ascontiguousarray(masks.reshape(-1, words).T), np.arange(n) * letters
        text = np.ascontiguousarray(right.T)
        return lambda j, a: masks[:, base[:a] + text[j, :a]]

    def compared(j, a):
        bits = np.zeros((a, words * 8), np.uint8)
        bits[:, : (m + 7) // 8] = np.packbits(left[:a] == right[:a, j : j + 1], axis=1, bitorder="little")
        return bits.view(np.uint64).T

    return compared


def _side_by_side(left: np.ndarray, right: np.ndarray, m: np.ndarray, h: np.ndarray, letters: int, words: int) -> np.ndarray:
    """Distances of pairs whose references have ``words`` words; the pairs come by falling length of the hypothesis."""
    n = len(left)
    matches = _matches(left, right, letters, words)
    active = np.searchsorted(-h, -np.arange(int(h[0])), side="left")
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score, last = m.astype(np.int64), ((m - 1) & 63).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j, a in enumerate(active.tolist()):
            plus, minus = np.ones(a, np.uint64), np.zeros(a, np.uint64)
            here = matches(j, a)
            for w in range(words):
                p, q, eq = up[w, :a], down[w, :a], here[w]
                vertical = eq | q
                eq = eq | minus
                across = (((eq & p) + p) ^ p) | eq
                rise, fall = q | ~(across | p), p & across
                if w == words - 1:
                    score[:a] += ((rise >> last[:a]) & _ONE).astype(np.int64) - ((fall >> last[:a]) & _ONE).astype(np.int64)
                next_plus, next_minus = rise >> _TOP, fall >> _TOP
                rise, fall = (rise << _ONE) | plus, (fall << _ONE) | minus
                up[w, :a], down[w, :a] = fall | ~(vertical | rise), rise & vertical
                plus, minus = next_plus, next_minus
    return score


def _bends(distance, difference):
    """How far off the diagonal a path of so many edits may come, of which ``difference`` make up for the lengths."""
    return (distance + abs(difference)) // 2


def _in_narrow_bands(left: np.ndarray, right: np.ndarray, m: np.ndarray, h: np.ndarray, letters: int) -> np.ndarray:
    """As ``_in_band`` side by side, in bands around both the first and the last diagonal; the pairs come by falling length of the hypothesis."""
    n, k = len(left), (NARROW - (m - h)) // 2
    planes = np.zeros(((max(int((m + k).max()), right.shape[1]) >> 6) + 2, n * letters), np.uint64)
    row, place = np.nonzero(left >= 0)
    at = row * letters + left[row, place]
    place += k[row]
    np.bitwise_or.at(planes.reshape(-1), (place >> 6) * planes.shape[1] + at, _ONE << (place & 63).astype(np.uint64))
    text, base = np.ascontiguousarray(right.T), np.arange(n) * letters
    active = np.searchsorted(-h, -np.arange(int(h[0])), side="left")
    middle = k.astype(np.uint64)
    up, down = ~np.uint64(0) << middle, np.zeros(n, np.uint64)
    score, shortest = np.zeros(n, np.int64), int(m.min())
    with np.errstate(over="ignore"):
        for j, a in enumerate(active.tolist()):
            at = base[:a] + text[j, :a]
            eq = planes[j >> 6][at] >> np.uint64(j & 63)
            if j & 63:
                eq |= planes[(j >> 6) + 1][at] << np.uint64(64 - (j & 63))
            p, q = up[:a], down[:a]
            across = (((eq & p) + p) ^ p) | eq | q
            rise, fall = q | ~(across | p), across & p
            step = (~across >> middle[:a] & _ONE).astype(np.int64)
            if j >= shortest:
                bottom = np.clip(m[:a] - 1 - j + k[:a], 0, NARROW).astype(np.uint64)
                along = (rise >> bottom & _ONE).astype(np.int64) - (fall >> bottom & _ONE).astype(np.int64)
                step = np.where(j < m[:a], step, along)
            score[:a] += step
            across >>= _ONE
            up[:a], down[:a] = fall | ~(across | rise), across & rise
    below = (_ONE << np.maximum(m - h, 0).astype(np.uint64)) - _ONE
    return score + np.bitwise_count(up >> middle & below) - np.bitwise_count(down >> middle & below)


def _in_band(left: np.ndarray, right: np.ndarray, k: int) -> int:
    """The distance if a path of so many edits stays within ``k`` of the diagonal, else a bound above it. Lengths differ by ``k`` at most."""
    m, n, width = len(left), len(right), 2 * k + 1
    masks = {int(c): int.from_bytes(np.packbits(left == c, bitorder="little").tobytes(), "little") << k for c in np.unique(left)}
    full = (1 << width) - 1
    up, down, score, window, since = full >> k << k, 0, 0, {}, 0
    for j, c in enumerate(right.tolist()):
        if j - since >= width:
            window, since = {}, j
        if c not in window:
            window[c] = masks.get(c, 0) >> since & (1 << 2 * width) - 1
        eq = window[c] >> (j - since) & full
        across = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full & ~(across | up)), across & up
        if j < m:
            score += not across >> k & 1
        else:
            at = m - 1 - j + k
            score += (rise >> at & 1) - (fall >> at & 1)
        across >>= 1
        up, down = fall | (full & ~(across | rise)), across & rise
    if m > n:
        below = (1 << m - n) - 1
        score += (up >> k & below).bit_count() - (down >> k & below).bit_count()
    return score


def _alike(a: str, b: str, i: int, j: int) -> int:
    """How many characters are the same from there on."""
    at, step, most = 0, 16, min(len(a) - i, len(b) - j)
    while at + step <= most and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at, step = at + step, step * 2
    while step := step >> 1:
        if at + step <= most and a[i + at : i + at + step] == b[j + at : j + at + step]:
            at += step
    return at


def _by_diagonals(a: str, b: str, steps: int) -> int | None:
    """The distance if a few rounds of so many steps tell it, else null; the first round is always done.

    A round has one edit more beyond the difference of the lengths, which any path has. In it
    an edit towards the last diagonal costs nothing, a substitution one, an edit away from it two.
    The first round finds the pairs of which one side is the other with some left out.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    last, off = m - n, isqrt(steps) + 2
    none = [-1] * (last + 2 * off + 1)
    before, now = none, none
    for extra in range(off):
        earlier, before, now = before, now, none.copy()
        low, high = -(extra // 2), last + extra // 2
        for k in chain(range(low, last), range(high, last, -1), [last]):
            at = k + off
            j = before[at] + 1 if extra else -(k != 0)
            if k <= last:
                j = max(j, now[at - 1], earlier[at + 1] + 1 if extra > 1 and k < last else -1)
            if k >= last:
                j = max(j, now[at + 1] + 1 if k < high else -1, earlier[at - 1] if k > last else -1)
            if j >= 0:
                j = min(j, n, m - k)
                i = j + k
                if i < m and j < n and a[i] == b[j]:
                    j += _alike(a, b, i, j)
            now[at] = j
        if now[last + off] == n:
            return last + extra
        steps -= high - low + 1
        if steps <= 0:
            return None
    return None


def _as_text(letters: np.ndarray) -> str:
    return letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _long_pair(left: np.ndarray, right: np.ndarray) -> int:
    """The band grows until it holds the distance; one as wide as the text is no longer worth it."""
    left, right = _trimmed(left, right)
    if not len(left) or not len(right):
        return max(len(left), len(right))
    if max(left.max(), right.max()) <= sys.maxunicode:
        near = _by_diagonals(_as_text(left), _as_text(right), min(len(left), len(right)))
        if near is not None:
            return near
    differ = len(left) - len(right)
    k = max(BAND, len(left) >> 7, abs(differ) * 9 // 8)
    while 3 * k < len(left):
        found = _in_band(left, right, k)
        if _bends(found, differ) <= k:
            return found
        k = min(_bends(found, differ), 4 * k)
    return _as_one_number(left, right)


def _as_one_number(left: np.ndarray, right: np.ndarray) -> int:
    """The distance with columns of any length."""
    m = len(left)
    masks = {int(c): int.from_bytes(np.packbits(left == c, bitorder="little").tobytes(), "little") for c in np.unique(left)}
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in right.tolist():
        eq = masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(across | up)), up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return score


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what both begin and end with."""
    most = min(len(a), len(b))
    differs = np.flatnonzero(a[:most] != b[:most])
    begin = int(differs[0]) if len(differs) else most
    a, b, most = a[begin:], b[begin:], most - begin
    differs = np.flatnonzero(a[::-1][:most] != b[::-1][:most])
    end = int(differs[0]) if len(differs) else most
    return a[: len(a) - end], b[: len(b) - end]


def _distances(references: list, hypotheses: list, as_letters) -> np.ndarray:
    """Of pairs of sequences, which ``as_letters`` makes small numbers: of all references, one behind the other, then of all hypotheses."""
    m, h = (np.fromiter(map(len, side), np.int64, len(side)) for side in (references, hypotheses))
    distance = np.maximum(m, h)
    both, long = (m > 0) & (h > 0), m > 64 * WORDS
    for k in np.flatnonzero(both & long):
        letters = as_letters([[references[k]], [hypotheses[k]]])
        distance[k] = _long_pair(letters[: m[k]], letters[m[k] :])
    order = np.flatnonzero(both & ~long)
    order = order[np.lexsort((-h[order], m[order] + 63 >> 6))]
    if not len(order):
        return distance
    letters = as_letters([[side[k] for k in order] for side in (references, hypotheses)])
    alphabet = int(letters.max()) + 1
    m, h, out = m[order], h[order], np.zeros(len(order), np.int64)
    left = np.concatenate([[0], np.cumsum(m)])
    right = left[-1] + np.concatenate([[0], np.cumsum(h)])
    words = m + 63 >> 6
    at = 0
    while at < len(order):
        w = int(words[at])
        upto = min(int(np.searchsorted(words, w, side="right")), at + max(1, MASKS // (min(alphabet, LETTERS) * w)))
        part = np.arange(at, upto)
        sides = [_rows(letters[c[at] : c[upto]], size[part], filler) for c, size, filler in ((left, m, -1), (right, h, -2))]
        if w > 1 and alphabet <= LETTERS:
            differ = m[part] - h[part]
            near = np.flatnonzero(abs(differ) <= NARROW)
            found = np.full(len(part), 2 * NARROW + 2)  # more than what a band can hold
            if len(near) >= FEW:
                found[near] = _in_narrow_bands(*(s[near] for s in sides), m[part][near], h[part][near], alphabet)
            out[part] = found
            far = (found - abs(differ)) // 2 > (NARROW - abs(differ)) // 2
            part, sides = part[far], [s[far] for s in sides]
        if len(part) >= FEW * w:
            out[part] = _side_by_side(*sides, m[part], h[part], alphabet, w)
        else:
            out[part] = [_as_one_number(a[: m[k]], b[: h[k]]) for k, a, b in zip(part, *sides, strict=True)]
        at = upto
    distance[order] = out
    return distance


def _characters(sides: list[list[str]]) -> np.ndarray:
    codes = np.frombuffer("".join(chain(*sides)).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(codes.max()) + 1, bool)
    known[codes] = True
    return (np.cumsum(known, dtype=np.int32) - 1)[codes]


def distances(references: list[str], hypotheses: list[str]) -> np.ndarray:
    """Unit-cost distances in code points."""
    out = np.full(len(references), -1, np.int64)
    for k, (r, h) in enumerate(zip(references, hypotheses, strict=True)):
        if 0 < abs(len(r) - len(h)) * 4 < min(len(r), len(h)) <= 64 * WORDS:
            found = _by_diagonals(r, h, 0)
            if found is not None:
                out[k] = found
    rest = np.flatnonzero(out < 0)
    out[rest] = _distances([references[k] for k in rest], [hypotheses[k] for k in rest], _characters)
    return out


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of all texts, which one or more spaces part, and how many a text has."""
    lists = pc.split_pattern(texts, " ")
    words = pc.dictionary_encode(lists.flatten())
    numbers, empty = words.indices.to_numpy(), pc.index(words.dictionary, "").as_py()
    kept = numbers != empty
    upto = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    return numbers[kept], np.diff(upto)


def word_distances(references: pa.Array, hypotheses: pa.Array) -> np.ndarray:
    """Unit-cost distances in words, which one or more spaces part; texts aren't null."""
    numbers, lengths = word_numbers(pa.concat_arrays([references, hypotheses]))
    texts = np.split(numbers, np.cumsum(lengths)[:-1]) if len(lengths) else []
    return _distances(texts[: len(references)], texts[len(references) :], lambda sides: np.concatenate([*chain(*sides)]))
