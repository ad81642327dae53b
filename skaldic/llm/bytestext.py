"""Numpy views of Arrow strings, and hashes of all their words at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
BLOCK = 1 << 18
_ROW = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; a worker outlives its task, so it gives memory back when the task's batches end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    whole = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return whole, offsets - lo


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``BLOCK`` of each; those beyond are products with powers of the last."""
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        step_up, step_down = _BASE, _INVERSE
        while len(up) < BLOCK:
            up, down = np.concatenate([up, up * step_up]), np.concatenate([down, down * step_down])
            step_up, step_down = step_up * step_up, step_down * step_down
    return up, down


def _block_power(base: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(base), k * BLOCK, 1 << 64))


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i], times the base to the power -i, hashing bytes i to j."""
    up, _ = _powers()
    out = np.zeros(len(buffer) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(buffer), BLOCK):
            part = _ROW[buffer[at : at + BLOCK]]
            part *= up[: len(part)]
            if at:
                part *= _block_power(_BASE, at // BLOCK)
            part[0] += out[at]
            np.cumsum(part, out=out[at + 1 : at + 1 + len(part)])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers()
    with np.errstate(over="ignore"):
        back = down[starts % BLOCK]
        if len(sums) > BLOCK:
            high = np.array([_block_power(_INVERSE, k) for k in range(-(-len(sums) // BLOCK))], np.uint64)
            back *= high[starts // BLOCK]
        return mixed((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, owner) of the words between ASCII white space, none across texts."""
    inside = ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13)))
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner


def hashed_spans(buffer: np.ndarray, offsets: np.ndarray, longest: int):
    """(starts, ends, owner, hashes) of words, those over ``longest`` bytes in pieces cut between UTF-8 characters."""
    starts, ends, owner = word_spans(buffer, offsets)
    step = longest - 3
    length = ends - starts
    parts = np.where(length > longest, -(-length // step), 1)
    if len(parts) and parts.max() > 1:
        at = np.repeat(np.arange(len(starts)), parts)
        within = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[at] + within * step
        for _ in range(3):
            begin -= (within > 0) & (buffer[begin] & 0xC0 == 0x80)
        last = np.r_[at[1:] != at[:-1], True]
        starts, ends, owner = begin, np.where(last, ends[at], np.r_[begin[1:], 0]), owner[at]
    return starts, ends, owner, span_hashes(prefix_sums(buffer), starts, ends)
