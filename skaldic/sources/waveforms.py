"""Audio as arrays: containers of plain samples, the mean of their channels, a new rate by a windowed sinc.

A file is a row with its bytes; its signal leaves in blocks of bounded length,
so an hour of audio is many small rows and never one large array.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StructType

RATE = 16000
BLOCK = 1 << 17
# The filter: zero crossings on each side, the window's shape, the share of the band kept when the rate falls.
ZEROS = 32
BETA = 9.0
ROLLOFF = 0.95
_WORK = 1 << 21
# Format codes of a container, and the code that defers to a longer one.
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_UNKNOWN_SIZE = 0xFFFFFFFF


class Wave(NamedTuple):
    rate: int
    channels: int
    kind: int
    width: int
    data: memoryview

    @property
    def n_frames(self) -> int:
        return len(self.data) // (self.width * self.channels)


def parse(content) -> Wave | None:
    """The samples of a RIFF or RF64 container of integers (8 to 32 bits) or floats (32, 64); None for anything else.

    A chunk that claims more than there is ends with the file, as streams write it.
    """
    data = memoryview(content) if content is not None else memoryview(b"")
    if len(data) < 12 or bytes(data[:4]) not in (b"RIFF", b"RF64") or bytes(data[8:12]) != b"WAVE":
        return None
    form, long_size, at = None, None, 12
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 :]
        if name == b"ds64" and len(body) >= 16:
            long_size = struct.unpack_from("<Q", body, 8)[0]
        elif name == b"fmt " and min(size, len(body)) >= 16:
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if code == _EXTENSIBLE and min(size, len(body)) >= 26:
                code = struct.unpack_from("<H", body, 24)[0]
            form = code, channels, rate, bits
        elif name == b"data":
            if size == _UNKNOWN_SIZE and long_size is not None:
                size = long_size
            return _wave(form, body[:size])
        at += 8 + size + size % 2
    return None


def _wave(form, data: memoryview) -> Wave | None:
    if form is None:
        return None
    code, channels, rate, bits = form
    good = (code == _PCM and bits in (8, 16, 24, 32)) or (code == _FLOAT and bits in (32, 64))
    return Wave(rate, channels, code, bits // 8, data) if good and rate and channels else None


def mono(wave: Wave, start: int, stop: int) -> np.ndarray:
    """Frames ``start`` to ``stop`` as the mean of the channels, in -1 to 1; silence before the first and after the last."""
    a, b = max(start, 0), max(min(stop, wave.n_frames), 0)
    out = np.zeros(max(stop - start, 0))
    if a < b:
        frame = wave.width * wave.channels
        raw = wave.data[a * frame : b * frame]
        out[a - start : b - start] = _numbers(wave, raw).reshape(b - a, wave.channels).mean(axis=1)
    return out


def _numbers(wave: Wave, raw: memoryview) -> np.ndarray:
    if wave.kind == _FLOAT:
        return np.frombuffer(raw, f"<f{wave.width}").astype(np.float64)
    if wave.width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if wave.width == 3:
        # Three bytes become the upper ones of four, so that the sign is in its place.
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return wide.view("<i4").ravel() / 2.0**31
    return np.frombuffer(raw, f"<i{wave.width}") / 2.0 ** (8 * wave.width - 1)


def n_resampled(n: int, source: int, target: int) -> int:
    return -(-n * target // source)


def _filter(up: int, down: int, u: np.ndarray) -> np.ndarray:
    """The windowed sinc at distances ``u``, in samples of the source."""
    cut = 1.0 if up >= down else ROLLOFF * up / down
    inside = np.clip(1 - (u * cut / ZEROS) ** 2, 0, None)
    return np.where(inside > 0, cut * np.sinc(cut * u) * np.i0(BETA * np.sqrt(inside)) / np.i0(BETA), 0.0)


def _reach(up: int, down: int) -> int:
    return ZEROS if up >= down else int(np.ceil(ZEROS * down / (ROLLOFF * up)))


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray | None:
    """The filter of every phase, where the table is small; with two odd rates it isn't."""
    reach = _reach(up, down)
    if up * 2 * reach > _WORK:
        return None
    return _filter(up, down, np.arange(1 - reach, reach + 1)[None, :] - np.arange(up)[:, None] / up)


def resample(at: Callable[[int, int], np.ndarray], source: int, target: int, start: int, stop: int) -> np.ndarray:
    """Samples ``start`` to ``stop`` of a signal at its new rate; ``at(a, b)`` gives samples a to b of the old one.

    Polyphase: a sample's place among the old ones falls into one of ``up``
    phases, each with its filter. No sample of a block depends on the block's bounds.
    """
    ratio = Fraction(target, source)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return at(start, stop)
    reach = _reach(up, down)
    table = _phases(up, down)
    step = max(1, _WORK // (2 * reach))
    return np.concatenate([np.zeros(0), *(_resampled(at, up, down, reach, table, lo, min(lo + step, stop)) for lo in range(start, stop, step))])


def _resampled(at, up: int, down: int, reach: int, table: np.ndarray | None, lo: int, hi: int) -> np.ndarray:
    base, phase = np.divmod(np.arange(lo, hi) * down, up)
    first = int(base[0])
    x = at(first - reach + 1, int(base[-1]) + reach + 1)
    if down == 1 and table is not None:
        # A phase is then a plain convolution.
        every = np.stack([np.correlate(x, w, "valid") for w in table], axis=1)
        return every.ravel()[lo - first * up : hi - first * up]
    windows = np.lib.stride_tricks.sliding_window_view(x, 2 * reach)[base - first]
    if table is None:
        weights = _filter(up, down, np.arange(1 - reach, reach + 1)[None, :] - phase[:, None] / up)
    else:
        weights = table[phase]
    return np.einsum("ij,ij->i", windows, weights)


def waveforms(files: DataFrame, *keys: str, content: str = "content", target: int = RATE, block: int = BLOCK) -> DataFrame:
    """``keys`` of each file with rate, n_samples, start and samples: its signal at ``target``, in blocks.

    ``rate`` is the file's own, ``n_samples`` counts the whole signal at the
    new rate, ``start`` is the block's place in it. A file without samples has
    one block that is empty; one that can't be read, or null, has one with null
    rate and samples. Repeated files give repeated rows.
    """
    names = ("rate", "n_samples", "start", "samples")
    if clash := {k.lower() for k in keys} & set(names):
        raise ValueError(f"keys may not be named {sorted(clash)}")
    picked = files.select(*keys, F.col(content).alias("_content"))
    out = StructType(picked.schema.fields[:-1])
    for name, kind in zip(names, (IntegerType(), LongType(), LongType(), ArrayType(FloatType())), strict=True):
        out = out.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, data in enumerate(batch.column(len(keys))):
                for row in _blocks(parse(data.as_buffer() if data.is_valid else None), target, block):
                    rows.append((i, *row))
                    held += len(row[3]) if row[3] is not None else 0
                    if held >= block:
                        yield _batch(batch, len(keys), rows)
                        rows, held = [], 0
            if rows:
                yield _batch(batch, len(keys), rows)

    return picked.mapInArrow(run, out)


def _blocks(wave: Wave | None, target: int, block: int) -> Iterator[tuple]:
    if wave is None:
        yield None, 0, 0, None
        return
    n = n_resampled(wave.n_frames, wave.rate, target)
    for start in range(0, max(n, 1), block):
        signal = resample(lambda a, b: mono(wave, a, b), wave.rate, target, start, min(start + block, n))
        yield wave.rate, n, start, signal.astype(np.float32)


def _batch(source: pa.RecordBatch, n_keys: int, rows: list[tuple]) -> pa.RecordBatch:
    at, rates, counts, starts, signals = zip(*rows, strict=True)
    lengths = [0 if s is None else len(s) for s in signals]
    values = pa.array(np.concatenate([np.zeros(0, np.float32), *(s for s in signals if s is not None)]))
    offsets = [None if s is None else o for s, o in zip(signals, np.cumsum([0, *lengths[:-1]]).tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array([*offsets, sum(lengths)], pa.int32()), values)
    picked = [source.column(k).take(pa.array(at)) for k in range(n_keys)]
    columns = [*picked, pa.array(rates, pa.int32()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), lists]
    return pa.RecordBatch.from_arrays(columns, names=[*source.schema.names[:n_keys], "rate", "n_samples", "start", "samples"])


@F.pandas_udf(DoubleType())
def seconds(content: pd.Series) -> pd.Series:
    """How long a file's samples last; 0 if they can't be read."""
    waves = [parse(c) for c in content]
    return pd.Series([w.n_frames / w.rate if w else 0.0 for w in waves], dtype=float)


@F.pandas_udf(BinaryType())
def as_pcm(content: pd.Series) -> pd.Series:
    """A file as one of a single channel of 16-bit samples at ``RATE``; null if it can't be read. Louder samples than 1 are cut."""

    def one(data):
        wave = parse(data)
        if wave is None:
            return None
        wanted = np.concatenate([np.zeros(0), *(signal for _, _, _, signal in _blocks(wave, RATE, BLOCK))])
        body = np.clip(np.rint(wanted * 2.0**15), -(2**15), 2**15 - 1).astype("<i2").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, _PCM, 1, RATE, 2 * RATE, 2, 16, b"data", len(body))
        return head + body

    return pd.Series([one(c) for c in content], dtype=object)


def container(payload: Column, rate: int, channels: int = 1, bits: int = 8) -> Column:
    """Bare samples as a file with a header, by built-in expressions."""
    n, frame = F.octet_length(payload), channels * bits // 8
    return F.concat(
        F.encode(F.lit("RIFF"), "UTF-8"), _little(n + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), _little(F.lit(16), 4), _little(F.lit(_PCM), 2),
        _little(F.lit(channels), 2), _little(F.lit(rate), 4), _little(F.lit(rate * frame), 4), _little(F.lit(frame), 2), _little(F.lit(bits), 2),
        F.encode(F.lit("data"), "UTF-8"), _little(n, 4), payload,
    )


def _little(number: Column, width: int) -> Column:
    digits = F.lpad(F.hex(number.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))
