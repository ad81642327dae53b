"""Containers against the standard library, resampling against a convolution written out."""

import io
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from skaldic.sources import waveforms as W


def pcm(samples, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def chunks(*parts, head=b"RIFF"):
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(b) if s is None else s) + b + b"\0" * (len(b) % 2) for n, b, s in parts)
    return head + struct.pack("<I", len(body)) + body


def fmt(code, channels, rate, bits, more=b""):
    return b"fmt ", struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + more, None


def values(content):
    w = W.parse(content)
    return W.mono(w, 0, w.n_frames)


def test_integers():
    whole = [-(2**15), -1, 0, 1, 2**15 - 1]
    assert np.array_equal(values(pcm(struct.pack("<5h", *whole), 8000)), np.array(whole) / 2**15)
    assert np.array_equal(values(pcm(bytes([0, 128, 255]), 8000, width=1)), [-1, 0, 127 / 128])
    wide = [-(2**31), 5, 2**31 - 1]
    assert np.array_equal(values(pcm(struct.pack("<3i", *wide), 8000, width=4)), np.array(wide) / 2**31)
    three = [-(2**23), -2, 3, 2**23 - 1]
    packed = b"".join(v.to_bytes(3, "little", signed=True) for v in three)
    assert np.array_equal(values(pcm(packed, 8000, width=3)), np.array(three) / 2**23)


def test_floats_extensible_and_channels():
    data = struct.pack("<4f", 0.5, -0.25, 1.0, 0.0)
    assert np.array_equal(values(chunks(fmt(3, 2, 8000, 32), (b"data", data, None))), [0.125, 0.5])
    more = struct.pack("<HHI", 22, 16, 3) + struct.pack("<H", 1) + b"\0" * 14
    assert np.array_equal(values(chunks(fmt(0xFFFE, 1, 8000, 16, more), (b"data", struct.pack("<2h", 2**14, 0), None))), [0.5, 0])


def test_odd_containers():
    data = struct.pack("<3h", 1, 2, 3)
    plain = np.array([1, 2, 3]) / 2**15
    # Chunks of odd length before the samples, sizes that claim too much, sizes of 64 bits, a frame cut short.
    assert np.array_equal(values(chunks((b"LIST", b"abc", None), fmt(1, 1, 8000, 16), (b"data", data, None))), plain)
    assert np.array_equal(values(chunks(fmt(1, 1, 8000, 16), (b"data", data, 0xFFFFFFFF))), plain)
    long = (b"ds64", struct.pack("<QQQI", 0, 4, 2, 0), None)
    assert np.array_equal(values(chunks(long, fmt(1, 1, 8000, 16), (b"data", data, 0xFFFFFFFF), head=b"RF64")), plain[:2])
    w = W.parse(chunks(fmt(1, 2, 8000, 16), (b"data", data, None)))
    assert w.n_frames == 1
    for bad in (None, b"", b"RIFF", b"ID3" + b"x" * 50, chunks(fmt(1, 1, 0, 16), (b"data", data, None)), chunks(fmt(7, 1, 8000, 8), (b"data", data, None)),
                chunks((b"data", data, None)), chunks(fmt(1, 1, 8000, 16))):
        assert W.parse(bad) is None


def direct(x, source, target):
    """The same filter, each output a sum over all inputs."""
    cut = 1.0 if target >= source else W.ROLLOFF * target / source
    out = []
    for n in range(math.ceil(len(x) * target / source)):
        t, total = n * source / target, 0.0
        for k, v in enumerate(x):
            r = (k - t) * cut / W.ZEROS
            if abs(r) < 1:
                total += v * cut * np.sinc(cut * (k - t)) * np.i0(W.BETA * math.sqrt(1 - r * r)) / np.i0(W.BETA)
        out.append(total)
    return np.array(out)


def at(x):
    def get(a, b):
        out = np.zeros(b - a)
        lo, hi = max(a, 0), min(b, len(x))
        if lo < hi:
            out[lo - a : hi - a] = x[lo:hi]
        return out

    return get


@pytest.mark.parametrize("source,target", [(8000, 16000), (16000, 8000), (44100, 16000), (48000, 16000), (22050, 16000), (7919, 16000), (16000, 16000)])
def test_resample(source, target):
    x = np.random.default_rng(source).uniform(-1, 1, 150)
    n = W.n_resampled(len(x), source, target)
    whole = W.resample(at(x), source, target, 0, n)
    expected = x if source == target else direct(x, source, target)
    assert np.allclose(whole, expected, atol=1e-9)
    parts = [W.resample(at(x), source, target, a, min(a + 37, n)) for a in range(0, n, 37)]
    assert np.allclose(np.concatenate(parts), whole, atol=1e-12)


def test_tones():
    """A tone below the new limit stays, one above it goes."""
    source, target = 44100, 16000
    t = np.arange(source) / source
    low, high = (W.resample(at(np.sin(2 * np.pi * f * t)), source, target, 0, target) for f in (1000, 11000))
    wanted = np.sin(2 * np.pi * 1000 * np.arange(target) / target)
    inner = slice(500, -500)
    assert np.abs(low[inner] - wanted[inner]).max() < 1e-3
    assert np.abs(high[inner]).max() < 1e-3


def test_waveforms(spark):
    x = (np.sin(np.arange(5000) / 9) * 20000).astype("<i2")
    rows = [(1, pcm(x.tobytes(), 44100)), (2, None), (3, b"noise"), (4, pcm(b"", 8000)), (5, pcm(x.tobytes(), 16000)), (5, pcm(x.tobytes(), 16000))]
    files = spark.createDataFrame(rows, "id int, content binary").coalesce(1)
    got = W.waveforms(files, "id", block=300).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["id"], r["start"])):
        by.setdefault(r["id"], []).append(r)
    for bad in (2, 3):
        assert [tuple(r)[1:] for r in by[bad]] == [(None, 0, 0, None)]
    assert [tuple(r)[1:] for r in by[4]] == [(8000, 0, 0, [])]
    n = W.n_resampled(5000, 44100, 16000)
    assert {r["n_samples"] for r in by[1]} == {n} and [r["start"] for r in by[1]] == list(range(0, n, 300))
    joined = np.concatenate([r["samples"] for r in by[1]])
    assert np.allclose(joined, W.resample(at(x / 2**15), 44100, 16000, 0, n), atol=1e-6)
    assert len(by[5]) == 2 * math.ceil(5000 / 300)
    with pytest.raises(ValueError, match="start"):
        W.waveforms(files.withColumn("Start", F.lit(1)), "Start")


def test_container(spark):
    frame = spark.createDataFrame([(bytearray(range(6)),), (bytearray(),)], "p binary")
    for r in frame.select("p", W.container(F.col("p"), 44100, channels=2).alias("c")).collect():
        with wave.open(io.BytesIO(bytes(r["c"]))) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(9)) == (44100, 2, 1, bytes(r["p"]))


def test_as_pcm(spark):
    x = (np.sin(np.arange(3000) / 9) * 20000).astype("<i2")
    loud = chunks(fmt(3, 1, 16000, 32), (b"data", struct.pack("<3f", 2.0, -2.0, 0.5), None))
    rows = [(1, pcm(x.tobytes(), 44100)), (2, None), (3, b"noise"), (4, pcm(np.repeat(x, 2).tobytes(), 16000, channels=2)), (5, loud), (6, pcm(b"", 8000))]
    frame = spark.createDataFrame(rows, "id int, c binary").select("id", W.seconds(F.col("c")).alias("s"), W.as_pcm(F.col("c")).alias("p"))
    got = {r["id"]: (r["s"], None if r["p"] is None else values(bytes(r["p"]))) for r in frame.collect()}
    assert got[2] == (0.0, None) and got[3] == (0.0, None) and got[6][0] == 0 and len(got[6][1]) == 0
    assert got[1][0] == 3000 / 44100
    assert np.abs(got[1][1] - W.resample(at(x / 2**15), 44100, 16000, 0, W.n_resampled(3000, 44100, 16000))).max() <= 2**-15
    assert np.array_equal(got[4][1], x / 2**15)
    assert np.array_equal(got[5][1], [1 - 2**-15, -1, 0.5])
