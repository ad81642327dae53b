"""Rows by their places in files, listings of audio, names of backends, caseless order."""

import random

import pytest
from pyspark.sql import functions as F

import skaldic
from skaldic.operators import backends, scoring
from skaldic.sources import readers, writers


def test_placed(spark, tmp_path, monkeypatch):
    """Files of several sizes, cut into several blocks, in three formats."""
    rng = random.Random(1)
    lines = []
    for f in range(5):
        own = [f"{f}-{k}-" + "x" * rng.randint(0, 50) for k in range(rng.choice([1, 30, 400]))]
        (tmp_path / f"part{f}.txt").write_text("".join(w + "\n" for w in own))
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        scan = spark.read.text(str(tmp_path / "*.txt"))
        assert scan.rdd.getNumPartitions() > 3
        assert {r["ordinal"]: r["value"] for r in readers.placed(scan).collect()} == dict(enumerate(lines))
        frame = spark.createDataFrame([(w,) for w in lines], "w string").coalesce(1)
        frame.write.parquet(str(tmp_path / "pq"))
        frame.write.json(str(tmp_path / "js"))
        for other in (spark.read.parquet(str(tmp_path / "pq")), spark.read.schema("w string").json(str(tmp_path / "js"))):
            rows = scoring.zipped(scan, other).collect()
            assert len(rows) == len(lines) and all(r["value"] == r["w"] for r in rows)
        short = spark.read.text(str(tmp_path / "part0.txt")).select(F.col("value").alias("other"))
        assert scoring.zipped(scan, short).count() == short.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifest_rows_need_their_audio(spark, tmp_path):
    cache = tmp_path / "cache"
    (cache / "fleurs").mkdir(parents=True)
    for k in (0, 2):
        (cache / "fleurs" / f"{k}.wav").write_bytes(b"RIFF")
    (cache / "fleurs.manifest.jsonl").write_text("".join(f'{{"audio_path": "{cache}/fleurs/{k}.wav", "reference_text": "t{k}"}}\n' for k in range(3)))
    listed = readers.audio_files(spark, str(cache / "fleurs"))
    rows = readers.load_dataset(spark, "fleurs", "nowhere", str(cache), audio=listed).collect()
    assert sorted(r["reference_text"] for r in rows) == ["t0", "t2"]
    assert readers.load_dataset(spark, "fleurs", "nowhere", str(cache), audio=readers.audio_files(spark, str(cache / "none"))).count() == 0


def test_known_backends(spark):
    assert {"stub", "transformers", "soniox"} <= set(backends.known_backends())
    assert backends.available_backends() == ["stub"]
    rows = spark.createDataFrame([("a.wav",)], "audio_path string")
    with pytest.raises(ValueError, match="not built in"):
        backends.transcribe(rows, "transformers")
    with pytest.raises(ValueError, match="unknown"):
        backends.transcribe(rows, "nothing")


def test_caseless_order(spark):
    rows = spark.createDataFrame([(c, chr(c)) for c in range(0x20, 0x2FFF) if not 0xD800 <= c < 0xE000], "c int, t string")
    for r in rows.select("t", writers.folded(F.col("t")).alias("f")).collect():
        assert r["f"] == r["t"].casefold()
    assert skaldic.normalize_numbers_da is not None
