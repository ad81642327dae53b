"""Command lines and the sources and sinks behind them, on files."""

import io
import json
import wave

import pytest
from pyspark.sql import functions as F

from skaldic import cli
from skaldic.functions import naming
from skaldic.operators import board, scoring
from skaldic.sources import archives, readers, schemas, storage, writers


def lines(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def pair(i, r, h):
    return {"id": str(i), "reference": r, "hypothesis": h}


def wav(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(b"\0\0" * int(100 * seconds))
    return out.getvalue()


@pytest.fixture
def saved(tmp_path):
    """Raw outputs of two models, one with metadata, and a data set that isn't registered."""
    root = tmp_path / "outputs"
    for slug, hyp in (("lab__a", "et to"), ("lab__b", "tre")):
        (root / slug).mkdir(parents=True)
        (root / slug / "fleurs_da.jsonl").write_text(lines([pair(1, "et to", hyp), pair(2, "?!", "x")]) + "\n")
        (root / slug / "ftspeech.jsonl").write_text(lines([pair(1, "2 æbler", "to æbler")]))
        (root / slug / "other.jsonl").write_text(lines([pair(1, "a", "b")]))
    meta = {"model": "lab/a", "model_link": "[lab/a](https://x/lab/a)", "params_b": 1.5, "access": "", "submitted": "2026-01-02", "speed_x": 3.0, "datasets": ["fleurs_da"]}
    (root / "lab__a" / "meta.json").write_text(json.dumps(meta, indent=2))
    return root


def test_rescore(spark, saved, tmp_path, capsys):
    old = tmp_path / "old"
    old.mkdir()
    (old / "lab__a.json").write_text(json.dumps({"model": "lab/a", "mean_wer": 1.5}))
    (old / "broken.json").write_text("{not json")
    code = cli.main(["rescore", "--outputs-dir", str(saved), "--out-dir", str(tmp_path / "new"), "--compare", str(old)], spark)
    assert code == 0
    a = json.loads((tmp_path / "new" / "lab__a.json").read_text())
    b = json.loads((tmp_path / "new" / "lab__b.json").read_text())
    assert list(a) == schemas.RESULT_COLUMNS
    assert (a["model"], a["access"], a["params_b"], a["speed_x"], a["submitted"]) == ("[lab/a](https://x/lab/a)", "open", 1.5, 3.0, "2026-01-02")
    assert (a["mean_wer"], a["fleurs_da_wer"], a["ftspeech_wer"], a["cv17_da_wer"]) == (0.0, 0.0, 0.0, None)
    assert (b["mean_wer"], b["fleurs_da_wer"], b["params_b"], b["model"]) == (50.0, 100.0, 0.0, "")
    shown = capsys.readouterr().out
    assert "-1.50" in shown and "—" in shown
    assert cli.main(["rescore", "--outputs-dir", str(saved), "--model", "lab/a", "--no-number-words", "--out-dir", str(tmp_path / "plain")], spark) == 0
    plain = json.loads((tmp_path / "plain" / "lab__a.json").read_text())
    assert plain["ftspeech_wer"] == 50.0 and not (tmp_path / "plain" / "lab__b.json").exists()
    assert cli.main(["rescore", "--outputs-dir", str(tmp_path / "none")], spark) == 1


def test_outputs_and_repair(spark, saved, tmp_path, capsys):
    (saved / "lab__c.jsonl").write_text(lines([{"set": "s", "audio": "c.wav", "reference": "a", "hypothesis": "Hypothesis(text='b', y=1)"}]))
    (saved / "lab__a.jsonl").write_text(lines([{"dataset": "s", "id": "i", "reference": "a", "hypothesis": "combined"}]))
    table = str(tmp_path / "table")
    assert cli.main(["outputs", "--outputs-dir", str(saved), "--table", table, "--no-upload"], spark) == 0
    rows = spark.read.parquet(table)
    n = rows.count()
    assert {(r["model"], r["dataset"], r["id"]) for r in rows.filter("model = 'lab__c'").collect()} == {("lab__c", "s", "c.wav")}
    # A model with both layouts takes its folder, or its file if it alone is asked for.
    assert rows.filter("model = 'lab__a'").count() == 4
    assert cli.main(["outputs", "--outputs-dir", str(saved), "--table", str(tmp_path / "one"), "--model", "lab/a"], spark) == 0
    assert [r["hypothesis"] for r in spark.read.parquet(str(tmp_path / "one")).collect()] == ["combined"]
    assert cli.main(["outputs", "--outputs-dir", str(saved), "--model", "none"], spark) == 1
    assert cli.main(["repair", "--table", table, "--dry-run"], spark) == 0
    assert "would repair 1 row" in capsys.readouterr().out
    assert cli.main(["repair", "--table", table], spark) == 0
    fixed = spark.read.parquet(table)
    assert fixed.filter("model = 'lab__c'").first()["hypothesis"] == "b" and fixed.count() == n
    assert cli.main(["repair", "--table", table], spark) == 0
    assert "no corrupted rows" in capsys.readouterr().out


def test_publish(spark, tmp_path, capsys):
    local, published = tmp_path / "local", tmp_path / "published"
    for folder, name, wer in ((local, "x__a", 3.0), (published, "x__a", 9.0), (published, "x__b", 2.0), (published, "y__c", 1.0)):
        folder.mkdir(exist_ok=True)
        model = name.replace("__", "/")
        (folder / f"{name}.json").write_text(json.dumps({"model": f"[{model}]({naming.HUB}{model})", "mean_wer": wer, "mean_cer": wer, "submitted": "2026-02-03T00"}))
    (published / "bad.json").write_text("[")
    board_path, names = tmp_path / "board.json", tmp_path / "names.py"
    flags = ["publish", "--results-dir", str(local), "--published-dir", str(published), "--table", str(tmp_path / "t"), "--board", str(board_path),
             "--names", str(names), "--exclude-organisations", "Y", "--org-logo", "http://logo"]
    assert cli.main(flags, spark) == 0
    doc = json.loads(board_path.read_text())
    assert [(r["rank"], r["name"], r["mean_wer"], r["logo"], r["access"]) for r in doc["wer"]] == [(1, "x/b", 2.0, "", "open"), (2, "x/a", 3.0, "", "open")]
    assert doc["org_logo"] == "http://logo" and names.read_text() == "MODEL_NAMES = [\n    'x/a',\n    'x/b'\n]\n"
    assert spark.read.parquet(str(tmp_path / "t")).columns == schemas.RESULT_COLUMNS
    out = capsys.readouterr()
    assert "3 result(s): 1 local, 2 published only" in out.out and "excluded 1 row" in out.out and "bad.json" in out.err
    assert cli.main(flags, spark) == 0 and "unchanged" in capsys.readouterr().out
    assert cli.main(["publish", "--results-dir", str(tmp_path / "none")], spark) == 1


def test_evaluate_and_sweep(spark, tmp_path, monkeypatch, capsys):
    source = tmp_path / "sources"
    rows = [(bytearray(b""), "fleurs_00000", None), (bytearray(b""), " ", "fleurs_00001"), (bytearray(b""), None, "nej"), (bytearray(b""), None, None)]
    spark.createDataFrame(rows, "audio binary, transcription string, raw_transcription string").coalesce(1).write.parquet(str(source / "fleurs"))
    cache = tmp_path / "cache"
    (cache / "fleurs").mkdir(parents=True)
    (cache / "fleurs" / "fleurs_00000.wav").write_bytes(wav(2))
    common = ["--source-dir", str(source), "--audio-cache-dir", str(cache), "--out-dir", str(tmp_path / "results"), "--device", "cpu"]
    flags = ["evaluate", "--model", "lab/stub", "--backend", "stub", "--params-b", "0.5", "--datasets", "fleurs,ftspeech", "--outputs-dir", str(tmp_path / "outputs"), *common]
    assert cli.main(flags, spark) == 0
    assert "ftspeech did not load" in capsys.readouterr().err
    result = json.loads((tmp_path / "results" / "lab__stub.json").read_text())
    # The stub says a clip's name, which two of three references are.
    assert (result["fleurs_da_wer"], result["mean_wer"], result["ftspeech_wer"]) == (33.33, 33.33, None)
    assert result["model"] == f"[lab/stub]({naming.HUB}lab/stub)" and result["speed_x"] > 0 and len(result["submitted"]) == 10
    assert storage.exists(spark, str(cache / "fleurs.manifest.jsonl"))
    # What was saved scores the same again, and a full run reads its manifest.
    assert cli.main(["rescore", "--outputs-dir", str(tmp_path / "outputs"), "--unicode-form", "NFC", "--out-dir", str(tmp_path / "again")], spark) == 0
    again = json.loads((tmp_path / "again" / "lab__stub.json").read_text())
    assert again == result
    assert readers.load_dataset(spark, "fleurs", "nowhere", str(cache)).count() == 3
    assert cli.main([*flags[:5], "--datasets", "nope"], spark) == 1
    assert cli.main(["evaluate", "--model", "m", "--backend", "stub", "--datasets", "fleurs", *common], spark) == 1
    listed = tmp_path / "models.txt"
    listed.write_text(f"# models\nlab/one|stub|--params-b 1 --datasets fleurs --outputs-dir {tmp_path}/o {' '.join(common)}\nlab/two|stub|--datasets nope\nhosted|soniox|\nlab/three|stub|\n")
    monkeypatch.setenv("SKIP_MODELS", "lab/three")
    monkeypatch.setenv("MAX_SAMPLES", "1")
    assert cli.main(["sweep", str(listed), "--failures", str(tmp_path / "failed")], spark) == 0
    assert (tmp_path / "failed").read_text() == "lab/two\n" and json.loads((tmp_path / "results" / "lab__one.json").read_text())["fleurs_da_wer"] == 0.0


def test_fetch(spark, tmp_path, monkeypatch, capsys):
    table = "client\tpath\tsentence\nx\ta.wav\tførste\nx\tb.wav\tsyg\nx\tshort\nx\ta.wav\tanden\nx\tc.wav\t \n"
    files = {"cv/da/dev.tsv": table.encode(), "cv/da/test.tsv": b"nothing\there\n", "cv/da/clips/a.wav": wav(1.5), "cv/da/clips/b.wav": b"junk", "cv/da/clips/z.wav": wav(1)}
    for name in ("cv-corpus-16-da.tar.gz", "cv-corpus-17-da.tar.gz", "other.tar.gz"):
        (tmp_path / name).write_bytes(archives.tar_bytes(files))
    assert archives.find_archive(spark, str(tmp_path), cli.ARCHIVES).endswith("cv-corpus-17-da.tar.gz")
    assert archives.find_archive(spark, str(tmp_path), ["none*"]) is None
    assert cli.main(["fetch", "--output-dir", str(tmp_path), "--splits", "validation", "test"], spark) == 0
    out = capsys.readouterr().out
    assert "[validation] 1 extracted, 1 skipped" in out and "[test] 0 extracted, 0 skipped" in out
    manifest = str(tmp_path / "validation" / "validation_manifest.jsonl")
    row = spark.read.json(manifest).first()
    assert (row["text"], row["duration"], row["dataset"]) == ("anden", 1.5, "common_voice_da")
    assert row["audio_filepath"].endswith("/validation/audio/a.wav") and storage.exists(spark, row["audio_filepath"])
    assert cli.main(["fetch", "--output-dir", str(tmp_path), "--splits", "validation"], spark) == 0
    assert "manifest exists" in capsys.readouterr().out
    assert cli.main(["fetch", "--output-dir", str(tmp_path), "--splits", "validation,test"], spark) == 0
    assert capsys.readouterr().out.count("manifest exists") == 2
    # A local manifest is what the loader of this data set reads.
    monkeypatch.setenv("CV_DATA_DIR", str(tmp_path))
    assert readers.load_dataset(spark, "cv17", manifest, "").first()["reference_text"] == "anden"
    assert cli.main(["fetch", "--output-dir", str(tmp_path / "empty")], spark) == 1


def test_raw_outputs_round_trip_in_both_layouts(spark, saved, tmp_path):
    rows = readers.read_raw_outputs(spark, f"{saved}/*/*.jsonl")
    writers.write_raw_outputs(rows, str(tmp_path / "parted"))
    back = readers.read_raw_outputs(spark, str(tmp_path / "parted"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect())) and rows.count() == 8


def test_files_are_read_in_order(spark, tmp_path):
    """However splits are packed: large files first, in many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        (tmp_path / "a.jsonl").write_text(lines([{"audio_filepath": f"a{i}", "text": "x"} for i in range(20)]))
        (tmp_path / "b.jsonl").write_text(lines([{"audio_filepath": f"b{i}", "text": "x"} for i in range(2000)]))
        got = [r["audio_path"] for r in readers.read_external_manifest(spark, str(tmp_path), cap=25).collect()]
        assert got == [f"a{i}" for i in range(20)] + [f"b{i}" for i in range(5)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbering_over_files(spark, tmp_path):
    for name, values in (("p2", [3, 4]), ("p1", [0, 1, 2])):
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(str(tmp_path / "t" / name))
    rows = readers.numbered(spark.read.parquet(str(tmp_path / "t" / "p1"), str(tmp_path / "t" / "p2"))).collect()
    assert all(r["v"] == r["ordinal"] for r in rows)


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        naming.today_iso().alias("today"), naming.text_of(F.lit(None).cast("string")).alias("none"), naming.joined_segments(F.array(F.lit(" a "), F.lit("b"))).alias("segments"),
        naming.joined_alternatives(F.array(F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.array(F.lit("z")))).alias("alternatives"),
        naming.joined_chunks(F.array().cast("array<string>"), F.lit(" t ")).alias("chunks"), writers.folded(F.lit("Straße")).alias("folded"),
        naming.logo(F.lit("org/m"), {"org": "u", "openai": "o"}).alias("l1"), naming.logo(F.lit("GPT-4o-x"), {"openai": "o"}).alias("l2"),
        naming.logo(F.lit("scribe_v2"), {}).alias("l3"), naming.logo(F.lit("zz"), {}).alias("l4"),
    ).first()
    assert len(row["today"]) == 10 and (row["none"], row["segments"], row["alternatives"], row["chunks"], row["folded"]) == ("", "a b", "x z", "t", "strasse")
    assert (row["l1"], row["l2"], row["l4"]) == ("u", "o", "") and row["l3"] == naming.PROVIDER_LOGOS["scribe_v"]


def test_rates_as_aggregates(spark):
    rows = spark.createDataFrame([("a b", "a c"), ("", "x"), ("d e", None)], "r string, h string")
    got = rows.agg(scoring.compute_wer(F.col("r"), F.col("h")).alias("w"), scoring.compute_cer(F.col("r"), F.col("h")).alias("c")).first()
    assert got["w"] == 75.0 and round(got["c"], 3) == round(400 / 6, 3)
    assert rows.filter("r = ''").agg(scoring.compute_wer(F.col("r"), F.col("h")).alias("w")).first()["w"] == 0.0


def test_counts(spark):
    remote = spark.createDataFrame([("a",), ("b",)], "file string")
    local = spark.createDataFrame([("b",), ("c",)], "file string")
    assert tuple(board.origin_counts(remote, local).first()) == (3, 2, 1)
    table = spark.createDataFrame([("org/a",), ("x/b",)], "model string")
    assert board.excluded_count(table, {"ORG"}, set()).first()["n_excluded"] == 1
    assert readers.read_published_results(spark, "/nonexistent")[0].count() == 0
