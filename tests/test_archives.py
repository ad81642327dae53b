"""Archives staged once: each is streamed a single time, later steps run in many tasks."""

import io
import wave

from skaldic import cli
from skaldic.sources import archives, storage


def sound(seconds, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\1\0" * int(2 * seconds * rate))
    return out.getvalue()


def table(names):
    return ("path\tsentence\n" + "".join(f"{n}\ttext of {n}\n" for n in names)).encode()


def test_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "STAGED_MEMBERS", 3)
    for k in range(2):
        files = {f"c/clips/{k}-{i}.wav": sound(0.1) for i in range(10)} | {"c/empty.wav": b""}
        (tmp_path / f"a{k}.tar.gz").write_bytes(archives.tar_bytes(files))
    staged = archives.stage(spark, f"{tmp_path}/a*.tar.gz", f"{tmp_path}/staged")
    assert len(staged.inputFiles()) >= 8
    # The archives aren't needed any more.
    for k in range(2):
        (tmp_path / f"a{k}.tar.gz").unlink()
    rows = staged.collect()
    assert len(rows) == 22 and {(r["size"], len(r["content"])) for r in rows} == {(len(sound(0.1)),) * 2, (0, 0)}
    plan = staged.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_no_archive_gives_an_empty_table(spark, tmp_path):
    assert archives.stage(spark, f"{tmp_path}/none*.tar.gz", f"{tmp_path}/staged").count() == 0


def test_fetch_reads_an_archive_once(spark, tmp_path, monkeypatch, capsys):
    files = {f"c/clips/{n}.wav": sound(0.5) for n in "abcd"} | {"c/clips/e.wav": b"junk"}
    files |= {"c/test.tsv": table(["a.wav", "b.wav", "e.wav"]), "c/dev.tsv": table(["c.wav"]), "c/train.tsv": table(["d.wav", "a.wav"])}
    (tmp_path / "x.tar.gz").write_bytes(archives.tar_bytes(files))
    asked = []
    stage = archives.stage
    monkeypatch.setattr(archives, "stage", lambda *a: asked.append(a) or stage(*a))
    assert cli.main(["fetch", "--output-dir", str(tmp_path), "--tarball", f"{tmp_path}/x.tar.gz", "--splits", "test,validation", "train"], spark) == 0
    out = capsys.readouterr().out
    assert len(asked) == 1 and not storage.exists(spark, asked[0][2])
    assert "[test] 2 extracted, 1 skipped" in out and "[validation] 1 extracted, 0 skipped" in out and "[train] 2 extracted, 0 skipped" in out
    rows = spark.read.json(f"{tmp_path}/*/*_manifest.jsonl").collect()
    assert sorted(r["text"] for r in rows) == sorted(f"text of {n}.wav" for n in "aabcd")
    for r in rows:
        with wave.open(r["audio_filepath"]) as w:
            assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, 16000, 8000)
