"""Parameters from the headers of files of known shapes."""

import json
import struct

from pyspark.sql import functions as F

from skaldic.sources import weights


def blob(shapes, data=b"", more=None):
    head = {**(more or {}), **{n: {"dtype": d, "shape": s, "data_offsets": [0, 0]} for n, (d, s) in shapes.items()}}
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + data


def put(folder, files):
    folder.mkdir(parents=True)
    for name, content in files.items():
        (folder / name).write_bytes(content)


def test_parameters(spark, tmp_path):
    put(tmp_path / "whole", {
        "model.safetensors": blob({"w": ("F16", [1000, 3000]), "b": ("F32", [7]), "scale": ("F32", []), "none": ("F32", [0, 5])}, b"\xff" * 500, {"__metadata__": {"format": "pt"}}),
        # The same model in shards does not count again.
        "model-00001-of-00001.safetensors": blob({"w": ("F16", [1000, 3000])}),
        "notes.txt": b"no weights",
    })
    put(tmp_path / "a" / "shards", {f"model-0000{k}-of-00003.safetensors": blob({f"l{k}": ("BF16", [500_000, k])}) for k in (1, 2, 3)} | {"adapter.safetensors": blob({"x": ("F32", [9])})})
    put(tmp_path / "other", {"adapter.safetensors": blob({"x": ("F32", [3, 3])})})
    put(tmp_path / "bad", {"model-1-of-2.safetensors": blob({"x": ("F32", [3])}), "model-2-of-2.safetensors": struct.pack("<Q", 1 << 40) + b"{}"})
    put(tmp_path / "short", {"model.safetensors": b"abc"})
    put(tmp_path / "text", {"model.safetensors": struct.pack("<Q", 3) + b"[1]"})
    put(tmp_path / "empty", {"model.safetensors": blob({})})
    files = weights.weight_files(spark, str(tmp_path))
    got = {r["folder"].rsplit("/", 1)[1]: tuple(r)[1:] for r in weights.parameters(files).collect()}
    assert got == {
        "whole": (1, 4, 3_000_008, 0.003), "shards": (3, 3, 3_000_000, 0.003), "other": (1, 1, 9, 0.0), "bad": (2, 1, None, None),
        "short": (1, 0, None, None), "text": (1, 0, None, None), "empty": (1, 0, 0, 0.0),
    }


def test_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame([("m", f"t{i}", [i, 2]) for i in range(1, 9)] + [("n", "x", [])], "model string, name string, shape array<bigint>")
    rows = weights.header_of(shapes, "model").withColumn("path", F.concat("model", F.lit("/model.safetensors")))
    assert weights.write_headers(rows, f"file:{tmp_path}/w").count() == 2
    read = weights.headers(weights.weight_files(spark, f"{tmp_path}/w"))
    names = weights.tensors(read).orderBy("name").collect()
    assert [(r["name"], r["shape"], r["n_params"]) for r in names] == [(f"t{i}", [i, 2], 2 * i) for i in range(1, 9)] + [("x", [], 1)]
    head = json.loads(read.filter("path like '%/m/%'").first()["header"])
    assert head["t2"]["data_offsets"] == [8, 24] and head["t8"]["data_offsets"][1] == 4 * 72


def test_of_one_folder(spark, tmp_path):
    put(tmp_path / "m", {"model.safetensors": blob({"w": ("F16", [50_000, 1_000])})})
    put(tmp_path / "m" / "draft", {"model.safetensors": blob({"w": ("F16", [9_000_000])})})
    assert weights.params_b(spark, f"{tmp_path}/m") == 0.05
    put(tmp_path / "none", {"config.json": b"{}"})
    assert weights.params_b(spark, f"{tmp_path}/none") is None
