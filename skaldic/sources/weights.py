"""Parameters counted from files of weights, of which only the headers are read.

A file opens with eight bytes, the length of a JSON header that names every
tensor with its type, shape and place; the numbers themselves stay where they are.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.rounding import exact_round
from . import storage

HEADER = "map<string, struct<dtype: string, shape: array<bigint>, data_offsets: array<bigint>>>"
# The format's limit on a header, the key that is no tensor, names of the one file and of its shards.
_LONGEST = 100_000_000
_NOT_A_TENSOR = "__metadata__"
_WHOLE = "model.safetensors"
_SHARD = r"-\d+-of-\d+\.safetensors$"


def weight_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of weights at or below ``path``, which are listed and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.safetensors").load(path)
    return files.select("path", "length")


def main_files(files: DataFrame) -> DataFrame:
    """(folder, path) of the files that make a folder's model: the whole one, else its shards, else whatever is there.

    Else a model kept both whole and in shards would count twice.
    """
    base = F.regexp_extract("path", "([^/]*)$", 1)
    order = F.when(base == _WHOLE, 0).when(base.rlike(_SHARD), 1).otherwise(2)
    ranked = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path", order.alias("_order"))
    best = ranked.groupBy("folder").agg(F.min("_order").alias("_order"))
    return ranked.join(best, ["folder", "_order"]).select("folder", "path")


def headers(files: DataFrame) -> DataFrame:
    """``files`` with ``header``, the JSON text at the head of ``path``; null where there is none or it is cut short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1]
                yield row.assign(header=[_header(row["path"].iloc[0])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{kinds}, header string")


def _header(path: str) -> str | None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    with system.open_input_file(inner) as file:
        size = file.size()
        if size < 8:
            return None
        (length,) = struct.unpack("<Q", file.read_at(8, 0))
        if not 2 <= length <= min(_LONGEST, size - 8):
            return None
        try:
            return file.read_at(length, 8).decode("utf-8")
        except UnicodeDecodeError:
            return None


def tensors(with_headers: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with name, dtype, shape and n_params of every tensor. A tensor without dimensions is one number."""
    entries = with_headers.select(*keys, F.explode(F.from_json("header", HEADER)).alias("name", "t")).filter(F.col("name") != _NOT_A_TENSOR)
    count = F.aggregate("t.shape", F.lit(1).cast("long"), lambda n, k: n * k)
    return entries.select(*keys, "name", "t.dtype", "t.shape", count.alias("n_params"))


def parameters(files: DataFrame) -> DataFrame:
    """(folder, n_files, n_tensors, n_params, params_b) of every folder's model.

    ``params_b`` is in thousands of millions to three places. One file that
    can't be read makes both counts of numbers null, as the rest is less than the model.
    """
    read = headers(main_files(files)).withColumn("_bad", F.from_json("header", HEADER).isNull())
    by_file = tensors(read, "path").groupBy("path").agg(F.count("*").alias("n_tensors"), F.sum("n_params").alias("n_params"))
    sums = read.select("folder", "path", "_bad").join(by_file, "path", "left").groupBy("folder").agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("n_tensors"), F.lit(0)).cast("long").alias("n_tensors"),
        F.when(F.count_if("_bad") == 0, F.coalesce(F.sum("n_params"), F.lit(0))).cast("long").alias("n_params"),
    )
    return sums.withColumn("params_b", exact_round(F.col("n_params").cast("double") / 1e9, 3))


def params_b(spark: SparkSession, folder: str) -> float | None:
    """The count of the model in ``folder`` itself, in thousands of millions; None if it has no weights that can be read."""
    pattern = f"{folder.rstrip('/')}/*.safetensors"
    if not storage.glob(spark, pattern):
        return None
    return parameters(weight_files(spark, pattern)).select("params_b").first()["params_b"]


def header_of(shapes: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with ``header`` for rows of (keys, name, shape) of 32-bit tensors laid end to end in the order of their names.

    A header is one text, so the tensors of one ``keys`` are as many as a file should have.
    """
    size = F.aggregate("shape", F.lit(4).cast("long"), lambda n, k: n * k)
    end = F.sum("_size").over(Window.partitionBy(*keys).orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    laid = shapes.withColumn("_size", size).withColumn("_end", end)
    place = F.array(F.col("_end") - F.col("_size"), F.col("_end"))
    tensor = F.struct(F.lit("F32").alias("dtype"), F.col("shape").alias("shape"), place.alias("data_offsets"))
    return laid.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", tensor.alias("tensor")))))).alias("header"))


def write_headers(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the ``header`` of each row at ``folder``/``path``, without the numbers; (path) of what was written.

    A task that runs twice writes the same bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, header in zip(pdf["path"], pdf["header"], strict=True):
                full = f"{folder}/{path}"
                system, inner = fs.FileSystem.from_uri(full if "://" in full else "file://" + full.removeprefix("file:"))
                system.create_dir(posixpath.dirname(inner), recursive=True)
                data = header.encode("utf-8")
                with system.open_output_stream(inner) as out:
                    out.write(struct.pack("<Q", len(data)) + data)
            yield pdf[["path"]]

    return rows.select("path", "header").mapInPandas(run, "path string")
