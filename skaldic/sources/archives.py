"""Speech corpora packed in tar archives: look-up, members, clip tables, clips with text."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.text import python_strip
from . import storage, waveforms
from .readers import last_of_each, split_alias

MEMBER = "archive string, ordinal long, path string, content binary"
BATCH_BYTES = 16 << 20
STAGED_MEMBERS = 1024


def find_archive(spark: SparkSession, folder: str, patterns: list[str]) -> str | None:
    """Of the first pattern that matches anything, the lexically last path."""
    for pattern in patterns:
        if found := storage.glob(spark, f"{folder}/{pattern}"):
            return found[-1]
    return None


def read_members(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Files of the archives at ``path`` whose base name fits the glob ``names``: archive, ordinal, path, content.

    An archive is one stream, read by one task in batches of bounded bytes, so
    neither its size nor its number of members has to fit in memory.
    """
    import fnmatch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                yield from members(archive)

    def members(archive: str) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        with open_stream(archive) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for ordinal, member in enumerate(tar):
                if not member.isfile() or not fnmatch.fnmatchcase(posixpath.basename(member.name), names):
                    continue
                held.append((archive, ordinal, member.name, tar.extractfile(member).read()))
                size += member.size
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=["archive", "ordinal", "path", "content"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["archive", "ordinal", "path", "content"])

    paths = storage.glob(spark, path)
    if not paths:
        return spark.createDataFrame([], MEMBER)
    listed = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(len(paths), "archive")
    return listed.mapInPandas(run, MEMBER)


def stage(spark: SparkSession, path: str, folder: str, names: str = "*") -> DataFrame:
    """``read_members`` written once below ``folder`` and read back, with ``size``: what every later step reads.

    A stream of a compressed archive can't be split, so one task reads it, once.
    The table it leaves has files of few members and blocks of bounded bytes,
    so all steps after it run in many tasks, and those that look for names or
    sizes don't read contents. A job that loses an executor reads that task's archive anew.
    """
    rows = read_members(spark, path, names).withColumn("size", F.octet_length("content").cast("long"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", STAGED_MEMBERS).option("parquet.block.size", BATCH_BYTES).option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def open_stream(path: str):
    """A stream of bytes from any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_stream(inner, compression=None)


def clip_table(tables: DataFrame, content: str = "content") -> DataFrame:
    """(ordinal, path, text) of tab-separated tables in ``content``.

    The header tells where ``path`` is and the first of ``sentence`` and
    ``text``; short lines and blank fields are dropped, and so is a table
    without these columns. Of a repeated clip the last line counts.
    """
    lines = tables.select(F.split(F.decode(content, "UTF-8"), "\r\n|\n|\r").alias("lines"))
    header = F.split(F.col("lines")[0], "\t")

    def place(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0).cast("long")) for n in names]).cast("int")

    located = lines.withColumns({"_path": place("path"), "_text": place("sentence", "text")}).dropna(subset=["_path", "_text"])
    rows = located.select("_path", "_text", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("ordinal", "line"))
    fields = rows.withColumn("f", F.split("line", "\t")).select(
        F.col("ordinal").cast("long").alias("ordinal"),
        python_strip(F.try_element_at("f", F.col("_path"))).alias("path"),
        python_strip(F.try_element_at("f", F.col("_text"))).alias("text"),
    )
    return last_of_each(fields.filter("path != '' and text != ''"))


def split_table(members: DataFrame, split: str) -> DataFrame:
    """The clip table of a split, which is one of the archives' ``members``."""
    wanted = F.concat(split_alias(F.lit(split)), F.lit(".tsv"))
    return clip_table(members.filter(F.regexp_extract("path", "([^/]*)$", 1) == wanted))


def clips(members: DataFrame, table: DataFrame, folder: str) -> DataFrame:
    """Members that the table names, as manifest rows: audio_filepath, text, duration, dataset, usable.

    A clip whose length can't be read is not usable; its file's name is the
    clip's with the extension ``wav``, and so is its content: one channel of
    16-bit samples at 16 kHz. Only containers of plain samples are decoded here.
    """
    base = F.regexp_extract("path", "([^/]*)$", 1)
    named = members.withColumn("clip", base).join(table.select(F.col("path").alias("clip"), "text"), "clip")
    return named.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_replace("clip", r"(.)\.[^.]*$", "$1"), F.lit(".wav")).alias("audio_filepath"),
        "text",
        F.round(waveforms.seconds(F.col("content")), 3).alias("duration"),
        waveforms.as_pcm(F.col("content")).alias("content"),
    ).withColumn("usable", F.col("duration") > 0)


def extract_counts(found: DataFrame) -> DataFrame:
    """One row: how many clips were extracted and how many skipped."""
    return found.agg(F.count_if("usable").alias("n_extracted"), F.count_if(~F.col("usable")).alias("n_skipped"))


def observed_counts(found: DataFrame) -> tuple[DataFrame, Observation]:
    """``found`` and its ``extract_counts``, which are known once what follows has run."""
    counts = Observation()
    return found.observe(counts, F.count_if("usable").alias("n_extracted"), F.count_if(~F.col("usable")).alias("n_skipped")), counts


def write_clips(found: DataFrame, dataset: str) -> DataFrame:
    """Writes the audio of usable clips at their paths, from the tasks that hold it; the manifest rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, content in zip(pdf["audio_filepath"], pdf["content"], strict=True):
                system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                system.create_dir(posixpath.dirname(inner), recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(bytes(content))
            yield pdf.assign(dataset=dataset)[["audio_filepath", "text", "duration", "dataset"]]

    return found.filter("usable").mapInPandas(run, "audio_filepath string, text string, duration double, dataset string")


def tar_bytes(files: dict[str, bytes]) -> bytes:
    """A compressed archive of small files, for fixtures."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()
