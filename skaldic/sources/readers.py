"""Scans. All take paths that Spark resolves; none lists or opens files itself."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.naming import first_non_blank
from ..functions.text import python_strip
from . import schemas, storage


def file_order() -> Column:
    """Sorts rows of text files as they stand: by file, split and place, however Spark packs splits into tasks."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def read_raw_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(model, dataset, id, reference, hypothesis) of a folder of raw outputs, or of the files of a glob. Bad lines fail.

    Either layout: folders by model and data set as ``write_raw_outputs`` makes
    them, or JSON lines whose stem is the data set, in a folder per model.
    """
    read = spark.read.option("mode", "FAILFAST")
    if storage.glob(spark, f"{path}/model=*"):
        rows = read.option("basePath", path).schema(f"{schemas.RAW_OUTPUT}, model string, dataset string").json(path)
    else:
        files = storage.glob(spark, f"{path}/*.jsonl") or storage.glob(spark, path)
        rows = read.schema(schemas.RAW_OUTPUT).json(files)
        names = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1), F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.jsonl$", 1)
        rows = rows.withColumns({"model": F.url_decode(names[0]), "dataset": F.url_decode(names[1])})
    return rows.select("model", "dataset", "id", "reference", "hypothesis")


def read_outputs_folder(spark: SparkSession, folder: str, model: str = "") -> DataFrame | None:
    """(model, dataset, id, reference, hypothesis) of every source below ``folder``, or of one model; None if there is none.

    Sources are combined files ``<slug>.jsonl`` and folders of JSON lines.
    """
    from ..operators.outputs import layouts

    slug = slug_of(model) if model else "*"
    files = storage.glob(spark, f"{folder}/{slug}.jsonl")
    folders = storage.glob(spark, f"{folder}/{slug}/*.jsonl")
    parted = storage.glob(spark, f"{folder}/model={slug}")
    parts = []
    if files:
        rows = spark.read.schema(schemas.COMBINED).option("mode", "FAILFAST").json(files)
        stem = F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.jsonl$", 1))
        parts.append(combined_aliases(rows.withColumn("model", stem), "model"))
    if folders or parted:
        rows = read_raw_outputs(spark, folder) if parted else read_raw_outputs(spark, f"{folder}/{slug}/*.jsonl")
        parts.append(rows.filter(F.col("model") == slug) if model else rows)
    if len(parts) == 2:
        return layouts(parts[0], parts[1], one_model=bool(model))
    return parts[0] if parts else None


def slug_of(name: str) -> str:
    """``naming.slugify`` of a name at hand."""
    return re.sub("[^a-zA-Z0-9_-]", "__", name.strip("/"))


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of several data sets; ``set`` and ``audio`` stand in for missing or empty names."""
    return combined_aliases(spark.read.schema(schemas.COMBINED).option("mode", "FAILFAST").json(path))


def combined_aliases(rows: DataFrame, *more: str) -> DataFrame:
    def either(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))

    return rows.select(*more, either("dataset", "set").alias("dataset"), either("id", "audio").alias("id"), "reference", "hypothesis")


def read_manifest(spark: SparkSession, path: str, audio: DataFrame | None = None) -> DataFrame:
    """A manifest; with a listing of audio files (``path``), the rows whose file exists."""
    rows = spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").json(path)
    return rows if audio is None else existing_files(rows, audio)


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files below a folder, which are listed and not read."""
    if not storage.exists(spark, folder):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def existing_files(rows: DataFrame, audio: DataFrame, column: str = "audio_path") -> DataFrame:
    listed = audio.select(F.regexp_replace("path", "^file:/*", "/").alias("_path")).distinct()
    return rows.join(listed, F.regexp_replace(F.col(column), "^file:/*", "/") == F.col("_path"), "left_semi")


def read_external_manifest(spark: SparkSession, path: str, cap: int = 0, audio: DataFrame | None = None) -> DataFrame:
    """Rows with a path and text, text stripped; the cap counts what is left. (ordinal, audio_path, reference_text)"""
    rows = spark.read.schema(schemas.EXTERNAL_MANIFEST).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("ordinal", file_order())
    kept = rows.select("ordinal", F.col("audio_filepath").alias("audio_path"), python_strip(F.col("text")).alias("reference_text"))
    kept = kept.filter("audio_path != '' and reference_text != ''")
    if audio is not None:
        kept = existing_files(kept, audio)
    return cap_after(kept, "ordinal", cap)


def cap_before(rows: DataFrame, ordinal: str, cap: int) -> DataFrame:
    """Rows of the first ``cap`` ordinals, whatever later filters drop; 0 is all."""
    return rows.filter(F.col(ordinal) < cap) if cap else rows


def cap_after(rows: DataFrame, ordinal: str, cap: int) -> DataFrame:
    """The first ``cap`` rows that are left; 0 is all. The limit is taken per task before it is taken in all."""
    return rows.orderBy(ordinal).limit(cap) if cap else rows


def materialise(rows: DataFrame, slug: str, text_keys: tuple[str, ...], cap: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """Test-set rows from source rows: (ordinal, audio_path, reference_text).

    The cap counts raw rows, before those without text are dropped, and the
    name of a clip has its raw ordinal, of five digits or more.
    """
    keys = [k for k in text_keys if k in rows.columns]
    text = first_non_blank(*[F.col(k) for k in keys]) if keys else F.lit(None).cast("string")
    return cap_before(rows, ordinal, cap).select(
        ordinal, clip_name(slug, F.col(ordinal)).alias("audio_path"), text.alias("reference_text")
    ).filter(F.col("reference_text").isNotNull())


def clip_name(slug: str, ordinal: Column) -> Column:
    number = ordinal.cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return F.concat(F.lit(f"{slug}_"), padded, F.lit(".wav"))


# The text columns of each source, in order of preference.
TEXT_KEYS = {
    "coral_conversation": ("text",),
    "coral_read_aloud": ("text",),
    "cv17": ("sentence", "text"),
    "fleurs": ("transcription", "raw_transcription"),
    "ftspeech": ("text", "sentence"),
}


def load_or_skip(loaders: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Data sets that load, and what went wrong with the others, whose columns stay null."""
    good, bad = {}, {}
    for name, load in loaders.items():
        try:
            good[name] = load()
        except Exception as e:  # noqa: BLE001  a source that fails must not stop the others
            bad[name] = f"{type(e).__name__}: {e}"
    return good, bad


def load_dataset(spark: SparkSession, selector: str, source: str, cache: str, cap: int = 0, audio: DataFrame | None = None) -> DataFrame:
    """Test-set rows of a data set: its manifest in ``cache`` for full runs that have one, else its source table.

    A source is a Parquet table; ``cv17`` is a manifest of its own. A full run
    leaves a manifest behind, a capped one doesn't. With ``audio``, a listing such as ``audio_files``
    gives, a manifest's rows whose file is not there are left out.
    """
    if selector == "cv17":
        return read_external_manifest(spark, source, cap, audio)
    manifest = f"{cache}/{selector}.manifest.jsonl"
    if not cap and storage.exists(spark, manifest):
        return read_manifest(spark, manifest, audio).withColumn("ordinal", file_order())
    rows = materialise(numbered(spark.read.parquet(source)), selector, TEXT_KEYS[selector], cap)
    rows = rows.withColumn("audio_path", F.concat(F.lit(f"{cache}/{selector}/"), "audio_path"))
    if not cap:
        from .writers import write_manifest

        write_manifest(rows, manifest)
    return rows


def placed(scan: DataFrame) -> DataFrame:
    """A scan of files of any format with ``ordinal``: the place of a row from 0, by path and place in the file.

    Two passes: the first counts the rows of every block that a task read in one
    go, which is as many rows as there are blocks; the second adds what lies before a block
    to a row's place in it. No row is sorted or moved.
    """
    marked = scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    blocks = marked.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")
    offsets = blocks.select("_file", "_block", (before - F.col("_first")).alias("_offset"))
    return marked.join(offsets, ["_file", "_block"]).withColumn("ordinal", F.col("_id") + F.col("_offset")).drop("_file", "_block", "_id", "_offset")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files with ``ordinal``, their place from 0 over the files in path order. Only files are sorted."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_file").withColumn("ordinal", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files, one object each, with their file name; NaN counts as missing. A file that isn't an object fails."""
    rows = spark.read.schema(schemas.RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return nan_to_null(rows).withColumn("file", F.col("_metadata.file_name"))


def read_published_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(results, files that were skipped as they can't be read). A folder that is missing or empty has no results."""
    schema = f"{schemas.RESULT}, _bad string"
    paths = storage.glob(spark, f"{folder}/*.json")
    if not paths:
        none = spark.createDataFrame([], f"{schemas.RESULT}, file string")
        return none, none.select("file")
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "true"})
    rows = texts.withColumn("_r", parsed).select("_r.*", "file")
    return nan_to_null(rows.filter("_bad is null")).drop("_bad"), rows.filter("_bad is not null").select("file")


def nan_to_null(rows: DataFrame) -> DataFrame:
    doubles = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    return rows.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of runs, with the name of its folder as ``slug``; no rows where there is none.

    It lies in a model's folder, or below ``_runs``, out of the way of data partitioned by model.
    """
    paths = storage.glob(spark, f"{folder}/*/meta.json") + storage.glob(spark, f"{folder}/_runs/*/meta.json")
    if not paths:
        return spark.createDataFrame([], f"{schemas.RUN}, slug string")
    rows = spark.read.schema(schemas.RUN).option("multiLine", True).json(paths)
    return rows.withColumn("slug", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/[^/]*$", 1)))


def attach_runs(rows: DataFrame, runs: DataFrame, slug: str = "slug") -> DataFrame:
    """Rows with their run's metadata; the slug stands in for a missing name, other gaps have defaults."""
    from ..functions.naming import default_access, slugify

    key = F.coalesce("slug", slugify(F.col("model"))) if "slug" in runs.columns else slugify(F.col("model"))
    meta = runs.select(key.alias(slug), F.col("model").alias("_model"), "params_b", "access", "submitted", "speed_x", "model_link")
    return rows.join(meta, slug, "left").select(
        *rows.columns,
        F.coalesce("_model", slug).alias("model_name"),
        F.coalesce("model_link", F.lit("")).alias("model_link"),
        F.coalesce("params_b", F.lit(0.0)).alias("params_b"),
        "speed_x",
        F.coalesce("submitted", F.lit("")).alias("submitted"),
        default_access(F.col("access")).alias("access"),
    )


def read_clip_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated clip table with ``path`` and ``sentence`` or ``text``; of a repeated clip the last row counts."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    keys = [c for c in ("sentence", "text") if c in rows.columns][:1]
    if "path" not in rows.columns or not keys:
        raise ValueError("the table needs a path and a sentence or text column")
    return last_of_each(
        rows.select(file_order().alias("ordinal"), python_strip(F.col("path")).alias("path"), python_strip(F.col(keys[0])).alias("text"))
        .filter("path != '' and text != ''")
    )


def last_of_each(rows: DataFrame, key: str = "path", ordinal: str = "ordinal") -> DataFrame:
    others = [c for c in rows.columns if c not in (key, ordinal)]
    last = F.max_by(F.struct(*others), ordinal).alias("_last")
    return rows.groupBy(key).agg(last, F.max(ordinal).alias(ordinal)).select(ordinal, key, "_last.*")


def split_alias(split: Column) -> Column:
    return F.when(split.isin("validation", "val"), F.lit("dev")).otherwise(split)


def split_frontmatter(text: Column) -> Column:
    """struct(header, body) of a document that may open with a header between dashes."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    has = text.rlike(r"(?s)^---\n.*?\n---\n")
    return F.struct(
        F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(F.lit("")).alias("header"),
        F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"),
    )


@F.pandas_udf(DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Seconds of a WAV file's bytes, 0 if they can't be read."""

    def one(data):
        try:
            with wave.open(io.BytesIO(bytes(data))) as w:
                return w.getnframes() / w.getframerate()
        except Exception:  # noqa: BLE001  unreadable audio has no length
            return 0.0

    return content.map(one)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over the tasks by ``keys`` where the scan itself makes too few.

    A scan hands out at most a split of bytes a task, but at least a row group,
    so a small file is one task however many cores wait. Input of a split or
    more for every core is spread by its scan and isn't shuffled.
    """
    spark = rows.sparkSession
    scanned = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if scanned < cores * split else rows
