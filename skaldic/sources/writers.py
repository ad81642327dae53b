"""Sinks: raw outputs, results, boards, name lists and documentation headers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from . import schemas, storage


def write_raw_outputs(rows: DataFrame, path: str) -> None:
    """JSON lines below model slug and data set, replacing the ones present; text is not escaped beyond JSON's needs."""
    from ..functions.naming import slugify

    slugged = rows.select(slugify(F.col("model")).alias("model"), "dataset", "id", "reference", "hypothesis")
    slugged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "dataset").json(path)


def write_output_table(rows: DataFrame, path: str) -> int:
    """Parquet partitioned by model, replacing only the models present; no rows write nothing. Returns the row count.

    The rows are counted as they pass to the files, so they are computed once.
    """
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)
    return seen.get["n"]


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines of test-set rows, in their order where they have one."""
    if "ordinal" in rows.columns:
        rows = rows.orderBy("ordinal")
    rows.select("audio_path", "reference_text").write.mode("overwrite").json(path)


def write_result_files(spark: SparkSession, results: DataFrame, folder: str, slug: str = "slug") -> list[str]:
    """``<slug>.json`` of each row, with its nulls; a table of results has a row per model. Returns the paths."""
    columns = [*schemas.RESULT_COLUMNS]
    paths = []
    for row in results.select(slug, *columns).orderBy(slug).toLocalIterator():
        path = f"{folder}/{row[slug]}.json"
        storage.write_text(spark, path, json.dumps({c: row[c] for c in columns}, indent=2, ensure_ascii=False) + "\n")
        paths.append(path)
    return paths


def result_json(*columns: str) -> Column:
    """A result as JSON that keeps its nulls."""
    return F.to_json(F.struct(*(columns or schemas.RESULT_COLUMNS)), {"ignoreNullFields": "false", "pretty": "true"})


def write_results(rows: DataFrame, path: str) -> None:
    """The results table in its column order, best first, in one file: it has a row per model."""
    ordered = rows.select(*schemas.RESULT_COLUMNS).orderBy(F.col("mean_wer").asc_nulls_last(), "model")
    ordered.coalesce(1).write.mode("overwrite").parquet(path)


def board_document(wer: DataFrame, cer: DataFrame, updated: Column, org_logo: str = "") -> DataFrame:
    """The two boards in rank order, as one JSON document."""

    def rows(board: DataFrame, name: str) -> DataFrame:
        return board.agg(F.array_sort(F.collect_list(F.struct(*board.columns))).alias(name))

    both = rows(wer, "wer").crossJoin(rows(cer, "cer"))  # one row each
    document = F.struct(updated.alias("updated"), F.lit(org_logo).alias("org_logo"), "wer", "cer")
    return both.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def folded(name: Column) -> Column:
    """Caseless form by full case folding; names of ASCII alone need no more than lower case."""

    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else n.casefold())

    return F.coalesce(fold(F.when(name.rlike(r"[^\x00-\x7F]"), name)), F.lower(name))


def model_names(board: DataFrame) -> DataFrame:
    """Distinct repository names, in caseless order."""
    from ..functions.naming import is_repository

    return board.filter(is_repository(F.col("name"), F.col("url"))).select("name").distinct().orderBy(folded(F.col("name")), "name")


def model_names_module(names: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(folded(F.col("name")), "name"))), lambda s: F.concat(F.lit("    '"), s["name"], F.lit("'"))), ",\n")
    return names.agg(F.concat(F.lit("MODEL_NAMES = [\n"), listed, F.lit("\n]\n")).alias("module"))


def card_configs(files: DataFrame) -> DataFrame:
    """Configs of a data card from repository paths: results first, then one per outputs file in path order."""
    results = files.filter("path = 'data/results.parquet'").select(
        F.lit(0).alias("o"), F.lit("results").alias("config_name"), F.lit("train").alias("split"), "path", F.lit(True).alias("default")
    )
    outputs = files.filter(F.col("path").startswith("outputs/") & F.col("path").endswith(".parquet")).select(
        F.lit(1).alias("o"),
        F.regexp_extract("path", r"([^/]*)\.parquet$", 1).alias("config_name"),
        F.lit("test").alias("split"),
        "path",
        F.lit(None).cast("boolean").alias("default"),
    )
    return results.unionByName(outputs).orderBy("o", "path").select(
        "config_name", F.array(F.struct("split", "path")).alias("data_files"), "default"
    )


def changed(old: str | None, new: str) -> bool:
    """Whether a document is worth writing."""
    return old != new


def write_metadata(values: dict) -> str:
    return json.dumps(values, indent=2, ensure_ascii=False)
