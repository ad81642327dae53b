"""Results over results: merge, backfill, exclude, rank and decorate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import naming
from ..functions.rounding import exact_round
from ..sources import schemas
from ..sources.readers import nan_to_null
from .scoring import rank_rows

# Metrics of the two boards, in order.
WER_METRICS = [
    "mean_wer", "mean_cer", "speed_x", "coral_conversation_wer", "coral_read_aloud_wer", "ftspeech_wer", "cv17_da_wer", "fleurs_da_wer",
]
CER_METRICS = ["mean_cer", "coral_conversation_cer", "coral_read_aloud_cer", "ftspeech_cer", "cv17_da_cer", "fleurs_da_cer"]


def overlay(remote: DataFrame, local: DataFrame, key: str = "file") -> DataFrame:
    """Whole rows: a local row replaces the remote one of its key. ``origin`` tells where a row is from."""
    only_remote = remote.join(local.select(key), key, "left_anti")
    return local.withColumn("origin", F.lit("local")).unionByName(
        only_remote.withColumn("origin", F.lit("remote")), allowMissingColumns=True
    )


def results_table(merged: DataFrame) -> DataFrame:
    """The published columns; missing ones are null, missing access is open."""
    present = set(merged.columns)
    cols = []
    for f in schemas.RESULT.split(", "):
        name, kind = f.split()
        cols.append(F.col(name) if name in present else F.lit(None).cast(kind).alias(name))
    return merged.select(*cols).withColumn("access", naming.default_access(F.col("access")))


def backfill(results: DataFrame) -> DataFrame:
    """Older tables: speed from the real-time factor at one place (null for 0), access where there is none."""
    if "rtf" in results.columns and "speed_x" not in results.columns:
        inverse = F.try_divide(F.lit(1.0), F.col("rtf"))
        results = results.withColumn("speed_x", exact_round(inverse, 1)).drop("rtf")
    if "access" not in results.columns:
        results = results.withColumn("access", F.lit("open"))
    return results


def excluded(name: Column, organisations: set[str], models: set[str]) -> Column:
    """Caseless: by organisation, or by exact name. Both lists are settings of bounded length."""
    org = F.lower(naming.organisation(name))
    return org.isin(*[o.lower() for o in organisations] or [""]) & (org != "") | F.lower(name).isin(
        *[m.lower() for m in models] or [""]
    )


def exclude(results: DataFrame, organisations: set[str], models: set[str], cell: str = "model") -> DataFrame:
    """Drops rows before anything ranks them, so ranks stay without gaps."""
    return results.filter(~F.coalesce(excluded(naming.link_name(F.col(cell)), organisations, models), F.lit(False)))


def excluded_count(results: DataFrame, organisations: set[str], models: set[str], cell: str = "model") -> DataFrame:
    """One row: how many rows ``exclude`` drops."""
    gone = F.coalesce(excluded(naming.link_name(F.col(cell)), organisations, models), F.lit(False))
    return results.agg(F.count_if(gone).alias("n_excluded"))


def origin_counts(remote: DataFrame, local: DataFrame, key: str = "file") -> DataFrame:
    """One row: files in all, local ones, and those that only the remote side has."""
    both = overlay(remote.select(key), local.select(key), key)
    return both.agg(
        F.count("*").alias("n_files"), F.count_if(F.col("origin") == "local").alias("n_local"), F.count_if(F.col("origin") == "remote").alias("n_remote_only")
    )


def board(
    results: DataFrame, metric: str, metrics: list[str], overrides: dict[str, float] | None = None, avatars: dict[str, str] | None = None
) -> DataFrame:
    """Rows with the metric, ranked and decorated. A repository keeps its own link; a hosted model gets its documentation's.

    ``avatars`` has the logo of each organisation, as no network is asked.
    """
    rows = nan_to_null(results).dropna(subset=[metric])
    name = naming.link_name(F.col("model"))
    rows = rows.withColumns({"name": name, "_url": naming.link_url(F.col("model"))})
    is_repo = F.contains(F.col("name"), F.lit("/"))
    return rank_rows(rows, metric).select(
        "rank",
        "name",
        F.when(is_repo, F.col("_url")).otherwise(naming.first_substring(F.col("name"), naming.PROVIDER_DOCS)).alias("url"),
        naming.logo(F.col("name"), avatars or {}).alias("logo"),
        F.coalesce("access", F.lit("open")).alias("access"),
        naming.official_size(F.col("name"), F.col("params_b"), overrides).alias("size"),
        naming.submitted_day(F.col("submitted")).alias("submitted"),
        *[naming.number_or_null(F.col(m)).alias(m) for m in metrics if m in results.columns],
    )


def boards(results: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(by word error rate, by character error rate), ranked apart."""
    return board(results, "mean_wer", WER_METRICS, **kwargs), board(results, "mean_cer", CER_METRICS, **kwargs)


def count_datasets(columns: list[str], default: int = 5) -> int:
    """How many data sets a table's columns speak of."""
    return sum(c.endswith("_wer") and c != "mean_wer" for c in columns) or default
