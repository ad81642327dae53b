"""Schemas of everything that is read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The data sets (selector, column, title, core) of the published table.
DATASETS = [
    ("coral_conversation", "coral_conversation", "CoRal-v3 conversation", True),
    ("coral_read_aloud", "coral_read_aloud", "CoRal-v3 read-aloud", True),
    ("cv17", "cv17_da", "Common Voice 17 (da)", True),
    ("fleurs", "fleurs_da", "FLEURS (da_dk)", True),
    ("ftspeech", "ftspeech", "FTSpeech", True),
]
CORE_COLUMNS = tuple(c for _, c, _, core in DATASETS if core)

RAW_OUTPUT = "id string, reference string, hypothesis string"
RAW_OUTPUT_TABLE = "dataset string, " + RAW_OUTPUT
COMBINED = "dataset string, `set` string, id string, audio string, reference string, hypothesis string"
MANIFEST = "audio_path string, reference_text string"
EXTERNAL_MANIFEST = "audio_filepath string, text string, duration double, dataset string"
RUN = (
    "model string, model_link string, params_b double, access string, submitted string, unicode_form string, "
    "number_words boolean, filler_words boolean, speed_x double, datasets array<string>"
)
# The order of columns of the results table.
RESULT_COLUMNS = [
    "model",
    "access",
    "params_b",
    "mean_wer",
    "mean_cer",
    "speed_x",
    "coral_conversation_wer",
    "coral_read_aloud_wer",
    "cv17_da_wer",
    "fleurs_da_wer",
    "ftspeech_wer",
    "coral_conversation_cer",
    "coral_read_aloud_cer",
    "cv17_da_cer",
    "fleurs_da_cer",
    "ftspeech_cer",
    "submitted",
]
_TEXT_COLUMNS = ("model", "access", "submitted")
RESULT = ", ".join(f"{c} {'string' if c in _TEXT_COLUMNS else 'double'}" for c in RESULT_COLUMNS)
CARD_CONFIG = "config_name string, data_files array<struct<split:string,path:string>>, `default` boolean"


def dataset_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "selector string, `column` string, title string, core boolean")


def resolve_selectors(chosen: str) -> list[tuple[str, str, str, bool]]:
    """Rows of the dimension for a comma-separated list; an unknown name is an error."""
    wanted = [s.strip() for s in chosen.split(",") if s.strip()]
    known = {row[0]: row for row in DATASETS}
    if unknown := [s for s in wanted if s not in known]:
        raise ValueError(f"unknown data sets: {', '.join(unknown)}")
    return [known[s] for s in wanted]
