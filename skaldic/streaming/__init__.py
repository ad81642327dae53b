"""Scoring of utterances as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import scoring


def streamed_edits(utterances: DataFrame, config: scoring.Config) -> DataFrame:
    """Edits and units of each utterance, for append mode: no state."""
    return scoring.utterance_char_edits(scoring.utterance_word_edits(scoring.normalised_pairs(utterances, config)))


def streamed_rates(utterances: DataFrame, config: scoring.Config, *keys: str) -> DataFrame:
    """Running corpus rates, for complete or update mode: state is four sums per key."""
    return scoring.corpus_rates(scoring.normalised_pairs(utterances, config), *keys)
