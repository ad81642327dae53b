"""Corpus word and character error rates, macro means, wide rows, re-scoring and deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import edit, text as T
from ..functions.rounding import exact_round
from ..sources import readers
from ..sources.schemas import CORE_COLUMNS


@dataclass(frozen=True)
class Config:
    """Normaliser settings of one scoring. The Unicode form has no default, as entry points differ on it."""

    unicode_form: str | None
    number_words: bool = True
    filler_words: bool = False
    name: str = "config"

    def apply(self, column: Column) -> Column:
        return T.normalise(column, unicode=self.unicode_form, numbers=self.number_words, fillers=self.filler_words)

    def apply_pair(self, reference: Column, hypothesis: Column) -> tuple[Column, Column]:
        return T.normalised_pair(reference, hypothesis, unicode=self.unicode_form, numbers=self.number_words, fillers=self.filler_words)


def require_text(rows: DataFrame) -> DataFrame:
    """Fails on a null reference or hypothesis: a null would leave its words in the denominator alone."""
    ok = F.col("reference").isNotNull() & F.col("hypothesis").isNotNull()
    return rows.withColumn(
        "reference", F.when(ok, F.col("reference")).otherwise(F.raise_error(F.lit("null reference or hypothesis")))
    )


def align(references: DataFrame, hypotheses: DataFrame, keys: tuple[str, ...] = ("dataset", "ordinal")) -> DataFrame:
    """References and hypotheses by position; what lies beyond the shorter side is dropped."""
    return references.join(hypotheses, list(keys), "inner")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two scans of files side by side, by their places alone; the shorter one ends it. (ordinal and the columns of both)"""
    return readers.placed(left).join(readers.placed(right), "ordinal")


def normalised_pairs(utterances: DataFrame, config: Config) -> DataFrame:
    """Normalised pairs; those whose reference has nothing left are dropped, empty hypotheses stay."""
    columns = utterances.columns
    return _normal_forms(utterances, [config], [c for c in columns if c not in ("reference", "hypothesis")]).select(*columns)


def _normal_forms(utterances: DataFrame, configs: list[Config], keys: list[str]) -> DataFrame:
    """``keys``, config, reference, hypothesis: a pair under every config.

    The pairs pass a generator, as the filter would otherwise be pushed below
    and normalise every reference a second time.
    """
    checked = require_text(utterances)
    sides = [(c.name, *c.apply_pair(F.col("reference"), F.col("hypothesis"))) for c in configs]
    forms = F.array(*[F.struct(F.lit(name).alias("config"), r.alias("reference"), h.alias("hypothesis")) for name, r, h in sides])
    return checked.select(*keys, forms.alias("_forms")).select(*keys, F.inline_outer("_forms")).filter(F.col("reference") != "")


def utterance_word_edits(pairs: DataFrame) -> DataFrame:
    """``word_edits`` and ``n_words`` of each pair of normalised texts."""
    return pairs.withColumns(
        {"word_edits": edit.text_word_edits(F.col("reference"), F.col("hypothesis")), "n_words": F.size(T.words(F.col("reference"))).cast("long")}
    )


def utterance_char_edits(pairs: DataFrame) -> DataFrame:
    """``char_edits`` and ``n_chars`` of each pair; spaces are characters."""
    return pairs.withColumns(
        {"char_edits": edit.char_edits(F.col("reference"), F.col("hypothesis")), "n_chars": F.length("reference").cast("long")}
    )


OPERATIONS = ("hits", "substitutions", "deletions", "insertions")


def _count_operations(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..functions.alignment import operation_counts
    from ..functions.bitparallel import word_numbers

    for batch in batches:
        reference, hypothesis = batch.columns[-2:]
        numbers, lengths = word_numbers(pa.concat_arrays([reference, hypothesis]))
        upto, n = np.concatenate([[0], np.cumsum(lengths)]), len(reference)
        counts = np.zeros((n, len(OPERATIONS)), np.int64)
        counts[:, 0] = lengths[:n]  # all hits where the sides are equal
        differ = np.flatnonzero(pc.not_equal(reference, hypothesis).to_numpy(zero_copy_only=False))
        counts[differ] = operation_counts(*([numbers[upto[k] : upto[k + 1]] for k in at] for at in (differ, differ + n)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, counts.T)], names=[*batch.schema.names[:-2], *OPERATIONS])


def utterance_operations(pairs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and how many words of each pair of normalised texts are hit, substituted, deleted and inserted.

    The edits are as few as can be, and of those alignments the one with
    fewest substitutions counts, so the numbers don't depend on a path.
    """
    narrow = pairs.select(*keys, "reference", "hypothesis")
    fields = [f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys] + [f"{o} long" for o in OPERATIONS]
    return narrow.mapInArrow(_count_operations, ", ".join(fields))


def corpus_operations(pairs: DataFrame, *keys: str) -> DataFrame:
    return utterance_operations(pairs, *keys).groupBy(*keys).agg(*[F.sum(o).alias(o) for o in OPERATIONS])


def rate(edits: Column, units: Column) -> Column:
    """Percentage, 0 where there is nothing to count; it may exceed 100."""
    return F.coalesce(F.when(units > 0, edits / units * 100.0), F.lit(0.0))


def corpus_wer(pairs: DataFrame, *keys: str) -> DataFrame:
    """Sums are partial before the shuffle, so a large data set is a few rows."""
    sums = utterance_word_edits(pairs).groupBy(*keys).agg(F.sum("word_edits").alias("edits"), F.sum("n_words").alias("units"))
    return sums.withColumn("wer", rate(F.col("edits"), F.col("units")))


def corpus_cer(pairs: DataFrame, *keys: str) -> DataFrame:
    sums = utterance_char_edits(pairs).groupBy(*keys).agg(F.sum("char_edits").alias("edits"), F.sum("n_chars").alias("units"))
    return sums.withColumn("cer", rate(F.col("edits"), F.col("units")))


def corpus_rates(pairs: DataFrame, *keys: str) -> DataFrame:
    """wer and cer, unrounded, in one pass."""
    sums = utterance_char_edits(utterance_word_edits(pairs)).groupBy(*keys).agg(
        F.sum("word_edits").alias("we"), F.sum("n_words").alias("nw"), F.sum("char_edits").alias("ce"), F.sum("n_chars").alias("nc")
    )
    return sums.select(*keys, rate(F.col("we"), F.col("nw")).alias("wer"), rate(F.col("ce"), F.col("nc")).alias("cer"))


def compute_wer(references: Column, hypotheses: Column) -> Column:
    """Corpus word error rate of two columns of normalised texts, as an aggregate; unrounded. Empty references don't count."""
    return _corpus_rate(references, hypotheses, edit.text_word_edits, lambda c: F.size(T.words(c)))


def compute_cer(references: Column, hypotheses: Column) -> Column:
    """The same in characters, spaces included."""
    return _corpus_rate(references, hypotheses, edit.char_edits, F.char_length)


def _corpus_rate(references, hypotheses, edits, size) -> Column:
    counts = F.trim(references) != ""
    r, h = references, F.coalesce(hypotheses, F.lit(""))
    return rate(F.sum(F.when(counts, edits(r, h))), F.sum(F.when(counts, size(r)).cast("long")))


def published(rates: DataFrame) -> DataFrame:
    """Rates as published: at two places."""
    return rates.withColumns({"wer": exact_round(F.col("wer"), 2), "cer": exact_round(F.col("cer"), 2)})


def hundredths(value: Column) -> Column:
    """A double of two places as the decimal that it is written as; null for what is not a number."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double")).cast("decimal(18,2)")


def macro_mean(scores: DataFrame, value: str, *keys: str, null_if_empty: bool = False) -> DataFrame:
    """Mean of the rounded values that exist, rounded again; 0 where none does, or null on request.

    Values of two places are added as decimals: a sum of doubles depends on the order in which partial sums meet.
    """
    exact = hundredths(F.col(value))
    mean = F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))
    out = scores.groupBy(*keys).agg(mean.alias("_mean")).withColumn("_mean", exact_round(F.col("_mean"), 2))
    filled = F.col("_mean") if null_if_empty else F.coalesce("_mean", F.lit(0.0))
    return out.withColumn(f"mean_{value}", filled).drop("_mean")


def core_only(scores: DataFrame, core: tuple[str, ...] = CORE_COLUMNS) -> DataFrame:
    return scores.filter(F.col("dataset").isin(*core))


def wide_results(scores: DataFrame, datasets: tuple[str, ...] = CORE_COLUMNS) -> DataFrame:
    """One row per model with ``<dataset>_wer`` and ``<dataset>_cer``; a data set without scores is null."""
    cols = []
    for d in datasets:
        here = F.col("dataset") == d
        cols += [F.max(F.when(here, F.col(m))).alias(f"{d}_{m}") for m in ("wer", "cer")]
    return scores.groupBy("model").agg(*cols)


def row_mean(names: list[str]) -> Column:
    """Mean of a row's values that exist, at two places, 0 if none does."""
    values = F.array_compact(F.array(*[hundredths(F.col(c)) for c in names]))
    total = F.aggregate(values, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    mean = total.cast("double") / F.nullif(F.size(values), F.lit(0))
    return F.coalesce(exact_round(mean, 2), F.lit(0.0))


def rescore(utterances: DataFrame, configs: list[Config], *keys: str) -> DataFrame:
    """Rates of saved outputs under each config. The outputs are read once: a row becomes one pair a config."""
    return corpus_rates(_normal_forms(utterances, configs, list(keys)), *keys, "config")


def delta(new: DataFrame, old: DataFrame, value: str, *keys: str) -> DataFrame:
    """``new`` with ``published`` and ``delta``; null where nothing was published."""
    return new.join(old.select(*keys, F.col(value).alias("published")), list(keys), "left").withColumn(
        "delta", F.col(value) - F.col("published")
    )


def delta_text(value: Column) -> Column:
    """Signed at two places, a dash for none."""
    from ..functions.rounding import exact_format

    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.coalesce(F.concat(sign, exact_format(value, 2)), F.lit("—"))


def speed(seconds: DataFrame, *keys: str) -> DataFrame:
    """``speed_x``: audio seconds per inference second at one place; null without inference."""
    sums = seconds.groupBy(*keys).agg(F.sum("audio_s").alias("audio_s"), F.sum("infer_s").alias("infer_s"))
    ratio = F.when(F.col("infer_s") > 0, F.col("audio_s") / F.col("infer_s"))
    return sums.withColumn("speed_x", exact_round(ratio, 1))


def real_time_factor(audio_s: Column, infer_s: Column) -> Column:
    return F.when(audio_s > 0, infer_s / audio_s).otherwise(F.lit(float("nan")))


def rank_rows(rows: DataFrame, metric: str, name: str = "name") -> DataFrame:
    """Positions from 1 by metric, ties by name. A board has a row per model, so one ordered run is enough."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metric).asc_nulls_last(), F.col(name).asc())))
