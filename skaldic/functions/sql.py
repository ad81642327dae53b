"""The normaliser, the distances and the loaders for statements: ``register(spark)``, then ``SELECT normalise(text, 'NFC', true, false) ...``.

Steps that Spark has are SQL functions, which the optimiser unfolds into the
statement; only normal forms by distinct words, Unicode forms, number words and distances
are Arrow functions, and those of distances see only the pairs that differ.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import LongType, StringType

from . import edit, text as T


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; again does no harm.

    ``strip_number_separators(t)``, ``strip_punctuation(t)``, ``strip_fillers(t)``,
    ``collapse_space(t)``, ``unicode_form(t, form)``, ``number_words(t)``,
    ``normalise(t, form, numbers, fillers)`` (a null form leaves it as it is),
    ``word_count(t)``, ``word_edits(reference, hypothesis)``,
    ``char_edits(reference, hypothesis)``, ``percent(edits, units)`` and the table
    function ``clip_rows(TABLE (...), slug, cap)``. Nulls give null.
    """
    spark.udf.register("_by_words", _by_words)
    spark.udf.register("_unicode_form", _unicode_form)
    spark.udf.register("_number_words", _number_words)
    spark.udf.register("_word_edits", _word_edits)
    spark.udf.register("_char_edits", _char_edits)
    spark.udtf.register("clip_rows", F.arrow_udtf(ClipRows, returnType="ordinal bigint, audio_path string, reference_text string"))
    for head, body in BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


@F.arrow_udf(StringType())
def _by_words(texts: pa.Array, numbers: pa.Array, fillers: pa.Array) -> pa.Array:
    out = pa.nulls(len(texts), pa.string())
    flags = [pc.fill_null(f, False) for f in (numbers, fillers)]
    for wanted in ((False, False), (False, True), (True, False), (True, True)):
        here = pc.and_(*[pc.equal(f, w) for f, w in zip(flags, wanted, strict=True)])
        if pc.any(here).as_py():
            out = pc.replace_with_mask(out, here, T._by_words(texts.filter(here), *wanted))
    return out


@F.pandas_udf(StringType())
def _unicode_form(texts: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(texts, forms, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _number_words(texts: pd.Series) -> pd.Series:
    return texts.map(T.spelled)


@F.arrow_udf(LongType())
def _char_edits(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    return edit.char_distances(references, hypotheses)


@F.arrow_udf(LongType())
def _word_edits(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    return edit.word_distances(*[pc.binary_join(pc.utf8_split_whitespace(t), " ") for t in (references, hypotheses)])


class ClipRows:
    """Rows of a data set's source as those of its test set: blank texts go, the cap counts ordinals before that."""

    def eval(self, rows: pa.RecordBatch, slug: pa.Array, cap: pa.Array):
        from ..sources.readers import TEXT_KEYS

        name, most = slug[0].as_py(), cap[0].as_py()
        if name not in TEXT_KEYS:
            raise ValueError(f"unknown data set {name!r}; one of {sorted(TEXT_KEYS)}")
        texts = [rows.column(k).to_pylist() for k in TEXT_KEYS[name] if k in rows.schema.names]
        ordinals = rows.column("ordinal").to_pylist()
        found = []
        for i, ordinal in enumerate(ordinals):
            text = next((s for column in texts if column[i] is not None and (s := column[i].strip())), None)
            if text is not None and (not most or ordinal < most):
                found.append((ordinal, f"{name}_{ordinal:05d}.wav", text))
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["ordinal", "audio_path", "reference_text"])


def _raw(pattern: str) -> str:
    return f'r"{pattern}"'


_FORMS = ", ".join(f"'{f}'" for f in T.FORMS)
# Each function only uses those above it.
BODIES = [
    ("strip_number_separators(t STRING) RETURNS STRING", f"regexp_replace(t, {_raw(T._SEPARATORS)}, '$1')"),
    ("strip_punctuation(t STRING) RETURNS STRING", f"""translate(regexp_replace(t, {_raw(T._PUNCTUATION)}, ''), '’', "'")"""),
    ("strip_fillers(t STRING) RETURNS STRING", f"CASE WHEN t RLIKE {_raw(T._FILLER_PAIR)} THEN regexp_replace(t, {_raw(T.FILLERS)}, ' ') ELSE t END"),
    ("collapse_space(t STRING) RETURNS STRING", f"btrim(regexp_replace(t, {_raw(T._LOOSE_SPACE)}, ' '), ' ')"),
    ("_known_form(form STRING) RETURNS STRING", f"CASE WHEN form IN ({_FORMS}) THEN form ELSE raise_error(concat('unknown Unicode form ', form)) END"),
    (
        "unicode_form(t STRING, form STRING) RETURNS STRING",
        f"CASE WHEN form IS NULL THEN t ELSE coalesce(_unicode_form(CASE WHEN t RLIKE {_raw(T._BEYOND_ASCII)} THEN t END, _known_form(form)), t) END",
    ),
    (
        "number_words(t STRING) RETURNS STRING",
        f"coalesce(_number_words(CASE WHEN collapse_space(t) RLIKE {_raw(T._LONE_NUMBER)} THEN collapse_space(t) END), collapse_space(t))",
    ),
    ("_bare(t STRING) RETURNS STRING", "strip_punctuation(lower(strip_number_separators(t)))"),
    ("_spelled(t STRING, numbers BOOLEAN) RETURNS STRING", "CASE WHEN numbers THEN number_words(t) ELSE t END"),
    ("_unhesitant(t STRING, fillers BOOLEAN) RETURNS STRING", "CASE WHEN fillers THEN strip_fillers(t) ELSE t END"),
    (
        "_chain(t STRING, form STRING, numbers BOOLEAN, fillers BOOLEAN) RETURNS STRING",
        "collapse_space(_unhesitant(_spelled(_bare(unicode_form(t, form)), numbers), fillers))",
    ),
    (
        "_plain_form(t STRING, form STRING, numbers BOOLEAN, fillers BOOLEAN) RETURNS STRING",
        "_by_words(CASE WHEN form IS NULL OR form = 'NFC' THEN t END, numbers, fillers)",
    ),
    # Texts that the words' forms don't tell pass the chain; others are null to it.
    (
        "normalise(t STRING, form STRING, numbers BOOLEAN, fillers BOOLEAN) RETURNS STRING",
        "coalesce(_plain_form(t, form, numbers, fillers), _chain(CASE WHEN _plain_form(t, form, numbers, fillers) IS NULL THEN t END, form, numbers, fillers))",
    ),
    ("word_count(t STRING) RETURNS BIGINT", "CAST(size(array_remove(split(collapse_space(t), ' '), '')) AS BIGINT)"),
    (
        "word_edits(reference STRING, hypothesis STRING) RETURNS BIGINT",
        "CASE WHEN reference = hypothesis THEN 0 ELSE _word_edits(CASE WHEN reference <> hypothesis THEN reference END, CASE WHEN reference <> hypothesis THEN hypothesis END) END",
    ),
    (
        "char_edits(reference STRING, hypothesis STRING) RETURNS BIGINT",
        "CASE WHEN reference = hypothesis THEN 0 ELSE _char_edits(CASE WHEN reference <> hypothesis THEN reference END, CASE WHEN reference <> hypothesis THEN hypothesis END) END",
    ),
    ("percent(edits BIGINT, units BIGINT) RETURNS DOUBLE", "CASE WHEN units > 0 THEN CAST(edits AS DOUBLE) / units * 100.0 END"),
]
