"""Edit distances by bit-parallel columns; of arrays of words by ``levenshtein`` with each word written as one character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

_FIRST = 0x4E00
_SURROGATES = 0xD800
_AFTER_SURROGATES = 0xE000
_TABLE = 256


def _distance(reference: Column, hypothesis: Column, exact: Column) -> Column:
    """``exact``, spared where the answer is plain: equal sides, or an empty one."""
    return (
        F.when(reference == hypothesis, F.lit(0))
        .when(reference == "", F.char_length(hypothesis))
        .when(hypothesis == "", F.char_length(reference))
        .otherwise(exact)
        .cast("long")
    )


def char_edits(reference: Column, hypothesis: Column) -> Column:
    """Unit-cost distance in code points, spaces included, of texts of any length.

    Pairs that differ pass an Arrow hop to bit-parallel columns, which for lines of 200
    characters take a fraction of what ``levenshtein`` does and for whole
    documents far less.
    """

    @F.arrow_udf("long")
    def bit_parallel(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        return char_distances(references, hypotheses)

    differ = (reference != hypothesis) & (reference != "") & (hypothesis != "")
    return _distance(reference, hypothesis, bit_parallel(F.when(differ, reference), F.when(differ, hypothesis)))


def _where_given(distances, references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    given = pc.and_(references.is_valid(), hypotheses.is_valid())
    here = given.to_numpy(zero_copy_only=False)
    out = np.zeros(len(here), np.int64)
    out[here] = distances(references.filter(given), hypotheses.filter(given))
    return pa.array(out, mask=~here)


def char_distances(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    from .bitparallel import distances

    return _where_given(lambda r, h: distances(r.to_pylist(), h.to_pylist()), references, hypotheses)


def word_distances(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
    from . import bitparallel

    return _where_given(bitparallel.word_distances, references, hypotheses)


def text_word_edits(reference: Column, hypothesis: Column) -> Column:
    """Unit-cost distance in words of two texts, which spaces part; only pairs that differ pass the Arrow hop."""

    @F.arrow_udf("long")
    def bit_parallel(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        return word_distances(references, hypotheses)

    differ = reference != hypothesis
    return F.when(reference == hypothesis, F.lit(0)).otherwise(bit_parallel(F.when(differ, reference), F.when(differ, hypothesis))).cast("long")


def shared_words(reference: Column, hypothesis: Column) -> Column:
    """The distinct words of both sides, which are the alphabet of their distance."""
    return F.array_intersect(reference, hypothesis)


def _as_characters(words: Column, alphabet: Column, unshared: int) -> Column:
    """The first places come from a constant table, later ones are computed."""
    table = F.array(F.lit(chr(unshared)), *[F.lit(chr(_FIRST + i)) for i in range(1, _TABLE)])

    def character(at: Column) -> Column:
        code = at + F.lit(_FIRST)
        code = F.when(code < _SURROGATES, code).otherwise(code + F.lit(_AFTER_SURROGATES - _SURROGATES))
        late = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.when(at < _TABLE, F.get(table, at.cast("int"))).otherwise(late)

    # Two steps, so that a word is looked up once however often its place is used.
    places = F.transform(words, lambda w: F.array_position(alphabet, w))
    return F.array_join(F.transform(places, character), "")


def word_edits(reference: Column, hypothesis: Column, alphabet: Column) -> Column:
    """Unit-cost distance of two arrays of words.

    ``alphabet`` is ``shared_words`` of the two. It must be a column of its own,
    as an expression would be computed again for every word. Each shared word
    becomes one character; the words of one side only match nothing, so one
    character a side does for all of them. A million shared words can be told
    apart, far beyond what a distance can be computed for.
    """
    coded = F.levenshtein(
        _as_characters(reference, alphabet, _FIRST - 1), _as_characters(hypothesis, alphabet, _FIRST)
    )
    return (
        F.when(reference == hypothesis, F.lit(0))
        .when(F.size(alphabet) == 0, F.greatest(F.size(reference), F.size(hypothesis)))
        .otherwise(coded)
        .cast("long")
    )
