"""The text normaliser as one chain of column expressions.

Everything is built in but two steps, for which Spark has nothing: Unicode
normal forms and number words. Both see only the rows that need them; the
others pass as nulls, at no cost but the hop.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .cardinals import cardinal

FORMS = ("NFC", "NFKC", "NFD", "NFKD")
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
_WHOLE_NUMBER = re.compile(r"^\d+$")
# A single space is its own replacement, so only other runs are matched.
_LOOSE_SPACE = r" [\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85&&[^ ]][\s\p{Z}\x1c-\x1f\x85]*"
_SEPARATORS = r"(\p{Nd})[.,]+"
_PUNCTUATION = r"[\p{P}\p{S}&&[^'’]]+|['’](?:(?<!\p{L}['’])|(?!\p{L}))"
_LONE_NUMBER = r"(^| )\p{Nd}+( |$)"
_BEYOND_ASCII = r"[^\x00-\x7F]"
_FILLER_PAIR = "[eøm]h|hm"
# Fixed value: hesitations, as whole words.
FILLERS = r"(?U)\b(?:eh+m*|øh+m*|h+m+|m+h+)\b"


def strip_number_separators(text: Column) -> Column:
    """Dots and commas that follow a digit within a numeral go."""
    return F.regexp_replace(text, _SEPARATORS, "$1")


def lower(text: Column) -> Column:
    return F.lower(text)


def strip_punctuation(text: Column) -> Column:
    """Punctuation and symbols go; an apostrophe between two letters stays, straightened."""
    bare = F.regexp_replace(text, _PUNCTUATION, "")
    return F.translate(bare, "’", "'")


def tokens(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _LOOSE_SPACE, " "), F.lit(" "))


def words(text: Column) -> Column:
    """Words of a text whose white space is collapsed."""
    return F.array_remove(F.split(text, " "), "")


def strip_fillers(text: Column) -> Column:
    # Every filler holds one of these pairs, which are sooner looked for.
    return F.when(text.rlike(_FILLER_PAIR), F.regexp_replace(text, FILLERS, " ")).otherwise(text)


def python_strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def unicode_form(text: Column, form: str) -> Column:
    """The Unicode normal form; texts of ASCII alone are their own."""
    if form not in FORMS:
        raise ValueError(f"unicode_form must be one of {sorted(FORMS)}, not {form!r}")

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    beyond_ascii = F.when(text.rlike(_BEYOND_ASCII), text)
    return F.coalesce(normal(beyond_ascii), text)


def spelled(text: str | None) -> str | None:
    """The words of a text, those of digits alone as cardinals."""
    return None if text is None else " ".join(cardinal(w) if _WHOLE_NUMBER.match(w) else w for w in text.split())


def number_words(text: Column) -> Column:
    """Tokens of digits alone as Danish cardinals; tokens are joined by one space."""

    @F.pandas_udf("string")
    def spell(texts: pd.Series) -> pd.Series:
        return texts.map(spelled)

    joined = collapse_space(text)
    has_number = F.when(joined.rlike(_LONE_NUMBER), joined)
    return F.coalesce(spell(has_number), joined)


def normalise(text: Column, *, unicode: str | None, numbers: bool = True, fillers: bool = False) -> Column:
    """The whole chain, in its order. ``unicode=None`` leaves the form as it is."""
    if unicode is not None:
        text = unicode_form(text, unicode)
    text = strip_punctuation(lower(strip_number_separators(text)))
    if numbers:
        text = number_words(text)
    if fillers:
        text = strip_fillers(text)
    return collapse_space(text)


# Latin letters and common signs: Java and Python agree on their kinds, NFC leaves all but two spaces of them, and no mark is among them.
_PLAIN_CHARACTERS = [chr(c) for a, b in ((0, 0x130), (0x131, 0x250), (0x2000, 0x20C0)) for c in range(a, b)]


def _of_kinds(kinds: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN_CHARACTERS if unicodedata.category(c)[0] in kinds and c not in "'’")


_PLAIN = re.compile(f"[{re.escape(''.join(_PLAIN_CHARACTERS))}]*")
_LETTER = f"[{_of_kinds('L')}]"
_DIGIT_SEPARATORS = re.compile(_SEPARATORS.replace(r"\p{Nd}", r"\d"))
_LOOSE_APOSTROPHE = re.compile(f"['’](?:(?<!{_LETTER}['’])|(?!{_LETTER}))")
_SIGNS = re.compile(f"[{_of_kinds('PS')}]+")
_NUMBER_LINE = re.compile(r"^\d+$", re.MULTILINE)
_HESITATION, _HESITATIONS = re.compile(_FILLER_PAIR), re.compile(FILLERS.removeprefix("(?U)"))


def _plain_words(text: str, numbers: bool, fillers: bool) -> list[str | None]:
    """Normal forms of words, which are the lines of a text; null for those whose characters or hesitations are left to the expressions."""
    other = []
    if not _PLAIN.fullmatch(text):
        words = text.split("\n")
        other = [k for k, w in enumerate(words) if not _PLAIN.fullmatch(w)]
        for k in other:
            words[k] = ""
        text = "\n".join(words)
    text = _DIGIT_SEPARATORS.sub(r"\1", text.lower())
    text = _SIGNS.sub("", _LOOSE_APOSTROPHE.sub("", text)).replace("’", "'")
    if numbers:
        text = _NUMBER_LINE.sub(lambda m: cardinal(m[0]), text)
    forms: list[str | None] = text.split("\n")
    if fillers:
        for k, w in enumerate(forms):
            if _HESITATION.search(w):
                clear = all(c.isalpha() or c in "0123456789' " for c in w)
                forms[k] = " ".join(_HESITATIONS.sub(" ", w).split()) if clear else None
    for k in other:
        forms[k] = None
    return forms


def _by_words(texts: pa.Array, numbers: bool, fillers: bool) -> pa.Array:
    """Normal forms of the plain texts; null for others. A reference that comes again with every model is normalised once."""
    again = texts.dictionary_encode()
    lists = pc.utf8_split_whitespace(again.dictionary)
    parts = lists.flatten().dictionary_encode()
    n = len(parts.dictionary)
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), parts.dictionary), "\n")[0].as_py()
    forms = pa.array(_plain_words(lines, numbers, fillers)[:n], pa.string())
    at, offsets = parts.indices.to_numpy(), lists.offsets.to_numpy()

    def upto(of_form: pa.Array):
        of_part = of_form.to_numpy(zero_copy_only=False)[at]
        return of_part, np.concatenate([[0], np.cumsum(of_part)])[offsets]

    kept, starts = upto(pc.fill_null(pc.not_equal(forms, ""), False))
    other = np.diff(upto(forms.is_null())[1]) > 0
    found = forms.take(pa.array(at[kept]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), found), " ")
    return pc.if_else(pa.array(other), None, joined).take(again.indices)


def normalised_pair(reference: Column, hypothesis: Column, *, unicode: str | None, numbers: bool = True, fillers: bool = False) -> tuple[Column, Column]:
    """Both sides as ``normalise`` has them, for the many short texts of transcripts.

    The chain treats each word between white space on its own. So of texts in
    Latin letters each distinct word passes it once, and a text is its words' forms; other
    texts pass the chain itself.
    """

    def chain(text: Column) -> Column:
        return normalise(text, unicode=unicode, numbers=numbers, fillers=fillers)

    if unicode not in (None, "NFC"):
        return chain(reference), chain(hypothesis)

    @F.arrow_udf("struct<r:string,h:string>")
    def by_words(references: pa.Array, hypotheses: pa.Array) -> pa.Array:
        both = _by_words(pa.concat_arrays([references, hypotheses]), numbers, fillers)
        return pa.StructArray.from_arrays([both[: len(references)], both[len(references) :]], ["r", "h"])

    found = by_words(reference, hypothesis)
    # Others are null to the chain, whose own Arrow functions would see every row.
    return tuple(F.coalesce(found[k], chain(F.when(found[k].isNull(), c))) for k, c in (("r", reference), ("h", hypothesis)))


normalize = normalise
normalize_numbers_da = number_words
