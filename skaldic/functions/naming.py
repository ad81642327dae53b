"""Names, links, slugs and sizes of models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rounding import exact_format, exact_round

# Where model repositories are, and how links and sizes are written.
HUB = "https://huggingface.co/"
MARKDOWN_LINK = r"^\[([^\]]+)\]\((https?://[^)]+)\)$"
SIZE_IN_NAME = r"(\d+(?:\.\d+)?)\s*[bBmM](?![a-zA-Z])"
UNIT_IN_NAME = r"\d+(?:\.\d+)?\s*([bBmM])(?![a-zA-Z])"
UNKNOWN = "—"
LANGUAGE_MODEL_ARCHIVE = r"kenlm|n_?gram"
CORRUPT_TEXT = r"""(?s)^Hypothesis\(.*\btext=(?:'([^']*)'|"([^"]*)").*\)$"""

# Substrings of names of hosted models and their documentation, in order of precedence.
PROVIDER_DOCS = {
    "scribe_v": "https://elevenlabs.io/docs/capabilities/speech-to-text",
    "gpt-4o": "https://platform.openai.com/docs/guides/speech-to-text",
    "chirp": "https://cloud.google.com/speech-to-text/v2/docs/chirp_3-model",
    "soniox": "https://soniox.com/docs/stt/get-started/transcribe-audio-file",
    "azure": "https://learn.microsoft.com/azure/ai-services/openai/concepts/models",
    "syv-transcribe": "https://syv.ai",
}
# Substrings of names of hosted models and their logos, in order of precedence.
PROVIDER_LOGOS = {
    "scribe_v": "https://elevenlabs.io/_next/image?url=https%3A%2F%2Feleven-public-cdn.elevenlabs.io%2Fpayloadcms%2Felevenlabs-official-logo-11-icon.webp&w=1920&q=95",
    "syv-transcribe": "https://syv.ai/_next/image?url=%2F7.png&w=256&q=75",
}
# Hosted models whose maker has an organisation with an avatar.
PROVIDER_ORGANISATIONS = {"gpt-4o": "openai"}
# Sizes in billions of parameters that neither the name nor the weights tell.
OFFICIAL_SIZE = {
    "syvai/hviske-v5": 2.0,
    "syvai/hviske-v5.3": 2.0,
    "syvai/hviske-v3-conversation": 2.0,
    "capacit-ai/saga": 1.7,
    "pluttodk/milo-asr": 1.7,
    "microsoft/VibeVoice-ASR-HF": 8.0,
    "facebook/seamless-m4t-v2-large": 2.0,
    "openai/whisper-large-v3": 2.0,
}


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^/+|/+$", ""), "[^a-zA-Z0-9_-]", "__")


def model_link(name: Column) -> Column:
    """A markdown link to the repository; a decoding suffix after + is not part of its address. Paths stay."""
    bare = F.regexp_replace(name, "/+$", "")
    link = F.concat(F.lit("["), bare, F.lit(f"]({HUB}"), F.substring_index(bare, "+", 1), F.lit(")"))
    return F.when(name.startswith("/"), name).otherwise(link)


def link_name(cell: Column) -> Column:
    found = F.regexp_extract(F.trim(cell), MARKDOWN_LINK, 1)
    return F.when(found != "", found).otherwise(F.coalesce(cell, F.lit("None")))


def link_url(cell: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(cell), MARKDOWN_LINK, 2), F.lit(""))


def organisation(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", 1)).otherwise(F.lit(""))


def size_from_name(name: Column) -> Column:
    """The last size written in a name, in billions."""
    number = F.try_element_at(F.regexp_extract_all(name, F.lit(SIZE_IN_NAME), F.lit(1)), F.lit(-1)).cast("double")
    unit = F.try_element_at(F.regexp_extract_all(name, F.lit(UNIT_IN_NAME), F.lit(1)), F.lit(-1))
    return F.when(F.lower(unit) == "m", number / 1000.0).otherwise(number)


def format_size(billions: Column) -> Column:
    value = F.nanvl(billions.cast("double"), F.lit(None).cast("double"))
    short, long = exact_format(value, 1), exact_format(value, 2)
    return F.when(value.isNull() | (value <= 0), UNKNOWN).when(value < 0.1, long).otherwise(short)


def official_size(name: Column, params_b: Column, overrides: dict[str, float] | None = None) -> Column:
    """An override, else the size in the name, else the counted parameters, written."""
    table = OFFICIAL_SIZE if overrides is None else overrides
    fixed = F.lit(None).cast("double")
    for key, value in table.items():
        fixed = F.when(name == key, F.lit(value)).otherwise(fixed)
    return format_size(F.coalesce(fixed, size_from_name(name), params_b.cast("double")))


def first_substring(name: Column, table: dict[str, str]) -> Column:
    """The value of the first key, in the table's order, that lies in the lower-cased name; else empty."""
    low, out = F.lower(name), F.lit("")
    for key, value in reversed(table.items()):
        out = F.when(F.contains(low, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def logo(name: Column, avatars: dict[str, str]) -> Column:
    """The avatar of a repository's organisation; of a hosted model its provider's logo, else its maker's avatar. Else empty."""

    def avatar(org: Column) -> Column:
        out = F.lit("")
        for key, url in avatars.items():
            out = F.when(org == key, F.lit(url)).otherwise(out)
        return out

    hosted = F.coalesce(
        F.nullif(first_substring(name, PROVIDER_LOGOS), F.lit("")), avatar(first_substring(name, PROVIDER_ORGANISATIONS))
    )
    return F.when(F.contains(name, F.lit("/")), avatar(organisation(name))).otherwise(hosted)


def number_or_null(value: Column) -> Column:
    """A double at two places; null for what is not a number."""
    return exact_round(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), 2)


def is_repository(name: Column, url: Column) -> Column:
    return F.contains(name, F.lit("/")) & url.startswith(HUB)


def is_language_model(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^/]*)/*$", 1)).rlike(LANGUAGE_MODEL_ARCHIVE)


def repair_hypothesis(text: Column) -> Column:
    """The text within a printed hypothesis object, empty if there is none to be read; other values stay."""
    one, two = F.regexp_extract(text, CORRUPT_TEXT, 1), F.regexp_extract(text, CORRUPT_TEXT, 2)
    return F.when(text.startswith("Hypothesis("), F.when(one != "", one).otherwise(two)).otherwise(text)


def is_corrupt(text: Column) -> Column:
    return text.startswith("Hypothesis(")


def first_non_blank(*columns: Column) -> Column:
    """The first value with something but white space, stripped."""
    from .text import python_strip

    return F.coalesce(*[F.nullif(python_strip(c), F.lit("")) for c in columns])


def default_access(access: Column) -> Column:
    return F.coalesce(F.nullif(access, F.lit("")), F.lit("open"))


def submitted_day(submitted: Column) -> Column:
    return F.coalesce(F.substring(submitted, 1, 10), F.lit(""))


def today_iso() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def text_of(text: Column) -> Column:
    """A hypothesis as text: stripped, empty for none."""
    from .text import python_strip

    return python_strip(F.coalesce(text, F.lit("")))


def joined_segments(segments: Column) -> Column:
    """Texts of segments, each stripped, joined by a space."""
    from .text import python_strip

    return python_strip(F.coalesce(F.array_join(F.transform(segments, lambda s: python_strip(s)), " "), F.lit("")))


def joined_alternatives(results: Column) -> Column:
    """The first alternative of each result that has one, joined by a space. results: array of arrays of text."""
    from .text import python_strip

    firsts = F.transform(F.filter(results, lambda r: F.size(r) > 0), lambda r: F.coalesce(r[0], F.lit("")))
    return python_strip(F.coalesce(F.array_join(firsts, " "), F.lit("")))


def joined_chunks(chunks: Column, text: Column) -> Column:
    """Texts of segments joined by a space, else the whole text, stripped."""
    from .text import python_strip

    parts = F.array_join(F.transform(chunks, lambda c: python_strip(c)), " ")
    return python_strip(F.coalesce(F.when(F.size(chunks) > 0, parts), text, F.lit("")))
