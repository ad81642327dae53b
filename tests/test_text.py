import unicodedata

import pytest
from pyspark.sql import functions as F

from skaldic.functions import text as T
from skaldic.functions.cardinals import cardinal

# Texts and what they must become, by published behaviour.
DIGITS_KEPT = [
    ("ånd".replace("å", "å"), "ånd"), ("å" + "nd", "ånd"), ("1.234 kroner", "1234 kroner"), ("1,234 kroner", "1234 kroner"), ("3,14", "314"),
    ("3.14", "314"), ("12.345,67", "1234567"), ("år 2025", "år 2025"), ("HUND", "hund"), ("Æble Øl Ånd", "æble øl ånd"),
    ("hej, verden!", "hej verden"), ("hej... verden", "hej verden"), ("hej - verden", "hej verden"), ("det's", "det's"),
    ("o'clock", "o'clock"), ("'hej'", "hej"), ("  hej   verden  ", "hej verden"), ("hej\tverden\ngodt", "hej verden godt"),
    ("", ""), ("   ", ""), ("det’s godt", "det's godt"), ("a b c\x85d", "a b c d"), ("kr€", "kr"),
]
NFKC = [("ﬁsk", "fisk"), ("ｈｅｊ", "hej"), ("ｈｅｊ ２０２５", "hej 2025"), ("m²", "m2"), ("¾", "34"), ("2½", "212"), ("Ⅻ", "xii"), ("ånd", "ånd")]
NUMBERS = [
    ("jeg har 4 æbler", "jeg har fire æbler"), ("24", "fireogtyve"), ("der var 100 mennesker", "der var ethundrede mennesker"),
    ("året 2025", "året totusinde og femogtyve"), ("ingen tal her", "ingen tal her"), ("4", "fire"), ("1960'erne", "1960erne"), ("007", "syv"),
]
FILLERS = [
    ("øh jeg tror det", "jeg tror det"), ("det er øhm svært", "det er svært"), ("hmm ja", "ja"), ("jamen ehm altså", "jamen altså"),
    ("nej det passer ikke", "nej det passer ikke"), ("modstanden er en ohm", "modstanden er en ohm"), ("søh", "søh"),
]


def check(spark, cases, **config):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", T.normalise(F.col("t"), **config).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_layers_without_number_words(spark):
    check(spark, DIGITS_KEPT, unicode="NFKC", numbers=False)


def test_nfkc_folds_compatibility(spark):
    check(spark, NFKC, unicode="NFKC", numbers=False)


def test_nfc_keeps_fractions_and_composes(spark):
    check(spark, [("¾", "¾"), ("ﬁsk", "ﬁsk"), ("ånd", "ånd")], unicode="NFC", numbers=False)


def test_number_words(spark):
    check(spark, NUMBERS, unicode="NFKC")


def test_fillers_are_opt_in(spark):
    check(spark, FILLERS, unicode="NFC", fillers=True)
    check(spark, [("øh jeg tror det", "øh jeg tror det")], unicode="NFC")


def test_unknown_form(spark):
    with pytest.raises(ValueError):
        T.normalise(F.col("t"), unicode="NFKZ")


def test_control_characters_are_no_marks(spark):
    check(spark, [("a\u0001b d'e", "a\u0001b d'e"), ("\u0001'", "\u0001")], unicode="NFC", numbers=False)


def test_null_stays_null(spark):
    rows = spark.createDataFrame([(None,)], "t string").select(T.lower(T.unicode_form(F.col("t"), "NFD")).alias("n"))
    assert rows.first()["n"] is None


@pytest.mark.parametrize("n,words", [("0", "nul"), ("1", "en"), ("21", "enogtyve"), ("101", "ethundrede og en"), ("1000", "ettusinde"), ("1000000", "en million"), ("1000000000000", "en billion"), ("3000000000000000000", "tre trillioner"), ("2000000000000005", "to billiarder fem")])
def test_cardinals(n, words):
    assert cardinal(n) == words


def test_cardinals_beyond_the_limit_stay():
    assert cardinal("1" + "0" * 66) == "1" + "0" * 66
    assert cardinal("9" * 66) != "9" * 66
    assert cardinal("4²") == "4²"


def test_punctuation_agrees_with_unicode_categories(spark):
    chars = [chr(c) for c in range(0x20, 0x2100) if unicodedata.category(chr(c))[0] != "C"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.strip_punctuation(F.col("c")).alias("s")).collect()
    wrong = [r["c"] for r in rows if (r["s"] == "") != (unicodedata.category(r["c"])[0] in "PS")]
    # Only code points that the older of the two Unicode versions does not know.
    assert len(wrong) <= 8
