import random

import pytest
from pyspark.sql import functions as F

from skaldic.functions import edit, rounding
from skaldic.operators import scoring

PLAIN = scoring.Config(None, number_words=False)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def pairs(spark, rows):
    return spark.createDataFrame([("d", str(i), a, b) for i, (a, b) in enumerate(rows)], "dataset string, id string, reference string, hypothesis string")


def wer(spark, rows):
    return scoring.corpus_wer(scoring.normalised_pairs(pairs(spark, rows), PLAIN), "dataset").first()


def test_distances_agree_with_dynamic_programming(spark):
    rng = random.Random(1)
    words = ["a", "b", "å", "øl", "blåbær", "𝒳", "c'd"]
    rows = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(2)) for _ in range(200)] + [("blåbær", "blabar")]
    got = scoring.utterance_char_edits(scoring.utterance_word_edits(pairs(spark, rows))).select(
        "id", F.col("word_edits").alias("w"), F.col("char_edits").alias("c")
    ).collect()
    for r in got:
        a, b = rows[int(r["id"])]
        assert (r["w"], r["c"]) == (distance(a.split(), b.split()), distance(a, b))


def test_words_beyond_the_basic_plane(spark):
    """Places before, between and after the surrogates are distinct characters; unshared words are one."""
    alphabet = [f"w{i}" for i in range(60_000)]
    picked = ["w0", "w35839", "w35840", "w35841", "w59999", "x", "y"]
    rows = spark.createDataFrame([(picked, alphabet)], "w array<string>, b array<string>")
    coded = rows.select(edit._as_characters(F.col("w"), F.col("b"), 0x4DFF).alias("c")).first()["c"]
    assert len(coded) == 7 and len(set(coded)) == 6 and coded[5] == coded[6]


def test_rescore_reads_its_input_once(spark):
    rows = pairs(spark, [("øh a b", "a b"), ("c", "c d")])
    plain, fillers = scoring.Config("NFC", name="plain"), scoring.Config("NFKC", filler_words=True, name="fillers")
    out = scoring.rescore(rows, [plain, fillers], "dataset")
    got = {r["config"]: (round(r["wer"], 3), round(r["cer"], 3)) for r in out.collect()}
    assert got == {"plain": (50.0, 71.429), "fillers": (33.333, 50.0)}


def test_corpus_rate_is_a_ratio_of_sums(spark):
    assert wer(spark, [("a", "b"), ("a b c d", "a b c d")])["wer"] == 20.0


def test_empty_hypothesis_is_full_deletion(spark):
    r = wer(spark, [("a b", "")])
    assert (r["edits"], r["units"], r["wer"]) == (2, 2, 100.0)


def test_empty_reference_drops_the_pair(spark):
    assert wer(spark, [("?!", "x"), ("a", "a")])["units"] == 1
    assert wer(spark, [("", "x")]) is None


def test_rates_exceed_100(spark):
    assert wer(spark, [("a", "b c d")])["wer"] == 300.0


def test_formatting_alone_costs_nothing(spark):
    assert wer(spark, [("hej verden 1234", "Hej, VERDEN! 1.234")])["wer"] == 0.0


def test_null_text_fails(spark):
    with pytest.raises(Exception, match="null reference"):
        wer(spark, [("a", None)])


def test_exact_rounding(spark):
    rows = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (None,)], "x double").select(rounding.exact_round(F.col("x"), 2).alias("r"))
    assert [r["r"] for r in rows.collect()] == [2.67, 0.12, 1.0, None]


def test_macro_mean(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", None), ("a", 20.0), ("b", None)], "model string, wer double")
    got = {r["model"]: r["mean_wer"] for r in scoring.macro_mean(rows, "wer", "model").collect()}
    assert got == {"a": 15.0, "b": 0.0}
    got = {r["model"]: r["mean_wer"] for r in scoring.macro_mean(rows, "wer", "model", null_if_empty=True).collect()}
    assert got["b"] is None


def test_delta_of_the_unpublished_is_null(spark):
    new = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "slug string, wer double")
    old = spark.createDataFrame([("a", 1.5)], "slug string, wer double")
    rows = scoring.delta(new, old, "wer", "slug").withColumn("t", scoring.delta_text(F.col("delta"))).orderBy("slug").collect()
    assert [(r["delta"], r["t"]) for r in rows] == [(0.5, "+0.50"), (None, "—")]


def test_alignment_truncates(spark):
    refs = spark.createDataFrame([("d", i, "a") for i in range(3)], "dataset string, ordinal int, reference string")
    hyps = spark.createDataFrame([("d", i, "a") for i in range(2)], "dataset string, ordinal int, hypothesis string")
    assert scoring.align(refs, hyps).count() == 2


def test_streamed_rates(spark, tmp_path):
    from skaldic.streaming import streamed_edits, streamed_rates

    pairs(spark, [("a b", "a"), ("c", "c")]).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("dataset string, id string, reference string, hypothesis string").json(str(tmp_path / "in"))
    q = streamed_rates(stream, PLAIN, "dataset").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert round(spark.table("rates").first()["wer"], 6) == round(100 / 3, 6)
    q = streamed_edits(stream, PLAIN).writeStream.outputMode("append").format("memory").queryName("edits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("edits").agg(F.sum("word_edits")).first()[0] == 1


def test_names_at_the_package_top():
    import skaldic
    from skaldic.functions import text
    from skaldic.operators import scoring

    assert skaldic.normalise is text.normalise is skaldic.normalize
    assert skaldic.compute_wer is scoring.compute_wer and skaldic.compute_cer is scoring.compute_cer
    assert skaldic.strip_number_separators is text.strip_number_separators
    assert not hasattr(skaldic, "nothing_of_this_name")
