"""Statements give what the column expressions give."""

import pytest
from pyspark.sql import functions as F

from skaldic.functions import edit, sql, text as T
from skaldic.sources import readers

TEXTS = [
    "Det er 1.000,5 og 21 øh hm A", "", "   ", None, "it’s 'quoted' t'", "é ﬁ ２", "ehh mhm\x1c7", "a" * 5000 + " 3 " + "b" * 10, "12 12 12", "½ ²",
]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    sql.register(spark)
    frame = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "id int, t string, u string")
    frame.createOrReplaceTempView("sql_surface_rows")
    return frame


@pytest.mark.parametrize("form", [None, "NFC", "NFKD"])
@pytest.mark.parametrize("numbers,fillers", [(True, False), (False, True), (True, True)])
def test_normalise(spark, rows, form, numbers, fillers):
    wanted = rows.select("id", T.normalise(F.col("t"), unicode=form, numbers=numbers, fillers=fillers).alias("n")).collect()
    form = "NULL" if form is None else f"'{form}'"
    got = spark.sql(f"SELECT id, normalise(t, {form}, {str(numbers).lower()}, {str(fillers).lower()}) AS n FROM sql_surface_rows").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_normalise_by_distinct_words_with_flags_of_rows(spark, rows):
    flags = "id % 2 = 0 AS n, CASE WHEN id > 1 THEN id % 3 = 0 END AS f"
    got = spark.sql(f"SELECT id, n, f, normalise(t, 'NFC', n, f) AS x FROM (SELECT *, {flags} FROM sql_surface_rows)")
    assert "_by_words" in got._jdf.queryExecution().executedPlan().toString()
    for n in (True, False):
        for f in (True, False):
            wanted = rows.select("id", T.normalise(F.col("t"), unicode="NFC", numbers=n, fillers=f).alias("x")).collect()
            here = [(r["id"], r["x"]) for r in got.collect() if r["n"] == n and bool(r["f"]) == f]
            assert set(here) <= set(map(tuple, wanted))


def test_distances(spark, rows):
    r, h = F.col("t"), F.col("u")
    rw, hw = T.words(T.collapse_space(r)), T.words(T.collapse_space(h))
    wanted = rows.select("id", rw.alias("rw"), hw.alias("hw"), r.alias("t"), h.alias("u")).withColumn("a", edit.shared_words(F.col("rw"), F.col("hw")))
    wanted = wanted.select("id", edit.word_edits(F.col("rw"), F.col("hw"), F.col("a")).alias("w"), edit.char_edits(r, h).alias("c"))
    got = spark.sql("SELECT id, word_edits(t, u) AS w, char_edits(t, u) AS c FROM sql_surface_rows")
    # The array expressions call a pair with a null side 0 or -1; here it is null.
    both = {r["id"] for r in rows.filter("t is not null and u is not null").collect()}
    assert {tuple(r) for r in got.collect() if r["id"] in both} == {tuple(r) for r in wanted.collect() if r["id"] in both}
    assert all(r["w"] is None and r["c"] is None for r in got.collect() if r["id"] not in both)


def test_sums(spark, rows):
    r = spark.sql("SELECT sum(word_count(t)) AS n, percent(3, 4) AS p, percent(1, 0) AS q FROM sql_surface_rows").first()
    assert r["n"] == sum(len((t or "").split()) for t in TEXTS) and r["p"] == 75.0 and r["q"] is None


def test_unknown_form(spark, rows):
    with pytest.raises(Exception, match="unknown Unicode form"):
        spark.sql("SELECT unicode_form(t, 'NFX') FROM sql_surface_rows").collect()


def test_clip_rows(spark):
    sql.register(spark)
    source = spark.createDataFrame([(i, [None, " ", " a b "][i % 3], ["", "x"][i % 2]) for i in range(40)] + [(123456, "z", None)], "ordinal long, sentence string, text string")
    for cap in (0, 7):
        wanted = readers.materialise(source, "cv17", readers.TEXT_KEYS["cv17"], cap)
        got = spark.sql(f"SELECT * FROM clip_rows(TABLE (SELECT * FROM {{rows}}), 'cv17', {cap})", rows=source)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(got.columns).collect()))
    assert spark.sql("SELECT * FROM clip_rows(TABLE (SELECT * FROM {rows}), 'cv17', 0)", rows=source.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown data set"):
        spark.sql("SELECT * FROM clip_rows(TABLE (SELECT * FROM {rows}), 'none', 0)", rows=source).collect()
