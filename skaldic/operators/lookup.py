"""The first key of a table that lies in a name, for tables of keys of any size.

Each key is found by one of its pieces: a gram of the largest of ``WIDTHS``
characters that fits it, and of its grams the one that fewest keys have. Names are cut into
grams of the same widths and meet the keys by a plain join on the gram; what meets is
compared in full. So no task holds all keys, nor does a name meet each of them. Keys whose
first or last gram is in no name lie in none, and go before their rarest gram is looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WIDTHS = (1, 2, 3, 4, 8, 16)


def _grams(text: Column, width: Column) -> Column:
    """Places, from 1, of the grams of a text; null if it is shorter."""
    return F.when(F.char_length(text) >= width, F.sequence(F.lit(1), F.char_length(text) - width + 1))


def _wide(keys: DataFrame) -> DataFrame:
    """``keys`` with width: the largest that fits the key."""
    width = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        width = F.when(F.char_length("key") >= w, w).otherwise(width)
    return keys.withColumn("width", width)


def anchored(keys: DataFrame) -> DataFrame:
    """``keys`` (key, value, position) with width, gram and at: where its rarest gram begins."""
    wide = _wide(keys.select("key", "value", "position"))
    grams = wide.select("*", F.explode(_grams(F.col("key"), F.col("width"))).alias("at")).withColumn("gram", F.substring("key", F.col("at"), F.col("width")))
    shared = grams.groupBy("width", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(shared, ["width", "gram"]).groupBy("key").agg(F.min(F.struct("n", "at", "gram", "width", "position", "value")).alias("a"))
    return rarest.select("key", "a.value", "a.position", "a.width", "a.gram", "a.at")


def _cut(texts: DataFrame) -> DataFrame:
    """``_name``, low, width, place and gram: every gram of every width of the lower-cased names."""
    wide = texts.select("_name", F.lower("_name").alias("low"), F.explode(F.array(*map(F.lit, WIDTHS))).alias("width"))
    placed = wide.select("*", F.explode(_grams(F.col("low"), F.col("width"))).alias("place"))
    return placed.withColumn("gram", F.substring("low", F.col("place"), F.col("width")))


def possible(keys: DataFrame, grams: DataFrame) -> DataFrame:
    """``keys`` of which the first and the last gram are among ``grams`` (width, gram)."""
    left = _wide(keys)
    for at in (F.lit(1), F.char_length("key") - F.col("width") + 1):
        left = left.withColumn("gram", F.substring("key", at, F.col("width"))).join(grams, ["width", "gram"], "left_semi")
    return left.select(*keys.columns)


def first_key(names: DataFrame, keys: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``key`` and ``value``: those of the key at the smallest position that lies in the lower-cased name; else null.

    ``keys`` has key, value and position. Of equal keys the one at the smallest position counts;
    null and empty keys are none.
    """
    once = keys.filter(F.col("key") != "").groupBy("key").agg(F.min(F.struct("position", "value")).alias("first")).select("key", "first.*")
    cut = _cut(names.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct())
    found = anchored(possible(once, cut.select("width", "gram").distinct()))
    begins = F.col("place") - F.col("at") + 1
    met = cut.join(found, ["width", "gram"])
    hits = met.filter((begins >= 1) & (F.substring("low", begins, F.char_length("key")) == F.col("key")))
    best = hits.groupBy("_name").agg(F.min(F.struct("position", "key", "value")).alias("best"))
    return names.join(best, F.col(name) == F.col("_name"), "left").select(*[names[c] for c in names.columns], F.col("best.key").alias("key"), F.col("best.value").alias("value"))
