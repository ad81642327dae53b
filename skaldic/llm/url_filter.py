"""URL filter by rule lists held in Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe. Level 0
is a Bloom filter of the listed keys. The universe's keys that pass it without
being listed make level 1; the listed keys that pass level 1 make level 2; and
so on until no key passes wrongly. A key's answer is the parity of the first
level that it fails. Levels are constants of the plan, so judging a row takes
no join.

The universe is every key that a row could be matched by: for each url, the
suffixes of its host with as many labels as some rule has, followed by the
prefixes of its path as long as some rule's path.

Size: a level gets as many hashes as halve its wrong passes down to about the
number of keys it encodes, and at least ``HASHES``, with 1.5 bits a key for each and
at least ``BITS_PER_KEY``. So levels shrink from the second on, and a cascade
takes some 20 bits a listed key at any size of the universe. Levels are read to
the driver as bitmaps of 4 KB. A level over ``MAX_BYTES`` is an error, as it would be a
constant of every task: that is a list of some fifty million rules.

Cases: a null url or one without ``://`` has an empty host and path, matches no
rule and is allowed; an empty path matches no rule, as every rule's path starts
with a slash. Very long urls are cut and judged whole. Of rules that tie in length the first in
the order of keys is taken. Repeated rows are judged alike. An empty table gives no rows; with an empty rule
list everything is allowed. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace, unused_names

BITS_PER_KEY = 12
MIN_BITS = 64
HASHES = 4
MAX_HASHES = 30
MAX_BYTES = 128 << 20
MAX_LEVELS = 60


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path prefix, such as ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def labels(self) -> int:
        return self.text.split("/", 1)[0].count(".") + 1

    @property
    def path_length(self) -> int:
        return len(self.text) - self.text.index("/")


@dataclass(frozen=True)
class Level:
    bits: bytes
    seed: int
    hashes: int = HASHES

    @property
    def size(self) -> int:
        return 8 * len(self.bits)


def bit_positions(key: Column, size: int, seed: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * MAX_HASHES + i), key), F.lit(size)) for i in range(hashes)]


def passes(key: Column, level: Level) -> Column:
    """Whether every bit of ``key`` is set in the constant filter."""
    whole = F.lit(bytearray(level.bits))
    tests = []
    for at in bit_positions(key, level.size, level.seed, level.hashes):
        byte = F.substr(whole, (at / 8).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        tests.append(value.bitwiseAND(bit_of(at)) != 0)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def bit_of(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))


def build_level(keys: DataFrame, n_keys: int, n_others: int, seed: int) -> Level:
    """The Bloom filter of column ``key``, with about ``n_keys`` wrong passes among ``n_others`` keys."""
    hashes = min(MAX_HASHES, max(HASHES, math.ceil(math.log2(max(1, n_others / n_keys)))))
    size = max(MIN_BITS, 1 << (math.ceil(n_keys * max(BITS_PER_KEY, 1.5 * hashes)) - 1).bit_length())
    if size > 8 * MAX_BYTES:
        raise ValueError(f"{n_keys} keys need a filter of {size >> 23} MB; at most {MAX_BYTES >> 20} are a constant")
    at = F.explode(F.array(*[p + 1 for p in bit_positions(F.col("key"), size, seed, hashes)]))
    # Bits are set in bitmaps of 4 KB where the keys are, and only those are read here.
    bitmaps = (
        keys.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    )
    whole = bytearray(size // 8)
    for r in bitmaps.toLocalIterator():
        begin = 4096 * (r["bucket"] - 1)
        part = bytes(r["bits"])[: len(whole) - begin]
        whole[begin : begin + len(part)] = part
    return Level(bytes(whole), seed, hashes)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Level]:
    """Levels that answer exactly for the listed keys and every key of the universe.

    Both tables have one column ``key`` of distinct values.
    """
    n = listed.count()
    if n == 0:
        return []
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n_others = outside.count()
    while n and len(levels) < MAX_LEVELS:
        level = build_level(inside, n, n_others, seed + len(levels))
        levels.append(level)
        wrong = outside.filter(passes(F.col("key"), level))
        n, n_others = wrong.count(), n
        inside, outside = wrong, inside
    if n:
        raise ValueError("the cascade did not end; some keys agree in all hashes")
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """The parity of the first level that ``key`` fails; after the last, membership of its side."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(passes(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key that could match, longest first, ties in the order of keys."""
    parts = F.split(host, r"\.", -1)
    keys = []
    for n in sorted({r.labels for r in rules}):
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - F.lit(n - 1), F.lit(1)), n), ".")
        for k in sorted({r.path_length for r in rules}):
            fits = (F.size(parts) >= n) & (F.length(path) >= k)
            keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, k))))
    found = F.filter(F.array(*keys), lambda k: k.isNotNull())
    ranked = F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(ranked, lambda s: s["key"])


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; unlisted urls are allowed.

    The longest matching rule decides. Columns of ``pages`` with one of these
    four names are replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    if not rules:
        return pages.withColumns(
            {"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}
        )
    ws = Workspace(spark, "url-filter")
    keyed = pages.select(host.alias("h"), path.alias("p")).select(candidate_keys(F.col("h"), F.col("p"), rules).alias("keys"))
    universe = ws.keep(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    cascades = {}
    for k, verdict in enumerate(sorted({r.verdict for r in rules})):
        listed = spark.createDataFrame([(r.text,) for r in rules if r.verdict == verdict], "key string").distinct()
        cascades[verdict] = build_cascade(listed, universe, seed=1000 * k)
    ws.drop(universe)

    def matched(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, levels in cascades.items():
            verdict = F.when(is_listed(key, levels), F.lit(name)).otherwise(verdict)
        return F.struct(key.alias("rule"), verdict.alias("verdict"))

    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    hits = F.filter(F.transform(keys, matched), lambda s: s["verdict"].isNotNull())
    split = pages.withColumns({"host": host, "path": path})
    (hit,) = unused_names(split, "hit")
    found = split.withColumn(hit, F.try_element_at(hits, F.lit(1)))
    return found.withColumns({"rule": F.col(f"{hit}.rule"), "verdict": F.coalesce(F.col(f"{hit}.verdict"), F.lit("allow"))}).drop(hit)
