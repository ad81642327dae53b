"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes the weight p**a / sum(p**a). The
exponent a is bisected to the smallest departure from 1 that meets a target
entropy (a fraction of the even mixture's) and then raised, if needed, until no
source repeats more often than a limit. Each bisection step is an aggregate
over the table of sources; only its few sums reach the driver.

The weights are realised as budgeted block permutations. A seeded hash deals a
source's documents to blocks. An epoch visits the blocks in its own permutation
and each block's documents in hash order, and the source's budget of tokens is
laid along that sequence: whole epochs, whole blocks of the last epoch, and a
cut inside one block. Block sums are aggregated before they are ordered, and an
epoch's blocks are ordered by stretches, so a source with a third of all rows is
never one task: a task orders a block's rows, or a stretch's blocks.

The stream is cut into ``n_mix_blocks`` mix blocks; mix block b holds from each
source the documents that start in the b-th part of its budget, so every mix block shows
the target weights.

Cases: a null source is a source of its own, apart from the empty string. Null
and empty texts have no tokens; they follow their block at no cost, once, in the first epoch. Very
long texts are counted whole and may run over the end of a budget or block. Repeated
rows share a hash, and so do rows whose hashes tie: they are taken or left together. A source without tokens has
weight 0 and passes once. With a fixed budget a source may repeat more often than the limit, where even its
own share breaks it, and a tiny source as often as its budget asks. An empty table gives no rows. ``mixed_documents`` keeps all columns,
whatever their names; ``mix`` has its own and ignores others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import Workspace, own_columns, unused_names

WORD = r"[^\x20\x09-\x0D]+"
SPECULATED_LEVELS = 4
"""Bisection levels that one pass over the sources answers."""
BISECTION_PASSES = 10
ROWS_PER_BLOCK = 4096
STRETCH_BITS = 12
"""log2 of the stretches that an epoch's sequence of blocks is cut into."""


@dataclass(frozen=True)
class MixTarget:
    """entropy: fraction of the even mixture's entropy, or None to keep shares as they are.
    repetitions: most passes over any source. budget: tokens to draw; None draws
    as few as show every source at least once."""

    entropy: float | None = 0.97
    repetitions: float | None = 4.0
    budget: int | None = None
    n_mix_blocks: int = 64
    seed: int = 17


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bisect(passing, low: float, high: float) -> float:
    """The boundary where ``passing`` turns true, false at ``low`` and true at ``high``.

    ``passing`` takes a list of exponents and answers all of them in one job;
    each pass asks for every midpoint of the next levels, then walks down.
    """
    for _ in range(BISECTION_PASSES):
        n = 1 << SPECULATED_LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        answers = dict(zip(points, passing(points), strict=True))
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if answers[points[mid - 1]]:
                hi = mid
            else:
                lo = mid
        low, high = low + (high - low) * lo / n, low + (high - low) * hi / n
    return high


@dataclass(frozen=True)
class PowerSums:
    """Sums over sources of the shares p at one exponent a."""

    a: float
    z: float
    logs: float
    most: float
    least: float

    @property
    def entropy(self) -> float:
        """Entropy of the weights p**a / z."""
        return math.log(self.z) - self.a * self.logs / self.z


def power_sums(shares: DataFrame, exponents: list[float]) -> list[PowerSums]:
    """z = sum p**a, logs = sum p**a ln p, most and least p**(a-1), in one job for all exponents."""
    cols = []
    for i, a in enumerate(exponents):
        power, ratio = F.pow("p", F.lit(float(a))), F.pow("p", F.lit(float(a) - 1.0))
        cols += [
            F.sum(power).alias(f"z{i}"),
            F.sum(power * F.log("p")).alias(f"l{i}"),
            F.max(ratio).alias(f"m{i}"),
            F.min(ratio).alias(f"n{i}"),
        ]
    row = shares.agg(*cols).first()
    return [PowerSums(a, row[f"z{i}"], row[f"l{i}"], row[f"m{i}"], row[f"n{i}"]) for i, a in enumerate(exponents)]


def fit_exponent(shares: DataFrame, target: MixTarget, total: int) -> float:
    """The exponent in [0, 1] for a table with a positive share ``p`` per source.

    Entropy falls as the exponent grows: the largest exponent that reaches the
    target entropy is taken, 1 if the shares themselves do. The most repeated
    source is the rarest, and its repetitions fall as the exponent grows: the
    exponent is raised to the least that keeps the limit. Where even 1 breaks
    it, because of a fixed budget, 1 stays.
    """
    n = shares.count()
    if n < 2:
        return 1.0
    a = 1.0
    if target.entropy is not None:
        goal = target.entropy * math.log(n)

        def short(points: list[float]) -> list[bool]:
            return [s.entropy < goal for s in power_sums(shares, points)]

        if short([1.0])[0]:
            a = _bisect(short, 0.0, 1.0)
    if target.repetitions is not None:

        def within(points: list[float]) -> list[bool]:
            sums = power_sums(shares, points)
            if target.budget is None:
                return [s.most / s.least <= target.repetitions for s in sums]
            return [s.most / s.z * target.budget / total <= target.repetitions for s in sums]

        if not within([a])[0]:
            a = _bisect(within, a, 1.0)
    return a


def narrow_rows(docs: DataFrame, target: MixTarget, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, key, h, tokens) of every row, text left behind."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        source_key(F.col(source_col)).alias("key"),
        row_hash(F.col(id_col), F.col(text_col), target.seed).alias("h"),
        token_count(F.col(text_col)).alias("tokens"),
    )


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def source_weights(narrow: DataFrame, target: MixTarget, ws: Workspace) -> tuple[DataFrame, float]:
    """(key, source_tokens, weight, budget) of every source, and the exponent."""
    sources = ws.keep(narrow.groupBy("key").agg(F.sum("tokens").alias("source_tokens")), "sources")
    total = sources.agg(F.sum("source_tokens")).first()[0] or 0
    shares = ws.keep(
        sources.filter("source_tokens > 0").select("key", (F.col("source_tokens") / F.lit(max(total, 1))).alias("p")),
        "shares",
    )
    a = fit_exponent(shares, target, total) if total else 1.0
    sums = power_sums(shares, [a])[0] if total else None
    budget = target.budget
    if budget is None:
        budget = total * sums.z / sums.least if total else 0
    p = F.col("source_tokens") / F.lit(max(total, 1))
    weight = F.when(F.col("source_tokens") > 0, F.pow(p, F.lit(a)) / F.lit(sums.z if sums else 1.0)).otherwise(F.lit(0.0))
    weights = sources.withColumn("weight", weight).withColumn(
        # With the least budget the commonest source passes exactly once, whatever the rounding.
        "budget",
        F.greatest(F.round(F.col("weight") * F.lit(float(budget))).cast("long"), F.lit(0).cast("long"))
        if target.budget is not None
        else F.greatest(F.round(F.col("weight") * F.lit(float(budget))).cast("long"), F.col("source_tokens")),
    )
    return ws.keep(weights, "weights"), a


def lay_out(narrow: DataFrame, weights: DataFrame, target: MixTarget, ws: Workspace) -> DataFrame:
    """(key, h, weight, epoch, position, mix_block) of every draw; ``position`` counts the source's tokens before it.

    Ordered sums run over blocks of a source, then over the hashes of a block,
    both bounded, and never over a source's rows.
    """
    n_rows = narrow.count()
    n_blocks = 1 << max(0, math.ceil(math.log2(max(1, n_rows / ROWS_PER_BLOCK))))
    hashes = ws.keep(
        narrow.withColumn("block", F.pmod(F.col("h"), F.lit(n_blocks)))
        .groupBy("key", "block", "h")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("before", F.sum("tokens").over(Window.partitionBy("key", "block").orderBy("h")) - F.col("tokens")),
        "hashes",
    )
    blocks = hashes.groupBy("key", "block").agg(F.sum("tokens").alias("block_tokens"))
    epochs = F.greatest(F.ceil(F.col("budget") / F.greatest("source_tokens", F.lit(1))), F.lit(1))
    visits = ws.keep(
        blocks.join(weights, "key")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
        .withColumn("visit", F.xxhash64(F.lit(target.seed), "epoch", "block"))
        .withColumn("stretch", F.shiftright("visit", 64 - STRETCH_BITS)),
        "visits",
    )
    # An epoch's sequence of blocks is cut into stretches, whose sums are laid out first.
    order = Window.partitionBy("key", "epoch").orderBy("stretch")
    stretches = visits.groupBy("key", "epoch", "stretch").agg(F.sum("block_tokens").alias("stretch_tokens"))
    stretches = stretches.withColumn("before_stretch", F.sum("stretch_tokens").over(order) - F.col("stretch_tokens")).drop("stretch_tokens")
    within = Window.partitionBy("key", "epoch", "stretch").orderBy("visit", "block")
    start = F.col("epoch") * F.col("source_tokens") + F.col("before_stretch") + F.sum("block_tokens").over(within) - F.col("block_tokens")
    # Texts without tokens take no room, so they are drawn in the first epoch also where the budget is just used up.
    first = F.col("epoch") == 0
    plan = ws.keep(
        visits.join(stretches, ["key", "epoch", "stretch"])
        .withColumn("start", start)
        .filter((F.col("start") < F.col("budget")) | (first & (F.col("start") == F.col("budget"))))
        .select("key", "block", "weight", "budget", "epoch", "start"),
        "plan",
    )
    drawn = hashes.join(plan, ["key", "block"]).withColumn("position", F.col("start") + F.col("before"))
    part = F.floor(F.col("position") * F.lit(target.n_mix_blocks) / F.greatest("budget", F.lit(1)))
    free = first & (F.col("tokens") == 0) & (F.col("position") == F.col("budget"))
    return drawn.filter((F.col("position") < F.col("budget")) | free).select(
        "key", "h", "weight", "epoch", "position", F.least(part, F.lit(target.n_mix_blocks - 1)).alias("mix_block")
    )


def mix(
    docs: DataFrame,
    target: MixTarget = MixTarget(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per draw: doc_id, source, tokens, weight, epoch, position, mix_block, mix_order.

    Reading by mix_block, then mix_order, is the training stream.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    narrow = ws.keep(narrow_rows(docs, target, id_col, text_col, source_col), "narrow")
    weights, _ = source_weights(narrow, target, ws)
    draws = ws.keep(lay_out(narrow, weights, target, ws), "draws")
    return narrow.join(draws, ["key", "h"]).select(
        F.col("id").alias("doc_id"),
        "source",
        "tokens",
        "weight",
        "epoch",
        "position",
        "mix_block",
        F.xxhash64(F.lit(target.seed), "mix_block", "epoch", "h").alias("mix_order"),
    )


def mixed_documents(
    docs: DataFrame,
    target: MixTarget = MixTarget(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The drawn rows with all their columns, once per draw; the text moves once, to meet its draws."""
    ws = Workspace(docs.sparkSession, "mixed")
    narrow = ws.keep(narrow_rows(docs, target, id_col, text_col, source_col), "narrow")
    weights, _ = source_weights(narrow, target, ws)
    drawn_key, drawn_h, copies, key, h, copy = unused_names(docs, "drawn_key", "drawn_h", "copies", "key", "h", "copy")
    draws = lay_out(narrow, weights, target, ws).groupBy("key", "h").agg(F.count("*").cast("int").alias(copies))
    draws = ws.keep(draws.select(F.col("key").alias(drawn_key), F.col("h").alias(drawn_h), copies), "copies")
    # A document drawn once needs no lookup, so only the others and the undrawn are sent.
    every_row_drawn = target.budget is None
    here = docs.withColumns({key: source_key(F.col(source_col)), h: row_hash(F.col(id_col), F.col(text_col), target.seed)})
    met = here.join(
        draws.filter(F.col(copies) > 1) if every_row_drawn else draws,
        (F.col(key) == F.col(drawn_key)) & (F.col(h) == F.col(drawn_h)),
        "left" if every_row_drawn else "inner",
    )
    each = F.sequence(F.lit(1), F.coalesce(F.col(copies), F.lit(1)))
    return met.withColumn(copy, F.explode(each)).select(*own_columns(docs))
