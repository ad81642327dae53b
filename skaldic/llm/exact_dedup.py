"""Exact deduplication by a tree merge of sorted digest runs.

Every input task turns its rows into one run: sorted by digest, equal digests
folded to the smallest identifier and the row count as they pass. Runs are
exchanged in binomial rounds: in each round the runs whose numbers agree beyond
the lowest bits meet, spread over the tasks by digest, are merged into one
sorted run, and neighbours with equal digests are folded. After the last round one
logical run, itself spread over all tasks, holds each digest once. A digest
enters a round at most once per run, so a hot group of copies is a few rows.

Folding is Spark's sort aggregate, which reads rows in digest order and holds
one digest at a time; the smallest identifier is a struct, which a hash
aggregate can't update, so that the plan has sorted runs on both sides of every
exchange.

A digest is SHA-256 of the normalised text; byte length and an independent
64-bit hash travel with it, and rows merge only when all three agree, so every
level keeps a verified smallest identifier.

Cases: null text counts as empty; very long texts are one digest like others. A null ``doc_id`` is never preferred to an
identifier; in a group of null identifiers alone ``keep_id`` is null and the
rows are all kept. Rows that repeat an identifier within a group are kept if
it is the smallest, so ties stay together. An empty table gives no rows. Other columns are ignored, or
kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace, own_columns, unused_names

RUN_BITS = 6
"""log2 of the number of logical runs that input tasks are numbered into."""
ROUND_BITS = 2
"""log2 of the number of runs that meet in one multiway merge."""

# A single space is its own replacement, so only other runs have to be rewritten.
_LOOSE_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text) -> F.Column:
    """Text with every run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LOOSE_SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, digest, verification columns and run number."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("n_bytes"),
        F.spark_partition_id().bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("run"),
    )


def merge_runs(runs: DataFrame, shift: int) -> DataFrame:
    """One round: runs that agree beyond ``shift`` bits are merged into one sorted run.

    ``first`` is struct(no identifier, identifier), whose minimum is the smallest identifier if there is one.
    """
    return runs.groupBy(F.shiftright("run", shift).alias("run"), "digest", "check", "n_bytes").agg(
        F.min("first").alias("first"), F.sum("group_size").alias("group_size")
    )


def exact_groups(narrow: DataFrame) -> DataFrame:
    """(digest, check, n_bytes, keep_id, group_size) of every distinct text."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")).alias("first")
    runs = narrow.select("run", "digest", "check", "n_bytes", first, F.lit(1).cast("long").alias("group_size"))
    bits = RUN_BITS
    while bits > 0:
        shift = min(ROUND_BITS, bits)
        runs = merge_runs(runs, shift)
        bits -= shift
    return runs.select("digest", "check", "n_bytes", F.col("first.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The text is read once, to write the narrow digest table. A group of one row
    is that row's answer already; only rows of real groups are looked up.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    narrow = ws.keep(digests(docs, id_col, text_col), "digests")
    groups = ws.keep(exact_groups(narrow), "groups")
    text_sha256 = F.lower(F.hex("digest")).alias("text_sha256")
    alone = groups.filter("group_size = 1").select(
        F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.lit(True).alias("kept"), text_sha256
    )
    # Both sides of the join are plain shuffles, so a hot digest can be split at run time.
    members = narrow.join(groups.filter("group_size > 1"), ["digest", "check", "n_bytes"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return members.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept, text_sha256).unionByName(alone)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Only repeated texts are looked up, and a text whose digest is not repeated
    passes without meeting any other row. Rows without an identifier stay.
    """
    ws = Workspace(docs.sparkSession, "exact-keep")
    narrow = ws.keep(digests(docs, id_col, text_col), "digests")
    shared = ws.keep(exact_groups(narrow).filter("group_size > 1"), "shared")
    lost_id, lost_check, check = unused_names(docs, "lost_id", "lost_check", "check_here")
    losers = ws.keep(
        narrow.join(shared, ["digest", "check", "n_bytes"])
        .filter(F.col("id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id")))
        .select(F.col("id").alias(lost_id), F.col("check").alias(lost_check))
        .distinct(),
        "losers",
    )
    here = docs.withColumn(check, F.xxhash64(normalised(F.col(text_col))))
    gone = (F.col(id_col) == F.col(lost_id)) & (F.col(check) == F.col(lost_check))
    return here.join(losers, gone, "left_anti").select(*own_columns(docs))
