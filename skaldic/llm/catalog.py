"""Queries of the operators on the tables of TESTDATA.md, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import ann, exact_dedup, html_text, langid, leaderboard, mixing, neardup, packing, periodic, suffix_dedup, toxicity, url_filter, warc
from .workspace import Workspace, table

RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").new_path("archive")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).withColumnRenamed("doc_id", "page_id")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN url IS NOT NULL AND position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, b, unnest(range(0, greatest(n_bytes - 49, 0))) AS s FROM d
), strings AS MATERIALIZED (
  SELECT doc_id, s, array_slice(b, s + 1, s + 50) AS string FROM starts
), firsts AS (
  SELECT string, min(doc_id) AS least FROM strings GROUP BY string HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, s FROM strings JOIN firsts USING (string) WHERE doc_id > least
), marked AS (
  SELECT doc_id, s, coalesce(s > 50 + lag(s) OVER (PARTITION BY doc_id ORDER BY s), true) AS opens FROM hits
), numbered AS (
  SELECT doc_id, s, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked
), spans AS (
  SELECT doc_id, min(s) AS first, max(s) + 50 AS last FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS after FROM spans
), lost AS (
  SELECT doc_id, sum(last - first)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * after + 1, 2 * (first - after)), '' ORDER BY first) || substr(any_value(h), 2 * max(last) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex20 FROM pages
), coded AS (
  SELECT page_id, body, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex20, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, strlen(body) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
FROM coded WINDOW same AS (PARTITION BY body)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 4 THEN list_filter([array_to_string(words, ' ')], lambda s: s <> '')
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM w
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT one, two FROM met JOIN sizes x ON one = x.doc_id JOIN sizes y ON two = y.doc_id
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), sides AS MATERIALIZED (
  SELECT one, two FROM links UNION ALL SELECT two, one FROM links
), reach AS (
  SELECT one, two FROM sides
  UNION
  SELECT reach.one, sides.two FROM reach JOIN sides ON reach.two = sides.one
), least AS (
  SELECT one AS doc_id, min(two) AS other FROM reach GROUP BY one
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
  doc_id <= coalesce(other, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP11_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))
), written AS (
  SELECT *, concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(item_id::VARCHAR, ''), ',', coalesce(vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, '')) AS w
  FROM sale_lines
), hashed AS (
  SELECT written.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(w) + 1), lambda i: ord(w[i])::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM written, crc
), dated AS (
  SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150) AS s FROM hashed
), arrived AS (
  SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated
), cut AS MATERIALIZED (
  SELECT *, least(10, greatest(1, 1 + floor((a - 19723) * 10 / 180)))::INTEGER AS batch FROM arrived
), newest AS (
  SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM cut GROUP BY batch
), one_vendor AS (
  SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id
), one_item AS (
  SELECT item_id, min(price) AS price FROM items GROUP BY item_id
), valued AS (
  SELECT nation_id, item_id, a, batch, (CASE WHEN flag = 'returned' THEN -1 ELSE 1 END) * coalesce(
    CASE WHEN abs(amount) < 1e13 THEN floor(100 * amount + 0.5) END, quantity * CASE WHEN abs(price) < 1e13 THEN floor(100 * price + 0.5) END, 0)::BIGINT AS cents
  FROM cut JOIN newest USING (batch) JOIN one_vendor USING (vendor_id) JOIN one_item USING (item_id)
  WHERE nation_id IS NOT NULL AND (earlier IS NULL OR s + 3 >= earlier)
), sums AS (
  SELECT nation_id, item_id, a, sum(cents) AS cents FROM valued GROUP BY ALL
), running AS MATERIALIZED (
  SELECT nation_id, item_id, a, sum(cents) OVER w AS revenue, lead(a) OVER w AS until
  FROM sums WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)
), days AS MATERIALIZED (
  SELECT nation_id, a AS day, min(batch) AS batch, lead(a) OVER (PARTITION BY nation_id ORDER BY a) AS next_day FROM valued GROUP BY nation_id, a
), boards AS MATERIALIZED (
  SELECT nation_id, day, next_day, item_id, row_number() OVER (PARTITION BY nation_id, day ORDER BY revenue DESC, item_id) AS rank
  FROM days JOIN running USING (nation_id) WHERE a <= day AND (until IS NULL OR day < until) AND revenue > 0
  QUALIFY rank <= 10
), both_boards AS (
  SELECT nation_id, day, item_id, rank AS new_rank, NULL AS old_rank FROM boards
  UNION ALL SELECT nation_id, next_day, item_id, NULL, rank FROM boards WHERE next_day IS NOT NULL
), ranks AS (
  SELECT nation_id, day, item_id, max(old_rank)::INTEGER AS old_rank, max(new_rank)::INTEGER AS new_rank FROM both_boards GROUP BY ALL
)
SELECT ranks.nation_id, ranks.day::BIGINT AS arrival_day, ranks.item_id, days.batch,
  CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, revenue::BIGINT AS revenue
FROM ranks JOIN days USING (nation_id, day) JOIN running ON running.nation_id = ranks.nation_id AND running.item_id = ranks.item_id AND a <= ranks.day AND (until IS NULL OR ranks.day < until)
WHERE old_rank IS DISTINCT FROM new_rank
"""


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


BATCHES = 10
FIRST_DAY = 19723
"""The first of January 2024, in days since 1970."""
DAYS = 180
DAYS_LATE = 3
LINES_A_FILE = 1 << 21
LINES_A_PART = 1 << 16
"""Lines of a nation's part, on average; a state can't be dealt anew, so its parts are fixed when it begins."""


def sale_batches(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    """Lines with board (nation; null where it or the item isn't known), item_id, day, ship_day, value in cents and batch.

    Both joins are of plain shuffles, so that a hot vendor or item is split at
    run time; what they move is five numbers and a key a line. Of repeated rows of a vendor
    or item the smallest nation and price count.
    """
    lines = table(spark, sf_dir, "sale_lines")
    written = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")])
    h, sign = F.col("h"), F.when(F.col("flag") == "returned", -1).otherwise(1)
    dated = lines.withColumn("h", F.crc32(written)).withColumn("ship_day", F.coalesce(F.unix_date(F.to_date("shipped_at")), FIRST_DAY + h % 150))
    day = F.col("ship_day") + h % 7 + F.when(h % 5 == 0, 20).otherwise(0)

    def cents(money: Column) -> Column:
        """Null for what is no amount of money: not a number, or more cents than a double can count."""
        return F.when(F.abs(money) < 1e13, F.floor(100 * money + 0.5))

    paid = cents(F.col("amount"))
    # A line carries the signed cents of its amount, or else the signed quantity for the price.
    narrow = dated.select(
        "vendor_id", "item_id", (sign * paid).alias("paid"), F.when(paid.isNull(), sign * F.col("quantity")).alias("quantity"), F.col("ship_day").cast("int").alias("ship_day"), day.cast("int").alias("day")
    )
    vendors = ws.keep(table(spark, sf_dir, "vendors").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "vendors")
    items = ws.keep(table(spark, sf_dir, "items").groupBy("item_id").agg(cents(F.min("price")).alias("price"), F.lit(True).alias("known")), "items")
    joined = narrow.join(vendors.hint("merge"), "vendor_id", "left").drop("vendor_id").join(items.hint("merge"), "item_id", "left")
    number = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    return joined.select(
        F.when(F.col("known"), F.col("nation_id")).alias("board"), "item_id", F.col("day").cast("long").alias("day"), "ship_day",
        F.coalesce("paid", F.col("quantity") * F.col("price"), F.lit(0)).cast("long").alias("value"), number.alias("batch"),
    )


def op11_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "leaderboard")
    cut, root = ws.new_path("cut"), ws.new_path("stream")
    lines, n = sale_batches(spark, sf_dir, ws), table(spark, sf_dir, "sale_lines").count()
    # A batch is a few files, as each costs the shared folder and the stream's log an entry.
    files = F.pmod(F.xxhash64("item_id", "board", "day"), F.lit(2 + n // (BATCHES * LINES_A_FILE)))
    lines.repartition("batch", files).write.partitionBy("batch").parquet(cut)
    found = spark.read.schema(lines.schema).parquet(cut).groupBy("batch").agg(F.max("ship_day").alias("newest")).collect()
    newest = {r["batch"]: r["newest"] for r in found}
    parts = 4
    while 25 * parts * LINES_A_PART < n:
        parts *= 2

    def on_time(stream: DataFrame, number: int) -> DataFrame:
        earlier = [day for batch, day in newest.items() if batch < number]
        known = stream.filter(F.col("board").isNotNull() & F.col("item_id").isNotNull())
        return known.filter(F.col("ship_day") + DAYS_LATE >= max(earlier)) if earlier else known

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    out = leaderboard.replay_batches(spark, cut, root, schema, list(range(1, BATCHES + 1)), on_time, parts)
    feed = spark.read.schema(leaderboard.PART_FEED.format(kind="int")).parquet(out)
    return leaderboard.merged_boards(feed, parts).withColumnsRenamed({"board": "nation_id", "day": "arrival_day"})


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def with_tails(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, by the CRC of their identifiers, go on from word a with a period p of their own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))
    n, a, p = F.size("w"), F.col("a"), F.col("p")
    placed = cut.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))

    def word(own: Column, i: Column) -> Column:
        return F.when(i < a, own).otherwise(F.get(F.col("w"), (a + (i - a) % p).cast("int")))

    tailed = F.when(a.isNotNull(), F.array_join(F.transform("w", word), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", tailed.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = periodic.periodic_runs(docs).withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_ann": op2_ann,
        "op3_packing": op3_packing,
        "op4_url_filter": op4_url_filter,
        "op5_langid": op5_langid,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_warc": op9_warc,
        "op10_neardup": op10_neardup,
        "op11_leaderboard": op11_leaderboard,
        "op12_html_text": op12_html_text,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": OP4_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op8_suffix_dedup": OP8_SQL,
        "op9_warc": OP9_SQL,
        "op10_neardup": OP10_SQL,
        "op11_leaderboard": OP11_SQL,
    }
