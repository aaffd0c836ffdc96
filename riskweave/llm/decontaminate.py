"""Benchmark decontamination: a broadcast hash set of item windows, scanned by document token windows.

Items are cut into windows of ten words (shorter items are one window). The distinct windows are the set; documents
hash every window of the lengths that occur, probe the set in the same stage and compare the words on a hit, so hash
collisions never count. Only hits are shuffled.

The set is broadcast while it has at most `broadcast_windows` windows (counted first); a larger set is joined by
shuffle, on which Spark splits hot windows.

Defined cases: NULL and empty texts have no words, hits or windows. Items without words never occur; items with a NULL
id cause hits but are not listed. Repeated items count once. Repeated rows of a document get the same result each.
Empty tables give no hits. Other columns pass through `remove_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

WINDOW = 10
BROADCAST_WINDOWS = 200_000
#: As common.PLAIN_WORD, for text whose case is kept, with what follows the word.
BEFORE_WORDS = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WORD_AND_REST = r"[\x30-\x39\x41-\x5A\x61-\x7A\x80-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows: `_window` (words), `_length`, `_hash` and the sorted ids of the items that hold them."""
    words = items.select(F.col(item_id).cast("string").alias("_item"), c.plain_words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.lit(n), F.size("_w"))
    cut = words.select("_item", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.size("_w") - length + 1), lambda i: F.slice("_w", i, length))).alias("_window"))
    return cut.groupBy("_window").agg(F.sort_array(F.collect_set("_item")).alias("_items")).select(
        "_window", F.size("_window").alias("_length"), F.xxhash64("_window").alias("_hash"), "_items")


def _merged(spans: Column) -> Column:
    """Sorted (at, length) windows as disjoint spans and their words: one linear pass."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def step(s: Column, x: Column) -> Column:
        end = (x["at"] + x["length"]).cast("bigint")
        new = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(s["end"], x["at"].cast("bigint")))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["hit"] + new).alias("hit"))

    return F.aggregate(spans, start, step)["hit"]


def find_hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text",
              broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per contaminated document: `_id`, `_key` (hash of the text), `_spans`, `n_hit`, `_items`."""
    spark = docs.sparkSession
    windows = c.materialise(windows)
    sizes = {r["_length"]: r["n"] for r in windows.groupBy("_length").agg(F.count("*").alias("n")).collect()}  # lengths 1 to WINDOW
    words = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), c.plain_words(F.col(text)).alias("_words"))
    found = None
    for length, n in sorted(sizes.items()):
        own = windows.where(F.col("_length") == length).select("_hash", "_window", "_items")
        if n <= broadcast_windows:
            own = F.broadcast(own)
        scanned = words.withColumn("_hashes", c.window_hashes(F.col("_words"), length)).select(
            "_id", "_key", "_words", F.posexplode_outer("_hashes").alias("_at", "_hash"))
        hits = scanned.join(own, "_hash").where(F.slice("_words", F.col("_at") + 1, length) == F.col("_window")).select(
            "_id", "_key", F.struct(F.col("_at").alias("at"), F.lit(length).alias("length")).alias("_span"), "_items")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), F.struct(
            F.lit(0).alias("at"), F.lit(0).alias("length")).alias("_span"), F.array(F.lit("")).alias("_items")).schema)
    # All windows of a document meet here: as many as the document has words, never more than one text holds.
    return found.groupBy("_id", "_key").agg(
        F.sort_array(F.collect_set("_span")).alias("_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"),
    ).withColumn("n_hit", _merged(F.col("_spans")))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_key"] == right["_key"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document with its digest."""
    hits = find_hits(docs, item_windows(items), **options)
    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.size(c.plain_words(F.col("text"))).cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return own.join(hits, _same(own, hits), "left").select(
        own["_id"].alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(F.coalesce("_items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", none)), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        remove: str = "documents", **options) -> DataFrame:
    """Without contaminated documents, or (`remove="spans"`) with the hit words cut out of their texts."""
    hits = find_hits(docs, item_windows(items), doc_id, text, **options)
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"))
    if remove == "documents":
        return rows.join(hits, _same(rows, hits), "left_anti").select("_row.*")
    hit = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    joined = rows.join(hits.select("_id", "_key", hit.alias("_hit")), _same(rows, hits), "left")
    parts = joined.withColumn("_parts", F.regexp_extract_all(F.col("_row")[text], F.lit(WORD_AND_REST), F.lit(0)))
    left = parts.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_hit"))
    kept = F.concat(F.regexp_extract(F.col("_row")[text], BEFORE_WORDS, 0), F.array_join(F.transform("_left", lambda i: F.get("_parts", i)), ""))
    cleaned = F.when(F.col("_hit").isNotNull(), kept).otherwise(F.col("_row")[text])
    return left.withColumn("_row", F.col("_row").withField(text, cleaned)).select("_row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(c.table(spark, sf_dir, "documents").select("doc_id", "text"), c.table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{c.UPPER}', '{c.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
covered AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit)),
h AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
