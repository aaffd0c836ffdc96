"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise  # noqa: F401 - the operators write and read back their intermediate tables by it

#: Words between white space, case kept: [^\x20\x09-\x0D]+, written as ranges, which Java matches several times faster.
SPACED_WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"
#: Words of letters, digits and everything beyond ASCII, after A-Z were lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
PLAIN_WORD = r"[\x30-\x39\x61-\x7A\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII takes the cheap built-in, which does the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """Lower-cased words of a text as an array; NULL has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; NULL stays NULL."""
    return F.unhex(F.md5(text))


def window_hashes(words: Column, n: int) -> Column:
    """Hash of each n consecutive words, in order; empty for shorter texts."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def covered_words(starts: Column, lengths: Column | int) -> Column:
    """Words under windows, given the sorted starts (an attribute, not an expression) of windows of one length."""
    return F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(lengths), F.coalesce(F.get(starts, k + 1) - s, F.lit(lengths)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint"))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which the optimizer moves no filter: what is computed above is
    computed once, not again inside each filter that names it (inside a lambda even once per element)."""
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("_all")).select("_all.*")


BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For a materialised table of narrow rows: marked for broadcast if it is small enough, counted first; a larger
    one is left to Spark's shuffle joins."""
    return F.broadcast(df) if df.count() <= most_rows else df


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows_per_bucket: int = 2_000,
             most_buckets: int = 1 << 14) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, however many rows a key has.

    Rows of a key are dealt into buckets by a hash of the order columns; each bucket is numbered by itself and starts
    where the buckets before it end. The table of counts holds one row per key and bucket. Rows that agree in all
    order columns are interchangeable; many of them share a bucket.
    """
    buckets = max(1, min(most_buckets, -(-df.count() // rows_per_bucket)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    first = counts.select(*keys, "_bucket", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_first"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return own.join(first, [*keys, "_bucket"]).withColumn(name, F.col("_first") + F.col("_own")).drop("_bucket", "_own", "_first")
