"""Readers. Every schema is given, nothing is inferred.

Files of lines are read in splits, by several tasks if they are large, and lines still know their numbers: a split's lines
are numbered in the order of its rows, the counts of the earlier splits of the file are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.events import EVENT_SCHEMA
from ..tables import host_signals

# Line breaks of Python's str.splitlines besides the line feed.
_OTHER_BREAKS = r"\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def read_lines(spark: SparkSession, path, *, other_breaks: bool = False) -> DataFrame:
    """Lines of text files as ``(path, line_no, line)``, numbered from 1. Bytes that are not UTF-8 are replaced.

    A line ends at a line feed. With ``other_breaks`` the further breaks of `functions.lines` end one as well; then
    a line that holds some counts as several, for which only the splits that hold such lines are shuffled.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.make_valid_utf8("value").alias("line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"\r\z", "")) if other_breaks else rows
    lines_in = F.when(F.col("line").rlike(_OTHER_BREAKS), F.size(F.split("line", _OTHER_BREAKS, -1))).otherwise(1) if other_breaks else F.lit(1)
    splits = rows.groupBy("path", "_start").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows"), F.sum(lines_in).alias("_n"))
    earlier = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = rows.join(splits, ["path", "_start"])
    plain = placed.filter("_rows = _n").select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
    if not other_breaks:
        return plain
    inside = W.partitionBy("path", "_start").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    broken = placed.filter("_rows <> _n").withColumn("_at", F.col("_before") + F.coalesce(F.sum(lines_in).over(inside), F.lit(0)))
    parts = broken.select("path", "_at", F.posexplode(F.split("line", _OTHER_BREAKS, -1)).alias("_pos", "line"))
    return plain.unionByName(parts.select("path", (F.col("_at") + F.col("_pos") + 1).alias("line_no"), "line"))


def read_history(spark: SparkSession, path) -> DataFrame:
    """Histories as lines ``(path, line_no, line)``, for `verdicts.judge_lines`. A missing path raises."""
    return read_lines(spark, path, other_breaks=True)


def read_chat_export(spark: SparkSession, path) -> DataFrame:
    """Chat exports as ``(path, position, record)``: a file is a JSON array if its first character that is no
    white space is ``[``, else one record per line; blank lines are skipped.

    JSON lines are read in splits; the position is the line number. A file that is one array has to be parsed as one
    document, its elements are numbered. An array that does not parse gives one record, the whole text, at position 0."""
    lines = read_lines(spark, path)
    text = F.regexp_replace("line", r"^[\s\ufeff]+", "")
    filled = lines.filter(text != "")
    arrays = filled.groupBy("path").agg(F.min_by(F.left(text, F.lit(1)), "line_no").alias("_first")).filter("_first = '['").select("path")
    records = filled.join(arrays, "path", "left_anti").select("path", F.col("line_no").alias("position"), F.col("line").alias("record"))
    whole = lines.join(arrays, "path", "left_semi").groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("_text"))
    elements = F.transform(F.try_variant_get(F.try_parse_json("_text"), "$", "array<variant>"), lambda v: F.to_json(v))
    numbered = F.transform(elements, lambda e, i: F.struct((i + 1).cast("bigint").alias("position"), e.alias("record")))
    broken = F.array(F.struct(F.lit(0).cast("bigint").alias("position"), F.col("_text").alias("record")))
    return records.unionByName(whole.select("path", F.inline(F.coalesce(numbered, broken))))


def read_events(spark: SparkSession, path, *, strict: bool = False) -> DataFrame:
    """A guard event log in JSON lines. Bad lines are dropped, or raise if ``strict``; `read_event_lines` keeps them."""
    return (spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
            .option("timeZone", "UTC").json(path))


def read_event_lines(spark: SparkSession, path) -> DataFrame:
    """Every line of a guard event log as ``(path, position, <event fields>, problem, line)``. A bad line fails nothing: it
    has a problem, its text and no fields. Blank lines are skipped."""
    lines = read_lines(spark, path).filter(F.trim("line") != "")
    parsed = F.from_json("line", f"{EVENT_SCHEMA}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "timeZone": "UTC"})
    lines = lines.withColumn("_kind", F.regexp_extract(F.schema_of_variant(F.try_parse_json("line")), "^[A-Z]+", 0)).withColumn("_e", parsed)
    problem = (F.when(F.col("_kind").isNull(), "not JSON").when(F.col("_kind") != "OBJECT", "not an object")
               .when(F.col("_e._bad").isNotNull(), "field of another type"))
    lines = lines.withColumn("problem", problem)
    names = [field.split()[0] for field in EVENT_SCHEMA.split(", ")]
    return lines.select("path", F.col("line_no").alias("position"), *[F.when(F.col("problem").isNull(), F.col(f"_e.{n}")).alias(n) for n in names],
                        "problem", F.when(F.col("problem").isNotNull(), F.col("line")).alias("line"))


def read_event_stream(spark: SparkSession, path, *, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path))


def read_sarif(spark: SparkSession, path) -> DataFrame:
    """SARIF files, each one JSON document, as ``(source_file, document)``."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(name.alias("source_file"), F.col("value").alias("document"))


def read_file_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as ``(skill, path, content)``; the skill is the first
    folder. Bytes that are not UTF-8 are replaced."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.substring_index(relative, "/", 1).alias("skill"),
        F.regexp_replace(relative, "^[^/]+/", "").alias("path"), text.alias("content"))


def read_messages(spark: SparkSession, table: str) -> DataFrame:
    """A session store table ``messages(id, role, content)`` as chat turns in order."""
    return spark.table(table).select("id", "role", F.col("content").alias("text")).orderBy("id")


def read_blocklist(spark: SparkSession, path: str | None = None):
    """``(hosts, sha256)`` of a pinned blocklist file, or the built-in one. The digest is the one of a single small
    field; hosts stay a table."""
    if path is None:
        return spark.createDataFrame([(h,) for h in host_signals.SEED_HOSTS], "host string"), host_signals.SEED_SHA256
    doc = spark.read.schema("hosts array<string>, sha256 string").option("multiLine", "true").json(path)
    return doc.select(F.explode("hosts").alias("host")), doc.select("sha256").first().sha256


def event_time(text: Column) -> Column:
    """The time of an event written as ISO 8601, a day or with a time, with or without an offset (then UTC); NULL if it is
    none."""
    text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    has_offset = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(has_offset, text).otherwise(F.concat(text, F.lit("Z"))))
