"""Registered queries of readers, writers, checks and reports.

Files are written to the shared storage from the given tables and read back by the library's readers, so every reader sees
whole tables; what it should find is known from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.lines import safe_path
from ..operators import chat, evaluation, events, files, hosts, rules, sarif, snapshots, verdicts
from ..sources import readers, writers
from ..tables.line_rules import LINE_RULES
from . import views

SHARDS = 16
OWN_RULE = ("calls a colleague", r"""ring[^\n]*bell|(?:bonjour|hallo)[^\n]*!""")


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", "|"))


def _pick(key: Column, options: list) -> Column:
    out = F.lit(options[-1])
    for i, option in enumerate(options[:-1]):
        out = F.when(key % len(options) == i, option).otherwise(out)
    return out


def _shard(path: str) -> Column:
    return F.regexp_extract(path, r"shard=(\d+)", 1).cast("int")


def _written_lines(df: DataFrame, line: Column, shard: Column, order: list[str]) -> str:
    """A folder of text files, one per shard, lines in order."""
    path = storage.scratch(df.sparkSession)
    rows = df.select(line.alias("value"), (shard % SHARDS).cast("int").alias("shard"), *order)
    (rows.repartition("shard").sortWithinPartitions("shard", *order).select("value", "shard")
     .write.partitionBy("shard").option("lineSep", "\n").text(path))
    return path


# --- lines and chats ---------------------------------------------------------

def history_lines(spark, sf):
    """Risky lines of histories that are read in splits, with their numbers in the file."""
    docs = views.planted_documents(spark, sf)
    path = _written_lines(docs, F.coalesce("text", F.lit("")), F.col("doc_id"), ["doc_id"])
    lines = readers.read_history(spark, path).select(_shard("path").alias("shard"), "line_no", "line")
    judged = verdicts.judge_lines(lines, keys=["shard"])
    return _joined(judged).select("shard", F.col("line_no").cast("bigint").alias("line_no"), "line", "code", "reasons")


def history_line_counts(spark, sf):
    """Lines per file and the sum of their numbers."""
    docs = views.planted_documents(spark, sf)
    path = _written_lines(docs, F.coalesce("text", F.lit("")), F.col("doc_id"), ["doc_id"])
    lines = readers.read_history(spark, path).groupBy(_shard("path").alias("shard"))
    return lines.agg(F.count("*").alias("lines"), F.max("line_no").cast("bigint").alias("last"), F.sum("line_no").cast("bigint").alias("total"))


def chat_export_positions(spark, sf):
    """Turns of exports, one of which in sixteen is a JSON array, with their positions."""
    records = views.chat_records(spark, sf)
    shard = F.col("conv_id") % SHARDS
    path = _written_lines(records.filter(shard != 3), F.col("record"), F.col("conv_id"), ["conv_id", "turn"])
    arrays = records.filter(shard == 3).groupBy((F.col("conv_id") % 48).cast("int").alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct("conv_id", "turn", "record"))).alias("_r"))
    text = F.concat(F.lit(" ["), F.array_join(F.transform("_r", lambda r: r.record), ",\n"), F.lit("]"))
    arrays.select(text.alias("value"), "shard").write.mode("append").partitionBy("shard").text(f"{path}-arrays")
    both = readers.read_chat_export(spark, path).unionByName(readers.read_chat_export(spark, f"{path}-arrays"))
    flat = chat.flatten_chat(both.withColumn("shard", _shard("path")), keys=["shard", "position"])
    return flat.select("shard", F.col("position").cast("bigint").alias("position"), "role", "text")


def _spoilt(record: Column, key: Column) -> Column:
    """Some records cut in the middle, some that are no objects, one in a hundred blank."""
    return (F.when(key % 25 == 3, F.left(record, F.lit(9))).when(key % 25 == 7, F.lit("[1, 2]")).when(key % 100 == 11, F.lit("  "))
            .otherwise(record))


def chat_quarantine(spark, sf):
    """Chat records with what is wrong with them; one bad record fails nothing."""
    records = views.chat_records(spark, sf).filter(F.col("turn").isNotNull())
    spoilt = records.withColumn("record", _spoilt(F.col("record"), F.col("conv_id") * 8 + F.col("turn")))
    return chat.flatten_chat(spoilt, keys=["conv_id", "turn"], keep_bad=True)


def guard_json(spark, sf):
    return _joined(chat.guard_json(views.chat_records(spark, sf), keys=["conv_id", "turn"]))


def session_messages(spark, sf):
    """A session store as a table, its assistant messages by the guard's roles."""
    name = "riskweave_messages"
    table = views.table(spark, sf, "conversations")
    table.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content")).createOrReplaceTempView(name)
    return chat.assistant_turns(readers.read_messages(spark, name)).select("id", "role", F.length("text").alias("chars"))


# --- events ------------------------------------------------------------------

def _event_file(spark, sf) -> str:
    """The guard events as JSON lines by log, some of them spoilt."""
    rows = views.guard_events(spark, sf)
    record = F.to_json(F.struct("ts", "command", F.lit(1).alias("argument_count"), F.lit(0).alias("wrapped_exit"),
                                F.lit(0).alias("guard_exit"), "verdict", "reasons"))
    key = F.col("event_id")
    spoilt = F.when(key % 50 == 17, F.replace(record, F.lit('"argument_count":1'), F.lit('"argument_count":"many"'))).otherwise(_spoilt(record, key))
    return _written_lines(rows, spoilt, key, ["event_id"])


def event_quarantine(spark, sf):
    """Bad lines of event logs with their file and position."""
    lines = readers.read_event_lines(spark, _event_file(spark, sf)).filter(F.col("problem").isNotNull())
    return lines.select(_shard("path").alias("shard"), F.col("position").cast("bigint").alias("position"), "problem")


def tolerant_events(spark, sf):
    """Events that a tolerant reader gets from the same logs."""
    lines = readers.read_event_lines(spark, _event_file(spark, sf)).filter(F.col("problem").isNull())
    return events.verdict_histogram(lines)


def event_log_round_trip(spark, sf):
    """Events appended by the event sink and read strictly."""
    path = storage.scratch(spark)
    names = [field.split()[0] for field in events.EVENT_SCHEMA.split(", ")]
    rows = views.guard_events(spark, sf).withColumns({"argument_count": F.size("reasons"), "wrapped_exit": F.lit(0), "guard_exit": F.lit(0)})
    writers.append_events(rows.select(*names), path, max_records_per_file=2000)
    read = readers.read_events(spark, path, strict=True)
    return read.groupBy("command", "verdict").agg(F.count("*").alias("events"), F.sum(F.unix_millis("ts")).alias("millis"))


def event_times(spark, sf):
    """Times written in several ISO forms."""
    ts, key = F.col("ts").cast("timestamp"), F.col("event_id")
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(key % 5 == 0, F.concat(plain, F.lit("Z"))).when(key % 5 == 1, plain).when(key % 5 == 2, F.concat(plain, F.lit("+02:00")))
            .when(key % 5 == 3, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.concat(F.lit("at "), plain)))
    return views.table(spark, sf, "events").select("event_id", F.unix_micros(readers.event_time(text)).alias("micros"))


def protocol_check(spark, sf):
    """Guard answers whose fields agree, and some that do not."""
    key = F.col("event_id")
    code = F.when(F.col("verdict") == "DANGEROUS", 2).when(F.col("verdict") == "SUSPICIOUS", 1).otherwise(0)
    rows = views.guard_events(spark, sf).select(
        "event_id", "verdict", F.when(key % 11 == 3, (code + 1) % 3).otherwise(code).alias("code"),
        F.when(key % 13 == 2, code != 0).otherwise(code == 0).alias("allowed"),
        F.when(key % 17 == 5, F.lit(1)).otherwise(F.when(code == 0, 0).otherwise(2)).alias("exit_code"),
        F.when(key % 19 != 4, F.when(key % 23 == 6, F.array(F.lit(None).cast("string"))).otherwise(F.col("reasons"))).alias("reasons"),
        F.when(key % 29 != 8, F.lit("")).alias("warning"))
    return _joined(events.checked_protocol(rows)).select("event_id", "valid", "verdict", "exit_code", "reasons")


def metric_file(spark, sf):
    """Metric lines as a scraper would read the file."""
    path = storage.scratch(spark)
    writers.write_metric_lines(events.metric_lines(events.event_metrics(views.guard_events(spark, sf))), path)
    return readers.read_lines(spark, path).select(F.col("line_no").cast("int").alias("line_no"), F.col("line").alias("value"))


# --- files, reports, rules ---------------------------------------------------

def file_tree_read(spark, sf):
    """A tree of small files, a folder per benchmark item, as the tree reader gives it."""
    path = storage.scratch(spark)
    items = views.table(spark, sf, "benchmark")
    items.select(F.col("text").alias("value"), (F.col("item_id") % 5).alias("skill"), F.col("item_id").alias("item")).write.partitionBy(
        "skill", "item").text(path)
    tree = readers.read_file_tree(spark, path).filter(F.col("path").endswith(".txt"))
    return tree.select("skill", F.regexp_extract("path", r"^item=(\d+)/", 1).cast("bigint").alias("item"), F.sha2(F.rtrim("content", F.lit("\n")), 256).alias("sha256"))


def line_findings_profile(spark, sf):
    """The line scan with another profile: an own rule before the built-in ones, nothing benign."""
    profile = files.LineProfile(rules=(OWN_RULE, *LINE_RULES), benign=())
    return files.scan_files(views.file_tree(spark, sf), profile=profile).select("skill", "path", "line", "severity", "risk")


def report_published(spark, sf):
    """The refusal report with the published widths."""
    found = files.scan_files(views.file_tree(spark, sf), context_chars=90)
    return files.refusal_report(found, context_chars=60).select("skill", "rank", "path", "line", "risk", "context")


def report_round_trip(spark, sf):
    """Findings written by severity and read back."""
    path = storage.scratch(spark)
    writers.write_report(files.scan_files(views.file_tree(spark, sf)), path, partition_by="severity")
    return spark.read.parquet(path).groupBy("severity", "risk").agg(F.count("*").alias("findings"))


def verdicts_limited(spark, sf):
    """Verdicts under the size limit for texts, and with decoded texts cut as published."""
    limited = verdicts.classify_corpus(views.planted_documents(spark, sf), keys=["doc_id"], max_bytes=2000, decoded_chars=80)
    return _joined(limited)


def sorted_findings(spark, sf):
    """The report order of the findings of each document, as a rank."""
    from pyspark.sql import Window as W
    # A global order reads its input twice, for the ranges and for the rows; findings are read then, not reports.
    found = storage.materialise(sarif.normalize_sarif(views.sarif_documents(spark, sf), keys=["l_orderkey"]))
    ordered = sarif.sorted_findings(found, keys=["l_orderkey"])
    order = W.partitionBy("l_orderkey").orderBy(F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), "id", "fingerprint")
    return ordered.select("l_orderkey", "id", "path", "line", F.row_number().over(order).alias("rank"))


def sarif_limited(spark, sf):
    """Documents that the published number of findings would refuse, at a limit that some exceed."""
    parsed = sarif.parse_sarif(views.sarif_documents(spark, sf), keys=["l_orderkey"], max_findings=5)
    return parsed.groupBy("problem").agg(F.count("*").alias("documents"))


def rule_problems(spark, sf):
    """What is wrong with a table of rules made from the parts."""
    key = F.col("p_partkey")
    table = views.table(spark, sf, "part").select(
        _pick(key, ["blocked", "suspicious", "safe_installers", "other"]).alias("section"), F.floor(key / 6).cast("int").alias("ord"),
        F.when(key % 7 == 0, " ").otherwise(F.col("p_name")).alias("rule_id"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("pattern"))
    return rules.validate_rules(table)


def unsafe_paths(spark, sf):
    """Problems of a baseline whose paths and digests are partly spoilt."""
    key = F.col("doc_id")
    name = key.cast("string")
    path = _pick(key, [F.concat(F.lit("docs/"), name), F.concat(F.lit("../"), name), F.concat(F.lit("/docs/"), name), F.concat(F.lit("docs//"), name),
                       F.concat(F.lit("docs/./"), name), F.concat(F.lit("docs/.."), name), F.concat(F.lit("docs/"), name, F.lit("/"))])
    docs = views.table(spark, sf, "documents")
    baseline = docs.select(path.alias("path"), F.when(key % 13 == 5, F.lit("abc")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return snapshots.baseline_problems(baseline)


def safe_paths(spark, sf):
    """Whether the path part of each page's address is one that stays below its root."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return views.table(spark, sf, "pages").select("page_id", safe_path(path).alias("safe"))


def tree_equality(spark, sf):
    """Trees compared in several columns, where NULL equals NULL."""
    key = F.col("doc_id")
    docs = views.table(spark, sf, "documents").withColumn("path", F.concat(F.lit("docs/"), key.cast("string")))
    lang = F.when(key % 31 != 2, F.col("lang"))
    old = docs.filter(key % 41 != 4).select("path", F.sha2("text", 256).alias("sha256"), "n_chars", F.when(key % 62 != 2, F.col("lang")).alias("lang"))
    new = docs.filter(key % 37 != 3).select("path", F.sha2("text", 256).alias("sha256"), (F.col("n_chars") + F.when(key % 29 == 1, 1).otherwise(0)).alias("n_chars"), lang.alias("lang"))
    return snapshots.snapshot_diff(old, new, compare=["sha256", "n_chars", "lang"])


def distinct_targets(spark, sf):
    """Suppliers in the order in which line items ask for them first."""
    items = views.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asked"))
    return snapshots.distinct_targets(items, target="l_suppkey", pos="asked")


def failures(spark, sf):
    """The first wrong verdicts of the planted documents, judged by the label for toxic texts."""
    judged = verdicts.classify_corpus(views.planted_documents(spark, sf), keys=["doc_id"])
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("expected"))
    return evaluation.failures(judged, labels, keys=["doc_id"])


def blocklist_digest(spark, sf):
    """Size and digest of the list of all hosts that pages name."""
    named = hosts.extract_hosts(views.planted_pages(spark, sf), keys=["page_id"], text_col="html").select(F.col("raw_host").alias("host"))
    return hosts.blocklist_digest(named)


def normal_hosts(spark, sf):
    """The list itself, normalised."""
    named = hosts.extract_hosts(views.planted_pages(spark, sf), keys=["page_id"], text_col="html").select(F.upper("raw_host").alias("host"))
    return hosts.normalize_blocklist(named)


def queries():
    return {f.__name__: f for f in (
        history_lines, history_line_counts, chat_export_positions, chat_quarantine, guard_json, session_messages, event_quarantine, tolerant_events,
        event_log_round_trip, event_times, protocol_check, metric_file, file_tree_read, line_findings_profile, report_published, report_round_trip,
        verdicts_limited, sorted_findings, sarif_limited, rule_problems, unsafe_paths, safe_paths, tree_equality, distinct_targets, failures,
        blocklist_digest, normal_hosts)}
