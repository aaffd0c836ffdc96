"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..functions.lines import split_lines
from ..operators import breaker, chat, chunks, evaluation, events, files, hosts, matching, pages, rule_table, rules, sarif, snapshots, verdicts
from ..streaming.breaker_stream import breaker_stream, danger_stream
from ..streaming.chunk_stream import chunk_stream
from ..streaming.guard_stream import guard_stream
from . import tables, views

Query = Callable[[SparkSession, str], DataFrame]


def _joined(df: DataFrame) -> DataFrame:
    """Reasons as one string, so results compare across engines."""
    return df.withColumn("reasons", F.array_join("reasons", "|"))


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


# --- texts ---------------------------------------------------------------

def verdicts_documents(spark, sf):
    return _joined(verdicts.classify_corpus(views.planted_documents(spark, sf), keys=["doc_id"]))


def verdicts_long_rows(spark, sf):
    return _joined(verdicts.classify_corpus(views.long_rows(spark, sf), keys=["row_id"]))


def verdict_counts_by_lang(spark, sf):
    judged = verdicts.classify_corpus(views.planted_documents(spark, sf), keys=["doc_id", "lang"])
    return judged.groupBy("lang", "action").agg(F.count("*").alias("documents"))


def guard_envelopes(spark, sf):
    return _joined(verdicts.guard_envelope(views.planted_documents(spark, sf), keys=["doc_id"])).drop("matched")


def findings_all_rules(spark, sf):
    return matching.match_rules(views.planted_documents(spark, sf), keys=["doc_id"])


def top_rules_by_source(spark, sf):
    found = matching.match_rules(views.planted_documents(spark, sf), keys=["doc_id", "source"])
    counted = found.groupBy("source", "section", "rule_id").agg(F.count("*").alias("hits"))
    order = W.partitionBy("source").orderBy(F.col("hits").desc(), "section", "rule_id")
    return counted.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")


def findings_rule_table(spark, sf):
    """The built-in book as a table."""
    index = rule_table.index_rules(rules.default_rules().to_df(spark).filter("section <> 'safe_installers'"))
    return rule_table.match_rule_table(views.planted_documents(spark, sf), index, keys=["doc_id"])


def findings_user_rules(spark, sf):
    """Rules that users keep in a table: every four words on end of every benchmark item."""
    index = rule_table.index_rules(views.phrase_rules(spark, sf))
    found = rule_table.match_rule_table(views.texts(spark, sf, "documents"), index, keys=["doc_id"])
    return found.select("doc_id", "rule_id")


def rule_table_verdicts(spark, sf):
    """First hit and last downgrade of the built-in book as a table."""
    book = rules.default_rules()
    index = rule_table.index_rules(book.to_df(spark).filter("section <> 'safe_installers'"))
    return _joined(rule_table.classify_by_table(views.planted_documents(spark, sf), index, keys=["doc_id"],
                                                installers=[p for _, p in book.safe_installers]))


def risky_lines(spark, sf):
    return _joined(verdicts.scan_lines(views.planted_documents(spark, sf), keys=["doc_id"])).select(
        "doc_id", "line_no", "line", "code", "action", "reasons")


def risky_line_summary(spark, sf):
    scanned = verdicts.scan_lines(views.planted_documents(spark, sf), keys=["doc_id", "source"])
    return verdicts.line_summary(scanned, keys=["source"])


def decoded_payloads(spark, sf):
    return _joined(verdicts.decode_payloads(views.planted_documents(spark, sf), keys=["doc_id"]))


# --- hosts ---------------------------------------------------------------

def _page_hosts(spark, sf):
    return hosts.extract_hosts(views.planted_pages(spark, sf), keys=["page_id"], text_col="html")


def _document_hosts(spark, sf):
    return hosts.extract_hosts(views.planted_documents(spark, sf), keys=["doc_id"])


def hosts_extracted(spark, sf):
    return _page_hosts(spark, sf)


def page_url_hosts(spark, sf):
    urls = hosts.extract_hosts(views.table(spark, sf, "pages"), keys=["page_id"], text_col="url")
    return hosts.hosts_by_volume(hosts.score_hosts(urls)).select("host", "signals", "code", "urls")


def host_signals(spark, sf):
    return _joined(hosts.score_hosts(_document_hosts(spark, sf))).drop("blocked")


def host_verdicts(spark, sf):
    return _joined(hosts.host_verdicts(hosts.score_hosts(_document_hosts(spark, sf)), keys=["doc_id"]))


def blocklist_hits(spark, sf):
    listed, _ = _seed_table(spark)
    scored = hosts.score_hosts(_page_hosts(spark, sf), blocklist=listed)
    return scored.filter("blocked").select("page_id", "pos", "host")


def verdicts_joined_blocklist(spark, sf):
    listed, _ = _seed_table(spark)
    return _joined(hosts.classify_with_blocklist(views.planted_documents(spark, sf), listed, keys=["doc_id"]))


def _seed_table(spark):
    from ..sources.readers import read_blocklist
    return read_blocklist(spark)


# --- conversations -------------------------------------------------------

def conversation_audit(spark, sf):
    audited = chat.audit_conversations(views.planted_turns(spark, sf), keys=["conv_id", "turn"])
    return _joined(audited).select("conv_id", "turn", "allowed", "verdict", "code", "reasons")


def conversation_audit_rollup(spark, sf):
    audited = chat.audit_conversations(views.planted_turns(spark, sf), keys=["conv_id", "turn"])
    return chat.audit_rollup(audited, by=["conv_id"])


def chat_json_flatten(spark, sf):
    return chat.flatten_chat(views.chat_records(spark, sf), keys=["conv_id", "turn"])


def chat_strict_content(spark, sf):
    return chat.strict_content(views.chat_records(spark, sf), keys=["conv_id", "turn"])


def chat_export(spark, sf):
    return chat.chat_export(views.table(spark, sf, "conversations"), order=["conv_id", "turn"])


# --- pages ---------------------------------------------------------------

def page_verdicts(spark, sf):
    return _joined(pages.classify_pages(views.planted_pages(spark, sf), keys=["page_id"]))


def profile_parity(spark, sf):
    html = views.planted_pages(spark, sf)
    return pages.verdict_parity(
        verdicts.classify_corpus(html, keys=["page_id"], text_col="html"),
        pages.classify_pages(html, keys=["page_id"]), keys=["page_id"])


# --- files ---------------------------------------------------------------

def line_findings(spark, sf):
    return files.scan_files(views.file_tree(spark, sf))


def skill_rollup(spark, sf):
    return files.rollup_skills(views.file_tree(spark, sf))


def _per_folder(spark, sf):
    """A skill per document, so that some are clean."""
    return views.file_tree(spark, sf).withColumn("skill", F.concat_ws("-", "skill", F.col("doc_id").cast("string")))


def sweep_summary(spark, sf):
    return files.sweep_summary(files.rollup_skills(_per_folder(spark, sf)))


def gate_refusals(spark, sf):
    tree = _per_folder(spark, sf)
    admitted, refused = files.gate(tree, files.rollup_skills(tree))
    both = (admitted.withColumn("admitted", F.lit(True))
            .unionByName(refused.withColumn("admitted", F.lit(False))))
    return both.groupBy("family", "admitted").agg(F.count("*").alias("files"))


def refusal_report(spark, sf):
    return files.refusal_report(files.scan_files(views.file_tree(spark, sf))).select(
        "skill", "rank", "path", "line", "risk", "context")


def secret_literals(spark, sf):
    found = files.scan_files(views.file_tree(spark, sf))
    return found.filter("risk like 'hardcoded credential literal%'").groupBy("skill", "severity", "risk").agg(
        F.count("*").alias("files"))


# --- events --------------------------------------------------------------

def event_metrics(spark, sf):
    return events.event_metrics(views.guard_events(spark, sf), by=["log"])


def verdict_histogram(spark, sf):
    return events.verdict_histogram(views.guard_events(spark, sf))


def event_status(spark, sf):
    return _micros(events.event_status(views.guard_events(spark, sf), order=["ts", "event_id"]), "ts")


def incidents(spark, sf):
    return _micros(events.incidents(views.guard_events(spark, sf), order=["ts", "event_id"]), "ts")


def event_health(spark, sf):
    return events.event_health(views.guard_events(spark, sf), order=["ts", "event_id"])


def metric_lines(spark, sf):
    return events.metric_lines(events.event_metrics(views.guard_events(spark, sf)))


# Errors are rare per log in the given events, so the window is longer here.
_MINUTES = 120


def breaker_alerts(spark, sf):
    return _micros(breaker.breaker_alerts(views.guard_events(spark, sf), log="log", minutes=_MINUTES), "ts")


def breaker_epochs(spark, sf):
    numbered = breaker.number_epochs(views.guard_events(spark, sf), log="log")
    alerts = breaker.breaker_alerts(numbered, log="log", minutes=_MINUTES)
    return _micros(breaker.breaker_epochs(numbered, alerts, log="log"), "opened_at")


def danger_watch_hourly(spark, sf):
    watched = breaker.danger_watch(views.guard_events(spark, sf))
    return _micros(watched, "window_start", "window_end")


@contextmanager
def _few_states(spark):
    """State partitions of the streams that start here: at most one per core. Each costs a store and a worker in every
    micro-batch, with or without rows, and logs and windows are few."""
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    spark.conf.set(name, min(int(given), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def _alerts_of_feed(spark, sf, build):
    """What a streaming query writes for the late and shuffled feed of the guard events, file after file."""
    base = storage.scratch(spark)
    schema = None
    for piece in views.late_feed(spark, sf):
        piece.write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(piece.schema).parquet(f"{base}/in"))
        schema = stream.schema
        with _few_states(spark):
            running = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
                       .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        running.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def breaker_stream_query(spark, sf):
    alerts = _alerts_of_feed(spark, sf, lambda events: breaker_stream(events, log="log", minutes=_MINUTES, watermark=views.FEED_LATENESS))
    return _micros(alerts.drop("opened_at"), "ts")


def danger_stream_query(spark, sf):
    watched = _alerts_of_feed(spark, sf, lambda events: danger_stream(events, window="1 hour", slide="1 hour", watermark=views.FEED_LATENESS))
    return _micros(watched, "window_start", "window_end")


# --- chunks --------------------------------------------------------------

def chunk_verdicts(spark, sf):
    return _joined(chunks.chunk_verdicts(views.chunk_table(spark, sf), stream="conv_id", seq="turn", block=64))


def chunk_stream_query(spark, sf):
    base = storage.scratch(spark)
    stream = views.chunk_table(spark, sf, streaming=True)
    chunk_stream(stream, f"{base}/out", f"{base}/checkpoint", stream="conv_id", seq="turn").awaitTermination()
    return _joined(spark.read.parquet(f"{base}/out").drop("batch"))


def chunk_verdicts_reset(spark, sf):
    table = views.chunk_table(spark, sf, resets=True)
    return _joined(chunks.chunk_verdicts(table, stream="conv_id", seq="turn", op_col="op", block=4))


def chunk_stream_reset(spark, sf):
    """Turns in two micro-batches, so that buffers and resets are carried over."""
    base = storage.scratch(spark)
    table = views.chunk_table(spark, sf, resets=True)
    for late in (False, True):
        table.filter((F.col("turn") >= 3) == late).write.mode("append").parquet(f"{base}/in")
        chunk_stream(spark.readStream.schema(table.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/checkpoint",
                     stream="conv_id", seq="turn", block=4).awaitTermination()
    return _joined(spark.read.parquet(f"{base}/out").drop("batch"))


def guard_stream_query(spark, sf):
    base = storage.scratch(spark)
    stream = views.planted_turns(spark, sf, streaming=True)
    guard_stream(stream, f"{base}/allowed", f"{base}/refused", f"{base}/checkpoint",
                 keys=["conv_id", "turn"]).awaitTermination()
    both = spark.read.parquet(f"{base}/allowed").unionByName(spark.read.parquet(f"{base}/refused"))
    return both.groupBy("allowed", "verdict").agg(F.count("*").alias("turns"))


# --- reports, snapshots, scores -------------------------------------------

def sarif_findings(spark, sf):
    return sarif.normalize_sarif(views.sarif_documents(spark, sf), keys=["l_orderkey"]).drop("pos")


def sarif_severity_counts(spark, sf):
    return sarif.severity_counts(sarif_findings(spark, sf), keys=["l_orderkey"])


def snapshot_digest(spark, sf):
    return snapshots.snapshot_digest(views.table(spark, sf, "documents"), path="doc_id", content="text")


def snapshot_diff(spark, sf):
    return snapshots.snapshot_diff(views.baseline_snapshot(spark, sf), views.current_snapshot(spark, sf))


def recover_rows(spark, sf):
    recovered = snapshots.recover_rows(snapshot_diff(spark, sf), views.baseline_snapshot(spark, sf), views.recovery_sources(spark, sf))
    return _micros(recovered, "ts")


def keep_latest(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    kept, removed = snapshots.keep_latest(orders, dataset="o_custkey", ts="o_orderdate", name="o_orderkey")
    both = kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))
    return both.select("o_custkey", "o_orderkey", "kept")


def _scored(spark, sf, by):
    planted = views.planted_documents(spark, sf)
    judged = verdicts.classify_corpus(planted, keys=["doc_id", "category", "expected"])
    scored = evaluation.evaluate_labelled(judged, by=by)
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


def evaluate_overall(spark, sf):
    return _scored(spark, sf, [])


def evaluate_by_category(spark, sf):
    return _scored(spark, sf, ["category"])


def evaluate_against_labels(spark, sf):
    """Verdicts of the planted documents against the toxic label as gold."""
    judged = verdicts.classify_corpus(views.planted_documents(spark, sf), keys=["doc_id"])
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("expected"))
    scored = evaluation.evaluate(judged, labels, keys=["doc_id"])
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


def recall_by_family(spark, sf):
    tree = _per_folder(spark, sf).filter(F.col("family").isNotNull())
    rolled = files.rollup_skills(tree)
    scored = evaluation.recall_by_family(rolled, tree.filter(files.scannable(F.col("path"))), keys=["skill"])
    return scored.withColumn("share", F.round("share", 6))


def document_lines(spark, sf):
    """Lines per source under the line-boundary rules."""
    lines = views.planted_documents(spark, sf).select("source", F.size(split_lines(F.col("text"))).alias("n"))
    return lines.groupBy("source").agg(F.sum("n").alias("lines"))


def queries() -> dict[str, Query]:
    named = [
        verdicts_documents, verdicts_long_rows, verdict_counts_by_lang, guard_envelopes, findings_all_rules, top_rules_by_source,
        findings_rule_table, findings_user_rules, rule_table_verdicts, risky_lines, risky_line_summary, decoded_payloads, document_lines,
        hosts_extracted, page_url_hosts, host_signals, host_verdicts, blocklist_hits,
        verdicts_joined_blocklist,
        conversation_audit, conversation_audit_rollup, chat_json_flatten, chat_strict_content, chat_export,
        page_verdicts, profile_parity,
        line_findings, skill_rollup, sweep_summary, gate_refusals, refusal_report, secret_literals, recall_by_family,
        event_metrics, verdict_histogram, event_status, incidents, event_health, metric_lines,
        breaker_alerts, breaker_epochs, danger_watch_hourly, chunk_verdicts, chunk_verdicts_reset, chunk_stream_reset,
        sarif_findings, sarif_severity_counts,
        snapshot_digest, snapshot_diff, recover_rows, keep_latest,
        evaluate_overall, evaluate_by_category, evaluate_against_labels,
    ]
    table = {query.__name__: query for query in named}
    table["breaker_stream"] = breaker_stream_query
    table["danger_stream"] = danger_stream_query
    table["chunk_stream"] = chunk_stream_query
    table["guard_stream"] = guard_stream_query
    return {**table, **tables.queries()}
