"""Headline queries, one JSON line: seconds per query and in total.

Each query is planned and run in full; its rows are counted where they are made
(a no-op write), nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from riskweave.plans import catalog
from riskweave.session import local_session

HEADLINE = (
    "verdicts_documents", "verdict_counts_by_lang", "findings_all_rules", "risky_lines", "decoded_payloads",
    "host_verdicts", "blocklist_hits", "conversation_audit_rollup", "chat_json_flatten", "page_verdicts",
    "profile_parity", "line_findings", "skill_rollup", "gate_refusals", "event_metrics", "breaker_alerts",
    "breaker_epochs", "danger_watch_hourly", "chunk_verdicts", "chunk_stream", "breaker_stream",
    "sarif_severity_counts", "snapshot_diff", "recover_rows", "keep_latest", "evaluate_by_category",
)


def rates(spark, sf_dir: str) -> dict[str, float]:
    """Units per second and core, comparable with the published rates."""
    from pyspark.sql import functions as F

    from riskweave.functions.lines import split_lines
    from riskweave.operators import files, verdicts
    from riskweave.plans import views

    cores, copies = spark.sparkContext.defaultParallelism, 4

    def repeated(df):
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(cores * 4).persist()
        df.count()
        return df

    docs = repeated(views.planted_documents(spark, sf_dir))
    lines = repeated(views.planted_documents(spark, sf_dir).select(
        "doc_id", F.posexplode(split_lines(F.col("text"))).alias("n", "text")))
    tree = repeated(views.file_tree(spark, sf_dir).filter(files.scannable(F.col("path"))))
    tree_lines = tree.agg(F.sum(F.size(split_lines(F.col("content"))))).first()[0]

    def seconds(df):
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - start

    out = {
        "documents_per_s_core": docs.count() / seconds(verdicts.classify_corpus(docs, keys=["doc_id"])) / cores,
        "texts_per_s_core": lines.count() / seconds(verdicts.classify_corpus(lines, keys=["doc_id", "n"])) / cores,
        "scan_lines_per_s_core": tree_lines / seconds(files.scan_files(tree)) / cores,
        "mean_line_chars": lines.agg(F.avg(F.length("text"))).first()[0],
    }
    return {k: round(v) for k, v in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    queries, times = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    result = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if not sys.argv[1:]:
        result["rates"] = rates(spark, sf_dir)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
