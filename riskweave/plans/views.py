"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import literal_array
from ..tables import contexts as values
from . import payloads


def table(spark: SparkSession, sf_dir: str, name: str, *, streaming: bool = False) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if streaming:
        # A table is a file, which the file source takes by its folder and name, or a folder of part files.
        path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir, f"{name}.parquet")
        stream = spark.readStream.schema(df.schema)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            return stream.parquet(path.toString())
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. Where the session asks for it, as the local one does for tables of a single file, its rows
    are spread over so many partitions."""
    df, spread = table(spark, sf_dir, name), spark.conf.get("spark.riskweave.spread", None)
    return df.repartition(int(spread)) if spread else df


def _pick(items, key: Column, modulus: int) -> Column:
    """The item the key selects, NULL for the keys past the end of the list."""
    return F.get(literal_array(items), (key % modulus).cast("int"))


def _appended(text: Column, payload: Column) -> Column:
    return F.when(payload.isNotNull(), F.concat(text, F.lit("\n"), payload)).otherwise(text)


def planted_documents(spark, sf_dir) -> DataFrame:
    """Documents with ``text, category, expected`` after planting."""
    docs = texts(spark, sf_dir, "documents")
    key = F.col("doc_id")
    payload_texts, kinds, codes = ([p[i] for p in payloads.TEXT_PAYLOADS] for i in (2, 0, 1))
    return docs.select(
        "doc_id", "lang", "source", _appended(F.col("text"), _pick(payload_texts, key, payloads.TEXT_MODULUS)).alias("text"),
        F.coalesce(_pick(kinds, key, payloads.TEXT_MODULUS), F.lit("none")).alias("category"),
        F.coalesce(_pick([str(c) for c in codes], key, payloads.TEXT_MODULUS), F.lit("0")).cast("int").alias("expected"))


def long_rows(spark, sf_dir) -> DataFrame:
    """Thirty-two documents on end in a row, some 80 kB, each followed by forty of one beginning."""
    docs = table(spark, sf_dir, "documents").withColumn("row_id", F.floor(F.col("doc_id") / 32))
    begun = F.repeat(_pick(payloads.BEGINNINGS, F.col("doc_id"), len(payloads.BEGINNINGS)), F.lit(40))
    parts = docs.select("row_id", "doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), begun).alias("text"))
    return parts.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.text), " ").alias("text"))


def phrase_rules(spark, sf_dir) -> DataFrame:
    """A rule per four words on end in a benchmark item, as users would keep them in a table."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").select(words.alias("_w")).filter(F.size("_w") >= 4)
    phrases = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - 3), lambda i: F.array_join(F.slice("_w", i, 4), " "))).alias("rule_id")).distinct()
    return phrases.select(F.lit("blocked").alias("section"), F.lit(1).alias("ord"), "rule_id", F.replace("rule_id", F.lit(" "), F.lit("[ ,.;:!?]+")).alias("pattern"))


def planted_turns(spark, sf_dir, *, streaming: bool = False) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", streaming=True) if streaming else texts(spark, sf_dir, "conversations")
    payload = _pick([p[2] for p in payloads.TEXT_PAYLOADS], F.col("conv_id") * 31 + F.col("turn"), payloads.TEXT_MODULUS)
    return turns.select("conv_id", "turn", "role", _appended(F.col("text"), payload).alias("text"))


def planted_pages(spark, sf_dir) -> DataFrame:
    payload = _pick(payloads.PAGE_PAYLOADS, F.col("page_id"), payloads.PAGE_MODULUS)
    script = F.concat(F.lit("<script>"), payload, F.lit("</script>"))
    return texts(spark, sf_dir, "pages").select(
        "page_id", "url", _appended(F.col("html"), script).alias("html"))


def file_tree(spark, sf_dir) -> DataFrame:
    """Documents as files of a skill per source; markdown payloads are fenced for
    one id in seven."""
    docs = texts(spark, sf_dir, "documents")
    key = F.col("doc_id")
    ext = _pick(payloads.EXTENSIONS, key, len(payloads.EXTENSIONS))
    lines = _pick([p[2] for p in payloads.LINE_PAYLOADS], key, payloads.LINE_MODULUS)
    fenced = F.when((ext == ".md") & (key % 7 == 0), F.concat(F.lit("```bash\n"), lines, F.lit("\n```"))).otherwise(lines)
    return docs.select(
        "doc_id", F.col("source").alias("skill"), F.concat(F.lit("scripts/"), key.cast("string"), ext).alias("path"),
        _appended(F.col("text"), fenced).alias("content"),
        _pick([p[0] for p in payloads.LINE_PAYLOADS], key, payloads.LINE_MODULUS).alias("family"),
        (_pick([str(p[1]) for p in payloads.LINE_PAYLOADS], key, payloads.LINE_MODULUS) == "True").alias("should_block"))


def guard_events(spark, sf_dir, *, streaming: bool = False) -> DataFrame:
    """Events as guard events: errors are dangerous, purchases suspicious."""
    kind = F.col("event_type")
    verdict = F.when(kind == "error", "DANGEROUS").when(kind == "purchase", "SUSPICIOUS").otherwise("SAFE")
    return table(spark, sf_dir, "events", streaming=streaming).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("log-"), (F.col("user_id") % 4).cast("string")).alias("log"),
        kind.alias("command"), verdict.alias("verdict"), F.array(kind).alias("reasons"),
        kind.isin("error", "view").alias("is_chat"),
        ((kind == "signup") & (F.col("event_id") % 50 == 0)).alias("is_reset"))


FEED_LATENESS = "3 days"


def late_feed(spark, sf_dir):
    """Guard events as three pieces in which every event comes up to three days late and in no order, then a piece
    whose one event, of no log, only moves the clock on."""
    events = guard_events(spark, sf_dir)
    day = F.unix_micros("ts") / 86_400_000_000
    events = events.withColumn("_at", day + 2.9 * F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000)
    first, last = events.agg(F.min("_at"), F.max("_at")).first()
    width = (last - first) / 3 + 1e-9 if first is not None else 1.0
    events = events.withColumn("_piece", F.floor((F.col("_at") - (first or 0.0)) / width))
    for piece in range(3):
        yield events.filter(F.col("_piece") == piece).drop("_at", "_piece").repartition(4, F.xxhash64("event_id", F.lit(1)))
    end = F.max("ts") + F.expr("INTERVAL 9 DAYS")
    yield guard_events(spark, sf_dir).agg(end.alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("string").alias("log"), F.lit("clock").alias("command"),
        F.lit("SAFE").alias("verdict"), F.array(F.lit("clock")).alias("reasons"), F.lit(False).alias("is_chat"), F.lit(False).alias("is_reset"))


def chunk_table(spark, sf_dir, *, streaming: bool = False, resets: bool = False) -> DataFrame:
    """Conversations as chunk streams; some payloads are cut over two turns. With ``resets`` some turns are resets."""
    n = len(payloads.SPLIT_PAYLOADS)
    turns = table(spark, sf_dir, "conversations", streaming=streaming)
    # Two adjacent turns of a stream share a slot: the even one gets the left half.
    slot = F.col("conv_id") + F.floor(F.col("turn") / 2)
    halves = [_pick([p[side] for p in payloads.SPLIT_PAYLOADS], slot, 2 * n + 1) for side in (0, 1)]
    even = F.col("turn") % 2 == 0
    text = (F.when(halves[0].isNull(), F.col("text"))
            .when(even, F.concat("text", F.lit(" "), halves[0])).otherwise(F.concat(halves[1], F.lit(" "), "text")))
    op = [F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, "reset").otherwise("chunk").alias("op")] if resets else []
    return turns.select("conv_id", "turn", text.alias("text"), *op)


def chat_records(spark, sf_dir) -> DataFrame:
    """Planted turns as JSON in four shapes."""
    turns = planted_turns(spark, sf_dir)
    role, text = F.col("role"), F.col("text")
    flat = F.to_json(F.struct(role, text.alias("content")))
    parts = F.to_json(F.struct(F.struct(role, F.array(F.struct(F.lit("text").alias("type"), text)).alias("content")).alias("message")))
    deep = F.to_json(F.struct(role, F.struct(F.array(F.struct(F.struct(text.alias("output_text")).alias("text"))).alias("content")).alias("content")))
    strings = F.to_json(F.struct(role, F.array(text, F.lit("")).alias("content")))
    # One in three of these is nested fifty levels deep.
    far = F.concat(F.lit('{"role":'), F.to_json(F.array(role)).substr(F.lit(2), F.length(F.to_json(F.array(role))) - 2), F.lit(',"content":'),
                   F.lit('{"content":[' * 25), F.to_json(F.array(text)), F.lit("]}" * 25), F.lit("}"))
    deep = F.when(F.col("conv_id") % 3 == 0, far).otherwise(deep)
    shape = (F.col("conv_id") + F.col("turn")) % 4
    return turns.select("conv_id", "turn", F.when(shape == 0, flat).when(shape == 1, parts)
                        .when(shape == 2, deep).otherwise(strings).alias("record"))


def sarif_documents(spark, sf_dir) -> DataFrame:
    """Orders as SARIF reports: one document per order, one result per line item."""
    # The columns are shuffled, not the texts made from them. An order has a handful of line items, so the groups are small.
    names = ("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_suppkey")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(*names)).alias("_items"))

    def numbered(item: Column) -> Column:
        part = item.l_partkey
        rule_id = F.concat(F.lit("RULE"), (part % 40).cast("string"))
        level = F.get(literal_array(["error", "warning", "note", "none", "other"]), (part % 5).cast("int"))
        by_score = F.when(part % 3 == 0, F.create_map(F.lit("security-severity"), (item.l_quantity / 5).cast("decimal(6,1)").cast("string")))
        result = F.struct(
            rule_id.alias("ruleId"), level.alias("level"),
            F.struct(F.concat(F.lit("ships by "), item.l_returnflag).alias("text")).alias("message"),
            by_score.alias("properties"),
            F.when(part % 4 == 0, F.create_map(F.lit("primary"), F.concat(F.lit("fp-"), part.cast("string")))).alias("partialFingerprints"),
            F.when(part % 7 != 0, F.array(F.struct(F.struct(
                F.struct(F.concat(F.lit("src/"), part.cast("string"), F.lit(".py")).alias("uri")).alias("artifactLocation"),
                F.struct(item.l_suppkey.cast("int").alias("startLine")).alias("region")).alias("physicalLocation")))).alias("locations"))
        return F.struct(item.l_linenumber.alias("l_linenumber"), F.to_json(result).alias("result"))

    grouped = grouped.select("l_orderkey", F.array_sort(F.transform("_items", numbered)).alias("_r"))
    rules = F.array(*[F.struct(
        F.lit(f"RULE{i}").alias("id"), F.struct(F.lit(f"Rule number {i}").alias("text")).alias("shortDescription"),
        F.create_map(F.lit("severity"), F.lit(values.SEVERITIES[i % 6])).alias("properties")) for i in range(0, 40, 2)])
    tool = F.to_json(F.struct(F.struct(rules.alias("rules")).alias("driver")))
    document = F.concat(
        F.lit('{"version":"2.1.0","runs":[{"tool":'), tool, F.lit(',"results":['),
        F.array_join(F.transform("_r", lambda r: r.result), ","), F.lit("]}]}"))
    return grouped.select("l_orderkey", document.alias("document"))


def baseline_snapshot(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))


def current_snapshot(spark, sf_dir) -> DataFrame:
    """The documents later on: those labelled toxic are gone, those of low quality
    were edited, and the benchmark items are new."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = docs.filter(F.coalesce("toxic", F.lit(0)) == 0)
    text = F.when(F.coalesce("quality", F.lit(1)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return (kept.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(text, 256).alias("sha256"))
            .unionByName(table(spark, sf_dir, "benchmark").select(
                F.concat(F.lit("items/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))))


def recovery_sources(spark, sf_dir) -> DataFrame:
    """Candidate copies: an archive of the non-English documents, an older archive
    whose short ones are spoilt, and a history with everything but French."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))

    def copies(rows, rank, source, ts, text):
        return rows.select(path.alias("path"), F.sha2(text, 256).alias("sha256"), F.lit(rank).alias("source_rank"),
                           F.lit(source).alias("source"), F.lit(ts).cast("timestamp").alias("ts"))

    spoilt = F.when(F.col("n_chars") < 500, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return (copies(docs.filter("lang <> 'en'"), 0, "archive-2", "2024-02-02 00:00:00", F.col("text"))
            .unionByName(copies(docs, 0, "archive-1", "2024-02-01 00:00:00", spoilt))
            .unionByName(copies(docs.filter("lang <> 'fr'"), 1, "history", "2024-03-01 00:00:00", F.col("text"))))
