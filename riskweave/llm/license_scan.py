"""License scan by diagonal voting.

Templates are short phrases and notices. Every rolling pair of document words is joined by its hash to the template
positions that hold the same pair (the words are compared on a hit). A hit votes for the diagonal document position
minus template position; votes are counted per diagonal, neighbouring diagonals (words put in or left out) are merged,
and every window of a merged span that is not much longer than the template is verified: enough distinct template
positions in it. A list that repeats a phrase is one merged span with a window for each.

The base phrases are templates too: a phrase stands where one diagonal has a vote of each of its pairs. Templates are
code, a few hundred pairs, so they are broadcast. Only votes are shuffled.

Defined cases: NULL and empty texts have no words and no labels. Repeated rows of a document get the same result each.
Texts of one word have no pair. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

# Base phrases with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Phrases and notices of the method's own, from the public license texts.
OWN = (
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
PAIR = 2
DRIFT = 3
COVERAGE = 0.8
STRETCH = 1.5


def template_pairs(spark: SparkSession, base=BASE, own=OWN) -> DataFrame:
    """Rows of `_template`, `_label`, `_is_base`, `_pairs` (how many), `_tpos`, `_a`, `_b`, `_pair` (hash)."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in own]):
        words = phrase.split()
        rows += [(number, label, is_base, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    schema = "_template int, _label string, _is_base boolean, _pairs int, _tpos int, _a string, _b string"
    return spark.createDataFrame(rows, schema).withColumn("_pair", F.xxhash64(F.array("_a", "_b")))


def votes(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Votes per document, template and diagonal: the template positions seen on it."""
    words = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), c.plain_words(F.col(text)).alias("_words"))
    pairs = words.withColumn("_hashes", c.window_hashes(F.col("_words"), PAIR)).select(
        "_id", "_key", "_words", F.posexplode_outer("_hashes").alias("_at", "_pair"))
    hits = pairs.join(F.broadcast(templates), "_pair").where(
        (F.get("_words", F.col("_at")) == F.col("_a")) & (F.get("_words", F.col("_at") + 1) == F.col("_b")))
    by = ["_id", "_key", "_template", "_label", "_is_base", "_pairs"]
    return hits.groupBy(*by, (F.col("_at") - F.col("_tpos")).alias("_diagonal")).agg(F.collect_set("_tpos").alias("_seen"))


def spans(voted: DataFrame, longest: int) -> DataFrame:
    """Neighbouring diagonals merged: one row per vote, with the coverage of the window that starts there, at most
    STRETCH times the template. `longest`: pairs of the longest template."""
    own = W.partitionBy("_id", "_key", "_template").orderBy("_diagonal")
    gap = F.col("_diagonal") - F.lag("_diagonal").over(own)
    marked = voted.withColumn("_new", F.when(gap <= DRIFT, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(own))
    each = marked.withColumn("_tpos", F.explode("_seen")).withColumn("_from", F.col("_diagonal") + F.col("_tpos"))
    window = W.partitionBy("_id", "_key", "_template", "_span").orderBy("_from").rangeBetween(0, int(STRETCH * longest))
    near = each.withColumn("_near", F.collect_set(F.struct(F.col("_from").alias("at"), F.col("_tpos").alias("tpos"))).over(window)).withColumn(
        "_near", F.filter("_near", lambda x: x["at"] - F.col("_from") <= STRETCH * F.col("_pairs")))
    return near.select("_id", "_key", "_template", "_label", "_from", F.array_max("_near.at").alias("_to"), "_pairs",
                       (F.size(F.array_distinct("_near.tpos")) / F.col("_pairs")).alias("_coverage"))


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, own=OWN) -> DataFrame:
    """One row per document: counts, first and last place, labels, and the best coverage of a verified span."""
    voted = votes(docs, template_pairs(docs.sparkSession, base, own), doc_id, text)
    places = voted.where(F.col("_is_base") & (F.size("_seen") == F.col("_pairs"))).select(
        "_id", "_key", F.col("_diagonal").alias("_place"), F.col("_label").alias("_base_label"), F.col("_label").alias("_any_label"), F.lit(1.0).alias("_score"))
    longest = max((len(phrase.split()) - 1 for phrase, _ in own), default=0)
    verified = spans(voted.where(~F.col("_is_base")), longest).where(F.col("_coverage") >= COVERAGE)
    own_labels = verified.select("_id", "_key", F.lit(None).cast("int").alias("_place"), F.lit(None).cast("string").alias("_base_label"),
                                 F.col("_label").alias("_any_label"), F.col("_coverage").alias("_score"))
    found = places.unionByName(own_labels).groupBy("_id", "_key").agg(
        F.count("_place").alias("n_base"), F.min("_place").cast("bigint").alias("first_word"), F.max("_place").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set("_base_label")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("_any_label")), ",").alias("labels"), F.max("_score").alias("score"))
    mine = docs.select(F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_text"), F.size(c.plain_words(F.col(text))).cast("bigint").alias("n_words"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    return mine.join(found, same, "left").select(
        F.col("_own").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(c.table(spark, sf_dir, "documents").select("doc_id", "text"))


_TEMPLATES = ", ".join(f"({i}, '{label}', {base}, '{phrase}')" for i, (phrase, label, base) in enumerate(
    [(*x, "TRUE") for x in BASE] + [(*x, "FALSE") for x in OWN]))
ORACLE_SQL = rf"""
WITH t AS (SELECT template, label, is_base, string_split(phrase, ' ') AS w FROM (VALUES {_TEMPLATES}) AS x(template, label, is_base, phrase)),
tp AS (SELECT template, label, is_base, len(w) - 1 AS pairs, i - 1 AS tpos, w[i] || ' ' || w[i + 1] AS pair
       FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{c.UPPER}', '{c.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dp AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
hit AS (SELECT DISTINCT doc_id, template, label, is_base, pairs, pos - tpos AS diagonal, tpos FROM dp JOIN tp USING (pair)),
place AS (SELECT doc_id, label, diagonal FROM hit WHERE is_base GROUP BY doc_id, template, label, pairs, diagonal HAVING count(*) = pairs),
lone AS (SELECT DISTINCT doc_id, template, diagonal FROM hit WHERE NOT is_base),
new AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {DRIFT} THEN 0 ELSE 1 END AS n FROM lone
        WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
span AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM new),
vote AS (SELECT doc_id, template, label, pairs, span, tpos, diagonal + tpos AS at FROM hit JOIN span USING (doc_id, template, diagonal)),
stretch AS (SELECT a.doc_id, a.label, a.at, a.tpos, count(DISTINCT b.tpos) / a.pairs AS coverage
            FROM vote AS a JOIN vote AS b ON a.doc_id = b.doc_id AND a.template = b.template AND a.span = b.span AND b.at BETWEEN a.at AND a.at + {STRETCH} * a.pairs
            GROUP BY a.doc_id, a.template, a.label, a.pairs, a.at, a.tpos, a.span),
own AS (SELECT doc_id, label, coverage FROM stretch WHERE coverage >= {COVERAGE}),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS score, diagonal, label AS base FROM place
          UNION ALL SELECT doc_id, label, coverage, NULL, NULL FROM own),
f AS (SELECT doc_id, count(diagonal) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
             string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM every GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)
"""
