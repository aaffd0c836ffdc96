"""Line dedup: a line goes if an earlier line, in the whole corpus, is within the edit bound.

Lines are compared by their lower-cased words. Lines under `MIN_WORDS` words are never removed; lines of at least
`NEAR_WORDS` words have a bound of one word put in, left out or exchanged, lines between those the bound 0. Earlier
means: smaller document id (NULL ids first), then smaller text hash, then line number. Whether the earlier line is
kept itself does not matter, so the result is defined without an order of work.

Method: deletion neighbourhoods. A line's variants are its words with one left out, and the line itself. Two lines are
one exchange apart if they agree in a variant and in the place left out, and one insertion apart if a variant of one
is the other. Variants are hashed (128 bits); per variant only the earliest line is looked for, by a partial minimum,
so a variant that many lines share makes one row per line, never pairs. Each line's earliest partner is verified word
by word.

Lines without a possible partner make no variants. Lines of n words have the tags n / 2, rounded down and up; lines
within one word of each other share a tag t, and the first or the last t - 1 words of both agree. Only lines that
share a tag and such an end with another line go on. No pair is lost by this.

Small intermediate tables (counted first) are broadcast, larger ones are joined by shuffle.

Defined cases: NULL texts stay NULL. Empty texts stay. Documents whose lines of words are all removed are left out by
`dedup_lines` (each of their lines stands elsewhere) unless `keep_empty`. Rows that agree in id and text count as one
document and get the same result each. Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

MIN_WORDS = 5
NEAR_WORDS = 10
GONE_LINES = 1_000_000


def _hash(words: Column, *more: Column) -> list[Column]:
    return [F.xxhash64(words, *more).alias("_v"), F.xxhash64(F.lit(7), words, *more).alias("_w")]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))


def _order() -> Column:
    """A line's place as one number: document id (NULL first), 31 bits of the text's hash, line number."""
    return F.expr("cast(cast(coalesce(_id, -9223372036854775807 - 1) as decimal(19,0)) * 4611686018427387904BD as decimal(38,0))"
                  " + cast((_key & 2147483647) * 2147483648 + _no as decimal(19,0))").cast("decimal(38,0)")


def line_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line of at least MIN_WORDS words: its place, its 128-bit words key, and the keys of its ends."""
    lines = _rows(docs, doc_id, text).select("_id", "_key", F.posexplode_outer(F.split("_text", "\n")).alias("_no", "_line"))
    words = c.settled(lines.select("_id", "_key", "_no", c.plain_words(F.col("_line")).alias("_words"))).where(F.size("_words") >= MIN_WORDS)
    n = F.size("_words")

    def ends(tag: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), tag, F.slice("_words", 1, tag - 1)), F.xxhash64(F.lit("last"), tag, F.slice("_words", 1 - tag, tag - 1))]

    low, high = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    keys = F.when(n >= NEAR_WORDS, F.when(low == high, F.array(*ends(low))).otherwise(F.array(*ends(low), *ends(high))))
    return words.select("_id", "_key", "_no", _order().alias("_order"), c.text_key(F.concat_ws(" ", "_words")).alias("_line"), keys.alias("_ends"))


def _candidates(places: DataFrame) -> DataFrame:
    """The first places of the lines that share an end with another line."""
    ends = places.where(F.col("_ends").isNotNull()).select(
        "_id", "_key", "_no", "_order", "_line", F.xxhash64("_line").alias("_short"), F.explode_outer("_ends").alias("_end"))
    shared = c.materialise(ends.groupBy("_end").agg(F.min("_short").alias("_a"), F.max("_short").alias("_b")).where("_a < _b").select("_end"))
    found = ends.join(c.sized(shared), "_end", "left_semi")
    return c.materialise(found.groupBy("_line").agg(F.min("_order").alias("_order"), F.min_by(F.struct("_id", "_key", "_no"), "_order").alias("_at")))


def near_duplicates(lines: DataFrame) -> DataFrame:
    """`_line`s with an earlier line one word apart. `lines`: _line, _order, _words; one row per line."""
    n = F.size("_words")
    lines = lines.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))  # variants are hashed from word hashes
    cut = F.concat(F.slice("_hashes", F.lit(1), F.col("_at") - 1), F.slice("_hashes", F.col("_at") + 1, F.greatest(F.col("_n") - F.col("_at"), F.lit(0))))
    each = c.settled(lines.select("_line", "_order", "_hashes", n.alias("_n"))).select("*", F.explode_outer(F.sequence(F.lit(1), F.col("_n"))).alias("_at"))
    variants = each.select("_line", "_order", "_n", "_at", *_hash(cut))
    by = ["_v", "_w", "_n", "_at"]
    earliest = c.materialise(variants.groupBy(*by).agg(F.min("_order").alias("_best"), F.count("*").alias("_k")).where("_k > 1").drop("_k"))
    whole = c.materialise(lines.select(*_hash(F.col("_hashes")), F.col("_line").alias("_whole"), F.col("_order").alias("_whole_order"), (n + 1).alias("_n")))
    met = variants.join(c.sized(earliest), by, "left").join(c.sized(whole), ["_v", "_w", "_n"], "left").where(
        (F.col("_best") < F.col("_order")) | F.col("_whole").isNotNull())
    later = F.col("_whole_order") < F.col("_order")

    def partner(line: Column, order: Column, at: Column) -> Column:
        return F.struct(line.alias("_line"), order.alias("_best"), at.alias("_at"))

    found = met.select(F.explode_outer(F.array(
        F.when(F.col("_best") < F.col("_order"), partner(F.col("_line"), F.col("_best"), F.lit(0))),
        F.when(F.col("_whole").isNotNull(), partner(F.when(later, F.col("_line")).otherwise(F.col("_whole")), F.least("_whole_order", "_order"), F.col("_at"))),
    )).alias("_found")).select("_found.*").where(F.col("_line").isNotNull())
    best = found.groupBy("_line").agg(F.min(F.struct("_best", "_at")).alias("_partner"))
    mine = lines.select("_line", F.col("_words").alias("_a"))
    theirs = lines.select(F.col("_order").alias("_best"), F.col("_words").alias("_b"))
    pairs = best.select("_line", "_partner._best", F.col("_partner._at").alias("_at")).join(mine, "_line").join(theirs, "_best")
    long = F.when(F.size("_a") > F.size("_b"), F.col("_a")).otherwise(F.col("_b"))
    short = F.when(F.size("_a") > F.size("_b"), F.col("_b")).otherwise(F.col("_a"))
    at = F.greatest(F.col("_at"), F.lit(1))
    rest = F.concat(F.slice(long, F.lit(1), at - 1), F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0))))
    differ = F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x != y), lambda x: x))
    return pairs.where(F.when(F.col("_at") == 0, (F.size("_a") == F.size("_b")) & (differ <= 1)).otherwise(rest == short)).select("_line")


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line to remove: _id, _key, _no."""
    places = c.materialise(line_places(docs, doc_id, text))
    often = places.groupBy("_line").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_line", "_first")
    at = _candidates(places).select("_at.*", "_line", "_order")
    raw = _rows(docs, doc_id, text).select("_id", "_key", F.posexplode_outer(F.split("_text", "\n")).alias("_no", "_raw"))
    wanted = c.sized(at)
    same = raw["_id"].eqNullSafe(wanted["_id"]) & (raw["_key"] == wanted["_key"]) & (raw["_no"] == wanted["_no"])
    # Rows that agree in id and text bring a line twice; one is enough.
    lines = raw.join(wanted, same).select("_line", "_order", c.plain_words(F.col("_raw")).alias("_words")).dropDuplicates(["_line"])
    near = near_duplicates(c.materialise(lines)).withColumn("_near", F.lit(True))
    judged = c.materialise(often.join(near, "_line", "full"))
    return c.materialise(places.select("_line", "_id", "_key", "_no", "_order").join(c.sized(judged), "_line").where(
        F.coalesce(F.col("_near"), F.col("_order") > F.col("_first"))).select("_id", "_key", "_no"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_empty: bool = False, counts: bool = False) -> DataFrame:
    """Documents with duplicate lines removed from `text`; with `counts` also n_lines and n_removed."""
    removed = duplicate_lines(docs, doc_id, text)
    gone = removed.groupBy("_id", "_key").agg(F.sort_array(F.collect_set("_no")).alias("_gone"))
    gone = F.broadcast(gone) if removed.count() <= GONE_LINES else gone
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).cast("bigint").alias("_own"), F.xxhash64(text).alias("_hash"))
    joined = rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    split = joined.withColumn("_lines", F.split(F.col("_row")[text], "\n"))
    left = split.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")))
    kept = F.transform("_left", lambda i: F.get("_lines", i))
    cleaned = left.withColumn("_kept", kept)
    new = F.when(F.col("_gone").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("_row")[text])
    out = c.settled(cleaned.withColumn("_new", new).drop("_left", "_kept"))
    if not keep_empty:
        out = out.where(F.col("_gone").isNull() | F.col("_new").rlike(c.SPACED_WORD))
    out = out.withColumn("_row", F.col("_row").withField(text, F.col("_new")))
    if not counts:
        return out.select("_row.*")
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    return out.select("_row.*", F.when(F.col("_lines").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
                      F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text without duplicate lines, how many lines it had and how many went."""
    return dedup_lines(c.table(spark, sf_dir, "documents").select("doc_id", "text"), keep_empty=True, counts=True)


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, i - 1 AS no, t[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT doc_id, no, x, regexp_extract_all(translate(x, '{c.UPPER}', '{c.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM l),
o AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS k, row_number() OVER (ORDER BY doc_id, no) AS place FROM w WHERE len(w) >= {MIN_WORDS}),
f AS (SELECT k, any_value(w) AS w, min(place) AS first FROM o GROUP BY k),
v AS (SELECT k, first, len(w) AS n, i, array_to_string(list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))), ' ') AS v
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {NEAR_WORDS})),
swap AS (SELECT k FROM v QUALIFY min(first) OVER (PARTITION BY v, n, i) < first),
pair AS (SELECT v.k AS long, v.first AS lf, f.k AS short, f.first AS sf FROM v JOIN f ON v.v = f.k WHERE len(f.w) >= {NEAR_WORDS}),
near AS (SELECT k FROM swap UNION SELECT long FROM pair WHERE sf < lf UNION SELECT short FROM pair WHERE lf < sf),
gone AS (SELECT doc_id, no FROM o JOIN f USING (k) WHERE place > first OR k IN (SELECT k FROM near)),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY no) AS text, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id),
all_lines AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(a.n, 0)::BIGINT AS n_lines, (coalesce(a.n, 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN all_lines a USING (doc_id)
"""
