"""Quality rules: a threshold table compiled into one projection.

`measure` adds counts of a text, `judge` compiles a table of thresholds on their ratios into one boolean expression.
Both are chains of projections without user functions, shuffles or joins; every text is judged whole, by itself.

Defined cases: NULL and empty texts have no words, all counts are 0, and they fail. Rows may repeat; each is judged
alike. Other columns, whatever their names, pass through `keep_good` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

WINDOW = 5

# Frequent words of the languages the rules know.
STOP_WORDS = tuple(
    "the be to of and that have with is in it for on was as at by this are or an a not he his from "
    "der die das und ist von zu mit den nicht ein eine auf im für sich dem "
    "le la les de des et est un une dans que qui pour du sur pas au en ne plus "
    "el los las del y una por con no se su para es al lo como".split())


@dataclass(frozen=True)
class Rule:
    """`over / under` must lie within the bounds; a rule with no `under` bounds the count itself."""

    name: str
    over: str
    under: str | None = None
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("enough words", "n_words", least=10),
    Rule("word length", "word_chars", "n_words", least=1.5, most=20.0),
    Rule("symbols", "n_symbols", "word_chars", most=0.05),
    Rule("stop words", "n_stop", "n_words", least=0.04),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.4),
    Rule("repeated windows", "n_repeat_words", "n_words", most=0.2),
)


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def measure(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts; `texts` must have no column of their names."""
    source = F.coalesce(F.col(text), F.lit(""))
    df = _stage(texts, _words=c.spaced_words(F.col(text)),
                _lines=F.filter(F.split(source, "\n"), lambda x: x.rlike(c.SPACED_WORD)))
    df = _stage(df, _windows=c.window_hashes(F.col("_words"), WINDOW))
    found = F.size("_windows") > F.size(F.array_distinct("_windows"))
    df = _stage(df, _sorted=F.when(found, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))))

    def twice(e: Column, k: Column) -> Column:
        before, after = F.get("_sorted", k - 1)["hash"], F.get("_sorted", k + 1)["hash"]
        return F.when(e["hash"].eqNullSafe(before) | e["hash"].eqNullSafe(after), e["at"])

    df = _stage(df, _starts=F.sort_array(F.filter(F.transform("_sorted", twice), lambda x: x.isNotNull())))
    long = "bigint"
    return _stage(
        df,
        n_words=F.size("_words").cast(long),
        word_chars=F.length(F.concat_ws("", "_words")).cast(long),
        n_symbols=F.regexp_count(source, F.lit(r"[#*$%&|<>]")).cast(long),
        n_lines=F.size("_lines").cast(long),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast(long),
        n_repeat_words=F.coalesce(c.covered_words(F.col("_starts"), WINDOW), F.lit(0).cast(long)),
        n_stop=F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast(long),
    ).drop("_words", "_lines", "_windows", "_sorted", "_starts")


def judge(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of rules as one boolean expression over the counts."""
    kept = F.lit(True)
    for rule in rules:
        value = F.col(rule.over)
        if rule.under:
            value = F.when(F.col(rule.under) > 0, value / F.col(rule.under)).otherwise(F.lit(0.0))
        if rule.least is not None:
            kept = kept & (value >= rule.least)
        if rule.most is not None:
            kept = kept & (value <= rule.most)
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of documents that pass, with the columns they came with."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return c.settled(measure(rows, "_text").drop("_text")).where(~base_failed() & judge(rules)).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measure(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & judge()).alias("kept"))


def _sql_rules(rules: tuple[Rule, ...] = RULES) -> str:
    out = []
    for r in rules:
        value = f"(CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under} ELSE 0 END)" if r.under else r.over
        out += [f"{value} >= {r.least}"] if r.least is not None else []
        out += [f"{value} <= {r.most}"] if r.most is not None else []
    return " AND ".join(out)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o] AS k,
               lead(x, 4) OVER o AS last FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
steps AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM rep),
r AS (SELECT doc_id, sum(n)::BIGINT AS n FROM steps GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})))::BIGINT AS n_stop FROM d),
c AS (SELECT m.*, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_sql_rules()} AS kept
FROM c
"""
