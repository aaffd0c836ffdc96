"""Rules as a table: any number of them, applied by an index instead of a plan per rule.

`operators.matching` unrolls a book of some dozen rules into one projection. Rules that users keep in a table may be
tens of thousands. Then each rule is indexed by short pieces (grams, see `functions.grams`) of the literals that it
cannot match without; candidates are compared with all necessary literals and then with the rule's pattern. Rules
without a literal are candidates for every text. An index of bounded size is sent to the tasks, which look for its grams
in Arrow batches, so texts are read once and not shuffled. A longer one is joined to the grams of the texts; both
sides of that join are narrow (keys and grams, grams and rule numbers), and texts are joined again only for candidates.
The keys must tell texts apart.

Which finding decides is a grouped minimum or maximum of the rule order, as in the cascade: the first spam rule, the
first blocked one without a downgrade or else the last downgraded one, then all suspicious ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams as pieces
from ..functions.dialect import literal_groups, python_to_java, with_prefix_group
from ..functions.linear import linear_form
from ..functions.normalize import canonicalize_shell, fold, normalize_corpus
from ..storage import materialise
from ..tables import contexts as values
from .matching import _rank
from .verdicts import VERDICT_TYPE, is_safe_installer, local_clause, safe_markers, verdict

#: An index up to this many grams goes to the tasks, after it was counted; a longer one is left to Spark's choice of joins.
BROADCAST_GRAMS = 500_000
INDEX = ("section string, ord int, rule_id string, java string, prefixed string, test string, needs array<array<string>>, "
         "grams array<bigint>, problem string")


def _indexed(pattern: str | None) -> tuple:
    try:
        if pattern is None or not pattern.strip():
            raise re.error("empty pattern")
        re.compile(pattern, re.IGNORECASE)
        groups = sorted(set(literal_groups(pattern)), key=_rank)
        grams = pieces.grams_of_pattern(pattern)
    except (re.error, RecursionError, OverflowError) as error:
        return None, None, None, [], [], str(error)
    java = python_to_java(pattern)
    return java, with_prefix_group(java), python_to_java(linear_form(pattern)), [list(g) for g in groups], grams, None


def _index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = pd.DataFrame([_indexed(p) for p in batch["pattern"]], columns=["java", "prefixed", "test", "needs", "grams", "problem"], index=batch.index)
        yield pd.concat([batch[["section", "ord", "rule_id"]], made], axis=1)


def index_rules(rules: DataFrame) -> DataFrame:
    """A rule table ``(section, ord, rule_id, pattern)`` with what it is found by; ``problem`` names what is wrong with a
    rule that cannot be used. Written once, to be used for many tables of texts."""
    return materialise(rules.select("section", F.col("ord").cast("int").alias("ord"), "rule_id", "pattern").mapInPandas(_index_rows, INDEX)
                       .withColumn("ref", F.monotonically_increasing_id()))


def rule_problems(index: DataFrame) -> DataFrame:
    """Unusable rules as rows ``(section, ord, rule_id, problem)``."""
    return index.filter(F.col("problem").isNotNull()).select("section", "ord", "rule_id", "problem")


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _normal(df: DataFrame, keys: list[str], text_col: str, unicode_forms: bool) -> DataFrame:
    df = df.select(*keys, F.col(text_col).alias("_text"))
    df = canonicalize_shell(normalize_corpus(df, "_text", "_norm", unicode_forms=unicode_forms), "_norm")
    return df.select(*keys, "_norm", fold(F.col("_norm")).alias("_fold"))


def _arrow(find) -> Column:
    """A function of an Arrow array of texts as a function of the folded text."""
    def of_texts(texts: pa.Array) -> pa.Array:
        return find(texts)
    return F.arrow_udf(of_texts, "array<bigint>")("_fold")


def _met_in_row(texts: DataFrame, rules: DataFrame, pairs: list) -> DataFrame:
    """Texts with the rules whose grams they hold, without a shuffle."""
    refs = _arrow(pieces.finder([(r["_gram"], r["ref"]) for r in pairs]))
    return texts.withColumn("ref", F.explode(refs)).join(F.broadcast(rules), "ref")


def _met_by_join(texts: DataFrame, rules: DataFrame, grams: DataFrame, keys: list[str]) -> DataFrame:
    """The same for an index of any size."""
    size = F.when(F.col("_gram") == 0, 0).when(F.col("_gram") < 0, 8).otherwise(F.ceil(F.length(F.ltrim(F.hex("_gram"), F.lit("0"))) / 2))
    sizes = sorted(r["n"] for r in grams.select(size.cast("int").alias("n")).distinct().collect())  # 0 to 8
    own = texts.select(*keys, F.explode(_arrow(pieces.all_grams(sizes))).alias("_gram"))
    candidates = own.join(grams, "_gram").select(*keys, "ref").distinct()
    same = [texts[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    named = candidates.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "ref")
    return texts.join(named, same).join(_narrow(rules, BROADCAST_GRAMS // 10), "ref")


def _hits(texts: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Texts with the rules that match them: ``(*keys, _norm, section, ord, rule_id, java, prefixed)``."""
    usable = index.filter(F.col("problem").isNull())
    grams = materialise(usable.select("ref", F.explode("grams").alias("_gram")))
    rules = usable.select("ref", "section", "ord", "rule_id", "java", "prefixed", "test", "needs")
    if grams.count() <= BROADCAST_GRAMS:
        met = _met_in_row(texts, rules, grams.collect())
    else:
        met = _met_by_join(texts, rules, grams, keys)
    needed = F.forall("needs", lambda group: F.exists(group, lambda word: F.contains(F.col("_fold"), word)))
    return met.filter(needed).filter(F.rlike(F.col("_norm"), F.col("test"))).select(*keys, "_norm", "section", "ord", "rule_id", "java", "prefixed")


def _cut(hits: DataFrame) -> DataFrame:
    """Adds where the first match is."""
    before = F.call_function("regexp_extract", F.col("_norm"), F.col("prefixed"), F.lit(1))
    matched = F.call_function("regexp_extract", F.col("_norm"), F.col("java"), F.lit(0))
    return hits.withColumns({"start": F.length(before), "matched": matched}).drop("java", "prefixed")


def match_rule_table(df: DataFrame, index: DataFrame, *, keys: list[str], text_col: str = "text", unicode_forms: bool = True) -> DataFrame:
    """All matches of the rules of `index_rules`, as `matching.match_rules` gives them for a book: rows
    ``(*keys, section, ord, rule_id, start, matched)``."""
    return _cut(_hits(_normal(df, keys, text_col, unicode_forms), index, keys)).select(*keys, "section", "ord", "rule_id", "start", "matched")


def _any(column: Column, parts, test) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | test(column, part)
    return out


def classify_by_table(df: DataFrame, index: DataFrame, *, keys: list[str], text_col: str = "text", installers: list[str] = (),
                      unicode_forms: bool = True) -> DataFrame:
    """Verdicts ``(*keys, code, action, reasons, matched)`` by the rules of a table alone, without the stages for hosts and
    payloads. Rules are downgraded by their ids, as those of a book; ``installers`` are the patterns of known installers."""
    texts = _normal(df, keys, text_col, unicode_forms)
    found = _cut(_hits(texts, index, keys))
    clause = local_clause(F.col("_norm"), F.left("_norm", F.col("start")), F.col("matched"))
    in_context = _any(F.col("rule_id"), values.CONTEXT_ID_PARTS, lambda c, part: F.contains(c, F.lit(part))) & clause.rlike(safe_markers())
    of_installer = F.col("rule_id").startswith(values.INSTALLER_ID_PREFIX) | F.col("rule_id").isin(*values.INSTALLER_IDS)
    excused = of_installer & is_safe_installer(F.col("_norm"), list(installers)) if installers else F.lit(False)
    why = F.when(in_context, values.SAFE_CONTEXT_REASON).when(excused, values.SAFE_INSTALLER_REASON)
    found = found.withColumn("_why", F.when(F.col("section") == "blocked", why)).drop("_norm")
    spam, blocked, suspicious = (F.col("section") == s for s in ("bounty_spam", "blocked", "suspicious"))
    hard, row = blocked & F.col("_why").isNull(), F.struct("rule_id", "matched", "_why")
    decided = found.groupBy(*keys).agg(
        F.min_by(F.when(spam, F.col("rule_id")), F.when(spam, F.col("ord"))).alias("_spam"),
        F.min_by(F.when(hard, row), F.when(hard, F.col("ord"))).alias("_hard"),
        F.max_by(F.when(blocked, row), F.when(blocked, F.col("ord"))).alias("_last"),
        F.transform(F.array_sort(F.collect_list(F.when(suspicious, F.struct("ord", "rule_id")))), lambda r: r.rule_id).alias("_susp"))
    named = decided.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_spam", "_hard", "_last", "_susp")
    joined = texts.select(*keys).join(named, [texts[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    hard, last = F.col("_hard"), F.col("_last")
    result = (F.when(F.col("_spam").isNotNull(), verdict(2, F.array(F.concat(F.lit("bounty_spam: "), F.col("_spam")))))
              .when(hard.isNotNull(), verdict(2, F.array(hard.rule_id), hard.matched))
              .when(last.isNotNull(), verdict(1, F.array(last.rule_id, last._why), last.matched))
              .when(F.size("_susp") > 0, verdict(1, F.col("_susp")))
              .otherwise(verdict(0, F.array().cast("array<string>"))))
    return joined.select(*keys, result.cast(VERDICT_TYPE).alias("_v")).select(*keys, "_v.*")
