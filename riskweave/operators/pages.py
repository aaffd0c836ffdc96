"""Web pages: the browser rule profile and its agreement with the shell profile.

The page profile has no spam, host or decoding stage, and a suspicious rule
outranks a downgraded blocked one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import emit, let
from ..functions.dialect import any_of, js_to_java
from ..functions.normalize import fold, normalize_pages
from ..tables import contexts as values
from ..tables import page_rules
from .matching import GuardedRules, literal_array
from .verdicts import NO_HITS, VERDICT_TYPE, blocked_verdict, judge_hits, verdict

_HTTPS_URL = js_to_java(r"""https://[^\s'"|;]+""")


@dataclass(frozen=True)
class PageProfile:
    """The rules of the page profile, replaceable as a whole or in part: (id, pattern) in order, known installers, the clause that
    makes a hit of ``context_id`` safe, and the beginning of the ids that a known installer excuses."""

    blocked: tuple = page_rules.PAGE_BLOCKED
    suspicious: tuple = page_rules.PAGE_SUSPICIOUS
    installers: tuple = page_rules.PAGE_SAFE_INSTALLERS
    safe_context: str = values.PAGE_SAFE_CONTEXT
    context_id: str = values.PAGE_CONTEXT_ID
    installer_prefix: str = values.INSTALLER_ID_PREFIX


def _safe_installer(text, installers):
    known = js_to_java(any_of(installers))

    def one_known(urls):
        return (F.size(urls) == 1) & F.regexp_replace(F.get(urls, F.lit(0)), r"[\])],?$", "").rlike(known)

    return let(F.regexp_extract_all(text, F.lit(_HTTPS_URL), F.lit(0)), one_known)


def classify_pages(df: DataFrame, *, keys: list[str], text_col: str = "html", guarded: bool = True,
                   profile: PageProfile | None = None) -> DataFrame:
    """Pages to rows ``(*keys, code, action, reasons, matched)`` under the page profile."""
    profile = profile or PageProfile()
    ids = [rule_id for rule_id, _ in profile.blocked]
    suspicious_ids = [rule_id for rule_id, _ in profile.suspicious]
    matcher = GuardedRules(
        {"blocked": [p for _, p in profile.blocked], "suspicious": [p for _, p in profile.suspicious]},
        to_java=js_to_java, guarded=guarded)
    names = ("_norm", "_fold", "_found")
    text = F.col("_norm")
    df = normalize_pages(df.select(*keys, F.col(text_col).alias("_text")), "_text", "_norm")
    df = df.withColumn("_fold", fold(text)).withColumn("_found", matcher.word_tests("_fold"))
    df = df.withColumns({"_hits": matcher.hits("blocked", *names), "_susp": matcher.hits("suspicious", *names)})
    judged = judge_hits(
        text, F.col("_hits"), ids, matcher.java["blocked"], context=js_to_java(profile.safe_context),
        installer=_safe_installer(text, profile.installers),
        context_at=[i for i, rule_id in enumerate(ids) if rule_id == profile.context_id],
        installer_at=[i for i, rule_id in enumerate(ids) if rule_id.startswith(profile.installer_prefix)])
    df = df.withColumn("_judged", F.when(F.size("_hits") > 0, judged).otherwise(F.expr(NO_HITS)))
    df = df.withColumn("_blocked", blocked_verdict(F.col("_judged")))
    susp = literal_array(suspicious_ids)
    result = (F.when(F.col("_blocked.code") == 2, F.col("_blocked"))
              .when(F.size("_susp") > 0, verdict(1, F.transform("_susp", lambda i: F.get(susp, i - 1))))
              .when(F.col("_blocked").isNotNull(), F.col("_blocked"))
              .otherwise(verdict(0, F.array().cast("array<string>"))))
    return emit(df, keys, result.cast(VERDICT_TYPE))


def verdict_parity(left: DataFrame, right: DataFrame, *, keys: list[str]) -> DataFrame:
    """Keys on which two sets of verdicts disagree: ``(*keys, left_code, right_code)``."""
    a = left.select(*keys, F.col("code").alias("left_code"))
    b = right.select(*keys, F.col("code").alias("right_code"))
    return a.join(b, keys).filter("left_code <> right_code")
