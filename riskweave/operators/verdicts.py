"""Verdicts: one per text, from an ordered cascade of stages.

The cascade is bounty spam, blocked rules, hosts, decoded payloads, suspicious
rules; the first stage that answers decides. It is one chain of projections, so
a corpus is classified in a single scan without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import emit, let
from ..functions.dialect import any_of, python_to_java, with_prefix_group
from ..functions.hosts import extract_host_array, host_signals, may_hold_url
from ..functions.linear import linear_form
from ..functions.lines import split_lines
from ..functions.normalize import canonicalize_shell, fold, normalize_corpus
from ..functions.payload import decoded_payload
from ..tables import contexts as values
from ..tables import host_signals as host_values
from .matching import GuardedRules, guarded_rules, literal_array, span
from .rules import RuleBook, default_rules

VERDICT_TYPE = "struct<code:int,action:string,reasons:array<string>,matched:string>"
NO_HITS = "cast(array() as array<struct<rule_id:string,matched:string,why:string>>)"
_MARKERS = python_to_java(any_of(values.SAFE_CONTEXT_MARKERS))
_HTTPS_URL = python_to_java(r"""https://[^\s'\"|;]+""")
_ANY_URL = python_to_java(r"""https?://[^\s'\"|;]+""")


@dataclass(frozen=True)
class Blocklist:
    """Lower-case hosts and whether their digest was the expected one."""

    hosts: frozenset[str] = frozenset()
    trusted: bool = True


def host_digest(hosts) -> str:
    """Digest of the sorted distinct lower-case hosts as a compact JSON list."""
    listed = sorted({host.lower() for host in hosts})
    return hashlib.sha256(json.dumps(listed, separators=(",", ":")).encode()).hexdigest()


def pinned_blocklist(hosts, sha256: str) -> Blocklist:
    """A list that becomes a hash set inside the plan; a list in a table is better joined, see
    `operators.hosts.classify_with_blocklist`."""
    hosts = frozenset(host.lower() for host in hosts)
    return Blocklist(hosts, bool(sha256) and host_digest(hosts) == sha256)


def seed_blocklist() -> Blocklist:
    return pinned_blocklist(host_values.SEED_HOSTS, host_values.SEED_SHA256)


def safe_markers() -> str:
    """The pattern of what makes the clause around a match safe."""
    return _MARKERS


def local_clause(text: Column, before: Column, matched: Column) -> Column:
    """The clause around a match: from the nearest of ``. ! ? \\n`` on its left to
    the nearest on its right. ``before`` is the text left of the match."""
    left = F.substring_index(F.translate(before, "!?\n", "..."), ".", -1)
    after = F.substring(text, F.length(before) + F.length(matched) + 1, F.length(text))
    right = F.substring_index(F.translate(after, "!?\n", "..."), ".", 1)
    return F.concat(
        F.right(before, F.length(left)), matched, F.left(after, F.length(right)),
    )


def is_safe_installer(text: Column, installers: list[str], *, strict: bool = False) -> Column:
    """True when the text holds exactly one URL and that is a known installer.
    Only https URLs count, unless ``strict`` also counts http ones."""
    known = python_to_java(rf"^(?:{any_of(installers)})\z")

    def one_known(urls):
        return (F.size(urls) == 1) & F.regexp_replace(F.get(urls, F.lit(0)), r"[)\],]+$", "").rlike(known)

    return let(F.regexp_extract_all(text, F.lit(_ANY_URL if strict else _HTTPS_URL), F.lit(0)), one_known)


def _downgrade_kind(rule_id: str) -> tuple[bool, bool]:
    context = any(part in rule_id for part in values.CONTEXT_ID_PARTS)
    installer = rule_id.startswith(values.INSTALLER_ID_PREFIX) or rule_id in values.INSTALLER_IDS
    return context, installer


def judge_hits(text: Column, hits: Column, rule_ids: list[str], java: list[str], *, context_at: list[int],
               installer_at: list[int], context: str, installer: Column) -> Column:
    """Hits as ``array<struct(rule_id, matched, why)>``; ``why`` names a downgrade.

    ``context_at`` and ``installer_at`` list the rules (from 0) each downgrade
    applies to, ``context`` is the regex for the clause around the match.
    """
    ids, plain = literal_array(rule_ids), literal_array(java)
    prefixed = literal_array(with_prefix_group(p) for p in java)

    def cut(i):
        return F.struct((i - 1).alias("at"), span(text, F.get(plain, i - 1)).alias("matched"))

    def judge(hit):
        in_context = let(span(text, F.get(prefixed, hit.at), 1),
                         lambda before: local_clause(text, before, hit.matched).rlike(context))
        return F.struct(
            F.get(ids, hit.at).alias("rule_id"), hit.matched.alias("matched"),
            F.when(hit.at.isin(context_at or [-1]) & in_context, F.lit(values.SAFE_CONTEXT_REASON))
            .when(hit.at.isin(installer_at or [-1]) & installer, F.lit(values.SAFE_INSTALLER_REASON)).alias("why"),
        )
    return F.transform(F.transform(hits, cut), judge)


def _judged(text: Column, hits: Column, rules: RuleBook, *, strict_installer: bool = False, installer: Column | None = None) -> Column:
    ids = [rule_id for rule_id, _ in rules.blocked]
    kinds = [_downgrade_kind(rule_id) for rule_id in ids]
    return judge_hits(
        text, hits, ids, rules.java["blocked"], context=_MARKERS,
        context_at=[i for i, (in_context, _) in enumerate(kinds) if in_context],
        installer_at=[i for i, (_, installer) in enumerate(kinds) if installer],
        installer=_installer(text, rules, strict_installer) if installer is None else installer)


def _installer(text: Column, rules: RuleBook, strict: bool) -> Column:
    return is_safe_installer(text, [p for _, p in rules.safe_installers], strict=strict)


def _add_deciding_hits(df: DataFrame, matcher: GuardedRules, rules: RuleBook, names: tuple[str, str, str], strict_installer: bool) -> DataFrame:
    """Adds ``_safe``, whether the text is a known installer, and ``_hits``, the blocked hits that can decide: those up to
    the first one that no context and no installer can downgrade. Rules behind that one are not tried."""
    kinds = [_downgrade_kind(rule_id) for rule_id, _ in rules.blocked]
    installers = [i for i, (_, installer) in enumerate(kinds) if installer]
    text, folded, found = names
    safe = F.when(matcher.may_hit("blocked", installers, folded, found) & F.contains(folded, F.lit("http")),
                  _installer(F.col(text), rules, strict_installer)).otherwise(F.lit(False))
    df = df.withColumn("_safe", F.coalesce(safe, F.lit(False)))
    final = {i: "NOT _safe" if installer else "true" for i, (context, installer) in enumerate(kinds) if not context}
    df = df.withColumn("_final", matcher.first_of("blocked", final, *names))
    rest = {i: "true" if context else "_safe" for i, (context, installer) in enumerate(kinds) if context or installer}
    return df.withColumn("_hits", matcher.hits_of("blocked", rest, *names, "_final")).drop("_final")


def _unguarded_hits(text: Column, rules: RuleBook) -> Column:
    """Blocked hits of a decoded text. Few texts have one, and it is neither
    normalised nor folded, so every pattern is tried from a list."""
    def hits(patterns):
        listed = literal_array(patterns)
        return F.filter(F.sequence(F.lit(1), F.lit(len(rules.blocked))), lambda i: F.rlike(text, F.get(listed, i - 1)))

    linear = [python_to_java(linear_form(p)) for _, p in rules.blocked]
    return F.when(F.contains(text, F.lit("\n")), hits(rules.java["blocked"])).otherwise(hits(linear))


def verdict(code: int, reasons: Column, matched: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(values.ACTIONS[code]).alias("action"), reasons.alias("reasons"),
        (F.lit(None).cast("string") if matched is None else matched).alias("matched"),
    )


def blocked_verdict(judged: Column) -> Column:
    """First hit without a downgrade, else the last downgraded one, else NULL."""
    hard = F.get(F.filter(judged, lambda h: h.why.isNull()), F.lit(0))
    last = F.element_at(judged, -1)
    return (F.when(F.size(judged) == 0, F.lit(None))
            .when(hard.isNotNull(), verdict(2, F.array(hard.rule_id), hard.matched))
            .otherwise(verdict(1, F.array(last.rule_id, last.why), last.matched)))


def _host_verdict(text: Column, folded: Column, blocklist: Blocklist) -> Column:
    """NULL when no host decides. An untrusted list makes every text reviewable."""
    def per_host(host):
        return host_signals(host, None, host.isin(*sorted(blocklist.hosts)) if blocklist.hosts else F.lit(False))

    hosts = F.when(may_hold_url(folded), F.transform(extract_host_array(text), per_host)).otherwise(
        F.array().cast("array<struct<signals:int,reasons:array<string>,code:int>>"))

    def decide(found):
        found_code = F.coalesce(F.array_max(F.transform(found, lambda h: h.code)), F.lit(0))
        reasons = F.flatten(F.transform(found, lambda h: h.reasons))
        if not blocklist.trusted:
            found_code = F.greatest(found_code, F.lit(1))
            reasons = F.concat(F.array(F.lit(values.TAMPERED_REASON)), reasons)
        return F.when(found_code == 2, verdict(2, reasons)).when(found_code == 1, verdict(1, reasons))

    return let(hosts, decide)


def _decoded_verdict(decoded: Column, judged: Column, chars: int | None = None) -> Column:
    """``chars`` cuts the decoded text that is shown (80 as published)."""
    inner = blocked_verdict(judged)
    return (F.when(decoded == "", F.lit(None))
            .when(F.size(judged) > 0, verdict(
                2, F.array(F.concat(F.get(inner.reasons, F.lit(0)), F.lit(values.DECODED_SUFFIX))), inner.matched))
            .when(decoded.rlike(python_to_java(values.DECODED_SHELL_PATTERN)), verdict(
                2, F.array(F.lit(values.DECODED_SHELL_REASON)), decoded if chars is None else F.left(decoded, F.lit(chars)))))


def add_verdict(df: DataFrame, text_col: str = "text", out_col: str = "verdict", *,
                rules: RuleBook | None = None, blocklist: Blocklist | None = None,
                host_stage: bool = True, max_bytes: int | None = None, strict_installer: bool = False,
                unicode_forms: bool = True, guarded: bool = True, settled_col: str | None = None,
                decoded_chars: int | None = None) -> DataFrame:
    """Adds ``out_col`` with the verdict struct of ``text_col``; keeps all columns.

    ``max_bytes`` makes longer texts dangerous without looking at them.
    ``settled_col`` adds whether a stage before the host stage decided.
    """
    rules = rules or default_rules()
    blocklist = seed_blocklist() if blocklist is None else blocklist
    keep = df.columns
    source = F.col(text_col)
    if max_bytes is not None:
        source = F.when(F.octet_length(source) <= max_bytes, source)
    df = df.withColumn("_in", source)
    df = canonicalize_shell(normalize_corpus(df, "_in", "_norm", unicode_forms=unicode_forms), "_norm")
    text, folded = F.col("_norm"), F.col("_fold")
    df = df.drop("_in").withColumn("_fold", fold(text))

    matcher = guarded_rules(rules, ("bounty_spam", "blocked", "suspicious"), guarded=guarded)
    names = ("_norm", "_fold", "_found")
    df = df.withColumn("_found", matcher.word_tests("_fold"))
    df = df.withColumn("_spam", matcher.first("bounty_spam", [rule_id for rule_id, _ in rules.bounty_spam], *names))
    df = _add_deciding_hits(df, matcher, rules, names, strict_installer)
    no_hits = F.expr(NO_HITS)
    df = df.withColumn("_judged", F.when(
        F.col("_spam").isNull() & (F.size("_hits") > 0),
        _judged(text, F.col("_hits"), rules, installer=F.col("_safe"))).otherwise(no_hits)).drop("_hits", "_safe")
    df = df.withColumn("_early", F.coalesce(
        F.when(F.col("_spam").isNotNull(), verdict(2, F.array(F.concat(F.lit("bounty_spam: "), F.col("_spam"))))),
        blocked_verdict(F.col("_judged")),
    )).drop("_spam", "_judged")
    settled = []
    if settled_col:
        over = F.octet_length(text_col) > max_bytes if max_bytes is not None else F.lit(False)
        df = df.withColumn("_settled", F.col("_early").isNotNull() | F.coalesce(over, F.lit(False)))
        settled = [F.col("_settled").alias(settled_col)]
    if host_stage:
        df = df.withColumn("_early", F.coalesce(
            F.col("_early"), F.when(text != "", _host_verdict(text, folded, blocklist))))

    df = df.withColumn("_decoded", F.when(F.col("_early").isNull(), decoded_payload(text)).otherwise(F.lit("")))
    decoded = F.col("_decoded")
    df = df.withColumn("_dhits", F.when(decoded != "", _unguarded_hits(decoded, rules)))
    df = df.withColumn("_djudged", F.when(
        F.size("_dhits") > 0, _judged(decoded, F.col("_dhits"), rules, strict_installer=strict_installer)
    ).otherwise(no_hits)).drop("_dhits")
    df = df.withColumn("_early", F.coalesce(F.col("_early"), _decoded_verdict(decoded, F.col("_djudged"), decoded_chars)))

    ids = literal_array(rule_id for rule_id, _ in rules.suspicious)
    df = df.withColumn("_susp", F.when(
        F.col("_early").isNull(),
        F.transform(matcher.hits("suspicious", *names), lambda i: F.get(ids, i - 1))))
    result = (F.when(F.col("_early").isNotNull(), F.col("_early"))
              .when(F.size("_susp") > 0, verdict(1, F.col("_susp")))
              .otherwise(verdict(0, F.array().cast("array<string>"))))
    if max_bytes is not None:
        result = F.when(F.octet_length(text_col) > max_bytes,
                        verdict(2, F.array(F.lit(values.TOO_LARGE_REASON)))).otherwise(result)
    return df.select(*keep, result.cast(VERDICT_TYPE).alias(out_col), *settled)


def classify_corpus(df: DataFrame, *, keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """Texts to rows ``(*keys, code, action, reasons, matched)``."""
    df = df.select(*keys, F.col(text_col).alias("_text"))
    return emit(add_verdict(df, "_text", "_verdict", **options), keys, F.col("_verdict"))


def guard_envelope(df: DataFrame, *, keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """Texts to the guard protocol ``(allowed, verdict, code, reasons, matched, warning)``.

    Texts of any length are read; ``max_bytes=MAX_TEXT_BYTES`` sets the published limit."""
    code = F.col("code")
    too_large = F.array_contains("reasons", values.TOO_LARGE_REASON)
    warning = (
        F.when(too_large, "This output was blocked because it exceeds the inspection limit.")
        .when(code == 2, "This output was blocked because it appears to contain dangerous or manipulated "
                         "instructions. Do not paste or execute it.")
        .when(code == 1, "Warning: this output contains suspicious patterns. Please review carefully before "
                         "executing anything.")
        .otherwise("")
    )
    return classify_corpus(df, keys=keys, text_col=text_col, **options).select(
        *keys, (code == 0).alias("allowed"), F.col("action").alias("verdict"), "code", "reasons", "matched",
        warning.alias("warning"))


def scan_lines(df: DataFrame, *, keys: list[str], text_col: str = "text", risky_only: bool = True,
               **options) -> DataFrame:
    """Every line as its own text: ``(*keys, line_no, line, code, action, reasons, matched)``."""
    lines = df.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("_pos", "line"))
    return judge_lines(lines.select(*keys, (F.col("_pos") + 1).alias("line_no"), "line"), keys=keys, risky_only=risky_only, **options)


def judge_lines(lines: DataFrame, *, keys: list[str], risky_only: bool = True, **options) -> DataFrame:
    """`scan_lines` for lines that have been cut already: ``(*keys, line_no, line)``, as `readers.read_history` gives them."""
    judged = emit(add_verdict(lines.select(*keys, "line_no", "line"), "line", "_verdict", **options), [*keys, "line_no", "line"], F.col("_verdict"))
    return judged.filter("code <> 0") if risky_only else judged


def line_summary(scanned: DataFrame, *, keys: list[str]) -> DataFrame:
    """Risky lines and worst code per key, from `scan_lines`."""
    return scanned.groupBy(*keys).agg(
        F.count_if(F.col("code") != 0).alias("risky_lines"), F.max("code").alias("worst_code"),
        F.bool_or(F.col("code") != 0).alias("any_risky"))


def decode_payloads(df: DataFrame, *, keys: list[str], text_col: str = "text",
                    rules: RuleBook | None = None, unicode_forms: bool = True) -> DataFrame:
    """Texts that carry a decodable blob: ``(*keys, decoded, code, action, reasons, matched)``."""
    rules = rules or default_rules()
    df = df.select(*keys, F.col(text_col).alias("_text"))
    df = canonicalize_shell(normalize_corpus(df, "_text", "_norm", unicode_forms=unicode_forms), "_norm")
    df = df.select(*keys, F.explode(F.filter(F.array(decoded_payload(F.col("_norm"))), lambda d: d != "")).alias("decoded"))
    decoded = F.col("decoded")
    df = df.withColumn("_hits", _unguarded_hits(decoded, rules))
    df = df.withColumn("_judged", _judged(decoded, F.col("_hits"), rules))
    safe = verdict(0, F.array().cast("array<string>"))
    df = df.withColumn("_verdict", F.coalesce(_decoded_verdict(decoded, F.col("_judged")), safe).cast(VERDICT_TYPE))
    return emit(df, [*keys, "decoded"], F.col("_verdict"))
