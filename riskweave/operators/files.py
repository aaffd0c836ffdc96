"""File trees: line findings, cross-line findings, roll-up per skill, and the gate.

A file is one row. Its lines and its cross-line findings leave one Generate, so
the tree is scanned once and nothing is shuffled before the roll-up. The lines are
cut into stretches at the fence lines; the number of a stretch gives the fence state of all its lines, in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.dialect import any_of, python_to_java
from ..functions.lines import base_name, extension, split_lines, strip
from ..functions.normalize import fold
from ..tables import file_scan as values
from ..tables.line_rules import LINE_RULES
from .matching import GuardedRules, literal_array

_EXEC = python_to_java(values.EXEC_PATTERN)
_LAUNCHCTL = python_to_java(values.LAUNCHCTL_PATTERN)
_DOWNLOAD = python_to_java(values.DOWNLOAD_PATTERN)
_EVERY_DOWNLOAD = python_to_java(values.EVERY_DOWNLOAD_PATTERN)
# Only line starts are consumed, so no run hides the next one.
_RUN = python_to_java(r"(?:^|\n)(?=[^\S\n]*" + values.INTERPRETER_PREFIX.removeprefix(r"(?:^|\n)\s*") + r"(\S+))")
_CHMOD = python_to_java(values.CHMOD_PREFIX + r"(?=(\S+))")
_LAST_TOKEN = python_to_java(r"(\S+)\s*$")
_IDIOMS = (values.SHELL_TRUE_PATTERN, values.EXEC_PATTERN, values.REMOTE_FETCH_PATTERN)
FINDING_FIELDS = ("file", "line", "severity", "risk", "context")


@dataclass(frozen=True)
class LineProfile:
    """What the line scan looks for, replaceable as a whole or in part: rules as (risk, pattern) in order; risks that
    block wherever they stand; (risk, pattern) pairs that make a finding reviewable; contexts where a fetch idiom is allowed; words
    that exclude the exec idiom."""

    rules: tuple = LINE_RULES
    always_block: tuple = values.KEEP_BLOCK_RISKS
    benign: tuple = ((values.PIPE_RISK, values.BENIGN_PIPE_SOURCES), (values.RM_RISK, values.BENIGN_RM_SPECIFIC))
    allowed_fetch: tuple = values.ALLOWED_FETCH_CONTEXTS
    exec_exclusions: tuple = values.EXEC_EXCLUSIONS


def scannable(path: Column) -> Column:
    """Files the scan reads: known extensions, no dot files, no cache folders."""
    return (extension(path).isin(*values.SCANNABLE_EXTENSIONS) & ~base_name(path).startswith(".")
            & ~F.array_contains(F.split(path, "/"), "__pycache__"))


def _word(char: Column) -> Column:
    return char.rlike(r"(?U)\w")


def _ends_of(tokens: Column, sizes: Column) -> Column:
    """Beginnings of the tokens, of the given sizes, that end at a word boundary."""
    def whole(token, n):
        after = F.substring(token, n + 1, F.lit(1))
        return (F.length(token) >= n) & (_word(F.substring(token, n, F.lit(1))) != _word(after))
    return F.flatten(F.transform(tokens, lambda t: F.array_compact(F.transform(sizes, lambda n: F.when(whole(t, n), F.left(t, n))))))


def _cross_line(df: DataFrame) -> DataFrame:
    """Adds ``_cross``: risks that span lines, each once. The names of all downloads are taken in one pass, the targets of
    all runs in another; the two sets are intersected, so no pattern is made from a name."""
    body, folded = F.col("_body"), F.col("_bfold")
    fetches = (F.contains(folded, F.lit("curl")) | F.contains(folded, F.lit("wget"))) & F.contains(folded, F.lit("http"))
    none = F.expr("cast(array() as array<string>)")

    def found(pattern, lowered=True):
        tokens = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        return F.array_distinct(F.transform(tokens, F.lower) if lowered else tokens)

    named = F.size("_names") > 0
    last = F.transform("_lines", lambda line: F.regexp_extract(line, _LAST_TOKEN, 1))
    # Of several downloads on a line the published pattern sees the last one; the lazy one sees all.
    df = df.withColumn("_names", F.when(fetches, F.array_union(found(_DOWNLOAD, False), found(_EVERY_DOWNLOAD, False))).otherwise(none))
    df = df.withColumn("_low", F.transform("_names", F.lower)).withColumn("_sizes", F.array_distinct(F.transform("_low", F.length)))
    df = df.withColumn("_run", F.when(named, F.array_intersect("_low", _ends_of(found(_RUN), F.col("_sizes")))).otherwise(none))
    df = df.withColumn("_chmod", F.when(named, F.array_intersect("_low", _ends_of(found(_CHMOD), F.col("_sizes")))).otherwise(none))
    tails = F.flatten(F.transform(F.array_distinct(last), lambda t: F.transform("_sizes", lambda n: F.right(t, n))))
    by_path = F.transform(F.array_intersect("_names", tails), F.lower)
    df = df.withColumn("_path_run", F.when(F.size("_chmod") > 0, F.array_except(F.array_intersect("_chmod", by_path), "_run")).otherwise(none))
    launch = (F.contains(body, F.lit("LaunchAgents/")) & F.contains(body, F.lit(".plist")) & body.rlike(_LAUNCHCTL))
    return df.withColumn("_cross", F.array_compact(F.array(
        F.when(F.size("_run") > 0, F.lit(values.CROSS_EXECUTE_RISK)), F.when(F.size("_path_run") > 0, F.lit(values.CROSS_CHMOD_RISK)),
        F.when(launch, F.lit(values.CROSS_LAUNCH_RISK))))).drop("_names", "_low", "_sizes", "_run", "_chmod", "_path_run")


def _line_rows(df: DataFrame, keys: list[str], path_col: str, content_col: str, markers: bool) -> DataFrame:
    """Scanned files to rows ``(*keys, _path, _md, _data, line, text, cross, in_code)``."""
    df = df.filter(scannable(F.col(path_col))).select(
        *keys, F.col(path_col).alias("_path"), split_lines(F.col(content_col)).alias("_lines"))
    ext = extension(F.col("_path"))
    df = df.withColumns({"_md": ext == ".md", "_data": ext.isin(*values.DATA_EXTENSIONS)})
    df = df.withColumn("_body", F.array_join("_lines", "\n")).withColumn("_bfold", fold(F.col("_body")))
    df = df.withColumn("_fences", F.when(F.col("_md"), F.array_compact(F.transform(
        "_lines", lambda text, i: F.when(F.contains(text, F.lit("```")) & strip(text).startswith("```"), i + 1)))
    ).otherwise(F.expr("cast(array() as array<int>)")))
    df = _cross_line(df)
    none, no = F.lit(None).cast("string"), F.lit(False)

    def stretch(k):
        """Lines behind the k-th fence line, up to and with the next one."""
        start = F.when(k == 0, 1).otherwise(F.get("_fences", k - 1) + 1)
        end = F.when(k == F.size("_fences"), F.size("_lines")).otherwise(F.get("_fences", k))
        return let(start, lambda at: F.transform(F.slice("_lines", at, end - at + 1), lambda text, i: F.struct(
            (at + i).alias("line"), text.alias("text"), none.alias("cross"), (k % 2 == 1).alias("in_code"))))

    parts = [
        F.flatten(F.transform(F.sequence(F.lit(0), F.size("_fences")), stretch)),
        F.transform("_cross", lambda risk: F.struct(F.lit(0).alias("line"), none.alias("text"), risk.alias("cross"), no.alias("in_code"))),
    ]
    if markers:
        parts.append(F.array(F.struct(F.lit(-1).alias("line"), none.alias("text"), none.alias("cross"), no.alias("in_code"))))
    return df.select(*keys, "_path", "_md", "_data", F.inline(F.concat(*parts)))


def _scan(df: DataFrame, *, keys: list[str], path_col: str, content_col: str, markers: bool, guarded: bool,
          context_chars: int | None = None, profile: LineProfile | None = None) -> DataFrame:
    profile = profile or LineProfile()
    rows = _line_rows(df, keys, path_col, content_col, markers)
    matcher = GuardedRules({"lines": [p for _, p in profile.rules], "idioms": list(_IDIOMS)}, guarded=guarded)
    names = ("_t", "_fold", "_found")
    text = F.col("_t")
    rows = rows.withColumn("_t", strip(F.coalesce("text", F.lit("")))).drop("text")
    skipped = (text == "") | (text.startswith("#") & ~F.col("_md")) | (F.col("_md") & text.startswith("```"))
    rows = rows.withColumn("_t", F.when(skipped, "").otherwise(text))
    rows = rows.withColumn("_fold", fold(text)).withColumn("_found", matcher.word_tests("_fold"))
    rows = rows.withColumn("_rule", matcher.first("lines", [str(i) for i in range(len(profile.rules))], *names).cast("int"))
    rows = rows.withColumn("_idioms", F.when(F.col("_rule").isNull(), matcher.hits("idioms", *names))).drop("_found", "_fold")
    prose = F.col("_md") & ~F.col("in_code")
    rows = rows.withColumn("_risk", F.get(literal_array(risk for risk, _ in profile.rules), F.col("_rule")))
    risk = F.col("_risk")
    benign = F.lit(False)
    for name, pattern in profile.benign:
        benign = benign | ((risk == name) & text.rlike(python_to_java(pattern)))

    shown = text if context_chars is None else F.left(text, F.lit(context_chars))

    def finding(severity, risk, context=None):
        return F.struct(F.lit(severity).alias("severity"), risk.alias("risk"),
                        (shown if context is None else context).alias("context"))

    ruled = (F.when(risk.isin(*profile.always_block), finding("BLOCK", risk))
             .when(prose, finding("REVIEW", F.concat(risk, F.lit(values.PROSE_SUFFIX))))
             .when(benign, finding("REVIEW", F.concat(risk, F.lit(values.BENIGN_SUFFIX))))
             .when(F.col("_data"), finding("REVIEW", risk))
             .otherwise(finding("BLOCK", risk)))
    excluded = F.lit(False)
    for words in profile.exec_exclusions:
        excluded = excluded | F.contains(text, F.lit(words))
    idiom = F.col("_idioms")
    idioms = F.array_compact(F.array(
        F.when(F.array_contains(idiom, 1), finding("REVIEW", F.lit(values.SHELL_TRUE_RISK))),
        F.when(F.array_contains(idiom, 2) & ~excluded,
               finding("REVIEW", F.concat(F.lit(values.EXEC_RISK), F.regexp_extract(text, _EXEC, 1)))),
        F.when(F.array_contains(idiom, 3) & ~text.rlike(python_to_java(any_of(profile.allowed_fetch))),
               finding("REVIEW", F.lit(values.REMOTE_FETCH_RISK))),
    ))
    marker = F.struct(F.lit("FILE").alias("severity"), F.lit(None).cast("string").alias("risk"),
                      F.lit(None).cast("string").alias("context"))
    found = (F.when(F.col("line") == -1, F.array(marker))
             .when(F.col("line") == 0, F.array(finding("BLOCK", F.col("cross"), F.lit(values.CROSS_CONTEXT))))
             .when(risk.isNotNull(), F.array(ruled))
             .when((F.size("_idioms") > 0) & ~prose, idioms))
    # Generate drops the rows without a finding, which are nearly all of them.
    return rows.select(*keys, F.col("_path").alias("path"), base_name(F.col("_path")).alias("file"), "line", F.inline(found))


def scan_files(df: DataFrame, *, keys: list[str] = ("skill",), path_col: str = "path",
               content_col: str = "content", guarded: bool = True, context_chars: int | None = None,
               profile: LineProfile | None = None) -> DataFrame:
    """Findings of a file tree: ``(*keys, path, file, line, severity, risk, context)``. The context is the whole line;
    ``context_chars=CONTEXT_CHARS`` cuts it as published."""
    return _scan(df, keys=list(keys), path_col=path_col, content_col=content_col, markers=False, guarded=guarded,
                 context_chars=context_chars, profile=profile)


def rollup_skills(df: DataFrame, *, key: str = "skill", path_col: str = "path",
                  content_col: str = "content", profile: LineProfile | None = None) -> DataFrame:
    """``(skill, files_scanned, block_count, review_count, verdict)``, clean skills
    included. One pass: each file adds a marker row that is counted as a file."""
    rows = _scan(df, keys=[key], path_col=path_col, content_col=content_col, markers=True, guarded=True, profile=profile)
    counts = rows.groupBy(key).agg(
        F.count_if(F.col("severity") == "FILE").alias("files_scanned"),
        F.count_if(F.col("severity") == "BLOCK").alias("block_count"),
        F.count_if(F.col("severity") == "REVIEW").alias("review_count"))
    return counts.withColumn("verdict", F.when(F.col("block_count") > 0, "BLOCK")
                             .when(F.col("review_count") > 0, "REVIEW").otherwise("CLEAN"))


def sweep_summary(rollup: DataFrame) -> DataFrame:
    """Skills scanned and how many are clean, for review, or blocked."""
    return rollup.agg(
        F.count("*").alias("skills_scanned"),
        *[F.count_if(F.col("verdict") == name).alias(name.lower()) for name in ("CLEAN", "REVIEW", "BLOCK")])


def gate(df: DataFrame, rollup: DataFrame, *, key: str = "skill") -> tuple[DataFrame, DataFrame]:
    """Splits files into admitted and refused ones by the verdict of their skill.

    Only the verdicts move: the roll-up has a row per skill and is joined to the
    files, which stay where they are when it is small and are split by AQE when
    one skill holds most of them.
    """
    judged = df.join(rollup.select(key, "verdict"), key, "left")
    refused = F.coalesce(F.col("verdict") == "BLOCK", F.lit(False))
    return judged.filter(~refused), judged.filter(refused)


def refusal_report(findings: DataFrame, *, key: str = "skill", n: int = 20, context_chars: int | None = None) -> DataFrame:
    """The first ``n`` blocking findings per skill in path and line order, a top-k
    that Spark prunes per partition before the shuffle. ``context_chars`` cuts the contexts (60 as published)."""
    context = F.col("context") if context_chars is None else F.left("context", F.lit(context_chars)).alias("context")
    order = W.partitionBy(key).orderBy("path", F.when(F.col("line") == 0, 2 ** 31 - 1).otherwise(F.col("line")), "risk")
    return (findings.filter("severity = 'BLOCK'")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .select(key, "rank", "path", "file", "line", "risk", context))
