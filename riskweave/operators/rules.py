"""Rule tables: load, validate, and keep ready for plan construction."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import python_to_java
from ..tables import shell_rules

SECTIONS = ("blocked", "suspicious", "safe_installers", "bounty_spam")
RULE_SCHEMA = "section string, ord int, rule_id string, pattern string, description string"
# A rule table becomes expressions of one plan, so its size is checked.


@dataclass(frozen=True)
class RuleBook:
    """Ordered ``(rule_id, pattern)`` pairs per section; patterns in the Python dialect."""

    blocked: tuple[tuple[str, str], ...]
    suspicious: tuple[tuple[str, str], ...]
    safe_installers: tuple[tuple[str, str], ...]
    bounty_spam: tuple[tuple[str, str], ...]
    descriptions: dict = field(default_factory=dict, compare=False, hash=False)

    def section(self, name: str) -> tuple[tuple[str, str], ...]:
        return getattr(self, name)

    @cached_property
    def java(self) -> dict[str, list[str]]:
        return {name: [python_to_java(p) for _, p in self.section(name)] for name in SECTIONS}

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, i, rule_id, pattern, self.descriptions.get((name, i)))
            for name in SECTIONS
            for i, (rule_id, pattern) in enumerate(self.section(name), 1)
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)


def default_rules() -> RuleBook:
    return RuleBook(
        blocked=shell_rules.BLOCKED, suspicious=shell_rules.SUSPICIOUS,
        safe_installers=shell_rules.SAFE_INSTALLERS, bounty_spam=shell_rules.BOUNTY_SPAM,
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """Problems of a rule table as rows ``(section, ord, problem)``; none means valid."""
    def blank(column):
        return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""

    required = rules.sparkSession.createDataFrame([(s,) for s in SECTIONS], "section string")
    missing = (required.join(rules, "section", "left_anti")
               .select("section", F.lit(None).cast("int").alias("ord"),
                       F.lit("missing or empty section").alias("problem")))
    bad_rows = (rules
                .withColumn("problem", F.when(~F.col("section").isin(*SECTIONS), "unknown section")
                            .when(blank("rule_id") | blank("pattern"), "empty rule field"))
                .filter(F.col("problem").isNotNull()).select("section", "ord", "problem"))
    doubled = (rules.groupBy("section", "ord").count().filter("count > 1")
               .select("section", "ord", F.lit("duplicate position").alias("problem")))
    return missing.unionByName(bad_rows).unionByName(doubled)


def _compile_check(spark: SparkSession, section: str, i: int, pattern: str) -> None:
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error as error:
        raise ValueError(f"invalid regex in {section}[{i}]: {error}") from error
    try:
        spark._jvm.java.util.regex.Pattern.compile(python_to_java(pattern))
    except Exception as error:
        raise ValueError(f"regex not usable on the JVM in {section}[{i}]: {pattern}") from error


def rules_from_df(rules: DataFrame, max_rules: int | None = None) -> RuleBook:
    """Validates a rule table and compiles it; raises ``ValueError`` on any problem.

    A rule book is part of the plan and so comes to the driver; ``max_rules`` refuses longer tables."""
    spark = rules.sparkSession
    rules = rules.select(*[F.col(c.split()[0]) for c in RULE_SCHEMA.split(", ")])
    rows = (rules if max_rules is None else rules.limit(max_rules + 1)).collect()
    if max_rules is not None and len(rows) > max_rules:
        raise ValueError(f"rule table has more than {max_rules} rules")
    bounded = spark.createDataFrame(rows, RULE_SCHEMA)
    problems = validate_rules(bounded).orderBy("section", "ord").take(5)
    if problems:
        raise ValueError("; ".join(f"{p.section}[{p.ord}]: {p.problem}" for p in problems))
    ordered = sorted(rows, key=lambda r: (r.section, r.ord))
    book, notes = {name: [] for name in SECTIONS}, {}
    for row in ordered:
        book[row.section].append((row.rule_id, row.pattern))
        position = len(book[row.section])
        _compile_check(spark, row.section, position, row.pattern)
        if row.description is not None:
            notes[(row.section, position)] = row.description
    return RuleBook(**{name: tuple(pairs) for name, pairs in book.items()}, descriptions=notes)


def _document_rows(document) -> list[tuple]:
    if not isinstance(document, dict):
        raise ValueError("rules document must be a JSON object")
    rows = []
    for section in SECTIONS:
        entries = document.get(section)
        if not isinstance(entries, list) or not entries:
            raise ValueError(f"rules section must be a non-empty list: {section}")
        for i, entry in enumerate(entries, 1):
            keys = set(entry) if isinstance(entry, dict) else set()
            if not {"id", "pattern"} <= keys <= {"id", "pattern", "description"}:
                raise ValueError(f"invalid rule entry: {section}[{i - 1}]")
            if not all(isinstance(value, str) for value in entry.values()):
                raise ValueError(f"rule fields must be text: {section}[{i - 1}]")
            rows.append((section, i, entry["id"], entry["pattern"], entry.get("description")))
    return rows


def load_rules(spark: SparkSession, source=None) -> RuleBook:
    """The built-in rules, a rule DataFrame, or a JSON document at a path."""
    if source is None:
        return default_rules()
    if isinstance(source, RuleBook):
        return source
    if isinstance(source, DataFrame):
        return rules_from_df(source)
    texts = spark.read.text(str(source), wholetext=True).take(2)
    if len(texts) != 1:
        raise ValueError(f"expected one rules document at {source}")
    return rules_from_df(spark.createDataFrame(_document_rows(json.loads(texts[0].value)), RULE_SCHEMA))
