"""Scores of verdicts against expected codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(code: Column, expected: Column) -> Column:
    """tp, fp, tn or fn: an expected 1 wants at least 1, an expected 2 wants 2."""
    return (F.when(expected == 0, F.when(code == 0, "tn").otherwise("fp"))
            .when(F.when(expected == 1, code >= 1).otherwise(code == 2), "tp").otherwise("fn"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top.cast("double"), bottom))


def _scores(counted: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    counted = counted.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return counted.withColumn("f1", _ratio(2 * p * r, p + r))


def evaluate(verdicts: DataFrame, labels: DataFrame, *, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Confusion counts and scores of ``code`` against ``expected``; with ``by`` per
    group and over all (NULL group)."""
    both = verdicts.select(*keys, "code").join(labels.select(*keys, "expected", *by), keys)
    return evaluate_labelled(both, by=by)


def evaluate_labelled(both: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """`evaluate` for rows that carry ``code`` and ``expected`` already."""
    both = both.withColumn("_o", outcome(F.col("code"), F.col("expected")))
    grouped = both.rollup(*by) if by else both.groupBy()
    return _scores(grouped.agg(
        F.count("*").alias("samples"),
        *[F.count_if(F.col("_o") == name).alias(name) for name in ("tp", "tn", "fp", "fn")]))


def failures(verdicts: DataFrame, labels: DataFrame, *, keys: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` wrong verdicts in key order, for a report."""
    both = verdicts.select(*keys, "code").join(labels.select(*keys, "expected"), keys)
    wrong = both.filter(outcome(F.col("code"), F.col("expected")).isin("fp", "fn"))
    return wrong.orderBy(*keys).limit(n)


def recall_by_family(verdicts: DataFrame, cases: DataFrame, *, keys: list[str], family: str = "family") -> DataFrame:
    """Per attack family: cases, cases caught, and the share; for benign families
    (``should_block`` false) a case is right when it is not blocked."""
    both = verdicts.select(*keys, F.col("verdict")).join(cases.select(*keys, family, "should_block"), keys)
    right = (F.col("verdict") == "BLOCK") == F.col("should_block")
    counted = both.groupBy(family, "should_block").agg(F.count("*").alias("cases"), F.count_if(right).alias("right"))
    return counted.withColumn("share", _ratio(F.col("right"), F.col("cases")))
