"""Snapshots of tables and file sets: digests, drift, recovery and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import safe_path
from ..tables import contexts as values


def snapshot_digest(df: DataFrame, *, path: str, content: str) -> DataFrame:
    """``(path, sha256)`` per row; content may be text or bytes."""
    return df.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"))


def baseline_problems(baseline: DataFrame) -> DataFrame:
    """Rows of a baseline with an unsafe path or an invalid digest."""
    problem = (F.when(~safe_path(F.col("path")), "unsafe baseline path")
               .when(F.coalesce(F.length("sha256"), F.lit(0)) != 64, "invalid baseline digest"))
    return baseline.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def snapshot_diff(baseline: DataFrame, current: DataFrame, *, compare: list[str] = ("sha256",)) -> DataFrame:
    """``(path, state)`` with state ok, changed, missing or unexpected. Several
    columns may make up the identity of a row; NULL equals NULL."""
    old = baseline.select("path", *[F.col(c).alias(f"_old_{c}") for c in compare], F.lit(True).alias("_old"))
    new = current.select("path", *[F.col(c).alias(f"_new_{c}") for c in compare], F.lit(True).alias("_new"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    state = (F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "unexpected")
             .when(same, "ok").otherwise("changed"))
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def state_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("rows"))


def recover_rows(diff: DataFrame, baseline: DataFrame, sources: DataFrame) -> DataFrame:
    """Recovery source per broken row: ``(path, sha256, source, ts)``.

    ``sources`` holds ``(path, sha256, source_rank, source, ts)``; a source helps
    if its digest is the baseline's. The best rank wins, then the newest. Broken
    rows without a source come with NULL source.
    """
    broken = (diff.filter(F.col("state").isin("missing", "changed")).select("path")
              .join(baseline.select("path", "sha256"), "path"))
    best = (sources.join(broken, ["path", "sha256"], "left_semi")
            .groupBy("path", "sha256")
            .agg(F.min_by(F.struct("source", "ts"),
                          F.struct("source_rank", -F.unix_micros("ts"), "source")).alias("_s")))
    return broken.join(best, ["path", "sha256"], "left").select("path", "sha256", "_s.source", "_s.ts")


def keep_latest(manifests: DataFrame, *, dataset: str, ts: str, name: str,
                keep: int = values.KEEP_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """Splits manifests into the newest ``keep`` per dataset and the rest.

    The kept ones are found by a top-k that Spark prunes before the shuffle; every row is then compared with the last
    kept key of its dataset, so a dataset of any size is never in one task whole. A NULL time or name is oldest, NULL
    datasets are one dataset. Of rows that agree with the last kept key in time and name, so many are kept as belong
    to the newest ``keep``; which of them is settled by a hash of their columns.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    order = W.partitionBy(dataset).orderBy(F.col(ts).desc(), F.col(name).desc())
    key = F.struct(F.col(ts).alias("ts"), F.col(name).alias("name"))
    top = manifests.select(F.col(dataset).alias("_of"), ts, name).withColumnRenamed("_of", dataset).withColumn(
        "_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep)
    last = top.groupBy(F.col(dataset).alias("_of")).agg(F.max_by(key, "_rn").alias("_last"), F.collect_list(key).alias("_keys"))
    last = last.select("_of", "_last", F.size(F.filter("_keys", lambda k: k.eqNullSafe(F.col("_last")))).alias("_room"))
    judged = manifests.join(last, F.col(dataset).eqNullSafe(F.col("_of"))).withColumn("_key", key)
    inner = ["_of", "_last", "_room", "_key"]
    newer, older = judged.filter(F.col("_key") > F.col("_last")), judged.filter(F.col("_key") < F.col("_last"))
    same = W.partitionBy(dataset).orderBy(F.xxhash64(*manifests.columns))
    tied = judged.filter(F.col("_key").eqNullSafe(F.col("_last"))).withColumn("_nth", F.row_number().over(same))
    return (newer.drop(*inner).unionByName(tied.filter("_nth <= _room").drop(*inner, "_nth")),
            older.drop(*inner).unionByName(tied.filter("_nth > _room").drop(*inner, "_nth")))


def distinct_targets(requested: DataFrame, *, target: str, pos: str) -> DataFrame:
    """Requested targets without repeats, in order of first request."""
    return requested.groupBy(target).agg(F.min(pos).alias(pos)).orderBy(pos)
