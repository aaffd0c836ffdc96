"""Hosts: extraction, signals per host, and verdicts per text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import emit
from ..functions.hosts import extract_host_array, host_signals, may_hold_url
from ..functions.normalize import canonicalize_shell, fold, nfkc, normalize_corpus
from ..tables import contexts as values
from .verdicts import VERDICT_TYPE, Blocklist, add_verdict, seed_blocklist, verdict


def extract_hosts(df: DataFrame, *, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per URL: ``(*keys, pos, raw_host)``, ``pos`` from 0 in text order."""
    text = F.col(text_col)
    # A condition inside the Generate, not a filter: a filter on a computed text
    # would be pushed below the projections that compute it, copying them.
    df = df.select(*keys, text.alias("_text"), fold(text).alias("_fold"))
    found = F.when(may_hold_url(F.col("_fold")), extract_host_array(F.col("_text")))
    return df.select(*keys, F.posexplode(found).alias("pos", "raw_host"))


def score_hosts(hosts: DataFrame, blocklist: Blocklist | DataFrame | None = None) -> DataFrame:
    """Adds ``host, blocked, signals, reasons, code`` to rows with a ``raw_host``.

    A `Blocklist` is a hash set in the plan. A DataFrame with a ``host`` column
    of any size is matched against the distinct hosts of the input first, so a
    host on a third of the rows is one row of that join.
    """
    keep = hosts.columns
    hosts = hosts.withColumn("host", nfkc(F.col("raw_host")))
    if isinstance(blocklist, DataFrame):
        hosts = _mark_listed(hosts, blocklist)
    else:
        listed = sorted((seed_blocklist() if blocklist is None else blocklist).hosts)
        hosts = hosts.withColumn("blocked", F.col("host").isin(listed) if listed else F.lit(False))
    signals = host_signals(F.col("host"), F.col("raw_host"), F.col("blocked"))
    return (hosts.withColumn("_s", signals)
            .select(*keep, "host", "blocked", "_s.signals", "_s.reasons", "_s.code"))


def _mark_listed(hosts: DataFrame, blocklist: DataFrame) -> DataFrame:
    listed = blocklist.select(F.lower("host").alias("host")).distinct()
    # Spark chooses the join by the size of the list, and splits hot hosts.
    marked = listed.withColumn("blocked", F.lit(True))
    return hosts.join(marked, "host", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def host_verdicts(scored: DataFrame, *, keys: list[str], trusted: bool = True) -> DataFrame:
    """Per text: worst code and all reasons in host order, ``(*keys, code, reasons)``.

    Texts without hosts have no row. ``trusted=False`` adds the reason for an
    unsigned blocklist and makes every row at least suspicious.
    """
    per_text = scored.groupBy(*keys).agg(
        F.max("code").alias("code"),
        F.array_sort(F.collect_list(F.struct("pos", "reasons"))).alias("_parts"))
    reasons = F.flatten(F.transform("_parts", lambda p: p.reasons))
    code = F.col("code")
    if not trusted:
        reasons = F.concat(F.array(F.lit(values.TAMPERED_REASON)), reasons)
        code = F.greatest(code, F.lit(1))
    return per_text.select(*keys, code.alias("code"), reasons.alias("reasons"))


def classify_with_blocklist(df: DataFrame, blocklist: DataFrame, *, keys: list[str], text_col: str = "text",
                            trusted: bool = True, unicode_forms: bool = True, **options) -> DataFrame:
    """`classify_corpus` with a blocklist table of any size; ``keys`` must be unique.

    With ``trusted=False``, for a list whose digest is wrong, every text that no earlier stage decides is at least
    suspicious. Texts over ``max_bytes`` are decided by that.

    Texts are judged without hosts where they lie. Only hosts and verdicts, both
    narrow, are joined by key afterwards; texts never move.
    """
    texts = df.select(*keys, F.col(text_col).alias("_text"))
    base = add_verdict(texts, "_text", "_v", host_stage=False, settled_col="_settled", unicode_forms=unicode_forms, **options)
    base = base.withColumn("_any", F.col("_text").rlike(r"\S")).drop("_text")
    norm = canonicalize_shell(normalize_corpus(texts, "_text", "_text", unicode_forms=unicode_forms), "_text")
    found = host_verdicts(score_hosts(extract_hosts(norm, keys=keys, text_col="_text"), blocklist), keys=keys)
    found = found.filter("code > 0").select(*keys, F.col("code").alias("_code"), F.col("reasons").alias("_reasons"))
    by_host = F.when(F.col("_code") == 2, verdict(2, F.col("_reasons"))).otherwise(verdict(1, F.col("_reasons")))
    joined = base.join(found, keys, "left")
    if not trusted:
        reasons = F.concat(F.array(F.lit(values.TAMPERED_REASON)), F.coalesce("_reasons", F.array().cast("array<string>")))
        joined = joined.withColumn("_reasons", F.when(F.col("_any"), reasons)).withColumn(
            "_code", F.when(F.col("_any"), F.greatest(F.coalesce("_code", F.lit(0)), F.lit(1))))
    return emit(joined, keys, F.when(~F.col("_settled") & F.col("_code").isNotNull(), by_host)
                .otherwise(F.col("_v")).cast(VERDICT_TYPE))


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted hosts: how many there are, and the digest of their list as compact JSON."""
    digest, n = hashlib.sha256(b"["), 0
    for batch in batches:
        for host in batch["host"]:
            digest.update((("," if n else "") + json.dumps(host)).encode())
            n += 1
    digest.update(b"]")
    yield pd.DataFrame([(n, digest.hexdigest())], columns=["hosts", "sha256"])


def blocklist_digest(blocklist: DataFrame) -> DataFrame:
    """One row ``(hosts, sha256)``: number and digest of the distinct lower-case hosts in order. A digest is taken in order, so
    the sorted hosts, one short string each, stream through one task; they are never gathered."""
    return normalize_blocklist(blocklist).coalesce(1).mapInPandas(_digest, "hosts long, sha256 string")


def blocklist_status(blocklist: DataFrame, sha256: str) -> DataFrame:
    """One row ``(hosts, ok)``: size and digest check of a host table."""
    return blocklist_digest(blocklist).select("hosts", (F.col("sha256") == F.lit(sha256)).alias("ok"))


def normalize_blocklist(blocklist: DataFrame) -> DataFrame:
    """Lower-case distinct hosts in order."""
    return blocklist.filter(F.col("host").isNotNull()).select(F.lower("host").alias("host")).distinct().orderBy("host")


def hosts_by_volume(scored: DataFrame) -> DataFrame:
    """Hosts with the number of URLs and their signals."""
    return scored.groupBy("host", "signals", "code").agg(F.count("*").alias("urls"))
