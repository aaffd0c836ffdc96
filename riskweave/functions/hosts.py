"""URLs, hosts and host signals of a text, as in-row array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import host_signals as values
from .common import let
from .dialect import python_to_java

_URL = python_to_java(values.URL_PATTERN)
_HOST = python_to_java(values.HOST_PATTERN)
_IP = python_to_java(values.IP_LITERAL_PATTERN, ignore_case=False)
_PUNYCODE = python_to_java(values.PUNYCODE_PATTERN)


def may_hold_url(folded: Column) -> Column:
    return F.contains(folded, F.lit("http")) | F.contains(folded, F.lit("www."))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+\z", "")


def extract_host_array(text: Column) -> Column:
    """Hosts of a text in order of appearance, one per URL."""
    return F.transform(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), host_of)


def _has_suffix(host: Column, suffixes) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | host.endswith(suffix)
    return test


def host_signals(host: Column, raw_host: Column | None, blocked: Column) -> Column:
    """``struct(signals, reasons, code)`` of one host. A blocklisted host is
    dangerous outright; two signals make it suspicious. Without a ``raw_host`` the
    host was extracted from text in compatibility form already."""
    free = host.isin(list(values.FREE_SUBDOMAIN_SUFFIXES)) | _has_suffix(
        host, ["." + s for s in values.FREE_SUBDOMAIN_SUFFIXES])
    tests = [
        (host.rlike(_IP), 2, "phish_ip_literal_host: ", host),
        (host.rlike(_PUNYCODE), 2, "phish_punycode_host: ", host),
        *([(host != raw_host, 2, "phish_homoglyph_host: ", raw_host)] if raw_host is not None else []),
        (_has_suffix(host, values.SUSPECT_TLDS), 1, "phish_suspect_tld: ", host),
        (free, 1, "phish_free_subdomain_host: ", host),
    ]
    fired = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(weight).alias("weight"), F.concat(F.lit(label), shown).alias("reason")))
        for test, weight, label, shown in tests
    ]))
    lookalike = F.lit(False)
    for token in values.LOOKALIKE_TOKENS:
        lookalike = lookalike | F.contains(host, F.lit(token))

    def judged(hits):
        all_hits = F.when(
            (F.size(hits) > 0) & lookalike,
            F.array_append(hits, F.struct(
                F.lit(1).alias("weight"), F.concat(F.lit("phish_lookalike_token: "), host).alias("reason"))),
        ).otherwise(hits)
        total = F.aggregate(all_hits, F.lit(0), lambda acc, h: acc + h.weight)
        return F.struct(
            total.alias("signals"),
            F.transform(all_hits, lambda h: h.reason).alias("reasons"),
            F.when(total >= 2, 1).otherwise(0).alias("code"),
        )

    listed = F.struct(
        F.lit(0).alias("signals"),
        F.array(F.concat(F.lit("phish_seed_blocklist: "), host)).alias("reasons"),
        F.lit(2).alias("code"),
    )
    return F.when(blocked, listed).otherwise(let(fired, judged))
