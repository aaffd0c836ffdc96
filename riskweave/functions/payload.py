"""Embedded base64 payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# Fixed value: a quoted run of at least 20 characters that is piped to base64.
BLOB_PATTERN = r"""['"]([A-Za-z0-9+/=\s]{20,})['"]\s*\|\s*base64"""


# Stands between the payloads of a text; no rule's gap reaches over it.
BLOB_BREAK = "\n\x01\n"


def quoted_blobs(text: Column) -> Column:
    """All quoted blobs in order, without white space."""
    return F.transform(F.regexp_extract_all(text, F.lit(BLOB_PATTERN), F.lit(1)), lambda b: F.regexp_replace(b, r"\s+", ""))


def _scan_padding(blob: Column) -> Column:
    """Where a lenient decoder stops in a blob with '=' between the data: two
    signs after two characters of a group or one after three end the data, any
    other sign is skipped."""
    state = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("filled"), F.lit(0).alias("pads"), F.lit(-1).alias("stop"),
    )

    def step(s, c):
        pad = (c == "=") & (s.filled >= 2)
        full = pad & (s.filled + s.pads + 1 >= 4)
        return F.when(s.stop >= 0, s).otherwise(F.struct(
            (s.at + 1).alias("at"),
            F.when(c == "=", s.filled).otherwise((s.filled + 1) % 4).alias("filled"),
            F.when(pad, s.pads + 1).when(c == "=", s.pads).otherwise(F.lit(0)).alias("pads"),
            F.when(full, s.at).otherwise(F.lit(-1)).alias("stop"),
        ))

    return F.aggregate(F.split(blob, ""), state, step)


def _data(blob: Column) -> Column:
    """The data characters a lenient decoder uses; NULL when the padding is wrong."""
    bare = F.regexp_replace(blob, r"=+\z", "")
    plain_len = F.length(bare)
    pads = F.length(blob) - plain_len
    plain = F.when(
        (plain_len % 4 == 0) | ((plain_len % 4 == 2) & (pads >= 2)) | ((plain_len % 4 == 3) & (pads >= 1)), bare)
    mixed = let(_scan_padding(blob), lambda end: F.when(end.stop >= 0, F.left(blob, end.stop)).when(end.filled == 0, blob))
    return F.when(~F.contains(bare, F.lit("=")), plain).otherwise(F.translate(mixed, "=", ""))


def _decoded_text(blob: Column) -> Column:
    def utf8(raw):
        return F.when(F.is_valid_utf8(raw), raw).otherwise(F.translate(F.make_valid_utf8(raw), "\ufffd", ""))

    padded = let(_data(blob), lambda data: F.concat(data, F.substring(F.lit("=="), F.lit(1), (4 - F.length(data) % 4) % 4)))
    return let(F.try_to_binary(padded, F.lit("base64")).cast("string"), utf8)


def decoded_payload(text: Column) -> Column:
    """All blobs decoded to text, without bytes that are not UTF-8, with
    `BLOB_BREAK` between them; '' if none decodes."""
    likely = F.contains(text, F.lit("base64")) & F.contains(text, F.lit("|"))
    decoded = F.transform(quoted_blobs(text), lambda b: F.coalesce(_decoded_text(b), F.lit("")))
    return F.when(likely, F.array_join(F.filter(decoded, lambda d: d != ""), BLOB_BREAK)).otherwise(F.lit(""))
