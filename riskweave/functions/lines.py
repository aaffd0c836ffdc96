"""Lines, paths and truncation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# The line boundaries of Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
# The characters of Python's str.isspace, as a Java class body.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_lines(text: Column) -> Column:
    """Lines without terminators; a final terminator adds no empty line."""
    return let(F.split(text, LINE_BREAK, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    edge = rf"[{SPACE_CLASS}]"
    padded = F.left(text, F.lit(1)).rlike(edge) | F.right(text, F.lit(1)).rlike(edge)
    return F.when(padded, F.regexp_replace(text, rf"^{edge}+|{edge}+\z", "")).otherwise(text)


def extension(path: Column) -> Column:
    """Lower-case suffix of the base name; a name with only a leading dot has none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_path(path: Column) -> Column:
    """True for a relative, canonical path that stays below its root."""
    bad = path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"(^|/)(\.\.?)?(/|$)")
    return ~F.coalesce(bad, F.lit(True))
