"""Text normalisation: compatibility forms, escape sequences, invisible
characters, backspaces, white space and shell spellings.

Each step is guarded by a byte test that is cheap for the usual text, so a clean
ASCII text costs a few scans and no regex replacement but the white-space one.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

# Code points that NFKC neither changes nor joins with a neighbour. A text made
# of these alone is already normalised; `tests/test_normalize.py` proves it.
NFKC_STABLE = (
    r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03ce\u0400-\u0482"
    r"\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u200b-\u200f\u2010\u2012-\u2016\u2018-\u2023"
    r"\u202a-\u202e\u2060\u2066-\u2069\u20ac\u3001-\u3029\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fff"
    r"\uac00-\ud7a3\ufeff"
)

CSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
OSC = r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)"
# Classes of non-ASCII characters are tried on non-ASCII characters only: a long
# class tested on every character is the slowest part of a scan.
def _wide(chars: str) -> str:
    return rf"[^\x00-\x7f](?<=[{chars}])"


INVISIBLE = _wide(r"\u200b\u200c\u200d\u200e\u200f\u202a-\u202e\u2060\u2066-\u2069\ufeff")
WIDE_SPACE = _wide(r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
# The look-ahead turns most characters away with one range test.
SPACE_RUN = r"(?=[\x00-\x20])(?:[\t-\r\x1c-\x20]{2,}|[\t-\r\x1c-\x1f])"
# JavaScript's white space differs: no U+001C..U+001F and no U+0085.
JS_WIDE_SPACE = _wide(r"\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
JS_SPACE_RUN = r"(?=[\x00-\x20])(?:[\t-\r ]{2,}|[\t-\r])"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def _wide(_: Column) -> Column:
    return F.col("_wide")


def nfkc(text: Column, wide: Column | None = None) -> Column:
    """NFKC. Spark has no built-in for it, so texts that may change pass through
    an Arrow batch; all others are sent as nulls and taken over unchanged."""
    # The long class is tried on non-ASCII characters only.
    risky = (non_ascii(text) if wide is None else wide) & text.rlike(rf"[^\x00-\x7f](?<![{NFKC_STABLE}])")
    return F.coalesce(_nfkc(F.when(risky, text)), text)


def _resolve_backspaces(text: Column) -> Column:
    """Each backspace removes the character left of it; leading ones vanish."""
    for _ in range(4):
        text = F.regexp_replace(text, r"[^\x08]\x08", "")
    pieces = F.split(text, "\b", -1)
    return F.aggregate(
        F.slice(pieces, 2, F.size(pieces)),
        F.get(pieces, F.lit(0)),
        lambda kept, piece: F.concat(F.left(kept, F.length(kept) - 1), piece),
    )


def _steps(df: DataFrame, column: str, steps) -> DataFrame:
    # Each step reads the text before it once, so the steps stay linear in size when
    # the optimizer merges them, or copies them into a filter on the result.
    text = F.col(column)
    for guard, step in steps:
        text = step(text) if guard is None else let(text, _guarded(guard, step))
    return df.withColumn(column, text)


def _guarded(guard, step):
    return lambda text: F.when(guard(text), step(text)).otherwise(text)


def non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def normalize_corpus(df: DataFrame, text_col: str, out_col: str = "norm", *, unicode_forms: bool = True) -> DataFrame:
    """Adds ``out_col``: the text without the spellings that hide a command."""
    df = df.withColumn(out_col, F.coalesce(F.col(text_col), F.lit("")))
    # No step makes an ASCII text anything else, so this is looked up once.
    df = df.withColumn("_wide", non_ascii(F.col(out_col)))
    if unicode_forms:
        df = df.withColumn(out_col, nfkc(F.col(out_col), F.col("_wide")))
    return _steps(df, out_col, [
        (lambda t: F.contains(t, F.lit("\x1b[")), lambda t: F.regexp_replace(t, CSI, "")),
        (lambda t: F.contains(t, F.lit("\x1b]")), lambda t: F.regexp_replace(t, OSC, "")),
        (_wide, lambda t: F.regexp_replace(t, INVISIBLE, "")),
        (lambda t: F.contains(t, F.lit("\b")), _resolve_backspaces),
        (_wide, lambda t: F.regexp_replace(t, WIDE_SPACE, " ")),
        (None, lambda t: F.trim(F.regexp_replace(t, SPACE_RUN, " "))),
    ]).drop("_wide")


def normalize_pages(df: DataFrame, text_col: str, out_col: str = "norm") -> DataFrame:
    """The page profile's normalisation: no escape or backspace handling."""
    df = df.withColumn(out_col, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_wide", non_ascii(F.col(out_col)))
    df = df.withColumn(out_col, nfkc(F.col(out_col), F.col("_wide")))
    return _steps(df, out_col, [
        (_wide, lambda t: F.regexp_replace(t, INVISIBLE, "")),
        (_wide, lambda t: F.regexp_replace(t, JS_WIDE_SPACE, " ")),
        (None, lambda t: F.trim(F.regexp_replace(t, JS_SPACE_RUN, " "))),
    ]).drop("_wide")


_FLAGS = "(?idU)"
_SHELL = r"(?:ba|z|da)?sh"


def canonicalize_shell(df: DataFrame, column: str) -> DataFrame:
    """Rewrites equivalent shell spellings in a normalised text to one form."""
    def replace(pattern, by):
        return lambda t: F.regexp_replace(t, pattern, by)

    has_backslash = lambda t: F.contains(t, F.lit("\\"))
    has_slash = lambda t: F.contains(t, F.lit("/"))
    has_pipe = lambda t: F.contains(t, F.lit("|"))
    has_option = lambda t: F.contains(t, F.lit(" -")) & t.rlike(r"(?i)rm -")

    def merge_rm(t: Column) -> Column:
        t = F.regexp_replace(t, _FLAGS + r"\brm\s+--recursive\b", "rm -r")
        t = F.regexp_replace(t, _FLAGS + r"\brm\s+(-[^\s]+)\s+--force\b", r"rm $1 -f")
        # Runs of one flag keep it, any other run of two or more groups is -rf.
        t = F.regexp_replace(t, _FLAGS + r"\brm\s+(?:-r+\s+){2,}(?!-[rf]+\s)", "rm -r ")
        t = F.regexp_replace(t, _FLAGS + r"\brm\s+(?:-f+\s+){2,}(?!-[rf]+\s)", "rm -f ")
        return F.regexp_replace(t, _FLAGS + r"\brm\s+(?:-[rf]+\s+){2,}", "rm -rf ")

    return _steps(df, column, [
        (has_backslash, replace(r"\\(?=[A-Za-z0-9_./-])", "")),
        (has_slash, replace(_FLAGS + rf"(?<![\w/])/(?:usr/)?bin/({_SHELL})\b", "$1")),
        (has_pipe, replace(_FLAGS + rf"\|\s*command\s+(?={_SHELL}\b)", "| ")),
        (has_option, merge_rm),
    ])


def fold(text: Column) -> Column:
    """Lower case with the few letters that match i and s regardless of case."""
    low = F.lower(text)
    odd = F.lit(False)
    for letter in "\u0130\u0131\u017f\u0307":
        odd = odd | F.contains(text, F.lit(letter))
    return F.when(non_ascii(text) & odd, F.translate(low, "\u0131\u017f\u0307", "is")).otherwise(low)
