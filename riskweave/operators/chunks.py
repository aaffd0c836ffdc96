"""Payloads split over chunks of a stream, as a batch query.

A chunk is judged alone, glued to the text before it, and glued with a space;
the worst verdict counts, the first of equals. The text before a chunk is at most
``lookback`` characters; a reset empties it.

"The last characters of two texts on end" is an associative combination, so no list
of earlier chunks is ever gathered. Streams are cut into blocks of consecutive sequence
numbers; inside a block the tails of 1, 2, 4, ... chunks are combined, each from two
of half the length, until the buffer is full for sure. A block's last tail is
one small row; those are combined in the same way. So a stream of any length is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import emit
from ..functions.normalize import normalize_corpus
from ..tables import contexts as values
from .verdicts import add_verdict


def joined_tail(left: Column, right: Column, lookback: int) -> Column:
    """The last ``lookback`` characters of two texts with a space between; NULL is no text."""
    return F.ltrim(F.right(F.concat_ws(" ", left, right), F.lit(lookback)))


def _running_tails(df: DataFrame, column: str, window, lookback: int) -> DataFrame:
    """Turns each row's text into the tail of all texts up to it. A text adds a character and a space at least, so
    ``lookback / 2`` texts always fill a tail."""
    reach = 1
    while reach < lookback // 2 + 1:
        df = df.withColumn("_earlier", F.lag(column, reach).over(window))
        df = df.withColumn(column, F.when(F.col("_earlier").isNull() | (F.length(column) >= lookback), F.col(column))
                           .otherwise(joined_tail(F.col("_earlier"), F.col(column), lookback))).drop("_earlier")
        reach *= 2
    return df


def add_lookback(df: DataFrame, *, stream: str, seq: str, text_col: str, op_col: str | None = None, known: DataFrame | None = None,
                 lookback: int = values.STREAM_LOOKBACK, block: int = 4096, unicode_forms: bool = True) -> DataFrame:
    """``(stream, seq, chunk, before, after)``: normalised chunks with the text before them and the buffer behind them.

    Rows whose ``op_col`` is ``reset`` empty the buffer; they stay, with NULL as their chunk. ``known`` gives
    ``(stream, tail)``, the buffers at the start.
    """
    reset = F.coalesce(F.col(op_col) == "reset", F.lit(False)) if op_col else F.lit(False)
    df = df.select(stream, seq, F.floor(F.col(seq) / block).cast("long").alias("_b"), reset.alias("_reset"), F.col(text_col).alias("_text"))
    df = normalize_corpus(df, "_text", "chunk", unicode_forms=unicode_forms).drop("_text")
    if op_col:  # resets so far tell the stretches of a stream apart
        inside = W.partitionBy(stream, "_b").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
        resets = df.groupBy(stream, "_b").agg(F.count_if("_reset").alias("_n"))
        earlier = W.partitionBy(stream).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        resets = resets.select(stream, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_resets"))
        df = df.withColumn("_e", F.count_if("_reset").over(inside)).join(resets, [stream, "_b"]).withColumn("_e", F.col("_e") + F.col("_resets")).drop("_resets")
    else:
        df = df.withColumn("_e", F.lit(0).cast("long"))
    df = df.withColumn("_said", ~F.col("_reset") & (F.col("chunk") != ""))
    # Chunks without text, and resets, stand in lines of their own: they take no place among the last ones.
    line = W.partitionBy(stream, "_e", "_b", "_said").orderBy(seq)
    df = _running_tails(df.withColumn("_tail", F.when(F.col("_said"), F.right("chunk", F.lit(lookback)))), "_tail", line, lookback)
    df = df.withColumn("_inside", F.lag("_tail", 1).over(line))
    ends = df.filter("_said").groupBy(stream, "_e", "_b").agg(F.max_by("_tail", seq).alias("_end"))
    if known is not None:
        ends = ends.unionByName(known.filter("tail <> ''").select(stream, F.lit(0).cast("long").alias("_e"), F.lit(-(1 << 62)).alias("_b"), F.col("tail").alias("_end")))
    blocks = W.partitionBy(stream, "_e").orderBy("_b")
    ends = _running_tails(ends, "_end", blocks, lookback).select(stream, "_e", "_b", F.lag("_end", 1).over(blocks).alias("_outside"))
    joined = df.join(ends, [stream, "_e", "_b"], "left")
    before = F.when(F.col("_said"), F.coalesce(joined_tail(F.col("_outside"), F.col("_inside"), lookback), F.lit(""))).otherwise("")
    joined = joined.select(stream, seq, F.when(~F.col("_reset"), F.col("chunk")).alias("chunk"), before.alias("before"), "_said", "_reset")
    after = F.when(F.col("_reset"), "").when(F.col("_said"), joined_tail(F.when(F.col("before") != "", F.col("before")), F.col("chunk"), lookback))
    return joined.select(stream, seq, "chunk", "before", after.alias("after"))


def candidate_texts(chunk: Column, before: Column) -> Column:
    """The texts a chunk is judged by, in order of precedence."""
    return F.array(chunk, F.concat(before, chunk), F.concat_ws(" ", before, chunk))


def chunk_verdicts(df: DataFrame, *, stream: str, seq: str, text_col: str = "text", op_col: str | None = None,
                   lookback: int = values.STREAM_LOOKBACK, block: int = 4096, unicode_forms: bool = True,
                   **options) -> DataFrame:
    """``(stream, seq, code, action, reasons, matched)`` per chunk; resets (see `add_lookback`) have no row."""
    with_before = add_lookback(df, stream=stream, seq=seq, text_col=text_col, op_col=op_col, lookback=lookback, block=block,
                               unicode_forms=unicode_forms)
    return judge_chunks(with_before, stream=stream, seq=seq, unicode_forms=unicode_forms, **options)


def judge_chunks(with_before: DataFrame, *, stream: str, seq: str, **options) -> DataFrame:
    """Verdicts of the rows of `add_lookback`."""
    judged = judge_candidates(with_before.filter(F.col("chunk").isNotNull()), keep=[stream, seq], **options)
    # Only verdicts are grouped here; the texts stay where they were judged.
    best = judged.groupBy(stream, seq).agg(F.max_by("_v", F.struct(F.col("_v.code"), -F.col("_at"))).alias("_v"))
    return emit(best, [stream, seq], F.col("_v"))


def judge_candidates(df: DataFrame, *, keep: list[str], unicode_forms: bool = True, **options) -> DataFrame:
    """Rows with ``chunk`` and ``before`` to one row per candidate: ``(*keep, _at, _v)``."""
    texts = F.when(F.col("chunk") == "", F.array(F.lit(""))).when(
        F.col("before") == "", F.array("chunk")).otherwise(candidate_texts(F.col("chunk"), F.col("before")))
    rows = df.select(*keep, F.posexplode(texts).alias("_at", "_candidate"))
    rows = normalize_corpus(rows, "_candidate", "_candidate", unicode_forms=unicode_forms)
    return add_verdict(rows, "_candidate", "_v", unicode_forms=unicode_forms, **options).drop("_candidate")
