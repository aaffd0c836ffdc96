"""Streaming twin of `operators.chunks`.

Each micro-batch is judged by the batch operators, so a hot stream is split into blocks over tasks and nothing runs row
by row. What is kept from batch to batch is a table of buffers, one row of at most ``lookback`` characters per
stream: a version per micro-batch holds the streams that it changed, every few versions one holds all. A batch that is run again
reads the versions before it and replaces its own output and version. Chunks of a stream must arrive in order
across micro-batches; inside one they are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.chunks import add_lookback, judge_chunks
from ..tables import contexts as values

WHOLE_EVERY = 16


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Batch id and whether the version holds all streams, in order."""
    names = [name.split("-") for name in storage.children(spark, path)]
    return sorted((int(batch), kind == "whole") for kind, batch in names)


def read_buffers(spark: SparkSession, path: str, *, stream: str, before_batch: int, idle_minutes: int | None = None) -> DataFrame | None:
    """``(stream, tail, seen)``: each stream's newest buffer before a batch; NULL if there is none yet. Streams that
    were idle for longer are left out."""
    found = [v for v in _versions(spark, path) if v[0] < before_batch]
    start = max((i for i, (_, whole) in enumerate(found) if whole), default=0)
    table = None
    for batch, whole in found[start:]:
        part = spark.read.parquet(f"{path}/{'whole' if whole else 'part'}-{batch}").withColumn("_batch", F.lit(batch))
        table = part if table is None else table.unionByName(part)
    if table is None:
        return None
    newest = table.groupBy(stream).agg(F.max_by(F.struct("tail", "seen"), "_batch").alias("_row")).select(stream, "_row.*")
    if idle_minutes:
        newest = newest.filter(F.col("seen") >= F.current_timestamp() - F.make_dt_interval(mins=F.lit(idle_minutes)))
    return newest


def chunk_stream(chunks: DataFrame, sink_path: str, checkpoint: str, *, stream: str, seq: str,
                 text_col: str = "text", op_col: str | None = None, lookback: int = values.STREAM_LOOKBACK, block: int = 4096,
                 trigger: dict | None = None, idle_minutes: int | None = None, buffers_path: str | None = None, **options):
    """Starts the query; each micro-batch writes its verdicts to ``sink_path/batch=<id>``. Buffers lie in
    ``buffers_path`` (beside the checkpoint unless given); ``op_col``, or a column ``op``, marks resets."""
    buffers = buffers_path or f"{checkpoint.rstrip('/')}-buffers"
    op_col = op_col or ("op" if "op" in chunks.columns else None)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = read_buffers(spark, buffers, stream=stream, before_batch=batch_id, idle_minutes=idle_minutes)
        # Written once: verdicts and buffers are both read off it.
        looked_path = storage.scratch(spark)
        looked = add_lookback(batch, stream=stream, seq=seq, text_col=text_col, op_col=op_col, known=known, lookback=lookback, block=block)
        looked.write.parquet(looked_path)
        looked = spark.read.schema(looked.schema).parquet(looked_path)
        judge_chunks(looked, stream=stream, seq=seq, **options).write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")
        ends = looked.filter(F.col("after").isNotNull()).groupBy(stream).agg(F.max_by("after", seq).alias("tail"))
        ends = ends.withColumn("seen", F.current_timestamp())
        whole = known is not None and batch_id % WHOLE_EVERY == 0
        if whole:
            ends = ends.unionByName(known.join(ends, stream, "left_anti"))
        ends.write.mode("overwrite").parquet(f"{buffers}/{'whole' if whole else 'part'}-{batch_id}")
        storage.delete(spark, looked_path)
        # What lies before the last but one whole version is read by no batch that may still run again.
        wholes = [b for b, complete in _versions(spark, buffers) if complete and b < batch_id]
        for old, complete in _versions(spark, buffers):
            if wholes and old < wholes[-1]:
                storage.delete(spark, f"{buffers}/{'whole' if complete else 'part'}-{old}")

    return (chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
