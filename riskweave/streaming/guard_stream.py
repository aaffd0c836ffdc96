"""Guarding a live stream of messages: verdicts are stateless, so the batch
projections run on it as they are; each micro-batch is split by verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators.verdicts import guard_envelope


def guard_stream(messages: DataFrame, allowed_path: str, refused_path: str, checkpoint: str, *,
                 keys: list[str], text_col: str = "text", trigger: dict | None = None, **options):
    """Starts the query. A micro-batch is judged once and written to both sinks."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, judged_path = batch.sparkSession, storage.scratch(batch.sparkSession)
        judged = guard_envelope(batch, keys=keys, text_col=text_col, **options)
        judged.write.parquet(judged_path)
        judged = spark.read.schema(judged.schema).parquet(judged_path)
        for path, side in ((allowed_path, F.col("allowed")), (refused_path, ~F.col("allowed"))):
            judged.filter(side).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        storage.delete(spark, judged_path)

    return (messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
