"""Shards of even bytes by Karmarkar-Karp differencing of indivisible groups.

Documents of equal text form a group that stays together. Groups are dealt by hash into buckets; in each, differencing
starts with one partial partition per group (its bytes in one slot, the others empty) and repeatedly combines the two
with the largest spread, the largest slot of one with the smallest of the other, until one partial partition is left.
The partial partitions of the buckets are combined in the same way, level by level, until one remains; its slots are
the shards. No task holds more than `per_bucket` partial partitions, whatever the number of groups.

Law `bytes`: shard sizes are near equal. One group larger than the mean of a shard gets a shard of its own.

Defined cases: a NULL text has size 16, no checksum, and is a group by its id; equal NULL ids with NULL texts share one.
Empty texts are equal. Repeated rows are rows: each counts and has its own slot. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SHARDS = 40
ROW_BYTES = 16
PER_BUCKET = 4096


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (rows of slot sums). Returns the sums of the one that is left and, per row and
    slot, the slot of it that takes the row's slot."""
    n, k = sums.shape
    own = np.argsort(-sums, axis=1, kind="stable")
    values = list(np.take_along_axis(sums, own, axis=1))
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(values)]
    heapq.heapify(heap)
    joined = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = values[a] + values[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        values[a] = values[b] = None
        values.append(both)
        joined.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(values) - 1))
    to = np.empty((len(values), k), dtype=np.int32)
    to[-1] = np.arange(k)
    for i in range(len(joined) - 1, -1, -1):
        a, b, order = joined[i]
        to[a, order] = to[n + i]
        to[b, k - 1 - order] = to[n + i]
    slots = np.empty((n, k), dtype=np.int32)
    np.put_along_axis(slots, own, to[:n], axis=1)
    return values[-1], slots


def _level(items: DataFrame, buckets: int, k: int) -> DataFrame:
    """`items`: _item, _sums (a prefix of the slots). Gives rows of _bucket and either _item with _slots or, for what
    is left of the bucket, _sums."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_item", key=lambda s: s.map(bytes))
        sums = np.zeros((len(group), k), dtype=np.int64)
        for i, own in enumerate(group["_sums"]):
            sums[i, : len(own)] = own
        left, slots = difference(sums)
        width = len(group["_sums"].iloc[0])
        rows = pd.DataFrame({"_bucket": key[0], "_item": group["_item"].to_list(), "_slots": list(slots[:, :width]), "_sums": None})
        return pd.concat([rows, pd.DataFrame({"_bucket": [key[0]], "_item": [None], "_slots": [None], "_sums": [left]})], ignore_index=True)

    dealt = items.select(F.pmod(F.xxhash64("_item"), F.lit(buckets)).alias("_bucket"), "_item", "_sums")
    return c.materialise(dealt.groupBy("_bucket").applyInPandas(run, "_bucket long, _item binary, _slots array<int>, _sums array<long>"))


def assign(groups: DataFrame, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """`groups`: _item (binary), _size. Gives _item and shard."""
    items = groups.select("_item", F.array(F.col("_size").cast("bigint")).alias("_sums"))
    count, levels = groups.count(), []
    while True:
        count = max(1, -(-count // per_bucket))
        done = _level(items, count, shards)
        levels.append(done.where(F.col("_item").isNotNull()).select("_item", "_bucket", "_slots"))
        if count == 1:
            break
        items = done.where(F.col("_item").isNull()).select(F.encode(F.col("_bucket").cast("string"), "utf-8").alias("_item"), "_sums")
    out = levels[0].select("_item", F.encode(F.col("_bucket").cast("string"), "utf-8").alias("_in"), F.get("_slots", F.lit(0)).alias("shard"))
    for level in levels[1:]:
        up = level.select(F.col("_item").alias("_in"), F.encode(F.col("_bucket").cast("string"), "utf-8").alias("_up"), "_slots")
        out = out.join(up, "_in").select("_item", F.col("_up").alias("_in"), F.get("_slots", F.col("shard")).alias("shard"))
    return out.select("_item", "shard")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    nothing = F.concat(F.unhex(F.lit("00")), c.text_key(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"), F.coalesce(c.text_key(F.col(text)), nothing).alias("_item"))
    groups = c.materialise(rows.groupBy("_item").agg(F.sum("size").alias("_size")))
    placed = c.materialise(rows.join(c.materialise(assign(groups, shards)), "_item"))
    slotted = c.numbered(placed, ["shard"], ["doc_id", "_item"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
