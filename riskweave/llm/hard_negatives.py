"""Hard-negative mining by secondary sort.

Rows are packed into blocks of vectors; anchors (a stated query set) into blocks of at most `ANCHORS`. Every anchor
block meets every row group in one task, which streams the group's blocks through exact integer products and keeps, per
anchor, only what can still matter: first the best `positives` of its label, and in a second pass, when those are known,
the best `negatives` inside each positive's window. What each task kept is packed into (anchor, descending score, kind,
id) keys, dealt by anchor and sorted by repartitionAndSortWithinPartitions; a streaming iterator opens a window at each
positive and emits negatives while they fall into it, holding at most one anchor's open windows. So all pairs are
scored and none is shuffled that another of its group has already beaten.

Memory is bounded by the block sizes; the number of (anchor block, row group) tasks grows with both sides. Keys of one
anchor are at most a few per row group.

Defined cases: rows with a NULL id, label or vector, or a NULL or non-finite component, take no part. Rows that share an
id count once (the least label and vector). Shorter vectors count as ended by zeros; empty ones score 0. Scores
are exact; beyond 64 bits they count as the nearest 64-bit value. Scores that tie are ordered by the smaller id. An
anchor without positives, and a positive below 0 or without negatives in its window, gives no rows; empty tables give
none. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a window in percent of the positive's score
SCALE = 256
ANCHORS, ROWS = 2048, 1024
BLOCKS_PER_GROUP = 512
BLOCK = "_ids binary, _labels binary, _data binary, _kind string, _dim int"
FOUND = "anchor long, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_TOP = (1 << 63) - 1


def usable(rows: DataFrame, id_: str, label: str | Column, vector: str) -> DataFrame:
    """_id, _label, _vector (doubles) of the rows that take part, one per id."""
    own = rows.select(F.col(id_).cast("bigint").alias("_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("_label"),
                      F.col(vector).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = own.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vector").isNotNull() & finite)
    return good.groupBy("_id").agg(F.min(F.struct("_label", "_vector")).alias("_row")).select("_id", "_row._label", "_row._vector")


def _packed(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
    order = np.argsort(ids, kind="stable")
    peak = np.abs(matrix).max(initial=0)
    kind = "<i2" if peak < 1 << 15 else "<f8"
    return {"_ids": ids[order].tobytes(), "_labels": labels[order].tobytes(), "_data": matrix[order].astype(kind).tobytes(), "_kind": kind, "_dim": matrix.shape[1]}


def _matrix(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = batch.column("_vector")
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(np.float64(scale) * vectors.flatten().to_numpy(zero_copy_only=False))
    matrix = np.zeros((batch.num_rows, int(sizes.max(initial=0))))
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
    return batch.column("_id").to_numpy(), batch.column("_label").to_numpy(), matrix


def _pack(most: int, scale: float):
    """Packs a partition's rows into blocks of at most `most`."""
    schema = pa.schema([("_ids", pa.binary()), ("_labels", pa.binary()), ("_data", pa.binary()), ("_kind", pa.string()), ("_dim", pa.int32())])

    def joined(parts: list) -> dict:
        ids, labels, matrices = zip(*parts)
        width = max(m.shape[1] for m in matrices)
        return _packed(np.concatenate(ids), np.concatenate(labels), np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, matrix = _matrix(batch, scale)
            at = 0
            while at < len(ids):
                take = min(most - n, len(ids) - at)
                held.append((ids[at:at + take], labels[at:at + take], matrix[at:at + take]))
                n, at = n + take, at + take
                if n == most:
                    yield pa.RecordBatch.from_pylist([joined(held)], schema)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([joined(held)], schema)

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["_ids"], np.int64), np.frombuffer(row["_labels"], np.int64)
    return ids, labels, np.frombuffer(row["_data"], row["_kind"]).reshape(len(ids), row["_dim"])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floats wide enough for the largest sum, else in Python's integers."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(dim, 1)
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[max(-_TOP, min(_TOP, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))


def _best(row: np.ndarray, score: np.ndarray, id_: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The first n per row number: higher scores, then smaller ids."""
    order = np.lexsort((id_, -score, row))
    row, score, id_ = row[order], score[order], id_[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < n
    return row[keep], score[keep], id_[keep]


def _found(scores: np.ndarray, mask: np.ndarray, ids: np.ndarray, kept: tuple, n: int) -> tuple[np.ndarray, ...]:
    """The first n per anchor of what was kept and the masked scores of a block. Only scores that reach the n-th kept
    one are looked at, so after a few blocks almost none is."""
    row, score, _ = kept
    least = np.full(len(scores), -_TOP - 1)
    if len(row):
        full = np.bincount(row, minlength=len(scores)) == n
        least[full] = score[np.searchsorted(row, np.flatnonzero(full), side="right") - 1]
    at, column = np.nonzero(mask & (scores >= least[:, None]))
    return _best(np.concatenate([row, at]), np.concatenate([score, scores[at, column]]), np.concatenate([kept[2], ids[column]]), n)


def _met(positives: int, negatives: int, low: int, high: int):
    """Streams (anchor block, row group) runs: the anchors first, their positives if known, then the group's blocks.
    Gives (anchor, score, id): candidates for positives, or for negatives where positives are known."""

    def flushed(kept: list, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        found = np.unique(np.concatenate([np.stack([ids[row], score, id_], axis=1) for row, score, id_ in kept]), axis=0)
        yield from map(tuple, found.tolist())

    def run(rows: Iterator) -> Iterator[tuple[int, int, int]]:
        nothing = (np.empty(0, np.int64),) * 3
        ids = labels = vectors = bounds = None
        kept: list = []
        for row in rows:
            if row["_part"] == 0:
                if kept:
                    yield from flushed(kept, ids)
                ids, labels, vectors = _opened(row)
                bounds, kept = None, [nothing]
            elif row["_part"] == 1:
                of, score = np.frombuffer(row["_ids"], np.int64), np.frombuffer(row["_data"], np.int64)
                at = np.searchsorted(ids, of)
                order = np.lexsort((-score, at))
                at, score = at[order], score[order]
                nth = np.arange(len(at)) - np.searchsorted(at, at)
                # The n-th window of each anchor, as bounds of a negative's score; empty where there is no positive.
                bounds = np.zeros((2, positives, len(ids)), np.int64)
                bounds[1] = -1
                bounds[0, nth, at] = [-(-s * low // 100) for s in score.tolist()]
                bounds[1, nth, at] = [s * high // 100 for s in score.tolist()]
                kept = [nothing] * positives
            else:
                own, own_labels, data = _opened(row)
                scores = exact_scores(vectors, data)
                same = labels[:, None] == own_labels[None, :]
                if bounds is None:
                    kept[0] = _found(scores, same & (ids[:, None] != own[None, :]), own, kept[0], positives)
                else:
                    for k in range(positives):
                        inside = ~same & (scores >= bounds[0, k][:, None]) & (scores <= bounds[1, k][:, None])
                        kept[k] = _found(scores, inside, own, kept[k], negatives)
        if kept:
            yield from flushed(kept, ids)

    return run


def _dealt(anchors: DataFrame, known: DataFrame | None, blocks: DataFrame, n_anchors: int, groups: int) -> DataFrame:
    """Every anchor block once per row group, each row block once per anchor block, a task per pair."""
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_rg")
    sides = [anchors.select("*", F.lit(0).alias("_part"), each_group)]
    if known is not None:
        sides.append(known.select("*", F.lit(1).alias("_part"), each_group))
    all_anchors = F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("_ab")
    sides.append(blocks.select(*[x.split()[0] for x in BLOCK.split(", ")], all_anchors, F.lit(2).alias("_part"), F.col("_group").alias("_rg")))
    both = sides[0]
    for side in sides[1:]:
        both = both.unionByName(side)
    return both.repartitionById(n_anchors * groups, F.col("_ab") * groups + F.col("_rg")).sortWithinPartitions("_ab", "_rg", "_part")


def _dealer(key: tuple) -> int:
    return zlib.crc32(b"%d" % key[0])


def _first(n: int):
    """Sorted (anchor, -score, kind, id) keys: the first n ids of each anchor."""
    def run(pairs: Iterator) -> Iterator[tuple[int, int, int]]:
        now, taken = None, 0
        for (anchor, down, _, id_), _ in pairs:
            if anchor != now:
                now, taken = anchor, 0
            if taken < n:
                taken += 1
                yield anchor, -down, id_

    return run


def _windows(negatives: int, low: int, high: int):
    """Sorted keys of positives (kind 0) and negatives (kind 1): a positive opens a window, negatives fall into it."""
    def run(pairs: Iterator) -> Iterator[tuple]:
        now, open_ = None, []
        for (anchor, down, kind, id_), _ in pairs:
            score = -down
            if anchor != now:
                now, open_ = anchor, []
            if kind == 0:
                if score >= 0:
                    open_.append([id_, score, 0])
                continue
            still = []
            for window in open_:
                if low * window[1] > 100 * score:
                    continue  # scores only fall: closed
                if 100 * score <= high * window[1]:
                    window[2] += 1
                    yield anchor, window[0], window[2], id_, window[1], score
                if window[2] < negatives:
                    still.append(window)
            open_ = still

    return run


def mine(rows: DataFrame, anchors: Column, id_: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """Hard negatives of the rows for which `anchors`, a condition on _id, holds. Components become floor(scale * x)."""
    spark = rows.sparkSession
    good = c.materialise(usable(rows, id_, label, vector))
    blocks = c.materialise(good.mapInArrow(_pack(ROWS, scale), BLOCK).withColumn("_block", F.monotonically_increasing_id()))
    chosen = good.where(anchors)
    n_blocks, n_anchors = blocks.count(), chosen.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    n_anchors = -(-n_anchors // ANCHORS)
    # As many row groups as keep the cores busy, and never more than so many blocks in one.
    groups = max(1, min(n_blocks, max(2 * spark.sparkContext.defaultParallelism // n_anchors, -(-n_blocks // BLOCKS_PER_GROUP))))
    blocks = blocks.withColumn("_group", F.pmod(F.shiftrightunsigned("_block", 33) + F.col("_block").bitwiseAND((1 << 33) - 1), F.lit(groups)).cast("int"))
    own_block = F.pmod(F.xxhash64("_id"), F.lit(n_anchors)).cast("int")
    packed = c.materialise(chosen.withColumn("_ab", own_block).repartitionById(n_anchors, F.col("_ab")).mapInArrow(_pack_anchors(scale), BLOCK + ", _ab int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_anchors)

    def sorted_keys(rdd):
        return rdd.repartitionAndSortWithinPartitions(parts, _dealer)

    best = sorted_keys(_dealt(packed, None, blocks, n_anchors, groups).rdd.mapPartitions(_met(positives, negatives, low, high))
                       .map(lambda x: ((x[0], -x[1], 0, x[2]), None))).mapPartitions(_first(positives))
    best = c.materialise(spark.createDataFrame(best, FOUND))
    known = best.withColumn("_ab", F.pmod(F.xxhash64("anchor"), F.lit(n_anchors)).cast("int")).repartitionById(n_anchors, F.col("_ab")).mapInArrow(
        _pack_known, BLOCK + ", _ab int")
    near = _dealt(packed, known, blocks, n_anchors, groups).rdd.mapPartitions(_met(positives, negatives, low, high))
    keys = best.rdd.map(lambda r: ((r[0], -r[1], 0, r[2]), None)).union(near.map(lambda x: ((x[0], -x[1], 1, x[2]), None)))
    return spark.createDataFrame(sorted_keys(keys).mapPartitions(_windows(negatives, low, high)), RESULT)


def _pack_anchors(scale: float):
    """One block per partition, which holds one anchor block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[int] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    first.append(batch.column("_ab")[0].as_py())
                yield batch

        for block in _pack(1 << 40, scale)(noted()):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array([first[0]] * block.num_rows, pa.int32())], names=[*block.schema.names, "_ab"])

    return run


def _pack_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positives of an anchor block as one row."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        ids, scores = (np.concatenate([b.column(n).to_numpy() for b in parts]) for n in ("anchor", "score"))
        yield pa.RecordBatch.from_pylist(
            [{"_ids": ids.tobytes(), "_labels": b"", "_data": scores.tobytes(), "_kind": "<i8", "_dim": 1, "_ab": parts[0].column("_ab")[0].as_py()}],
            pa.schema([("_ids", pa.binary()), ("_labels", pa.binary()), ("_data", pa.binary()), ("_kind", pa.string()), ("_dim", pa.int32()), ("_ab", pa.int32())]))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(c.table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0, label=moved)


ORACLE_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
          FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
found AS (SELECT p.a, p.b AS p, n.b AS n, p.s AS ps, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
          FROM positive AS p JOIN pairs AS n ON p.a = n.a AND NOT n.same AND {LOW} * p.s <= 100 * n.s AND 100 * n.s <= {HIGH} * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM found WHERE rank <= {NEGATIVES}
"""
