"""MinHash near-duplicates with tensored banding.

A text is the set of its four-word shingles (words between white space, A-Z lower-cased; a shorter text is one
shingle). Two collections of `HALVES` half keys are made from `WIDTH` min-hashes each; the key of table (i, j) joins
half i of the first with half j of the second collection. So HALVES squared tables cost 2 * HALVES * WIDTH min-hashes
instead of HALVES**2 * 2 * WIDTH. A pair at similarity s meets unless all halves of one collection differ:
(1 - (1 - s**WIDTH)**HALVES)**2, that is 0.9999 at 0.8.

Texts with equal sets (128 bits of two sums over the set) are one node. Only half keys that two nodes share are combined,
so texts without a near copy cost 2 * HALVES narrow rows and never a table row. Nodes in one table are tied to the
table's smallest (an edge per node, never pairs); tied nodes form groups, which hold every pair that met in any table.

Groups are verified on full sets of 64-bit shingle hashes, in blocks of at most about `CHUNK_BYTES` and `CHUNK_TEXTS`
a side. First every group is cut into chunks twice, by two hashes, and each chunk is verified by itself: every text is
sent twice, and texts of one family grow together. Only where a group of several chunks has not become one component,
the texts outside its largest component are compared with all the others, block by block; pairs within the largest one
need no look. Components of the verified links are the result, so no link is lost that met in a table.

Defined cases: NULL texts and texts without words have no shingles and no links. The component is named by its smallest
id; NULL ids are passed over, and a NULL id alone names itself NULL and is kept. Repeated rows share one result, so rows
that repeat the smallest id are all kept. Ids may be of any ordered type. Empty tables give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .hashing import SPACED_BYTE, mixed, text_word_hashes
from .ngram_join import shingle_hashes

SHINGLE = 4
PERCENT = 80
HALVES, WIDTH = 14, 3
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 1000
BROADCAST_ROWS = 500_000
PART = 200_000  # shingles whose min-hashes are taken together


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(words, n)) for words in text_word_hashes(texts, SPACED_BYTE)]


def half_keys(sets: list[np.ndarray], halves: int, width: int) -> np.ndarray:
    """Both collections' half keys of sets that are not empty."""
    numbers = mixed(np.arange(1, 4 * halves * width + 1, dtype=np.uint64))
    times, plus = numbers[: len(numbers) // 2] | np.uint64(1), numbers[len(numbers) // 2 :]
    keys = np.empty((len(sets), 2 * halves), np.uint64)
    ends = np.cumsum([len(x) for x in sets])
    at = 0
    while at < len(sets):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PART)))
        part = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], ends[at : end - 1] - before]).astype(np.int64)
        for half in range(2 * halves):
            key = np.full(end - at, half + 1, np.uint64)
            for i in range(half * width, half * width + width):
                key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(part * times[i] + plus[i], starts))
            keys[at:end, half] = key
        at = end
    return keys.view(np.int64)


def _signed(id_type: pa.DataType, shingle: int, halves: int, width: int):
    schema = pa.schema([("_id", id_type), ("_text", pa.int64()), ("_bytes", pa.int64()), ("_set", pa.binary()), ("_n", pa.int64()), ("_halves", pa.list_(pa.int64()))])
    other = np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column("_body").to_pylist(), shingle)
                keys = iter(half_keys([x for x in sets if len(x)], halves, width))
                names = [np.array([mixed(x).sum(), mixed(x ^ other).sum()], "<u8").tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id"), batch.column("_text"), batch.column("_bytes"), pa.array(names, pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()), pa.array([next(keys) if len(x) else None for x in sets], pa.list_(pa.int64()))], schema=schema)

    return run


def _sources(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.octet_length(text).cast("bigint").alias("_bytes"), F.col(text).alias("_body"))


def tied_groups(sets: DataFrame, halves: int) -> DataFrame:
    """_short, _group of the nodes that met another in a table."""
    rows = sets.select("_short", F.posexplode("_halves").alias("_at", "_half"))
    shared = rows.groupBy("_half").agg(F.min("_short").alias("_least"), F.max("_short").alias("_most")).where("_least < _most").select("_half")
    left, right = (F.collect_list(F.when(side, F.col("_half"))) for side in (F.col("_at") < halves, F.col("_at") >= halves))
    both = rows.join(shared, "_half").groupBy("_short").agg(left.alias("_left"), right.alias("_right"))
    tables = c.materialise(both.select("_short", F.explode("_left").alias("_l"), "_right").select(
        "_short", F.explode(F.transform("_right", lambda r: F.xxhash64("_l", r))).alias("_table")))
    met = tables.groupBy("_table").agg(F.min("_short").alias("_least"), F.max("_short").alias("_most")).where("_least < _most")
    ties = tables.join(met, "_table").where("_short != _least").select(F.col("_short").alias("a"), F.col("_least").alias("b")).distinct()
    tied = components(ties)
    return tied.select(F.col("node").alias("_short"), F.col("root").alias("_group")).unionByName(
        tied.select(F.col("root").alias("_short"), F.col("root").alias("_group")).distinct())


def linked(sets: list[np.ndarray], percent: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Which sets of a block reach the similarity, as a square; with `rows` only pairs that hold one of these."""
    size = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, code, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(size), sizes)
    column = np.cumsum(found > 1) - 1
    keep = found[code] > 1
    of, code = of[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    common, width = np.zeros((size, size), np.float64), 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [first, first + width])
        dense = np.zeros((size, width), np.float32)
        dense[of[a:b], code[a:b] - first] = 1
        common += dense @ dense.T
    out = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
    np.fill_diagonal(out, False)
    if rows is not None:
        out &= rows[:, None] | rows[None, :]
    return out


def _verify(percent: int, shingle: int):
    """Blocks of texts on end, sorted by block: one row per linked text, with the smallest set its links lead to."""
    def block(held: dict) -> Iterator[tuple]:
        names = sorted(held)
        rows = np.array([held[x][0] for x in names])
        links = linked(shingle_sets([held[x][1] for x in names], shingle), percent, None if rows.all() else rows)
        label = np.arange(len(names))
        while True:
            new = np.minimum(label, np.where(links, label[None, :], len(names)).min(axis=1))
            if (new == label).all():
                break
            label = new
        for i in np.flatnonzero(label != np.arange(len(names))):
            yield names[i], names[label[i]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, {}, []
        for batch in batches:
            for group, at, name, row, body in zip(batch["_group"], batch["_block"], batch["_set"], batch["_row"], batch["_body"]):
                if (group, at) != now:
                    if len(held) > 1:
                        out += block(held)
                    now, held = (group, at), {}
                name = bytes(name)
                held[name] = (row or (name in held and held[name][0]), body)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if len(held) > 1:
            out += block(held)
        yield pd.DataFrame(out, columns=["a", "b"])

    return run


def verified_components(docs: DataFrame, sets: DataFrame, groups: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """node, root: components of the verified links, for every node that is not a root itself."""
    members = sets.select("_set", "_short", "_rep", "_bytes").join(groups, "_short")
    sizes = members.groupBy("_group").agg(F.least(F.ceil(F.count("*") / 2), F.greatest(
        F.ceil(F.sum("_bytes") / CHUNK_BYTES), F.ceil(F.count("*") / CHUNK_TEXTS))).alias("_chunks"))
    members = c.materialise(members.join(sizes, "_group").select("_group", "_set", F.col("_rep._id").alias("_rep"), F.col("_rep._text").alias("_hash"), "_bytes", "_chunks"))

    def compared(places: DataFrame) -> DataFrame:
        """places: _group, _block, _set, _rep, _hash, _row. Fetches the texts and verifies the blocks."""
        places = c.materialise(places)
        wanted = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        own = _sources(docs, doc_id, text)
        rows = own.join(wanted, (own["_text"] == wanted["_hash"]) & own["_id"].eqNullSafe(wanted["_rep"])).select("_group", "_block", "_set", "_row", "_body")
        return c.materialise(rows.repartition("_group", "_block").sortWithinPartitions("_group", "_block").mapInPandas(
            _verify(percent, shingle), "a binary, b binary"))

    def dealt(seed: int, chunks: str = "_chunks"):
        return F.pmod(F.xxhash64("_set", F.lit(seed)), F.col(chunks))

    first = F.when(F.col("_chunks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(dealt(1), F.col("_chunks") + dealt(2)))
    links = compared(members.select("_group", F.explode(first).alias("_block"), "_set", "_rep", "_hash", F.lit(True).alias("_row")))
    roots = components(links)
    if not members.where("_chunks > 1").take(1):
        return roots
    large = members.where("_chunks > 1").join(roots, members["_set"] == roots["node"], "left").select(
        members["*"], F.coalesce("root", "_set").alias("_root"))
    main = large.groupBy("_group", "_root").agg(F.count("*").alias("_n")).groupBy("_group").agg(
        F.max(F.struct("_n", "_root"))["_root"].alias("_main"), F.count("*").alias("_parts")).where("_parts > 1")
    open_ = c.materialise(large.join(main, "_group").select(*members.columns, (F.col("_root") != F.col("_main")).alias("_row")))
    if not open_.take(1):
        return roots
    out = open_.where("_row").groupBy("_group").agg(F.least(F.count("*"), F.greatest(
        F.ceil(F.sum("_bytes") / CHUNK_BYTES), F.ceil(F.count("*") / CHUNK_TEXTS))).alias("_sides"))
    open_ = open_.join(out, "_group")
    last = F.col("_chunks") - 1
    outside = open_.where("_row").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_j")).withColumn("_i", dealt(3, "_sides"))
    inside = open_.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_sides") - 1)).alias("_i")).withColumn("_j", dealt(1)).withColumn("_row", F.lit(False))
    both = outside.unionByName(inside).select("_group", (F.col("_i") * F.col("_chunks") + F.col("_j")).alias("_block"), "_set", "_rep", "_hash", "_row")
    more = compared(both)
    if not more.take(1):
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    halves: int = HALVES, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    out = f"_id {kind.simpleString()}, _text long, _bytes long, _set binary, _n long, _halves array<long>"
    rows = c.materialise(_sources(docs, doc_id, text).mapInArrow(_signed(to_arrow_type(kind), shingle, halves, width), out))
    sets = c.materialise(rows.where(F.col("_set").isNotNull()).groupBy("_set").agg(
        F.min("_id").alias("_first"), F.first(F.struct("_id", "_text", "_bytes", "_halves")).alias("_any")).select(
        "_set", F.xxhash64("_set").alias("_short"), "_first", F.struct("_any._id", "_any._text").alias("_rep"), "_any._bytes", "_any._halves"))
    roots = verified_components(docs, sets, tied_groups(sets, halves), doc_id, text, shingle, percent)
    judged = sets.join(roots, sets["_set"] == roots["node"], "left").select("_set", "_first", F.coalesce("root", "_set").alias("_root"))
    names = judged.groupBy("_root").agg(F.min("_first").alias("_component"))
    named = judged.join(names, "_root").select("_set", "_component")
    found = rows.join(named, "_set", "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))
    empty = docs.where(F.col(text).isNull()).select(
        F.col(doc_id).alias("doc_id"), F.lit(0).cast("bigint").alias("n_shingles"), F.col(doc_id).alias("component_id"))
    return found.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{c.UPPER}', '{c.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM met JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a AS doc_id, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id),
least_ AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""
