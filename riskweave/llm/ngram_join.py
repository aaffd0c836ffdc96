"""N-gram Jaccard join with min-hash prefixes and exact verification.

Texts are sets of five-word shingles (words as in common.PLAIN_WORD; a shorter text is one shingle). Equal texts are
one text with copies. Every text has a signature of min-hashes in `trees` tries; in each trie a text is found under
the prefix of its signature. The prefix is the longest at which two texts at the threshold meet in at least one trie with
probability `recall`. It is the same for all texts: links are counted, so a longer prefix, even for texts that have found a
neighbour under it, would lose some of their links at the threshold, and a shorter one is not needed for the recall. Texts
under one prefix are tied to the prefix's smallest text (an edge per text, never pairs), and the tied texts form candidate
groups, which hold every pair that met anywhere.

Candidates are verified exactly: each text of a group is sent to its group once, words are compared as words, and all
similarities in the group are counted, so links that the tries missed within a group are found too. A large group is
cut into chunks by hash, and every two chunks are verified as a block of their own, at most `CHUNK_BYTES` and
`CHUNK_TEXTS` a side; nothing is dropped. Of a block only one row per text leaves: its links and the smallest text it
is linked to. Classes are the connected components of verified links.

Defined cases: NULL texts are classes of their own without links. Equal texts, empty ones too, are one class; texts
without words have no other link. The class id is the smallest document id of the class (NULL ids are passed over).
n_links counts other texts at or above the threshold, n_copies the rows of the same text. Repeated rows are copies.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .hashing import mixed, text_word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 12
RECALL = 0.9999
CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 1000
SLICE = 500
BROADCAST_ROWS = 500_000
_SEPARATORS = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in range(256))


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets with the wanted probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    if not len(words):
        return words
    n = min(n, len(words))
    weights = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * weights[j]
    return mixed(total + np.uint64(n))


def forest_keys(texts: list[str], trees: int, depth: int, n: int = SHINGLE) -> list[np.ndarray | None]:
    """Per text the key of its prefix in each trie; None without words."""
    numbers = mixed(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
    times, plus = numbers[: trees * depth] | np.uint64(1), numbers[trees * depth :]
    found = [shingle_hashes(w, n) for w in text_word_hashes(texts)]
    out: list[np.ndarray | None] = [None] * len(texts)
    some = [i for i, f in enumerate(found) if len(f)]
    at = 0
    while at < len(some):  # a few hundred thousand shingles at a time
        end, size = at, 0
        while end < len(some) and (end == at or size < 200_000):
            size += len(found[some[end]])
            end += 1
        part = np.concatenate([found[i] for i in some[at:end]])
        starts = np.cumsum([0] + [len(found[i]) for i in some[at : end - 1]])
        keys = np.empty((end - at, trees), np.uint64)
        for tree in range(trees):
            key = np.full(end - at, tree + 1, np.uint64)
            for d in range(tree * depth, tree * depth + depth):
                key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(part * times[d] + plus[d], starts))
            keys[:, tree] = key
        for i, key in zip(some[at:end], keys.view(np.int64)):
            out[i] = key
        at = end
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, trees: int, depth: int, n: int) -> DataFrame:
    kept = ["_own", "_key", "_short", "_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # few texts at a time are in Python
                part = batch.slice(at, SLICE)
                keys = forest_keys(part.column("_text").to_pylist(), trees, depth, n)
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(keys, pa.list_(pa.int64()))], names=[*kept, "_keys"])

    own = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("bigint").cast("string").alias("_own"), c.text_key(F.col(text)).alias("_key"), F.xxhash64(text).alias("_short"),
        F.octet_length(text).cast("bigint").alias("_bytes"), F.col(text).alias("_text"))
    done = own.mapInArrow(run, "_own string, _key binary, _short long, _bytes long, _keys array<long>")
    return c.materialise(done.select(F.col("_own").cast("bigint").alias("_own"), "_key", "_short", "_bytes", "_keys"))


def _shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs, shingles numbered exactly by their words."""
    ids: dict[bytes, int] = {}
    docs, words, short = [], [], {}
    for i, text in enumerate(texts):
        own = text.encode().lower().translate(_SEPARATORS).split()
        if len(own) < n:
            if own:
                short[i] = tuple(own)
            continue
        words.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int64, len(own)))
        docs.append(np.full(len(own), i))
    of, code = np.empty(0, np.int64), np.empty(0, np.int64)
    top = 0
    if words:
        word, of = np.concatenate(words), np.concatenate(docs)
        code = word
        for j in range(1, n):
            _, code = np.unique(code[:-1] * len(ids) + word[j:], return_inverse=True)
        whole = of[: len(code)] == of[n - 1 :]
        of, code = of[: len(code)][whole], code[whole]
        top = int(code.max()) + 1
    if short:
        names: dict[tuple, int] = {}
        of = np.concatenate([of, np.fromiter(short, np.int64, len(short))])
        code = np.concatenate([code, np.fromiter((top + names.setdefault(s, len(names)) for s in short.values()), np.int64, len(short))])
    if not len(of):
        return of, code
    span = int(code.max()) + 1
    both = np.unique(of * span + code)
    return both // span, both % span


def linked(texts: list[str], sides: np.ndarray | None, threshold: float, n: int = SHINGLE) -> np.ndarray:
    """Which texts of a block are similar, as a square; with two sides only across them."""
    size = len(texts)
    of, code = _shingle_sets(texts, n)
    sizes = np.bincount(of, minlength=size)
    common = np.zeros((size, size), np.float32)
    df = np.bincount(code) if len(code) else np.empty(0, int)
    shared = np.flatnonzero(df > 1)
    column = np.full(len(df), -1)
    column[shared] = np.arange(len(shared))
    at = column[code] if len(code) else code
    of, at = of[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    width = 4096
    for first in range(0, len(shared), width):
        a, b = np.searchsorted(at, [first, first + width])
        dense = np.zeros((size, min(width, len(shared) - first)), np.float32)
        dense[of[a:b], at[a:b] - first] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    out = (common > 0) & (common >= threshold * union - 1e-6)
    np.fill_diagonal(out, False)
    if sides is not None:
        out &= sides[:, None] != sides[None, :]
    return out


def _verify(threshold: float, n: int):
    def block(rows: list[tuple], across: bool) -> Iterator[tuple]:
        """rows: _key, _chunk, _text of one block. Across two chunks, links within either belong to its own block."""
        rows = list({r[0]: r for r in rows}.values())
        chunks = np.array([r[1] for r in rows])
        if across and chunks.min() == chunks.max():
            return
        links = linked([r[2] for r in rows], chunks if across else None, threshold, n)
        keys = [r[0] for r in rows]
        label = np.argsort(np.argsort(np.array(keys, dtype=object)))  # ranks of the keys
        by_rank = sorted(keys)
        while True:
            near = np.where(links, label[None, :], len(rows)).min(axis=1) if len(rows) else label
            new = np.minimum(label, near)
            if (new == label).all():
                break
            label = new
        count = links.sum(axis=1)
        for i in np.flatnonzero(count):
            yield keys[i], int(count[i]), by_rank[label[i]]

    schema = pa.schema([("_key", pa.binary()), ("_links", pa.int64()), ("_near", pa.binary())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], schema.types[i]) for i in range(3)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE).to_pydict()
                for group, lo, hi, key, chunk, text in zip(*(batch[x] for x in ("_group", "_lo", "_hi", "_key", "_chunk", "_text"))):
                    if (group, lo, hi) != now:
                        if len(held) > 1:
                            out += block(held, now[1] != now[2])
                        now, held = (group, lo, hi), []
                    held.append((key, chunk, text))
                if len(out) > 10_000:
                    yield table(out)
                    out = []
        if len(held) > 1:
            out += block(held, now[1] != now[2])
        yield table(out)

    return run


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE,
                  trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows (_own, _key) of the documents with text, and one row per distinct text: _key, _first (smallest id),
    _copies, _links, _root (key that its class shares)."""
    depth = prefix_depth(threshold, trees, max_depth, recall)
    rows = signatures(docs, doc_id, text, trees, depth, shingle)
    texts = c.materialise(rows.groupBy("_key", "_short", "_bytes").agg(F.min("_own").alias("_first"), F.count("*").alias("_copies")))
    one = rows.where(F.col("_keys").isNotNull()).dropDuplicates(["_short"])
    prefixes = one.select("_short", F.explode("_keys").alias("_prefix"))
    met = prefixes.groupBy("_prefix").agg(F.min("_short").alias("_least"), F.max("_short").alias("_most")).where("_least < _most")
    ties = prefixes.join(met, "_prefix").where("_short != _least").select(F.col("_short").alias("a"), F.col("_least").alias("b")).distinct()
    tied = components(ties)
    members = c.materialise(tied.select(F.col("node").alias("_short"), F.col("root").alias("_group")).unionByName(
        tied.select(F.col("root").alias("_short"), F.col("root").alias("_group")).distinct()).join(texts, "_short"))
    sizes = members.groupBy("_group").agg(F.greatest(F.ceil(F.sum("_bytes") / CHUNK_BYTES), F.ceil(F.count("*") / CHUNK_TEXTS)).alias("_chunks"))
    members = c.materialise(members.join(sizes, "_group").select(
        "_group", "_key", "_short", F.col("_first").alias("_rep"), "_chunks", F.pmod(F.xxhash64("_key"), F.col("_chunks")).alias("_chunk")))
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("_own"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    found = source.join(wanted, (source["_hash"] == wanted["_short"]) & source["_own"].eqNullSafe(wanted["_rep"])).where(c.text_key(F.col("_text")) == F.col("_key"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))
    blocks = found.select("_group", "_key", "_chunk", "_text", other.alias("_other")).select(
        "_group", F.least("_chunk", "_other").alias("_lo"), F.greatest("_chunk", "_other").alias("_hi"), "_key", "_chunk", "_text")
    by = ["_group", "_lo", "_hi"]
    verified = c.materialise(blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(
        _verify(threshold, shingle), "_key binary, _links long, _near binary"))
    links = verified.groupBy("_key").agg(F.sum("_links").alias("_links"))
    classes = components(verified.select(F.col("_key").alias("a"), F.col("_near").alias("b")))
    joined = texts.join(links, "_key", "left").join(classes.withColumnRenamed("node", "_key"), "_key", "left")
    return rows.select("_own", "_key"), c.materialise(joined.select(
        "_key", "_first", "_copies", F.coalesce("_links", F.lit(0).cast("bigint")).alias("_links"), F.coalesce("root", "_key").alias("_root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies."""
    rows, texts = similar_texts(docs, doc_id, text, **options)
    first = texts.groupBy("_root").agg(F.min("_first").alias("class_id"))
    judged = texts.join(first, "_root").select("_key", "class_id", F.col("_links").alias("n_links"), F.col("_copies").alias("n_copies"))
    out = rows.join(judged, "_key").select(F.col("_own").alias("doc_id"), "class_id", "n_links", "n_copies")
    own = F.col(doc_id).cast("bigint")
    empty = docs.where(F.col(text).isNull()).select(
        own.alias("doc_id"), own.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return out.unionByName(empty)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each class, with the columns it came with."""
    _, texts = similar_texts(docs, doc_id, text, **options)
    kept = texts.groupBy("_root").agg(F.min(F.struct(F.col("_first").isNull().alias("last"), "_first", "_key")).alias("_kept"))
    kept = kept.select(F.col("_kept._first").alias("_first"), F.col("_kept._key").alias("_text"))
    rows = docs.where(F.col(text).isNotNull()).select(F.struct("*").alias("_row"), F.col(doc_id).cast("bigint").alias("_own"), c.text_key(F.col(text)).alias("_key"))
    same = (rows["_key"] == kept["_text"]) & rows["_own"].eqNullSafe(kept["_first"])
    # Only rows that repeat both id and text are left to fold here.
    one = rows.join(kept, same, "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(docs.where(F.col(text).isNull()))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
