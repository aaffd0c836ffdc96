"""Language-model scoring by logistic context mixing.

A text is a row of tokens and an end. A token is spelled as bytes, a byte as eight binary decisions. For each decision
several predictors look up how often either bit followed in their hashed context: the last one, two and three bytes of
the token, the whole token so far, and the whole token so far after the same kind of token. Their logits are mixed by
weights that a gate selects (how often the longest context was seen, and where in the token the byte stands), and the
result is refined by an adaptive probability map. The sum over all decisions is the text's probability.

Counts come from all training documents: tokens with the kind of token before them are counted in tasks and summed by
Spark. Tokens are spelled into nodes (a prefix and the byte after it). The tokens lie in order, cut into blocks, so all
tokens that go on from a prefix lie in one block and a task counts them there; only prefixes of a block's first or last
token may go on in other blocks, and these alone are summed by Spark. Prefixes that behave alike (the same last three
bytes, place and counts of the bytes after them) are one row of a table of contexts with the number of its copies, and a
table holds the short contexts; so all counts grow with the corpus and nothing shares a slot.
The mixing weights and the map are learned from all training tokens: in each of `PASSES` passes over the contexts, tasks
add up gradients and second derivatives of each gate, each node as often as its token stood there, and the weights take
a Newton step. Each decision's own count is taken off first, so that rare contexts are weighted as they will be for new
text. Every distinct token is scored once, in its block, and joined to the texts.

The plain unigram score goes by the exact counts of all tokens. Counts and scores of the `HEAD` most frequent tokens
are broadcast; all others are joined by Spark from the complete table, so no count is left out.

Defined cases: NULL text is empty and has the end alone. A NULL id is neither learned from nor held out. Repeated rows
are scored alike (and learned from as often as they stand). With nothing learned from, counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .hashing import mixed, prefix_hashes

FOLDS, HELD = 7, 2
HEAD = 200_000
SLOT_BITS = 18  # of Mixer, the form in memory that learns online
PASSES = 4
WORDS_KEPT = 300_000
END = b"\n"
KINDS = 4  # of the token before: none, end of a sentence, a comma or the like, any other
PREDICTORS = 5
GATES = 8 * 4
BATCH_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
SHORT_ROWS = 300_000  # so many short contexts are sent to the tasks; more are joined
_KIND = np.full(256, 3, np.int64)
_KIND[[ord(x) for x in ".!?"]] = 1
_KIND[[ord(x) for x in ",;:"]] = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def learned(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS != HELD, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, cut at ASCII white space, and the end."""
    return [*(text or "").encode().lower().split(), END]


class Vocabulary:
    """Numbers of tokens in a task; starts anew when full."""

    def __init__(self, kept: int = WORDS_KEPT):
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.kind = np.empty(0, np.int64)

    def number(self, tokens: list[bytes]) -> np.ndarray:
        new = [t for t in dict.fromkeys(tokens) if t not in self.at]
        if new:
            for t in new:
                self.at[t] = len(self.names)
                self.names.append(t)
            self.kind = np.concatenate([self.kind, _KIND[np.fromiter((t[-1] for t in new), np.int64, len(new))]])
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Parts of a list of texts: the first text's place, all tokens, and how many each text has."""
    at, tokens, sizes, held = 0, [], [], 0
    for i, text in enumerate(texts):
        own = tokens_of(text)
        tokens += own
        sizes.append(len(own))
        held += len(text or "")
        if held > BATCH_BYTES:
            yield at, tokens, np.array(sizes)
            at, tokens, sizes, held = i + 1, [], [], 0
    if sizes:
        yield at, tokens, np.array(sizes)


def kinds_before(numbers: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The kind of the token before each token; 0 at a text's start."""
    out = np.zeros(len(numbers), np.int64)
    out[1:] = kind[numbers[:-1]]
    out[(np.cumsum(sizes) - sizes)] = 0
    return out


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each token stands after each kind of token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Vocabulary(), np.zeros(0, np.int64)

        def full() -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            names = [words.names[i] for i in at // KINDS]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(at % KINDS, pa.int32()), pa.array(counts[at], pa.int64())],
                                             names=["token", "kind", "n"])
            words.clear()
            return out

        for batch in batches:
            for _, tokens, sizes in batches_of(batch.column(0).to_pylist()):
                numbers = words.number(tokens)
                key = numbers * KINDS + kinds_before(numbers, words.kind, sizes)
                more = np.bincount(key, minlength=len(words.names) * KINDS)
                more[: len(counts)] += counts
                counts = more
                if len(words.names) > words.kept:
                    yield full()
                    counts = np.zeros(0, np.int64)
        if len(counts):
            yield full()

    found = docs.select(text).mapInArrow(run, "token binary, kind int, n long")
    return found.groupBy("token", "kind").agg(F.sum("n").alias("n"))


class Decisions:
    """The binary decisions that spell tokens, and each predictor's slot for them."""

    def __init__(self, tokens: list[bytes], kinds: np.ndarray):
        whole = [t if t == END else t + b" " for t in tokens]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        data = np.frombuffer(b"".join(whole), np.uint8)
        starts = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(whole)), sizes)
        self.data, first = data.astype(np.int64), starts[self.of]
        self.place = np.arange(len(data)) - first
        before = [np.where(self.place >= k, np.concatenate([np.zeros(k, np.int64), self.data[:-k] + 1])[: len(data)], 0) for k in (1, 2, 3)]
        own = prefix_hashes(data, first)
        kind = np.asarray(kinds, np.uint64)[self.of]
        one = before[0].astype(np.uint64)
        two = one * np.uint64(257) + before[1].astype(np.uint64)
        three = two * np.uint64(257) + before[2].astype(np.uint64)
        self.contexts = [mixed(x + np.uint64((i + 1) << 40)) for i, x in enumerate((one, two, three))]
        self.contexts += [mixed(own), mixed(own + kind * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))]

    def __iter__(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        node = np.ones(len(self.data), np.int64)
        for shift in range(7, -1, -1):
            bit = (self.data >> shift) & 1
            turned = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            at = [(((x ^ turned) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for x in self.contexts]
            yield bit, at
            node = node * 2 + bit


def vocabulary(counts: DataFrame) -> DataFrame:
    """One row per token: how often it was learned after each kind of token (n0 to n3)."""
    return counts.groupBy("token").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(KINDS)))


def _spelled(tokens: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each byte of the tokens: its token, the hash of the bytes before it, the last three of them, its place, itself."""
    whole = [t if t == END else t + b" " for t in tokens]
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    data = np.frombuffer(b"".join(whole), np.uint8)
    of = np.repeat(np.arange(len(whole)), sizes)
    first = (np.cumsum(sizes) - sizes)[of]
    place = np.arange(len(data)) - first
    three = np.zeros(len(data), np.int64)
    for k in (1, 2, 3):
        three = three * 257 + np.where(place >= k, np.concatenate([np.zeros(k, np.int64), data[:-k].astype(np.int64) + 1])[: len(data)], 0)
    return of, prefix_hashes(data, first).view(np.int64), three, np.minimum(7, place), data.astype(np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    rows = batch.column(name)
    return np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy())), rows.flatten()


def _floats(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for key in keys:
            out[1:] |= key[1:] != key[:-1]
    return out


def _paths(group: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each group goes on with the first 0, 1, .. 8 bits of the byte, for each row of sorted groups and bytes; of
    each row of `n` [_, row] as [_, bits, row]."""
    out = np.empty((len(n), 9, len(byte)))
    key = group * 256 + byte
    for k in range(9):
        new = _new(key >> (8 - k))
        out[:, k] = np.add.reduceat(n, np.flatnonzero(new), axis=1)[:, np.cumsum(new) - 1] if len(key) else 0
    return out


def _far(group: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Paths of the whole prefix, then of the prefix after each kind."""
    return _paths(group, byte, np.concatenate([n.sum(axis=0, keepdims=True), n]).astype(float))


class Trie:
    """The nodes of a block's tokens: own (hash of the prefix), three, place, byte, n [kind, node], sorted by own and
    byte; `node` gives each byte's node, `of` its token. `more` are nodes of prefixes that go on in other blocks, with
    their counts from all blocks, which stand for the block's own."""

    def __init__(self, tokens: list[bytes], n: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.of, own, three, place, byte = _spelled(tokens)
        self.edge = np.unique(own[(self.of == 0) | (self.of == len(tokens) - 1)])
        each = n[:, self.of]
        if more is not None:
            each = np.where(np.isin(own, more[0]), 0, each)
            own, byte, each = np.concatenate([own, more[0]]), np.concatenate([byte, more[1]]), np.concatenate([each, more[2]], axis=1)
            none = np.zeros(len(more[0]), np.int64)
            three, place = np.concatenate([three, none]), np.concatenate([place, none])
        order = np.lexsort((byte, own))
        own, byte = own[order], byte[order]
        fresh = _new(own)
        new = fresh | _new(byte)
        first = np.flatnonzero(new)
        self.node = np.empty(len(order), np.int64)
        self.node[order] = np.cumsum(new) - 1
        self.node = self.node[: len(self.of)]
        at = order[first]  # the block's own byte, where there is one
        self.own, self.byte, self.three, self.place = own[first], byte[first], three[at], place[at]
        self.n = np.add.reduceat(each[:, order], first, axis=1)
        self.context = np.cumsum(fresh[first]) - 1
        self.single = np.bincount(self.context)[self.context] == 1

    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes that alone follow their prefix: one of each three, place, byte and counts, which one each node is
        like, how many are like it."""
        at = np.flatnonzero(self.single)
        key = mixed(((self.three[at] * 8 + self.place[at]) * 256 + self.byte[at]).astype(np.uint64))
        for n in self.n[:, at]:
            key = mixed(key + n.astype(np.uint64))
        _, first, like, copies = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return at[first], like, copies


_CHILD = "byte int, n0 long, n1 long, n2 long, n3 long"


def _children(byte: np.ndarray, n: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(byte.astype(np.int32)), *map(pa.array, n.astype(np.int64))], names=["byte", "n0", "n1", "n2", "n3"])


def _counts(rows: pa.StructArray) -> np.ndarray:
    return np.stack([rows.field(f"n{k}").to_numpy() for k in range(KINDS)])


def _blocks(words: DataFrame) -> DataFrame:
    """Rows id, token, n0 to n3: the tokens in order, as lists of some `BLOCK_BYTES` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, held, size = TaskContext.get().partitionId() << 33, [], 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = [pa.array([name])] + [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), x.combine_chunks()) for x in whole.columns]
            return pa.RecordBatch.from_arrays(columns, names=["id", "token", "n0", "n1", "n2", "n3"])

        for batch in batches:
            ends = np.cumsum(np.fromiter(map(len, batch.column(0).to_pylist()), np.int64, len(batch)) + 1)
            at = 0
            while at < len(batch):
                taken = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(at, taken - at))
                size += int(ends[taken - 1] - (ends[at - 1] if at else 0))
                at = taken
                if size >= BLOCK_BYTES or at < len(batch):
                    yield block()
                    name, held, size = name + 1, [], 0
        if held:
            yield block()

    ordered = words.select("token", *(f"n{k}" for k in range(KINDS))).repartitionByRange("token").sortWithinPartitions("token")
    return ordered.mapInArrow(run, "id long, token array<binary>, n0 array<long>, n1 array<long>, n2 array<long>, n3 array<long>")


def _tokens(batch: pa.RecordBatch, row: int) -> tuple[list[bytes], np.ndarray]:
    return batch.column("token")[row].as_py(), np.stack([batch.column(f"n{k}")[row].values.to_numpy() for k in range(KINDS)])


def _edges(blocks: DataFrame) -> DataFrame:
    """The nodes of prefixes that may go on in another block: id, own, three, place, byte, n0 to n3."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                t = Trie(*_tokens(batch, row))
                at = np.flatnonzero(np.isin(t.own, t.edge))
                columns = [pa.array(np.full(len(at), batch.column("id")[row].as_py())), pa.array(t.own[at])]
                columns += [pa.array(x[at].astype(np.int32)) for x in (t.three, t.place, t.byte)] + [pa.array(x) for x in t.n[:, at]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "own", "three", "place", "byte", "n0", "n1", "n2", "n3"])

    return blocks.mapInArrow(run, f"id long, own long, three int, place int, {_CHILD}")


def _inner(blocks: DataFrame) -> DataFrame:
    """The contexts that lie within a block: three, place, copies, each (the bytes after it with their counts). Alike ones
    with a single byte are one row of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                t = Trie(*_tokens(batch, row))
                inside = ~np.isin(t.own, t.edge)
                t.single &= inside
                one, _, copies = t.alike()
                many = np.flatnonzero(inside & ~t.single)
                new = np.flatnonzero(_new(t.context[many]))
                at, first = np.concatenate([one, many]), np.concatenate([one, many[new]])
                starts = np.concatenate([np.arange(len(one)), len(one) + new, [len(at)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.three[first].astype(np.int32)), pa.array(t.place[first].astype(np.int32)),
                     pa.array(np.concatenate([copies, np.ones(len(new), np.int64)])),
                     pa.ListArray.from_arrays(pa.array(starts, pa.int32()), _children(t.byte[at], t.n[:, at]))],
                    names=["three", "place", "copies", "each"])

    return blocks.mapInArrow(run, f"three int, place int, copies long, each array<struct<{_CHILD.replace(' ', ': ').replace(',: ', ', ')}>>")


def _short_contexts(each: DataFrame) -> DataFrame:
    """Rows three, byte, near: the paths of the last one, two and three bytes; from rows three, byte, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                of, each = _lists(batch, "each")
                byte = each.field("byte").to_numpy()
                order = np.lexsort((byte, of))
                of, byte = of[order], byte[order]
                near = _paths(of, byte.astype(np.int64), each.field("n").to_numpy()[None, order].astype(float))[0].T
                yield pa.RecordBatch.from_arrays([batch.column("ctx").take(pa.array(of)), pa.array(byte), _floats(near)], names=["ctx", "byte", "near"])

    def paths(df: DataFrame, name: str) -> DataFrame:
        listed = df.groupBy("ctx", "byte").agg(F.sum("n").alias("n")).groupBy("ctx").agg(F.collect_list(F.struct("byte", "n")).alias("each"))
        return listed.mapInArrow(run, "ctx int, byte int, near array<float>").withColumnsRenamed({"ctx": name, "near": f"_{name}"})

    each = each.withColumnRenamed("three", "ctx")
    last = {name: paths(each.withColumn("ctx", F.floor(F.col("ctx") / over).cast("int")), name) for name, over in (("one", 257 * 257), ("two", 257), ("three", 1))}
    both = last["three"].withColumn("one", F.floor(F.col("three") / (257 * 257)).cast("int")).withColumn("two", F.floor(F.col("three") / 257).cast("int"))
    return both.join(last["two"], ["two", "byte"]).join(last["one"], ["one", "byte"]).select("three", "byte", F.concat("_one", "_two", "_three").alias("near"))


class Contexts:
    """The counts of all contexts of a vocabulary: `blocks` of tokens with the nodes that go on elsewhere, `contexts` (three,
    place, copies, each), and the short contexts, sent to the tasks as `near` or else listed in each row's column near."""

    def __init__(self, words: DataFrame, short_rows: int = SHORT_ROWS):
        blocks = c.materialise(_blocks(words))
        edges = c.materialise(_edges(blocks))
        counts = [f"n{k}" for k in range(KINDS)]
        merged = c.materialise(edges.groupBy("own", "three", "place", "byte").agg(*(F.sum(n).alias(n) for n in counts)))
        child = F.struct("byte", *counts)
        spread = merged.groupBy("own", "three", "place").agg(F.collect_list(child).alias("each")).select("three", "place", F.lit(1).cast("long").alias("copies"), "each")
        alike = _inner(blocks).unionByName(spread).groupBy("three", "place", "each").agg(F.sum("copies").alias("copies"))
        contexts = c.materialise(alike.withColumn("id", F.monotonically_increasing_id()))
        more = edges.select("id", "own").distinct().join(merged.select("own", child.alias("child")), "own")
        more = more.groupBy("id").agg(F.collect_list(F.struct("own", "child.*")).alias("more"))
        blocks = c.materialise(blocks.join(more, "id"))
        self.places = contexts.select("id", "three", F.explode("each").alias("x"), "copies")
        n = F.col("copies") * sum((F.col(f"x.{n}") for n in counts), F.lit(0))
        short = c.materialise(_short_contexts(c.materialise(self.places.groupBy("three", "x.byte").agg(F.sum(n).alias("n")))))
        self.near = None
        if short.count() <= short_rows:
            self.blocks, self.contexts = blocks, contexts
            rows = short.toArrow().combine_chunks()
            key = rows["three"].to_numpy().astype(np.int64) * 256 + rows["byte"].to_numpy()
            order = np.argsort(key)
            flat = np.concatenate([x.flatten().to_numpy() for x in rows["near"].chunks]) if len(rows) else np.empty(0, np.float32)
            self.near = words.sparkSession.sparkContext.broadcast((key[order], flat.reshape(len(rows), 27)[order]))
        else:
            self.contexts = self._listed(contexts, self.places.select("id", "three", "x.byte").distinct(), short)
            self.blocks = self._listed(blocks, blocks.mapInArrow(_pairs, "id long, three int, byte int"), short)

    @staticmethod
    def _listed(rows: DataFrame, pairs: DataFrame, short: DataFrame) -> DataFrame:
        listed = pairs.join(short, ["three", "byte"]).groupBy("id").agg(F.collect_list(F.struct("three", "byte", "near")).alias("near"))
        return c.materialise(rows.join(listed, "id"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three last bytes and the byte after them that a block's tokens have."""
    for batch in batches:
        for row in range(len(batch)):
            _, _, three, _, byte = _spelled(batch.column("token")[row].as_py())
            both = np.unique(three * 256 + byte)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(both), batch.column("id")[row].as_py())), pa.array((both // 256).astype(np.int32)), pa.array((both % 256).astype(np.int32))],
                names=["id", "three", "byte"])


def _near(batch: pa.RecordBatch, near, row: np.ndarray, three: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The paths of the last one, two and three bytes [predictor, bits, row], from those sent or those in the batch."""
    wanted = three.astype(np.int64) * 256 + byte
    if near is not None:
        key, paths = near.value
    else:
        of, each = _lists(batch, "near")
        key = (of.astype(np.int64) << 33) + each.field("three").to_numpy().astype(np.int64) * 256 + each.field("byte").to_numpy()
        order = np.argsort(key)
        key, paths = key[order], each.field("near").flatten().to_numpy().reshape(len(key), 27)[order]
        wanted = wanted + (row.astype(np.int64) << 33)
    return paths[np.searchsorted(key, wanted)].T.astype(float).reshape(3, 9, len(wanted))


def _read(batch: pa.RecordBatch, near) -> tuple[np.ndarray, ...]:
    """byte, place, copies, n [kind, row], near [predictor, bits, row], far [own or kind, bits, row] of a batch of contexts."""
    if "far" in batch.schema.names:
        size = len(batch)
        n, near, far = (batch.column(x).flatten().to_numpy().reshape(size, *shape).T.astype(float) for x, shape in (("n", (KINDS,)), ("near", (27,)), ("far", (45,))))
        byte, place = (batch.column(x).to_numpy().astype(np.int64) for x in ("byte", "place"))
        return byte, place, np.ones(size, np.int64), n, near.reshape(3, 9, size), far.reshape(5, 9, size)
    of, each = _lists(batch, "each")
    order = np.lexsort((each.field("byte").to_numpy(), of))
    of, byte, n = of[order], each.field("byte").to_numpy()[order].astype(np.int64), _counts(each)[:, order].astype(float)
    three, place, copies = (batch.column(x).to_numpy()[of].astype(np.int64) for x in ("three", "place", "copies"))
    return byte, place, copies, n, _near(batch, near, of, three, byte), _far(of, byte, n)


def count_contexts(words: DataFrame) -> DataFrame:
    """All nodes with the counts of all their contexts: byte, place, n (learned, by kind), near (paths of the last one, two
    and three bytes), far (paths of the whole prefix, then of the prefix after each kind). `Contexts` in full width."""
    found = Contexts(words)
    near = found.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                byte, place, copies, n, paths, far = _read(batch, near)
                for first in range(0, len(byte), 10_000):
                    at = np.repeat(np.arange(first, min(len(byte), first + 10_000)), copies[first : first + 10_000])
                    for part in range(0, len(at), 10_000):
                        i = at[part : part + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(byte[i].astype(np.int32)), pa.array(place[i].astype(np.int32)), _floats(n[:, i].T), _floats(paths[:, :, i].reshape(27, -1).T), _floats(far[:, :, i].reshape(45, -1).T)],
                            names=["byte", "place", "n", "near", "far"])

    return found.contexts.mapInArrow(run, "byte int, place int, n array<float>, near array<float>, far array<float>")


def _toward(all_: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The stretched logit of the bit that follows, `same` of `all_` times."""
    return np.log((same + 0.02) / (all_ - same + 0.02)) * (all_ / (all_ + 0.5))


def _gate(total: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.minimum(7, np.log2(total + 1).astype(np.int64)) * 4 + np.minimum(3, place)


def _cell(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.minimum(7, place) * Mixer.CELLS + np.rint((np.clip(x, -8, 8) + 8) * 2).astype(np.int64)


def _sums(nodes: DataFrame, weights: np.ndarray, near_=None) -> tuple[np.ndarray, ...]:
    """Gradient and second derivatives by gate, the loss, and how often each cell of the map was met and with a 1."""
    pairs = [(i, j) for i in range(PREDICTORS) for j in range(i + 1)]
    sizes = [GATES * PREDICTORS, GATES * len(pairs), 1, 8 * Mixer.CELLS, 8 * Mixer.CELLS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve, loss, met, ones = (np.zeros(size) for size in sizes)
        slope, curve = slope.reshape(PREDICTORS, GATES), curve.reshape(len(pairs), GATES)
        for batch in batches:
            if not len(batch):
                continue
            byte, place, copies, n, near, far = _read(batch, near_)
            kind, row = np.nonzero(n)
            if not len(row):
                continue
            times, byte, place = n[kind, row] * copies[row], byte[row], place[row]
            paths = np.concatenate([near[:, :, row], far[0][None, :, row], far[1 + kind, :, row].T[None]]) - 1  # the own count is off
            for k in range(8):
                x = _toward(np.maximum(paths[:, k], 0), np.maximum(paths[:, k + 1], 0))
                gate = _gate(np.maximum(paths[3, k], 0), place)
                mixed_ = (weights[gate].T * x).sum(axis=0)
                p = _logistic(mixed_)
                loss -= (times * np.log(p)).sum()
                part = times * (1 - p)
                for i in range(PREDICTORS):
                    slope[i] += np.bincount(gate, weights=part * x[i], minlength=GATES)
                part *= p
                for at, (i, j) in enumerate(pairs):
                    curve[at] += np.bincount(gate, weights=part * x[i] * x[j], minlength=GATES)
                bit = (byte >> (7 - k)) & 1
                cell = _cell(np.where(bit == 1, mixed_, -mixed_), place)
                met += np.bincount(cell, weights=times, minlength=len(met))
                ones += np.bincount(cell, weights=times * bit, minlength=len(ones))
        out = np.concatenate([slope.ravel(), curve.ravel(), loss, met, ones])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "x"])

    found = nodes.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(sum(sizes))
    out[found["at"].to_numpy()] = found["x"].to_numpy()
    slope, curve, loss, met, ones = np.split(out, np.cumsum(sizes)[:-1])
    square = np.zeros((GATES, PREDICTORS, PREDICTORS))
    for x, (i, j) in zip(curve.reshape(len(pairs), GATES), pairs):
        square[:, i, j] = square[:, j, i] = x
    return slope.reshape(PREDICTORS, GATES).T, square, float(loss[0]), met, ones


class Mixture:
    """Weights by gate and the map, learned from all contexts (or from nodes, as `count_contexts` gives them)."""

    def __init__(self, words: DataFrame, nodes: Contexts | DataFrame):
        self.words, self.nodes = words, nodes
        rows, near = (nodes.contexts, nodes.near) if isinstance(nodes, Contexts) else (nodes, None)
        self.weights, self.loss, self.losses = np.full((GATES, PREDICTORS), 0.3), math.inf, []
        plain = np.tile(_logistic(np.linspace(-8, 8, Mixer.CELLS)), 8)
        tried = self.weights
        for _ in range(PASSES):
            slope, square, loss, met, ones = _sums(rows, tried, near)
            self.losses.append(loss)
            if loss < self.loss:
                self.weights, self.loss, self.map = tried, loss, (ones + 2 * plain) / (met + 2)
                step = np.linalg.solve(square + np.eye(PREDICTORS), (slope - (tried - 0.3))[:, :, None])[:, :, 0]
            else:
                step = step / 4
            tried = self.weights + np.clip(step, -1, 1)

    def log10(self, nodes: Contexts) -> DataFrame:
        """Rows token, p0 to p3: the log10 probability of each token of the blocks after each kind of token."""
        weights, refined, near_ = self.weights, self.map, nodes.near

        def judged(byte, place, near, far) -> np.ndarray:
            out = np.zeros((KINDS, len(byte)))
            after = [np.flatnonzero(x) for x in far[1:, 0]]  # after other kinds the last predictor knows nothing and adds 0

            def log(x, bit, place):
                later = refined[_cell(np.where(bit == 1, x, -x), place)]
                return np.log10(np.clip((_logistic(x) + np.where(bit == 1, later, 1 - later)) / 2, 1e-7, 1 - 1e-7))

            for k in range(8):
                bit = (byte >> (7 - k)) & 1
                own = weights[_gate(far[0, k], place)].T
                base = (own[:3] * _toward(near[:, k], near[:, k + 1])).sum(axis=0) + own[3] * _toward(far[0, k], far[0, k + 1])
                plain = log(base, bit, place)
                for kind, at in enumerate(after):
                    part = plain.copy()
                    part[at] = log(base[at] + own[4, at] * _toward(far[1 + kind, k, at], far[1 + kind, k + 1, at]), bit[at], place[at])
                    out[kind] += part
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    tokens, n = _tokens(batch, row)
                    more = batch.column("more")[row].values
                    t = Trie(tokens, n, (more.field("own").to_numpy(), more.field("byte").to_numpy().astype(np.int64), _counts(more)))
                    wanted = np.zeros(len(t.own), bool)
                    wanted[t.node] = True
                    far = _far(t.context, t.byte, t.n)
                    t.single &= wanted  # a prefix's only byte is one of the block's
                    one, like, _ = t.alike()
                    many = np.flatnonzero(wanted & ~t.single)
                    at = np.concatenate([one, many])
                    place_of = np.zeros(len(t.own), np.int64)
                    place_of[t.single], place_of[many] = like, len(one) + np.arange(len(many))
                    out = np.empty((KINDS, len(at)))
                    for first in range(0, len(at), 10_000):
                        i = at[first : first + 10_000]
                        near = _near(batch, near_, np.full(len(i), row), t.three[i], t.byte[i])
                        out[:, first : first + 10_000] = judged(t.byte[i], t.place[i], near, far[:, :, i])
                    found = [np.bincount(t.of, weights=x[place_of[t.node]], minlength=len(tokens)) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), *map(pa.array, found)], names=["token", "p0", "p1", "p2", "p3"])

        return nodes.blocks.mapInArrow(run, "token binary, p0 double, p1 double, p2 double, p3 double")


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """The mixture in memory, on hashed slots and learning online: what `Mixture` is held against on small data."""

    CELLS = 33

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.weights = np.full((GATES, PREDICTORS), 0.3)
        self.map = np.tile(_logistic(np.linspace(-8, 8, self.CELLS)), (8, 1))

    def _inputs(self, at: list[np.ndarray], place: np.ndarray, bit: np.ndarray | None = None):
        n = np.stack([self.counts[i, slot] for i, slot in enumerate(at)]).astype(float)  # predictor, decision, bit
        if bit is not None:
            n[:, np.arange(n.shape[1]), bit] = np.maximum(n[:, np.arange(n.shape[1]), bit] - 1, 0)
        total = n.sum(axis=2)
        x = _logit((n[:, :, 1] + 0.02) / (total + 0.04))
        x *= total / (total + 0.5)
        gate = np.minimum(7, np.log2(total[3] + 1).astype(np.int64)) * 4 + np.minimum(3, place)
        return x, gate

    def _mix(self, x: np.ndarray, gate: np.ndarray, place: np.ndarray):
        p = _logistic(np.einsum("ij,ji->i", self.weights[gate], x))
        row, cell = np.minimum(7, place), np.rint((np.clip(_logit(np.clip(p, 1e-6, 1 - 1e-6)), -8, 8) + 8) * 2).astype(np.int64)
        return p, (row, cell), np.clip((p + self.map[row, cell]) / 2, 1e-7, 1 - 1e-7)

    def learn(self, tokens: list[bytes], kinds: np.ndarray, rate: float = 0.02, batch: int = 256) -> None:
        """One online pass in order."""
        self.__dict__.pop("_ready", None)
        for first in range(0, len(tokens), batch):
            what = Decisions(tokens[first : first + batch], kinds[first : first + batch])
            for bit, at in what:
                x, gate = self._inputs(at, what.place, bit)
                p, cells, _ = self._mix(x, gate, what.place)
                seen = np.maximum(1, np.bincount(gate, minlength=GATES))[gate]
                np.add.at(self.weights, gate, (rate * np.sqrt(seen) / seen * (bit - p) * x).T)
                seen = np.zeros(self.map.shape)
                np.add.at(seen, cells, 1)
                np.add.at(self.map, cells, 0.02 * (bit - self.map[cells]) / np.sqrt(seen[cells]))
        self.map = np.clip(self.map, 1e-6, 1 - 1e-6)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Each slot's weighted logit, and the gate of the longest context's slots."""
        total = self.counts.sum(axis=2, dtype=float)
        x = _logit((self.counts[:, :, 1] + 0.02) / (total + 0.04)) * (total / (total + 0.5))
        return x.astype(np.float32), (np.minimum(7, np.log2(total[3] + 1).astype(np.int64)) * 4).astype(np.int8)

    def log10(self, tokens: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """The log10 probability of each token; the same sums as `_mix`, from tables."""
        out = np.zeros(len(tokens))
        if not hasattr(self, "_ready"):
            self._ready = *self._tables(), self.weights.T.astype(np.float32).copy(), self.map.astype(np.float32).ravel()
        logits, gates, weights, refined = self._ready
        for first in range(0, len(tokens), 20_000):
            part = slice(first, first + 20_000)
            what = Decisions(tokens[part], kinds[part])
            bits = np.zeros(len(what.data), np.float32)
            late, row = np.minimum(3, what.place).astype(np.int8), np.minimum(7, what.place) * self.CELLS
            for bit, at in what:
                gate = gates[at[3]] + late
                x = logits[0][at[0]] * weights[0][gate]
                for i in range(1, PREDICTORS):
                    x += logits[i][at[i]] * weights[i][gate]
                np.clip(x, -30, 30, out=x)
                cell = np.rint((np.clip(x, -8, 8) + 8) * 2).astype(np.int64)
                p = (1 / (1 + np.exp(-x)) + refined[row + cell]) / 2
                np.clip(p, 1e-7, 1 - 1e-7, out=p)
                bits += np.log10(np.where(bit == 1, p, 1 - p))
            out[part] = np.bincount(what.of, weights=bits, minlength=len(tokens[part]))
        return out


class Model:
    def __init__(self, mixer: Mixture, head: dict[bytes, int], total: int, distinct: int):
        self.mixer, self.head, self.total, self.distinct = mixer, head, total, distinct

    @property
    def scale(self) -> float:
        return float(self.total + 1 * (self.distinct + 1))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the complete table of token counts. Tokens of all other documents are spelled along, without counts."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = c.materialise(count_tokens(own.where(learned(F.col("doc_id")))))
    tokens = c.materialise(counts.groupBy("token").agg(F.sum("n").alias("c")))
    whole = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = tokens.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    words = c.materialise(vocabulary(counts.unionByName(_unlearned(own.where(~learned(F.col("doc_id")))))))
    mixer = Mixture(words, Contexts(words))
    return Model(mixer, dict(zip(head["token"].to_pylist(), head["c"].to_pylist())), whole["n"], whole["v"]), tokens


def _unlearned(docs: DataFrame) -> DataFrame:
    return count_tokens(docs).withColumn("n", F.lit(0).cast("bigint"))


def score(docs: DataFrame, model: Model, tokens: DataFrame, doc_id: str = "doc_id", text: str = "text", spelled: bool = False) -> DataFrame:
    """`spelled`: the documents are those that were given to `train`, so all their tokens are spelled already."""
    words, nodes = model.mixer.words, model.mixer.nodes
    if not spelled:
        more = _unlearned(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))).select("token", *(F.col("n").alias(f"n{k}") for k in range(KINDS)))
        words = c.materialise(words.unionByName(more).groupBy("token").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(KINDS))))
        nodes = Contexts(words)
    judged = c.materialise(model.mixer.log10(nodes).join(tokens, "token", "left").select(
        "token", F.coalesce("c", F.lit(0)).alias("c"), F.array(*(f"p{k}" for k in range(KINDS))).alias("p")))
    wanted = docs.sparkSession.createDataFrame(pa.table({"token": pa.array(list(model.head), pa.binary())}))
    found = judged.join(F.broadcast(wanted), "token").select("token", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(KINDS))).toArrow()
    names = found["token"].to_pylist()
    head = {t: i for i, t in enumerate(names)}
    logs = np.stack([found[f"p{k}"].to_numpy() for k in range(KINDS)], axis=1)
    own_counts = np.fromiter((model.head[t] for t in names), np.int64, len(names))
    scale = model.scale
    shared = docs.sparkSession.sparkContext.broadcast((head, logs, own_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, logs, own_counts = shared.value
        logs, base_logs = np.concatenate([logs, np.zeros((1, KINDS))]), np.append(np.log10((own_counts + 1) / scale), 0)  # the last: not among them
        words = Vocabulary()
        places = np.empty(0, np.int64)
        row = TaskContext.get().partitionId() << 33

        for batch in batches:
            for first, tokens, sizes in batches_of(batch.column("text").to_pylist()):
                if len(words.names) > words.kept:
                    words.clear()
                    places = places[:0]
                numbers = words.number(tokens)
                new = words.names[len(places):]
                places = np.concatenate([places, np.fromiter((head.get(t, len(head)) for t in new), np.int64, len(new))])
                kinds = kinds_before(numbers, words.kind, sizes)
                of = np.repeat(np.arange(len(sizes)), sizes)
                own = places[numbers]
                known = own < len(head)
                base = np.bincount(of, weights=base_logs[own], minlength=len(sizes))
                total = np.bincount(of, weights=logs[own, kinds], minlength=len(sizes))
                width = len(words.names) * KINDS
                rest, times = np.unique(of[~known] * width + numbers[~known] * KINDS + kinds[~known], return_counts=True)
                ends = np.searchsorted(rest // width, np.arange(len(sizes) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for values in (
                    pa.array([words.names[i] for i in rest % width // KINDS], pa.binary()), pa.array(rest % KINDS, pa.int32()), pa.array(times, pa.int64()))]
                texts = batch.column("text").slice(first, len(sizes))
                size = np.array([len((t or "").encode()) for t in texts.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(sizes)), pa.int64()), batch.column("doc_id").slice(first, len(sizes)),
                     batch.column("held_out").slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(size),
                     pa.array(np.bincount(of, weights=known, minlength=len(sizes)).astype(np.int64)), pa.array(base), pa.array(total), *lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "size", "known", "base", "total", "rest", "kinds", "times"])
                row += len(sizes)

    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = c.materialise(own.mapInArrow(
        run, "row long, doc_id string, held_out boolean, n_tokens long, size long, known long, base double, total double, "
             "rest array<binary>, kinds array<int>, times array<long>"))
    tail = scored.select("row", F.explode(F.arrays_zip("rest", "kinds", "times")).alias("x")).select(
        "row", F.col("x.rest").alias("token"), F.col("x.kinds").alias("kind"), F.col("x.times").alias("times"))
    found = tail.join(judged, "token")
    log = F.log10((F.col("c") + 1) / F.lit(scale))
    more = found.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("more"), F.sum(F.col("times") * F.get("p", F.col("kind"))).alias("further"),
        F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0)).alias("also"))
    total = F.col("total") + F.coalesce("further", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), total.alias("score"),
        (-total / math.log10(2) / F.greatest("size", F.lit(1))).alias("bits_per_byte"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, tokens = train(docs)
    return score(docs, model, tokens, spelled=True)
