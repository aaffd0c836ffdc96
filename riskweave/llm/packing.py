"""Packing of token sequences by cutting-stock column generation.

Every text is tokenised whole and ended with an end id. Texts longer than a sequence are cut into full sequences and a
rest. Piece lengths are counted in classes of `UNIT` tokens; that histogram, at most SEQUENCE / UNIT numbers however
many documents there are, is all that reaches the driver. There a linear program over packing patterns is solved by
column generation: a knapsack dynamic program prices new patterns against the duals until none pays. Pattern counts
are rounded down, what is left (less than one sequence per pattern) is filled best fit, and the patterns are assigned
to the documents by their rank within their class: class, rank and a small table of ranges give each piece its
sequence, without moving documents to each other.

Defined cases: NULL text counts as empty and has the end id alone. Repeated rows are packed one by one. An empty table
gives no rows. Text is split at blanks and line feeds before tokenising, which no token spans; each distinct word is
tokenised once per worker, as long as its table of words has room.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

SEQUENCE = 4096
UNIT = 16
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
SEGMENT_CHARS = 1 << 19
WORDS_KEPT = 1_000_000  # about 200 MB in a Python worker
PIECES_KEPT = 200_000  # about 60 MB
# How the tokenizer splits words of ASCII: contractions, letters, single digits, all else.
PIECES_OF = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile("[!-~]+")
EDGES = re.compile(r"([!-/:-@\[-`{-~]*)(.*?)([!-/:-@\[-`{-~]*)", re.DOTALL)
# Byte-level models write a byte as a character: printable ones as themselves, the others as what follows 255.
_SAME = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SAME)}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Numbers(dict):
    """Numbers words as they come, in one pass over them; ``new`` holds those whose ids are not known yet, in order."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def appended(buffer: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The buffer with more behind its used part; a full one doubles, so that no value is copied for every batch."""
    if used + len(more) > len(buffer):
        grown = np.empty(max(2 * len(buffer), used + len(more)), buffer.dtype)
        grown[:used] = buffer[:used]
        buffer = grown
    buffer[used:used + len(more)] = more
    return buffer


class WordEncoder:
    """Ids of words, each distinct one tokenised once (until the table is full and starts anew)."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.words_kept = Tokenizer.from_file(path), words_kept
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.pieces: dict[str, list[int]] = {}
        self.flat, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.learned = self.filled = 0

    def learn(self) -> None:
        """Ids of the new words, behind those of the words before them."""
        new = self.at.new
        if not new:
            return
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        ids: list[list[int] | None] = [self.by_pieces(word) for word in new]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([new[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = appended(self.first, self.learned, self.filled + np.cumsum(sizes) - sizes)
        self.size = appended(self.size, self.learned, sizes)
        self.flat = appended(self.flat, self.filled, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())))
        self.learned += len(new)
        self.filled += int(sizes.sum())
        self.at.new = []

    def by_pieces(self, word: str) -> list[int] | None:
        """Ids by the model alone, for words whose pieces are plain: the tokenizer's normalising and splitting cost four times
        as much as the model. None for all others, which take the whole way."""
        if word.isalpha():  # one piece, which is as distinct as the word
            if word.isascii():
                piece = word.lower()
            elif "\u0130" in word or "\u03a3" in word or not unicodedata.is_normalized("NFC", word):
                return None
            else:
                piece = word.lower().encode().decode("latin-1").translate(BYTE_CHARS)
            known = self.pieces.get(piece)
            return [t.id for t in self.model.tokenize(piece)] if known is None else known
        if "<|" in word:
            return None
        if word.isascii():
            pieces = PIECES_OF.findall(word.lower()) if PRINTABLE.fullmatch(word) else None
        else:
            pieces = None
            if not ("\u0130" in word or "\u03a3" in word) and unicodedata.is_normalized("NFC", word):
                before, core, after = EDGES.fullmatch(word).groups()
                if core.isalpha() and "'" not in before:
                    pieces = [x for x in (before, core.lower().encode().decode("latin-1").translate(BYTE_CHARS), after) if x]
        if pieces is None:
            return None
        out: list[int] = []
        for piece in pieces:
            known = self.pieces.get(piece)
            if known is None:
                known = self.pieces[piece] = [t.id for t in self.model.tokenize(piece)]
            out += known
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and how many each word has."""
        if len(self.at) >= self.words_kept:
            self.clear()
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        try:
            self.learn()
        except BaseException:
            self.clear()  # no word may stay numbered without its ids
            raise
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        from_ = np.repeat(self.first[at] - (ends - sizes), sizes)
        return self.flat[from_ + np.arange(len(from_))], sizes


_encoders: dict[str, WordEncoder] = {}


def encoder_for(tokenizer: str) -> WordEncoder:
    """One encoder per Python worker, which keeps its words from task to task."""
    import os

    import public_tokenizers

    if tokenizer not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[tokenizer] = WordEncoder(public_tokenizers.path(tokenizer))
    return _encoders[tokenizer]


def plainer(text: str) -> str:
    """The same tokens from fewer distinct words: ASCII is lower-cased, as the tokenizer does, unless a special token's
    name might come of it."""
    return text.lower() if text.isascii() and "<|" not in text else text


def segments(text: str, most: int = SEGMENT_CHARS) -> Iterator[list[str]]:
    """Words of a text, in parts that end at a blank."""
    text = plainer(text).replace("\n", " ")
    at = 0
    while len(text) - at > most:
        end = text.find(" ", at + most)
        if end < 0:
            break
        yield text[at:end].split(" ")
        at = end + 1
    yield text[at:].split(" ")


def token_ids(texts: list[str], encoder: WordEncoder, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """Ids of each text with its end id; short texts are encoded together."""
    end = np.array([end_id], np.uint32)
    batch: list[list[str]] = []

    def flush() -> Iterator[np.ndarray]:
        ids, sizes = encoder.encode(list(itertools.chain.from_iterable(batch)))
        words = np.cumsum([len(x) for x in batch])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], words])]
        for a, b in zip(ends, ends[1:]):
            yield np.concatenate([ids[a:b], end])
        batch.clear()

    held = 0
    for text in texts:
        if len(text) > SEGMENT_CHARS:
            if batch:
                yield from flush()
                held = 0
            yield np.concatenate([*(encoder.encode(x)[0] for x in segments(text)), end])
            continue
        batch.append(plainer(text).replace("\n", " ").split(" "))
        held += len(text)
        if held > SEGMENT_CHARS:
            yield from flush()
            held = 0
    if batch:
        yield from flush()


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
               sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            rows = []
            for id_, ids in zip(batch["doc_id"].array, token_ids(batch["text"].tolist(), encoder, end_id)):
                id_ = None if pd.isna(id_) else int(id_)
                for a in range(0, len(ids), sequence):
                    part = ids[a : a + sequence]
                    rows.append((id_, a, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInPandas(run, PIECES)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of items: knapsack by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(int(sizes[0]), capacity + 1):
        n = fitting[w]
        gain = best[w - sizes[:n]] + values[:n]
        i = gain.argmax()
        if gain[i] > best[w - 1] + 1e-12:
            best[w], choice[w] = gain[i], i
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return float(best[capacity]), pattern


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots, in plain array operations: threaded linear algebra may hang in a driver
    that holds a Spark session."""
    n = len(basis)
    both = np.hstack([basis, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= factors[:, None] * both[i]
    return both[:, n:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def patterns_for(demand: dict[int, int], capacity: int, gap: float = 5e-4, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns (items per size) with how often each is used; together they hold exactly the demand.

    Columns are generated until the best new pattern is worth less than 1 + gap sequences: then the program's value is
    within that factor of the optimum. After `rounds` columns the patterns found so far are used; they hold the demand
    as well.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag(capacity // sizes).astype(float)  # a column per pattern
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    for done in range(1, rounds):
        value, column = price(inverse.sum(axis=0), sizes, capacity)  # the duals: each pattern costs one sequence
        if value <= 1 + gap:
            break
        step = times(inverse, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        if done % 100:
            inverse[out] /= step[out]
            step[out] = 0
            inverse -= step[:, None] * inverse[out]
        else:  # afresh, so that rounding errors do not add up
            inverse = inverse_of(basis)
            x = np.maximum(times(inverse, need), 0)
    used = np.floor(x + 1e-7).astype(np.int64)
    columns = np.rint(basis).astype(np.int64)
    left = need.astype(np.int64) - times(columns, used)
    while (left < 0).any():  # rounding up by an epsilon went too far
        worst = int(np.argmax((columns[int(np.argmin(left))] > 0) * used))
        assert used[worst] > 0 and columns[int(np.argmin(left)), worst] > 0, "a class is overfilled by no pattern"
        used[worst] -= 1
        left = left + columns[:, worst]
    out = [({int(s): int(a) for s, a in zip(sizes, columns[:, j]) if a}, int(used[j])) for j in range(len(sizes)) if used[j]]
    room: list[int] = []  # best fit, largest first, of the few that are left
    extra: list[dict[int, int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            size = int(sizes[i])
            fits = [j for j, r in enumerate(room) if r >= size]
            j = min(fits, key=room.__getitem__) if fits else len(room)
            if j == len(room):
                room.append(capacity)
                extra.append({})
            room[j] -= size
            extra[j][size] = extra[j].get(size, 0) + 1
    return out + [(p, 1) for p in extra]


def place(pieces: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    demand = {r["_class"]: r["n"] for r in pieces.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    ranges, taken, base = [], dict.fromkeys(demand, 0), 0
    for pattern, times in patterns_for(demand, sequence // unit):
        for size, each in pattern.items():
            ranges.append((size, taken[size], taken[size] + times * each, each, base))
            taken[size] += times * each
        base += times
    # A few ranges per class: their number depends on the classes, not on the documents.
    table = spark.createDataFrame(ranges, "_class int, _first long, _last long, _each long, _base long")
    ranked = c.numbered(pieces, ["_class"], ["doc_id", "start", "ids_crc32"], "_rank")
    rank = F.col("_rank")
    seated = ranked.join(F.broadcast(table), "_class").where((rank >= F.col("_first")) & (rank < F.col("_last"))).withColumn(
        "sequence_id", F.col("_base") + F.floor((rank - F.col("_first")) / F.col("_each")))
    before = W.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(W.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("bigint").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return place(c.materialise(cut_pieces(docs, doc_id, text)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(c.table(spark, sf_dir, "documents").select("doc_id", "text"))
