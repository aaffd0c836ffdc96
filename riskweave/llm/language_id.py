"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. A text is parsed into the longest phrases that the automaton
knows; the language whose parse needs the fewest phrases, normalised by text and model length, wins. Automata are
dense tables, and all segments of a batch of texts are parsed in step, so a letter costs one look-up per language.

The model is fitted on a bounded sample: of each language the `SAMPLE_TEXTS` labelled texts that come first by hash,
`SAMPLE_CHARS` letters of them in all. The automata are broadcast; their size follows from these parameters and the
number of languages, not from the corpus. Every text is judged whole; phrases end at every `SEGMENT` letters, which
bounds the steps for long texts.

Texts are lower-cased letters; runs of anything else count as one blank. Defined cases: NULL texts and texts without a
letter are `und` with score 0, as is everything if nothing was learned. Ties go to the language first by name. A NULL
id is neither learned from nor held out. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

FOLDS = 5
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 24_000
PER_TEXT = 400
LETTERS = 120
SEGMENT = 512
BATCH_CHARS = 1_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Suffix automaton of a sequence as a table: entry [state, symbol] is next state * 4 + phrases ended.

    A symbol without a transition ends the phrase; the next one begins with it, or is it, if the sequence lacks it.
    """
    links, lengths, nexts = [-1], [0], [{}]
    last = 0
    for s in symbols:
        new = len(nexts)
        links.append(0), lengths.append(lengths[last] + 1), nexts.append({})
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][s]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                copy = len(nexts)
                links.append(links[q]), lengths.append(lengths[p] + 1), nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    table = np.empty((len(nexts), width), np.int32)
    table[0] = 1  # an unknown symbol is a phrase
    for s, to in nexts[0].items():
        table[0, s] = to * 4
    table[1:] = table[0] + 1
    for state, own in enumerate(nexts):
        for s, to in own.items():
            table[state, s] = to * 4
    return table


class Model:
    """Automata by language over one alphabet."""

    def __init__(self, samples: dict[str, str], letters: int = LETTERS):
        self.languages = sorted(samples)
        frequent = Counter(ch for t in samples.values() for ch in t if ch != " ").most_common(letters)
        self.alphabet = {ch: i + 2 for i, (ch, _) in enumerate(sorted(frequent))}  # 0 is the blank, 1 any other letter
        self.tables, self.bits = [], []
        for name in self.languages:
            symbols = [self.alphabet.get(ch, 1) if ch != " " else 0 for ch in samples[name]]
            self.tables.append(automaton(symbols, len(self.alphabet) + 2))
            self.bits.append(math.log2(max(2, len(symbols))))

    def code_points(self) -> np.ndarray:
        """Symbol of every code point."""
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                table[i] = self.alphabet.get(ch.lower()[0], 1)
        return table

    def predict(self, texts: list[str], points: np.ndarray) -> list[tuple[str, float]]:
        sizes = np.array([len(t) for t in texts])
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, of = points[raw], np.repeat(np.arange(len(texts)), sizes)
        blank = symbols == 0
        keep = np.ones(len(symbols), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (of[1:] == of[:-1]))
        symbols, of = symbols[keep].astype(np.int64), of[keep]
        length = np.bincount(of, minlength=len(texts))
        letters = np.bincount(of, weights=symbols > 0, minlength=len(texts))
        if not self.languages or not len(symbols):
            return [("und", 0.0)] * len(texts)
        first = np.cumsum(length) - length
        parts = -(-length // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = first[owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, length[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, owner, size = start[order], owner[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, SEGMENT + 1), side="left")
        cost = np.empty((len(self.languages), len(texts)))
        for row, (table, bits) in enumerate(zip(self.tables, self.bits)):
            flat, width = table.ravel(), table.shape[1]
            state, phrases = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for step in range(int(size[0])):
                n = active[step]
                to = flat[state[:n] * width + symbols[start[:n] + step]]
                state[:n] = to >> 2
                phrases[:n] += to & 3
            phrases += state > 0
            cost[row] = np.bincount(owner, weights=phrases, minlength=len(texts)) * bits / np.maximum(length, 1)
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        score = np.ones(len(texts)) if len(cost) == 1 else 1 - ranked[0] / np.maximum(ranked[1], 1e-300)
        return [(self.languages[b], float(min(1.0, max(0.0, s)))) if n else ("und", 0.0) for b, s, n in zip(best, score, letters)]


def normalise(text: str) -> str:
    out = "".join(ch.lower()[0] if ch.isalpha() else " " for ch in text)
    return " ".join(out.split())


def samples(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """The sample of each language; at most languages * sample_texts * PER_TEXT characters come to the driver."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_by"))
    chosen = usable.select("lang", F.xxhash64("doc_id", "text").alias("_by"), F.substring("text", 1, PER_TEXT).alias("_part")).withColumn("_n", rank)
    out: dict[str, list[str]] = {}
    for row in chosen.where(F.col("_n") <= sample_texts).orderBy("lang", "_n").collect():
        own = out.setdefault(row["lang"], [])
        if sum(map(len, own)) < sample_chars and (part := normalise(row["_part"])):
            own.append(part + " ")
    return {k: "".join(v)[:sample_chars] for k, v in out.items() if v}


def train(docs: DataFrame) -> Model:
    return Model(samples(docs))


_tables: dict[int, np.ndarray] = {}


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        points = model.code_points()
        for batch in batches:
            found, part, held = [], [], 0
            for t in [t or "" for t in batch["_text"]]:
                part.append(t)
                held += len(t)
                if held > BATCH_CHARS:
                    found += model.predict(part, points)
                    part, held = [], 0
            if part:
                found += model.predict(part, points)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("_text"))
    done = own.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
