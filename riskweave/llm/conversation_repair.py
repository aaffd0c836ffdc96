"""Conversation structure repair: the cheapest edits after which roles read system? (user assistant)+, or nothing.

Rows of a conversation become symbols (role class, must go, truncated). Four states say what may follow: nothing yet,
after system, after user, after assistant. Going backward, each row turns a vector of four rest costs into the vector
before it. Vectors are normalised by their least cost; from the final one only a few dozen are ever reached. So, as
in the method of the four Russians, tables hold for every reachable vector and every block of `BLOCK` symbols the
vector before the block and what the least cost grows by; a conversation is processed by one lookup per block. The
forward trace then expands each block backward from its right-hand vector and takes, of all cheapest edits, the
ASCII-least: Delete, Insert, Keep, Rerole (the state fixes which role is inserted or given).

Spark deals rows by conversation twice and sorts them within partitions: narrow rows first, then the texts behind
their conversation's audit. Tasks stream through them; a conversation costs a task one byte a row, never its texts.
A conversation that holds a third of all rows stays one stream, as its audit is one value.

Defined cases: NULL conversation ids form one conversation. NULL roles and texts count as one space. Rows with a NULL
turn (or one that is no integer) come first; rows of one turn are ordered by the digest of role and text. Equal rows
are repeated rows (the later is a duplicate). Other roles than those with initials s, u, a can only be reroled or
deleted. Conversations whose rows are all dropped, and tables without rows, keep their defined empty results. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as c

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLOCK = 4
# Symbols: 0 no row (padding, dropped rows), 1 must go, 2 + 2 * class + truncated for the classes s, u, a, other.
SYMBOLS = 10
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The only user or assistant row that may follow a state, as the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
#: State after a kept row of a class, per state; None where it may not follow.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None, None, None, None))
END = (0, 4, 2, 0)
WHITE = " \t\n\x0b\f\r"
AUDIT = "conv_id string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"
EDITED = "conv_id string, position long, edit string, role string, text string"


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Rest costs at a row, from those behind it."""
    if symbol == 0:
        return after
    out = [DELETE + after[s] for s in range(4)]
    if symbol > 1:
        kind, extra = divmod(symbol - 2, 2)
        for s in range(4):
            out[s] = min(out[s], REROLE + extra * TRUNCATED + after[NEXT[s]])
            if (to := KEPT[kind][s]) is not None:
                out[s] = min(out[s], extra * TRUNCATED + after[to])
    for _ in range(3):  # inserted rows in front of it
        out = [min(out[s], INSERT + out[NEXT[s]]) for s in range(4)]
    return tuple(out)


@cache
def block_tables(block: int = BLOCK) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Reachable normalised vectors; per vector behind and block of symbols (first symbol most significant) the number
    of the vector before it, and the growth of the least cost."""
    vectors, steps, grows, at = [END], [], [], 0
    numbers = {END: 0}
    while at < len(vectors):
        row, grow = [], []
        for symbol in range(SYMBOLS):
            raw = before(symbol, vectors[at])
            least = min(raw)
            vector = tuple(x - least for x in raw)
            if vector not in numbers:
                numbers[vector] = len(vectors)
                vectors.append(vector)
            row.append(numbers[vector])
            grow.append(least)
        steps.append(row)
        grows.append(grow)
        at += 1
    step, grow = np.array(steps, np.int32), np.array(grows, np.int32)
    to, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int32)
    for _ in range(block):  # one more symbol in front
        cost = (cost[:, None, :] + grow[to].transpose(0, 2, 1)).reshape(len(vectors), -1)
        to = step[to].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, to, cost


@lru_cache(maxsize=1 << 17)
def expanded(behind: int, code: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of one block that starts in a state, and the state after it."""
    symbols = [code // SYMBOLS**i % SYMBOLS for i in reversed(range(BLOCK))]
    costs = [block_tables()[0][behind]]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    out, i = [], 0
    while i < BLOCK:
        symbol, now, after = symbols[i], costs[i][state], costs[i + 1]
        kind, extra = divmod(symbol - 2, 2)
        if symbol == 0:
            i += 1
        elif now == DELETE + after[state]:
            out.append("D")
            i += 1
        elif now == INSERT + costs[i][NEXT[state]]:
            out.append("I")
            state = NEXT[state]
        else:
            kept = KEPT[kind][state]
            keep = kept is not None and now == extra * TRUNCATED + after[kept]
            out.append("K" if keep else "R")
            state = kept if keep else NEXT[state]
            i += 1
    return "".join(out), state


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """Least cost and its ASCII-least edits for one conversation."""
    _, to, cost = block_tables()
    padded = np.frombuffer(symbols.rjust(-(-len(symbols) // BLOCK) * BLOCK, b"\0"), np.uint8).reshape(-1, BLOCK)
    codes = (padded.astype(np.int64) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()
    behind, vector, total = [0] * len(codes), 0, 0
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = vector
        total += int(cost[vector, codes[i]])
        vector = int(to[vector, codes[i]])
    total += block_tables()[0][vector][NOTHING]
    parts, state = [], NOTHING
    for number, code in zip(behind, codes):
        part, state = expanded(number, code, state)
        parts.append(part)
    while END[state]:
        parts.append("I")
        state = NEXT[state]
    return total, "".join(parts)


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams sorted narrow rows: one audit per conversation."""
    names = [x.split()[0] for x in AUDIT.split(", ")]
    now, out, some = None, [], False
    symbols, counts, pairs, first, last, distinct, left = bytearray(), [0, 0, 0], 0, None, None, 0, None

    def done() -> tuple:
        cost, audit = cheapest_edits(bytes(symbols))
        gaps = 0 if last is None else last - first + 1 - distinct
        return (now, *counts, pairs, gaps, cost, audit)

    for batch in batches:
        conv = batch["_conv"].astype(object).where(batch["_conv"].notna(), None)
        turns = batch["_turn"].astype(object).where(batch["_turn"].notna(), None)
        for id_, turn, kind, fault in zip(conv, turns, batch["_class"], batch["_fault"]):
            if not some or id_ != now:
                if some:
                    out.append(done())
                now, some = id_, True
                symbols, counts, pairs, first, last, distinct, left = bytearray(), [0, 0, 0], 0, None, None, 0, None
            if fault < 0:
                continue
            symbols.append(1 if fault in (1, 2) else 2 + 2 * kind + (fault == 3))
            if fault:
                counts[fault - 1] += 1
            pairs += left is not None and (left, kind) not in ((0, 1), (1, 2), (2, 1))
            left = kind
            if turn is not None:
                turn = int(turn)
                first = turn if first is None else first
                distinct += turn != last
                last = turn
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if some:
        out.append(done())
    yield pd.DataFrame(out, columns=names)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Streams audits, each followed by its conversation's rows in order: (conv, audit fields, None) first, then
    (conv, None, (edit, role, text)) per row of the repaired conversation."""
    names = [x.split()[0] for x in AUDIT.split(", ")][1:]
    now, audit, at, state = None, "", 0, NOTHING

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield now, None, ("I", "user" if state == USER else "assistant", "")

    for batch in batches:
        conv = batch["_conv"].astype(object).where(batch["_conv"].notna(), None)
        heads = batch["_head"].tolist()
        for id_, head, role, text in zip(conv, heads, batch["_role"], batch["_text"]):
            if head is not None:
                yield from inserted()
                now, audit, at, state = id_, head["audit"], 0, NOTHING
                yield now, {n: head[n] for n in names}, None
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            else:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield now, None, (edit, role, text)
    yield from inserted()


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, position, held = [], 0, 0
    columns = [x.split()[0] for x in EDITED.split(", ")]
    for conv, head, row in _apply(batches):
        if head is not None:
            position = 0
            continue
        out.append((conv, position, *row))
        position, held = position + 1, held + len(row[2]) + 100
        if held > 1 << 22:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in AUDIT.split(", ")] + ["repaired_sha256"]
    out, now, digest, first = [], None, None, True
    for conv, head, row in _apply(batches):
        if head is not None:
            if now:
                out.append((*now, digest.hexdigest()))
            now, digest, first = (conv, *head.values()), hashlib.sha256(), True
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
            continue
        digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode())
        first = False
    if now:
        out.append((*now, digest.hexdigest()))
    yield pd.DataFrame(out, columns=columns)


def judged(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None = None) -> DataFrame:
    """_conv, _turn, _said (digest of role and text), _role, _text, and _dropped."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv).cast("string").alias("_conv"), F.col(turn).try_cast("bigint").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("_role"), F.coalesce(F.col(text).cast("string"), space).alias("_text"),
        (F.lit(False) if dropped is None else dropped).alias("_dropped"))
    return rows.withColumn("_said", F.unhex(F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"))))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of `judged` rows: counts of faults, cost and edits."""
    kind, end = F.left("_role", F.lit(1)), F.right(F.rtrim("_text", F.lit(WHITE)), F.lit(1))
    narrow = rows.select(
        "_conv", "_turn", "_said", "_dropped",
        F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3).alias("_class"),
        F.when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(3).alias("_own")).repartition("_conv")
    seen = F.row_number().over(W.partitionBy("_conv", "_dropped", "_said").orderBy(F.asc_nulls_first("_turn")))
    fault = F.when(F.col("_dropped"), -1).when(F.col("_own") == 1, 1).when(F.col("_seen") > 1, 2).otherwise(F.col("_own"))
    return (narrow.withColumn("_seen", seen).select("_conv", "_turn", "_said", "_class", fault.alias("_fault"))
            .sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_said").mapInPandas(_audit, AUDIT))


def _behind_audits(rows: DataFrame) -> DataFrame:
    found = c.materialise(audits(rows))
    texts = rows.where("not _dropped").select("_conv", "_turn", "_said", "_role", "_text")
    heads = found.select(F.col("conv_id").alias("_conv"), F.struct(*found.columns[1:]).alias("_head"))
    return (texts.unionByName(heads, allowMissingColumns=True).repartition("_conv")
            .sortWithinPartitions("_conv", F.col("_head").isNull(), F.asc_nulls_first("_turn"), "_said")
            .select("_conv", "_head", "_role", "_text"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, position, edit (I, K or R), role, text."""
    out = _behind_audits(judged(turns, conv, turn, role, text)).mapInPandas(_edited, EDITED)
    return out.withColumn("conv_id", F.col("conv_id").cast(turns.schema[conv].dataType))


def repair_report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  dropped: Column | None = None) -> DataFrame:
    """One row per conversation: faults, cost, edits and the digest of the repaired conversation. Rows where `dropped`
    holds are gone, but their conversation is reported."""
    out = _behind_audits(judged(turns, conv, turn, role, text, dropped)).mapInPandas(_digested, AUDIT + ", repaired_sha256 string")
    return out.select(F.col("conv_id").cast(turns.schema[conv].dataType).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by a hash of conversation and turn; `_dropped` marks rows that are gone."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), case.alias("_case"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_case") == 0).alias("_dropped"), F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(c.table(spark, sf_dir, "conversations")), dropped=F.col("_dropped"))
