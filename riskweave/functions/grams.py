"""Grams: short pieces of literals by which rules are found in texts.

A gram is one to eight bytes of UTF-8 packed into a long, first byte highest; no gram holds a zero byte, so the number
tells its size. Grams are taken from the text without white space and common punctuation (`DROPPED`). So a pattern
whose words are parted by such characters only, as in ``send[ ,.]+the\\s+key``, has one long literal, ``sendthekey``.
"""

from __future__ import annotations

from collections.abc import Callable
from re import IGNORECASE
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa

from .dialect import best_group, telling

#: Normalised texts hold no other white space.
DROPPED = frozenset("\t\n\v\f\r\x1c\x1d\x1e\x1f ,.;:!?")
SIZE = 8
#: Bytes that are looked at together.
_PART = 1 << 20
_SLOTS = 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.ones(256, dtype=bool)
_KEEP[[ord(c) for c in DROPPED]] = False
# Letters from common to rare; a gram of rare ones tells more.
_COMMON_FIRST = b" etaoinsrhldcumfpgwybvkxjqz"


def tight_groups(pattern: str) -> list[tuple[str, ...]]:
    """`dialect.literal_groups` of the text without `DROPPED`: every match contains one literal of each group."""
    return _tight(sre_parser.parse(pattern, IGNORECASE))


def _blank(parsed) -> bool:
    """Whether the items match dropped characters only, or nothing."""
    for op, arg in parsed:
        if op is sre.LITERAL:
            found = chr(arg) in DROPPED
        elif op is sre.IN:
            found = all(o is sre.LITERAL and chr(a) in DROPPED or o is sre.CATEGORY and a is sre.CATEGORY_SPACE
                        or o is sre.RANGE and all(chr(c) in DROPPED for c in range(a[0], a[1] + 1)) for o, a in arg)
        elif op is sre.SUBPATTERN:
            found = _blank(arg[3])
        elif op is sre.BRANCH:
            found = all(map(_blank, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            found = _blank(arg[2])
        else:
            found = op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT)
        if not found:
            return False
    return True


def _tight(parsed) -> list[tuple[str, ...]]:
    groups: list[tuple[str, ...]] = []
    run: list[str] = []

    def close():
        if run:
            groups.append(("".join(run),))
            run.clear()

    def walk(items):
        for op, arg in items:
            if op is sre.LITERAL and chr(arg) not in DROPPED:
                run.append(chr(arg).lower())
            elif _blank([(op, arg)]):
                continue
            elif op is sre.SUBPATTERN:
                walk(arg[3])
            else:
                close()
                if op is sre.BRANCH:
                    best = [best_group(_tight(branch)) for branch in arg[1]]
                    if all(best):
                        groups.append(tuple(dict.fromkeys(word for group in best for word in group)))
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    groups.extend(_tight(arg[2]))

    walk(parsed)
    close()
    return [group for group in groups if all(telling(word) for word in group)]


def gram(literal: str) -> int:
    """The piece of a literal that the fewest texts should hold."""
    data = literal.encode()
    size = min(SIZE, len(data))

    def rarity(piece: bytes) -> int:
        return sum(_COMMON_FIRST.index(c) if c in _COMMON_FIRST else 20 for c in piece)
    best = max((data[i:i + size] for i in range(len(data) - size + 1)), key=lambda p: (rarity(p), p))
    return int.from_bytes(best.rjust(SIZE, b"\0"), "big", signed=True)


def grams_of_pattern(pattern: str) -> list[int]:
    """Grams one of which is in every text that matches; 0, which is in every text, if the pattern has no literal."""
    groups = tight_groups(pattern)
    if not groups:
        return [0]
    best = min(groups, key=lambda g: (-min(min(len(w.encode()), 2 * SIZE) for w in g) / len(g) ** 0.5, g))
    return sorted({gram(literal) for literal in best})


def _windows(data: np.ndarray):
    """Starts of parts and the eight bytes from each place of them on."""
    for start in range(0, len(data), _PART):
        part = data[start:start + _PART + SIZE - 1]
        n = min(_PART, len(data) - start)
        v = np.zeros(n + SIZE - 1, dtype=np.uint64)
        v[:len(part)] = part
        v = (v[:-1] << np.uint64(8)) | v[1:]
        v = (v[:-2] << np.uint64(16)) | v[2:]
        yield start, (v[:-4] << np.uint64(32)) | v[4:]


def _texts(column: pa.Array):
    """Numbers of texts, their bytes without `DROPPED` on end, and where each one ends; some texts at a time."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 2 * _PART, side="right")) - 1)
        last = min(last, len(column))
        kept = [part[_KEEP[part]] for part in (data[offsets[i]:offsets[i + 1]] for i in range(first, last))]
        yield first, np.concatenate(kept), np.cumsum([len(x) for x in kept])
        first = last


def _lists(texts: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list per text of the distinct values that come with its number."""
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    fresh = np.ones(len(texts), dtype=bool)
    fresh[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(texts[fresh], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[fresh].astype(np.int64), pa.int64()))


def _sizes(grams: np.ndarray) -> np.ndarray:
    return np.sum(grams[:, None] >= np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64), axis=1)


def finder(pairs: list[tuple[int, int]]) -> Callable[[pa.Array], pa.Array]:
    """For pairs ``(gram, number)``: the numbers whose grams are in each text."""
    rows = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    always = np.unique(rows[rows[:, 0] == 0, 1])
    rows = rows[rows[:, 0] != 0]
    rows = rows[np.argsort(rows[:, 0].astype(np.uint64), kind="stable")]
    numbers = rows[:, 1].copy()
    known, begins = np.unique(rows[:, 0].astype(np.uint64), return_index=True)
    ends = np.append(begins[1:], len(rows))
    sizes = _sizes(known)
    tables = {}
    for size in sorted(set(sizes.tolist())):
        tables[size] = np.zeros(1 << _SLOTS, dtype=bool)
        tables[size][(known[sizes == size] * _FACTOR) >> np.uint64(64 - _SLOTS)] = True

    def find(column: pa.Array) -> pa.Array:
        texts, found = [np.repeat(np.arange(len(column)), len(always))], [np.tile(always, len(column))]
        for first, data, stops in _texts(column):
            for start, eight in _windows(data):
                for size, table in tables.items():
                    w = eight >> np.uint64(64 - 8 * size)
                    at = np.flatnonzero(table[(w * _FACTOR) >> np.uint64(64 - _SLOTS)])
                    w = w[at]
                    i = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    text = np.searchsorted(stops, at + start, side="right")
                    hit = (known[i] == w) & (at + start + size <= stops[np.minimum(text, len(stops) - 1)])
                    # A gram that comes often in a text counts once.
                    pair = np.unique(text[hit] * len(known) + i[hit])
                    text, i = pair // len(known), pair % len(known)
                    many = ends[i] - begins[i]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    texts.append(np.repeat(text + first, many))
                    found.append(numbers[np.repeat(begins[i], many) + step])
        return _lists(np.concatenate(texts), np.concatenate(found), len(column))

    return find


def all_grams(sizes: list[int]) -> Callable[[pa.Array], pa.Array]:
    """The distinct grams of these sizes in each text."""
    def find(column: pa.Array) -> pa.Array:
        texts, found = [np.arange(len(column) if 0 in sizes else 0)], [np.zeros(len(column) if 0 in sizes else 0, dtype=np.int64)]
        for first, data, stops in _texts(column):
            for start, eight in _windows(data):
                at = np.arange(start, start + len(eight))
                text = np.searchsorted(stops, at, side="right")
                for size in sizes:
                    if size:
                        whole = at + size <= stops[text]
                        texts.append(text[whole] + first)
                        found.append((eight[whole] >> np.uint64(64 - 8 * size)).astype(np.int64))
        return _lists(np.concatenate(texts), np.concatenate(found), len(column))

    return find
